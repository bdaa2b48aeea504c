"""Arcs indexed twice, in buckets that label propagation joins without moving an arc.

Nodes and blocks of arcs are dealt to *homes*, of which each partition holds
some. ``blocks`` has the arcs by their source: a node's out-neighbours are one
block at its home, and the blocks of a hub are spread over many homes.
``mirrors`` has them by their target: for each node, the homes where it is
somebody's neighbour, and ``lists`` holds them as lists of nodes, one for each
pair of homes. So a round sends a label once to each home that needs it, by
``mirrors``, or the labels of a whole list without their ids, and counts votes
where the arcs lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import BLOCK
from loomgraph.operators.skew import join_keyed
from loomgraph.store import bucketed, cut, drop, open_bucketed

#: Arcs of a bucket, about.
BUCKET_ARCS = 1 << 20
#: Homes of a bucket, so that buckets come out even.
HOMES = 4
#: Fixed value: stores of other layouts are not opened.
LAYOUT = 2

_BLOCKS = "home bigint, src bigint, cut boolean, dsts array<bigint>, dsts_at array<int>"
_LISTS = "home bigint, at bigint, ids array<bigint>"


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """While it lasts, a join by (home, id) is planned on partitions by home alone; plans have to run inside."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class ArcStore:
    """``blocks(home, src, cut, dsts, dsts_at)`` and ``lists(home, at, ids)``, both in ``buckets`` buckets by home.

    cut: the node has more than one block. home in ``lists`` is the nodes'
    own one, ``at`` one where they are neighbours; ids ascend. dsts_at: places
    of the neighbours in the lists that come to a home, laid end to end by the
    homes they come from.
    """

    blocks: DataFrame
    lists: DataFrame
    homes: int
    buckets: int
    hubs: int

    @classmethod
    def build(cls, arcs: DataFrame, block: int = BLOCK, path: str | None = None) -> ArcStore:
        """Groups the arcs into blocks, a hub's of about ``block`` neighbours; at ``path`` if it is given, to be opened again."""
        spark = arcs.sparkSession
        arcs = cut(arcs.select("src", "dst"), "arcs")
        degree = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        total, hubs = degree.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > block)).first()
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ARCS))
        homes = HOMES * n
        rows, home, salt = arcs.select("src", "dst"), home_of("src", homes), F.lit(-1)
        if hubs:
            found = cut(degree.where(F.col("n") > block).withColumns({"size": F.col("n"), "salts": F.ceil(F.col("n") / block)}).drop("n"), "hubs")
            rows, salt = join_keyed(arcs, found, ["src"], "size", total), F.coalesce(F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int"), salt)
            home = F.when(F.col("salt") < 0, home_of("src", homes)).otherwise(F.pmod(F.xxhash64("src", "salt"), F.lit(homes)))
            rows, salt = rows.withColumn("salt", salt).select("src", "dst", "salt"), F.col("salt")
        # one shuffle of arcs, by home: the blocks are made where the buckets are written; homes follow from the ids, so they are not shuffled
        rows = rows.repartition(n, home).select(home.alias("home"), "src", "dst", salt.alias("salt"), home_of("dst", homes).cast("int").alias("sender"))
        made = rows.groupBy("home").applyInArrow(_blocks_of, _BLOCKS)
        blocks = bucketed(made, "home", n, ["home", "cut", "src"], path and f"{path}/blocks", placed=True)
        senders = F.transform("dsts", lambda x: F.pmod(F.xxhash64(x), F.lit(homes)))
        lists = blocks.select("home", "dsts", "dsts_at", senders.alias("senders")).groupBy("home").applyInArrow(_lists_of, _LISTS)
        lists = bucketed(lists, "home", n, ["home", "at"], path and f"{path}/lists")
        drop(arcs)
        return cls(blocks, lists, homes, n, hubs)

    @classmethod
    def open(cls, spark: SparkSession, path: str, homes: int, buckets: int, hubs: int, layout: int = LAYOUT) -> ArcStore:
        """The store that ``build`` has written at ``path``."""
        if layout != LAYOUT:
            raise ValueError(f"an arc store of layout {layout}, not {LAYOUT}")
        blocks = open_bucketed(spark, f"{path}/blocks", _BLOCKS, "home", buckets, ["home", "cut", "src"])
        return cls(blocks, open_bucketed(spark, f"{path}/lists", _LISTS, "home", buckets, ["home", "at"]), homes, buckets, hubs)

    def sizes(self) -> dict[str, int]:
        """What ``open`` needs to know besides the path."""
        return {"homes": self.homes, "buckets": self.buckets, "hubs": self.hubs, "layout": LAYOUT}

    @property
    def mirrors(self) -> DataFrame:
        """(home, id, at): each node with the homes where it is a neighbour."""
        return self.lists.select("home", F.explode("ids").alias("id"), "at")

    def ends(self, directed: bool = True) -> DataFrame:
        """(home, id) of all nodes that have an arc; in a graph that is not directed each is the source of one."""
        whole = self.blocks.where("not cut").select("home", F.col("src").alias("id"))
        hubs = self.blocks.where("cut").select(self.home("src"), F.col("src").alias("id"))
        if directed:
            return whole.unionAll(hubs).unionAll(self.mirrors.select("home", "id")).distinct()
        return whole.unionAll(hubs.distinct()) if self.hubs else whole

    def home(self, column: str) -> Column:
        return home_of(column, self.homes).alias("home")

    def deliver(self, rows: DataFrame) -> DataFrame:
        """``rows`` (home, id, ...) of nodes, as (home, dst, ...) at every home where the node is a neighbour."""
        rest = [c for c in rows.columns if c not in ("home", "id")]
        return rows.join(self.mirrors, ["home", "id"]).select(F.col("at").alias("home"), F.col("id").alias("dst"), *rest)

    def close(self) -> None:
        """Removes the files below the shared folder; a store at a path of its own stays."""
        for table in (self.blocks, self.lists):
            drop(table)


def home_of(column: str, homes: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(homes))


def arcs_of(blocks: DataFrame) -> DataFrame:
    """(home, src, cut, dst), each arc where its block lies."""
    return blocks.select("home", "src", "cut", F.explode("dsts").alias("dst"))


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in sorted_], axis=0)]))


def _listed(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _blocks_of(arcs: pa.Table) -> pa.Table:
    """The blocks of one home from its arcs (src, dst, salt, home, sender); the sender is the neighbour's home."""
    src, dst, salt, sender = (arcs.column(c).to_numpy() for c in ("src", "dst", "salt", "sender"))
    ids, first, spot = np.unique(dst, return_index=True, return_inverse=True)
    place = np.empty(len(ids), np.int32)
    place[np.lexsort((ids, sender[first]))] = np.arange(len(ids), dtype=np.int32)
    by = np.lexsort((dst, salt, src))
    src, salt = src[by], salt[by]
    starts = _starts(src, salt)
    home = pa.array(np.full(len(starts), arcs.column("home")[0].as_py()))
    lists = _listed(dst[by], starts, pa.int64()), _listed(place[spot[by]], starts, pa.int32())
    return pa.Table.from_arrays([home, pa.array(src[starts]), pa.array(salt[starts] >= 0), *lists], ["home", "src", "cut", "dsts", "dsts_at"])


def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, end to end, and the lists' lengths."""
    whole = lists.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(), whole.value_lengths().to_numpy(zero_copy_only=False)


def _lists_of(blocks: pa.Table) -> pa.Table:
    """The lists that come to one home, from its blocks and the homes of their neighbours (senders)."""
    at = flat(blocks.column("dsts_at"))[0]
    ids, senders = (np.empty(at.max() + 1, np.int64) for _ in range(2))
    ids[at], senders[at] = flat(blocks.column("dsts"))[0], flat(blocks.column("senders"))[0]
    starts = _starts(senders)
    home = pa.array(np.full(len(starts), blocks.column("home")[0].as_py()))
    return pa.Table.from_arrays([pa.array(senders[starts]), home, _listed(ids, starts, pa.int64())], ["home", "at", "ids"])
