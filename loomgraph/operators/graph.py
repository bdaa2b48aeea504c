"""Graph construction and per-node operators on (src, dst) frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.ranks import placed, placed_in_groups
from loomgraph.operators.sizes import dealt
from loomgraph.store import cut


def symmetrize(edges: DataFrame) -> DataFrame:
    """All edges and their reverses; repeats stay. What makes the edges runs once."""
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.inline(F.array(F.struct("src", "dst"), back)))


def dedupe(edges: DataFrame, rows: int = 0) -> DataFrame:
    """Distinct arcs without self-loops; ``rows`` is how many edges there are, about, if that is known."""
    return dealt(edges.where("src <> dst").select("src", "dst"), rows, "src", "dst").distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct node ids of both ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``; repeats stay."""
    ids = nodes.select(F.col("id"))
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def out_degrees(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    n = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("double").alias("degree"))


def adjacency(arcs: DataFrame, rows: int = 0) -> DataFrame:
    """(id, neighbors): out-neighbours in ascending order. A node's list is one row; ``adjacency_blocks`` is for graphs with hubs."""
    return dealt(arcs, rows, "src").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


#: Neighbours of a block.
BLOCK = 4096


def adjacency_blocks(arcs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(id, block, blocks, neighbors): ascending out-neighbours in blocks of ``size``, the last one shorter.

    blocks is how many the node has. No row holds more than ``size``
    neighbours and no task all arcs of a hub: places in the lists are prefix
    sums over ranges of (src, dst).
    """
    at, _ = placed_in_groups(arcs.select("src", "dst"), "src", "dst")
    whole = at.groupBy(F.col("src").alias("id"), F.floor(F.col("pos") / size).cast("int").alias("block"))
    return whole.agg(F.ceil(F.first("members") / size).cast("int").alias("blocks"), F.sort_array(F.collect_list("dst")).alias("neighbors"))


def local_rank(arcs: DataFrame) -> DataFrame:
    """(src, dst, pos): place of each arc in its node's list, from 0."""
    return placed_in_groups(arcs.select("src", "dst"), "src", "dst")[0].select("src", "dst", F.col("pos").cast("int").alias("pos"))


def dense_index(nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """(id, idx): rank of each id from 0, without a global window."""
    return placed(nodes.select("id"), [F.col("id")], "idx", buckets)[0]


def csr_offsets(nodes: DataFrame, arcs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(id, begin, end): running sums of out-degrees in id order."""
    deg = out_degrees(nodes, arcs).select("id", F.col("degree").cast("long").alias("n"))
    return _running(deg, "begin", buckets).select("id", "begin", (F.col("begin") + F.col("n")).alias("end"))


def _running(rows: DataFrame, name: str, buckets: int | None) -> DataFrame:
    """Exclusive prefix sum of n over ascending id."""
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, "id").withColumn("p", F.spark_partition_id()), "ranges")
    inside = F.sum("n").over(Window.partitionBy("p").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    total = placed.groupBy("p").agg(F.sum("n").alias("t"))
    before = F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    base = total.select("p", F.coalesce(before, F.lit(0)).alias("base"))
    out = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(base), "p")
    return out.select("id", (F.col("inside") + F.col("base")).alias(name), "n")


def chunk_size(n: int, parts: int) -> int:
    """Nodes of a contiguous chunk: n over min(max(1, parts), n), rounded up."""
    return -(-n // min(max(1, parts), n)) if n else 1


def node_chunks(nodes: DataFrame, parts: int) -> DataFrame:
    """(id, chunk): contiguous chunks in id order; there may be fewer than ``parts``."""
    size = chunk_size(nodes.count(), parts)
    return dense_index(nodes).select("id", F.floor(F.col("idx") / size).cast("int").alias("chunk"))


def shuffled_chunks(nodes: DataFrame, parts: int, seed: int) -> DataFrame:
    """(id, chunk): chunks of a seeded permutation, by the order of md5(seed:id)."""
    size = chunk_size(nodes.count(), parts)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    ranked = dense_index(nodes.select(F.struct(key.alias("key"), F.col("id").alias("node")).alias("id")))
    return ranked.select(F.col("id.node").alias("id"), F.floor(F.col("idx") / size).cast("int").alias("chunk"))
