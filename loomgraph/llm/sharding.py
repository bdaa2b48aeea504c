"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import column, packed
from loomgraph.store import cut

ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds partition number, rows before and bytes before, counted in this partition."""
    pid, rows, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = np.asarray(b.column(b.schema.get_field_index("size")))
        before = total + np.cumsum(size) - size
        n = b.num_rows
        extra = [np.full(n, pid, np.int32), rows + np.arange(n, dtype=np.int64), before.astype(np.int64)]
        rows, total = rows + n, total + int(size.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, extra)], names=[*b.schema.names, "pid", "rows", "bytes"])


def stored_order(docs: DataFrame) -> list[Column] | None:
    """Columns that give the order in which ``docs`` lies in its files; None if it isn't read from files."""
    try:
        order = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
        docs.select(order)
    except AnalysisException:
        return None
    return order


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 8,
    text_col: str = "text",
    id_col: str = "doc_id",
    partitions: int | None = None,
    carry: list[str] | None = None,
    order: list[Column] | None = None,
) -> DataFrame:
    """All rows of ``docs`` with the columns ``carry`` (default: all), size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus one (null: one). Rows are put in
    one global order: ``order``, or the MD5 of the text and the id, by which
    equal texts are neighbours. Each range partition counts its rows and
    bytes, the prefix sums of those totals give every row its global offset,
    and the order is cut where the middle of a row passes a multiple of
    total/shards: contiguous shards of near equal bytes, whatever repeats. The
    slot counts the rows of a shard from 0 without gaps.

    Null texts count as empty and null ids sort first; a text longer than a
    shard's target is a shard of its own and may leave others empty; repeated
    rows are rows of their own, in any order among them; an empty table gives
    no rows; columns of ``docs`` named like those added are replaced.
    """
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED]
    text = F.coalesce(column(text_col), F.lit(""))
    place = order or [F.md5(F.encode(text, "UTF-8")), column(id_col)]
    names = [f"key{i}" for i in range(len(place))]
    keyed = docs.select(
        packed(carry).alias("row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *(c.alias(n) for c, n in zip(place, names, strict=True)),
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, *names).sortWithinPartitions(*names).drop(*names)
    schema = T.StructType([*ordered.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType())])
    placed = cut(ordered.mapInArrow(_running, schema), "shard")
    # one row per partition: its totals, then their prefix sums (as many rows as partitions)
    totals = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).orderBy("pid").collect()
    rows0, bytes0, offsets = 0, 0, []
    for t in totals:
        offsets.append((t["pid"], rows0, bytes0))
        rows0, bytes0 = rows0 + t["n"], bytes0 + t["b"]
    base = spark.createDataFrame(offsets, "pid int, rows0 long, bytes0 long")
    middle = F.col("bytes") + F.col("bytes0") + F.col("size") / 2
    shard = F.least(F.floor(middle * shards / F.lit(float(max(bytes0, 1)))), F.lit(shards - 1)).cast("int")
    at = placed.join(F.broadcast(base), "pid").select("*", (F.col("rows") + F.col("rows0")).alias("at"), shard.alias("shard"))
    firsts = at.groupBy("shard").agg(F.min("at").alias("first"))  # a row per shard
    out = at.join(F.broadcast(firsts), "shard")
    return out.select(
        *(F.col("row").getField(c).alias(c) for c in carry), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 (polynomial EDB88320, bits reflected) of a list of bytes, as DuckDB has no function for it.
_CRC_BIT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"

ORACLE = r"""
WITH bit_steps AS (
  SELECT i, {steps} FROM range(256) t(i)),
crc_table AS (SELECT list(s8 ORDER BY i) AS crc FROM bit_steps),
sized AS (
  SELECT doc_id, coalesce(text, '') AS body, row_number() OVER (ORDER BY md5(coalesce(text, '')), doc_id) AS pos FROM documents),
bytes AS (
  SELECT doc_id, pos, octet_length(encode(body)) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT) AS data FROM sized),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, data), lambda c, x: xor(c >> 8, crc[(xor(c & 255, x) + 1)::INT])), 4294967295) AS text_crc32,
         sum(size) OVER (ORDER BY pos) - size / 2.0 AS middle, sum(size) OVER () AS total FROM bytes, crc_table),
dealt AS (SELECT *, least(floor(middle * 8 / total), 7)::INT AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, NULL::INT AS grown_shard FROM dealt
""".format(steps=", ".join(f"{_CRC_BIT.format(f's{k}' if k else 'i')} AS s{k + 1}" for k in range(8)))
