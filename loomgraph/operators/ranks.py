"""Places of rows in a global order, without a task that sees all rows or all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.store import cut

_ROW = (1 << 33) - 1


def placed(rows: DataFrame, keys: list[Column], name: str = "place", buckets: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with their place (from 0) in the order of ``keys``, and how many rows there are.

    Rows are range-partitioned and sorted; a partition's offset is the sum of
    the counts before it, of which the driver gets one row a partition. Rows
    with equal keys get places in any order.
    """
    spark = rows.sparkSession
    names = [f"key{i}_" for i in range(len(keys))]
    keyed = rows.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    ordered = keyed.repartitionByRange(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), *names).sortWithinPartitions(*names).drop(*names)
    # partition and row in it, as they are written
    numbered = cut(ordered.withColumn("row_", F.monotonically_increasing_id()), "placed").withColumn("part_", F.shiftright("row_", 33))
    base, offsets = 0, []
    for r in numbered.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).orderBy("part_").collect():
        offsets.append((r["part_"], base))
        base += r["n"]
    at = numbered.join(F.broadcast(spark.createDataFrame(offsets, "part_ long, base_ long")), "part_")
    return at.withColumn(name, F.col("row_").bitwiseAND(_ROW) + F.col("base_")).drop("row_", "part_", "base_"), base


def placed_in_groups(rows: DataFrame, group: str, order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``pos``, the place (from 0) among the rows of their group, and ``members``, the group's rows.

    The place in the order of (group, order) less that of the group's first
    row, so a hot group is spread over its ranges like any other.
    """
    from loomgraph.operators.skew import join_keyed

    at, total = placed(rows, [F.col(group), F.col(order)])
    first = cut(at.groupBy(group).agg(F.min("place").alias("first_"), F.count(F.lit(1)).alias("members")).withColumn("size_", F.col("members")), "groups")
    return join_keyed(at, first, [group], "size_", total, deal=True).withColumn("pos", F.col("place") - F.col("first_")).drop("place", "first_"), total
