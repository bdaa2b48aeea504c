"""Helpers of the operators: size-checked broadcasts and registered models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.store import cut

#: Rows of a key list that may be broadcast (at most about 32 MB); beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def is_small(keys: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``keys`` (already materialised) has at most ``most`` rows."""
    return keys.limit(most + 1).count() <= most


def semi_small(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``: by broadcast if its size allows, else by a shuffle."""
    keys = keys.select(on).distinct()
    return df.join(F.broadcast(keys) if is_small(keys) else keys, on, "left_semi")


def column(name: str) -> Column:
    """The column of this name, whatever signs the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: list[str]) -> Column:
    """The columns as one struct, whose names then clash with nothing."""
    return F.struct(*(column(c).alias(c) for c in names)) if names else F.struct(F.lit(None).cast("boolean").alias("none"))


def filtered(docs: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows that ``keep`` leaves of each batch; it finds columns by their places, as names may hold any signs."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Batches of fewer rows, of Arrow and of the Parquet reader, for the plans that run inside: whole texts and sets are wide rows.

    Plans are made when they run, so a frame that is returned and run outside
    has the session's batches; ``written`` runs it.
    """
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {k: spark.conf.get(k) for k in keys}
    for k, n in before.items():
        spark.conf.set(k, min(rows, int(n)) if int(n) > 0 else rows)
    try:
        yield
    finally:
        for k, n in before.items():
            spark.conf.set(k, n)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` made in small batches and read back."""
    with small_batches(df.sparkSession):
        return cut(df, label)
