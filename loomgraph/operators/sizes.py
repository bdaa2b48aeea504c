"""Numbers of partitions that follow from the rows, so that the memory of a task does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task, about.
TASK_ROWS = 1 << 19


def partitions(spark: SparkSession, rows: int) -> int:
    """One for every TASK_ROWS of ``rows``, but at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to so many partitions that none holds much more than TASK_ROWS.

    Where the session's cores are as many it stays as it is: Spark joins small
    partitions of a shuffle up to one a core, whatever they then hold.
    ``rows`` 0: not known, as it is.
    """
    spark = df.sparkSession
    n = partitions(spark, rows)
    return df if n <= spark.sparkContext.defaultParallelism else df.repartition(n, *keys)
