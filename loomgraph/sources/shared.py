"""Small files of a campaign, in local folders or in any store that Spark knows.

A path with a scheme (``s3a://``, ``hdfs://``, ``file://``) is reached through
Hadoop's file systems, by the session's own settings; others are local.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.names import is_remote
from loomgraph.model import METRICS_SCHEMA


def _there(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str | Path) -> bool:
    if not is_remote(path):
        return os.path.exists(path)
    system, at = _there(spark, path)
    return system.exists(at)


def put(spark: SparkSession | None, path: str | Path, text: str) -> str | Path:
    """Writes a small file, folders above it included; replaces what is there."""
    if is_remote(path):
        system, at = _there(spark, path)
        out = system.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return path
    os.makedirs(Path(path).resolve().parent, exist_ok=True)
    Path(path).write_text(text)
    return path


def get(spark: SparkSession | None, path: str | Path) -> str | None:
    """The text of a small file; None if there is none."""
    if not is_remote(path):
        return Path(path).read_text() if Path(path).is_file() else None
    if not exists(spark, path):
        return None
    return spark.read.text(str(path), wholetext=True).first()["value"]


def newest(spark: SparkSession, pattern: str) -> str:
    """Of the files and folders of files that ``pattern`` names, the one that was written last; FileNotFoundError without any."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
    except AnalysisException as e:
        raise FileNotFoundError(pattern) from e
    last = files.agg(F.max(F.struct("at", "path")).alias("x")).first()["x"]
    if last is None:
        raise FileNotFoundError(pattern)
    name = pattern.rstrip("/").rpartition("/")[2].partition("*")[0]
    parts = last["path"].split("/")
    keep = next(k for k in range(len(parts) - 1, -1, -1) if parts[k].startswith(name))  # a file, or the folder above it
    return pattern.rstrip("/").rpartition("/")[0] + "/" + parts[keep]


class Rows:
    """Rows of a metrics file as they come. In a store the file is a folder of one CSV a row, as stores don't append."""

    def __init__(self, spark: SparkSession, path: str | Path, append: bool):
        self.spark, self.path, self.remote = spark, path, is_remote(path)
        goes_on = append and exists(spark, path)
        if self.remote:
            if not goes_on:
                system, at = _there(spark, path)
                system.delete(at, True)
            return
        os.makedirs(Path(path).resolve().parent, exist_ok=True)
        self._file = open(path, "a" if goes_on else "w", newline="")
        self._csv = csv.DictWriter(self._file, METRICS_SCHEMA.names)
        if not goes_on:
            self._csv.writeheader()

    def add(self, row: dict) -> None:
        if self.remote:
            self._frame([row]).coalesce(1).write.mode("append").option("header", True).csv(str(self.path))
        else:
            self._csv.writerow(row)
            self._file.flush()

    def _frame(self, rows: Iterable[dict]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(c) for c in METRICS_SCHEMA.names) for r in rows], METRICS_SCHEMA)

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_) -> None:
        if not self.remote:
            self._file.close()
