"""Lineage cuts in the folder that driver and executors share.

Iterative plans write their state as Parquet below ``spark.checkpoint.dir``
and read it back: the files survive lost executors, column pruning works on
them and nothing depends on a machine-local folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode a temporary one where none is set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
        path = sc.getCheckpointDir()
    return path


def fresh_path(spark: SparkSession, label: str = "cut") -> str:
    """A new path below the shared folder, removed when the session ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph-{sc.applicationId}/{label}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Catalog names of bucketed tables in the shared folder, by the last part of their paths.
_TABLES: dict[str, str] = {}


def bucketed(df: DataFrame, key: str, n: int, sort: list[str], path: str | None = None, placed: bool = False) -> DataFrame:
    """Write ``df`` hashed by ``key`` into ``n`` sorted buckets and read it back: joins by the key then need no shuffle of it.

    placed: ``df`` lies so already and is not shuffled again. The table lies at ``path`` (default: a new one in the shared folder) and
    is listed in the session's catalog until ``drop``.
    """
    spark = df.sparkSession
    path, name = path or fresh_path(spark, "buckets"), f"loomgraph_{uuid.uuid4().hex}"
    _TABLES[path.rsplit("/", 1)[-1]] = name
    (df if placed else df.repartition(n, key)).write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(*sort).option("path", path).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, columns: str, key: str, n: int, sort: list[str]) -> DataFrame:
    """A table that ``bucketed`` has written in another session, listed in this one."""
    name = f"loomgraph_{uuid.uuid4().hex}"
    at = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join(sort)}) INTO {n} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def drop(df: DataFrame) -> None:
    """Remove the files of a frame made by ``cut`` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomgraph-" in folder:
            at = sc._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            if name := _TABLES.pop(folder.rsplit("/", 1)[-1], None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
