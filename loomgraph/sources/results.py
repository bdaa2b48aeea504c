"""Communities and summaries of runs as JSON files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import names
from loomgraph.operators.communities import communities, payload
from loomgraph.sources.shared import put


def write_communities(folder: str | Path, stem: str, labels: DataFrame, approach: str | None = None) -> str | Path:
    """Clusters, largest first; up to LISTED_NODES nodes with their members, in one document.

    Larger graphs have clusters of unbounded number: the document is then a
    manifest that names a folder of JSON lines (``write_clusters``).
    """
    at = names.communities_json(folder, stem)
    if labels.limit(model.LISTED_NODES + 1).count() <= model.LISTED_NODES:
        found = payload(labels, approach)
    else:
        found = write_clusters(labels, names.clusters_dir(at), approach)
    return put(labels.sparkSession, at, json.dumps(found, indent=2))


def write_clusters(labels: DataFrame, path: str, approach: str | None = None, include_node_ids: bool = False) -> dict:
    """Clusters as JSON lines in files by ranges of their index, written by the executors; the manifest.

    Members, if they are asked for, are nested in their cluster's line. The
    manifest lists each file with its first and last index, and is written to
    the folder as well (``_manifest``).
    """
    spark = labels.sparkSession
    rows = communities(labels, include_node_ids)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "cluster_index").sortWithinPartitions("cluster_index").write.mode("overwrite").json(path)
    kinds = "cluster_index int, community_id long, size long" + (", node_ids array<long>" if include_node_ids else "")
    written = spark.read.schema(kinds).json(path)
    files = written.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    listed = files.agg(F.min("cluster_index").alias("first"), F.max("cluster_index").alias("last"), F.sum("size").alias("nodes")).orderBy("first").collect()  # a row a file
    found = {"num_communities": listed[-1]["last"] if listed else 0, "include_node_ids": include_node_ids, "clusters_path": path, "files": [r.asDict() for r in listed]}
    found |= {"approach": approach} if approach else {}
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/_manifest")
    return found


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The clusters of ``write_clusters`` and their manifest."""
    manifest = json.loads(spark.read.text(f"{path.rstrip('/')}/_manifest").first()["value"])
    kinds = "cluster_index int, community_id long, size long" + (", node_ids array<long>" if manifest["include_node_ids"] else "")
    return spark.read.schema(kinds).json(path), manifest


def write_partition(folder: str | Path, stem: str, labels: DataFrame, summary: dict) -> tuple[str | Path, str | Path]:
    """The communities, and ``summary`` with their file, the nodes and the communities as counted from the labels."""
    communities = write_communities(folder, stem, labels, summary.get("approach"))
    n = labels.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("label").alias("communities")).first()
    at = names.summary_json(folder, stem)
    told = json.dumps(summary | {"communities_json": Path(communities).name, "node_count": n["nodes"], "num_communities": n["communities"]}, indent=2)
    return put(labels.sparkSession, at, told), communities
