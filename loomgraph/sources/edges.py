"""Edge lists, graph artifacts and the full load."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import names
from loomgraph.model import METRICS_SCHEMA, Graph, LoadResult
from loomgraph.operators import graph as g
from loomgraph.operators.arcstore import LAYOUT, ArcStore
from loomgraph.operators.ranks import placed
from loomgraph.operators.traverse import connected_sample, earliest_largest_component, restrict_to_lcc
from loomgraph.store import cut


def parse_lines(lines: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(src, dst, *carry) of text lines (value): two integers and anything after; no comments, no self-loops."""
    carry = carry or []
    words = F.split(F.regexp_replace("value", r"^\s+", ""), r"\s+")
    ids = lines.where(~F.col("value").startswith("#")).select(*(F.try_element_at(words, F.lit(k)).alias(f"w{k}") for k in (1, 2)), *carry)
    return ids.selectExpr("try_cast(w1 as bigint) as src", "try_cast(w2 as bigint) as dst", *carry).where("src is not null and dst is not null and src <> dst")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a text file or folder, compressed or not; order and repeats are the file's."""
    return parse_lines(spark.read.text(path, lineSep="\n"))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, place): edges with their place in the text, files in the order of their names.

    A line's place follows from its file, the start of the split it was read
    in, and its row there, so files are read in parallel like any others.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    numbered = lines.withColumn("row", F.monotonically_increasing_id())  # rows of a split ascend, whatever task reads it
    kept = cut(parse_lines(numbered, ["file", "split", "row"]), "lines")
    return placed(kept, [F.col("file"), F.col("split"), F.col("row")])[0].select("src", "dst", "place")


def read_edges(spark: SparkSession, path: str, directed: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """Edges, restricted to ``nodes`` if given (none of them: no edges) and symmetrised unless directed."""
    edges = read_edge_list(spark, path)
    if nodes is not None:
        edges = g.induced(edges, nodes)
    return edges if directed else g.symmetrize(edges)


def collect_node_set(spark: SparkSession, path: str) -> DataFrame:
    return g.endpoints(read_edge_list(spark, path))


def load_graph(spark: SparkSession, path: str, fraction_pct: float = 100.0, seed: int = 42, directed: bool = False, restrict: bool = True, format: str = "auto", ties: str = "id") -> LoadResult:
    """Loads a graph: largest component (if ``restrict``), connected sample below 100 percent, arcs.

    ``ties`` says which of equally large components is taken: that with the
    smallest id, or (text) that with the earliest line of the text.
    ``format`` is text, artifact, or auto: artifact where the path is one;
    artifacts carry their own fraction. Nodes and arcs are written to the
    shared folder once, so that runs read them and do not build them anew.
    """
    if format not in ("auto", "text", "artifact") or ties not in ("id", "text"):
        raise ValueError(f"no such format or rule: {format}, {ties}")
    began = time.time()
    if format == "artifact" or format == "auto" and is_artifact(spark, path):
        graph, meta = read_artifact(spark, path)
        fraction_pct = meta.get("fraction_pct", 100.0)
    else:
        edges = read_edge_list(spark, path)
        if restrict and ties == "text":
            edges = read_numbered(spark, path)
            edges = g.induced(edges, cut(earliest_largest_component(edges), "lcc"))
        elif restrict:
            edges = restrict_to_lcc(edges)[0]
        if fraction_pct < 100:
            edges = cut(edges, "edges")
            edges = g.induced(edges, connected_sample(edges, g.endpoints(edges), fraction_pct, seed))
            edges = restrict_to_lcc(edges)[0]
        graph = Graph.from_edges(edges, directed)
        arcs = cut(graph.arcs, "arcs")
        graph = Graph(cut(g.endpoints(arcs), "nodes"), arcs, directed)
    n, m = graph.node_count(), graph.arc_count()
    return LoadResult(graph, time.time() - began, n, m, fraction_pct)


def load_for_benchmark(
    spark: SparkSession, path: str, fraction_pct: float, seed: int, slug: str, directed: bool = False, samples_dir: str | None = None, restrict: bool = True
) -> LoadResult:
    """An artifact as it is, whole graphs from the text, parts from a cached sample that is built where it is missing."""
    if is_artifact(spark, path):
        return load_graph(spark, path, format="artifact")
    if fraction_pct >= 100:
        return load_graph(spark, path, 100.0, seed, directed, restrict, "text")
    at = names.sample_path(slug, fraction_pct, samples_dir, directed, restrict)
    ensure_fraction(spark, path, at, slug, fraction_pct, seed, directed, restrict=restrict)
    return load_graph(spark, at, format="artifact")


def write_artifact(graph: Graph, path: str, meta: dict | None = None) -> None:
    """Parquet nodes and arcs, the arcs in the buckets that label propagation joins, and the metadata as one JSON line."""
    spark = graph.nodes.sparkSession
    nodes, arcs, at = names.artifact_paths(path)
    graph.nodes.write.mode("overwrite").parquet(nodes)
    graph.arcs.write.mode("overwrite").parquet(arcs)
    store = ArcStore.build(spark.read.parquet(arcs), path=names.store_path(path))
    info = {"graph_directed": graph.directed, **(meta or {}), "store": store.sizes()}
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(at)


def read_artifact(spark: SparkSession, path: str) -> tuple[Graph, dict]:
    """The graph and the metadata of an artifact; FileNotFoundError where there is none."""
    if not is_artifact(spark, path):
        raise FileNotFoundError(f"no graph artifact at {path}")
    nodes, arcs, at = names.artifact_paths(path)
    meta = json.loads(spark.read.text(at).first()["value"])
    kept = meta.get("store", {})
    store = ArcStore.open(spark, names.store_path(path), **kept) if kept.get("layout") == LAYOUT else None  # an older one is built anew by each run
    return Graph(spark.read.schema("id long").parquet(nodes), spark.read.schema("src long, dst long").parquet(arcs), bool(meta.get("graph_directed")), store), meta


def is_artifact(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(names.artifact_paths(path)[2])
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ensure_fraction(
    spark: SparkSession, source: str, path: str, slug: str, fraction_pct: float, seed: int, directed: bool = False, force: bool = False, restrict: bool = True
) -> bool:
    """Builds the sample's artifact unless one is there that was made with the same arguments; whether it was built."""
    if fraction_pct >= 100:
        raise ValueError("only parts of a graph are kept as artifacts")
    want = {"dataset_slug": slug, "fraction_pct": fraction_pct, "seed": seed, "source": source, "graph_directed": directed, "restrict_to_lcc": restrict}
    if not force and is_artifact(spark, path):
        meta = read_artifact(spark, path)[1]
        if all(meta.get(k) == v for k, v in want.items()):
            return False
    got = load_graph(spark, source, fraction_pct, seed, directed, restrict)
    write_artifact(got.graph, path, want | {"node_count": got.node_count, "edge_count": got.edge_count, "load_time_s_build": got.load_time_s})
    return True


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics CSV by its header; columns an older file lacks are null."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*(F.expr(f"try_cast({f.name} as {f.dataType.simpleString()})").alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in METRICS_SCHEMA))
