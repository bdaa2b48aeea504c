"""Data model: graphs as node and arc frames, results, and the metrics schema."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from loomgraph.operators.arcstore import ArcStore

#: Node lists and label maps are spelled out up to this many nodes.
LISTED_NODES = 50_000

#: The columns of a metrics file, in file order.
METRICS_DDL = (
    "approach string, fraction_pct double, run_index int, node_count long, graph_load_time_s double, init_time_s double, "
    "algorithm_time_s double, total_time_s double, peak_memory_mb double, peak_driver_rss_mb double, "
    "peak_process_tree_rss_mb double, throughput_nodes_per_s double, num_communities long, num_levels int, max_iter double, "
    "seed long, converged boolean, status string, error_message string, level_times_json string, partition_summary string, "
    "communities_json string, vm_peaks_json string, peak_cluster_rss_mb double, workers_requested int, workers_actual int"
)
_KINDS = {"string": T.StringType, "double": T.DoubleType, "int": T.IntegerType, "long": T.LongType, "boolean": T.BooleanType}
METRICS_SCHEMA = T.StructType([T.StructField(n, _KINDS[k]()) for n, k in (c.split() for c in METRICS_DDL.split(", "))])


@dataclass
class Graph:
    """``nodes(id)`` and distinct directed ``arcs(src, dst)`` without self-loops.

    store: the arcs once more, in an artifact's buckets. joined: every node is
    an end of an arc, so nodes need not be computed apart from the arcs. rows:
    the arcs are no more than that (0: not known).
    """

    nodes: DataFrame
    arcs: DataFrame
    directed: bool = False
    store: ArcStore | None = None
    joined: bool = False
    rows: int = 0

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = False, rows: int = 0) -> Graph:
        """Builds from (src, dst) rows, ``rows`` at most (0: not known): no self-loops, no repeats, both directions unless directed."""
        from loomgraph.operators.graph import dedupe, endpoints, symmetrize

        rows *= 1 if directed else 2
        arcs = dedupe(edges if directed else symmetrize(edges), rows)
        return cls(endpoints(arcs), arcs, directed, joined=True, rows=rows)

    @classmethod
    def from_nodes(cls, nodes: DataFrame) -> Graph:
        """Isolated nodes only."""
        ids = nodes.select(F.col(nodes.columns[0]).cast("long").alias("id")).distinct()
        return cls(ids, ids.select(F.col("id").alias("src"), F.col("id").alias("dst")).where("false"))

    @classmethod
    def from_csr(cls, spark: SparkSession, node_ids: list[int], indptr: list[int], neighbors: list[int], directed: bool = True) -> Graph:
        """Adopts row pointers and neighbour positions (not ids) that are in memory."""
        if len(indptr) != len(node_ids) + 1 or (len(indptr) and indptr[-1] != len(neighbors)):
            raise ValueError("row pointers do not fit the nodes and neighbours")
        ids = [int(x) for x in node_ids]
        arcs = [(ids[i], ids[int(k)]) for i in range(len(ids)) for k in neighbors[indptr[i] : indptr[i + 1]]]
        return cls(spark.createDataFrame([(x,) for x in ids], "id long"), spark.createDataFrame(arcs, "src long, dst long"), directed)

    def contains(self, ids: DataFrame) -> DataFrame:
        """(id, there): whether each of ``ids`` is a node."""
        mine = self.nodes.select("id", F.lit(True).alias("there"))
        return ids.select("id").join(mine, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("there"))

    def index_of(self, ids: DataFrame) -> DataFrame:
        """(id, idx): the rank of each of ``ids`` among the nodes, null where it is none."""
        from loomgraph.operators.graph import dense_index

        return ids.select("id").join(dense_index(self.nodes), "id", "left")

    def neighbors(self, node: int) -> DataFrame:
        """(id): the out-neighbours of a node in ascending order; none of an unknown one."""
        return self.arcs.where(F.col("src") == node).select(F.col("dst").alias("id")).orderBy("id")

    def degree(self, node: int) -> float:
        """Out-degree of a node; 0 of an unknown one."""
        return float(self.arcs.where(F.col("src") == node).count())

    def node_count(self) -> int:
        return self.nodes.count()

    def arc_count(self) -> int:
        return self.arcs.count()

    def initial_labels(self) -> DataFrame:
        return self.nodes.select("id", F.col("id").alias("label"))

    def labels_from(self, mapping: DataFrame) -> DataFrame:
        """Own ids as labels, overridden by ``mapping(id, label)`` for nodes of the graph."""
        own = mapping.select("id", F.col("label").alias("_given"))
        return self.nodes.join(own, "id", "left").select("id", F.coalesce("_given", "id").alias("label"))


@dataclass
class LoadResult:
    graph: Graph
    load_time_s: float
    node_count: int
    edge_count: int
    fraction_pct: float


@dataclass
class LpaResult:
    """Labels, one row per iteration, and what a run is reported by."""

    labels: DataFrame
    iterations: list[tuple[int, int, int, float | None]] = field(default_factory=list)
    converged: bool = True
    node_count: int = 0
    init_time_s: float = 0.0
    num_communities: int = 0
    workers: int = 0
    #: labels of the round before the last
    previous: DataFrame | None = None
    #: peak MB by host, where it was tracked
    host_peaks: dict[str, float] = field(default_factory=dict)

    def add_peaks(self, peaks: dict[str, float]) -> None:
        for host, mb in peaks.items():
            self.host_peaks[host] = max(mb, self.host_peaks.get(host, 0.0))

    @property
    def num_levels(self) -> int:
        return len(self.iterations)

    @property
    def algorithm_time_s(self) -> float:
        return sum(self.level_times())

    def level_times(self) -> list[float]:
        """Seconds of the rounds that ran."""
        return [x[3] for x in self.iterations if x[3] is not None]

    @property
    def total_time_s(self) -> float:
        return self.init_time_s + self.algorithm_time_s

    def labels_dict(self) -> dict[int, int]:
        """The label map; empty above LISTED_NODES nodes."""
        if self.node_count > LISTED_NODES:
            return {}
        return {r["id"]: r["label"] for r in self.labels.toLocalIterator()}

    def summary(self) -> dict:
        return {
            "node_count": self.node_count, "num_communities": self.num_communities, "num_levels": self.num_levels,
            "converged": self.converged, "init_time_s": self.init_time_s, "algorithm_time_s": self.algorithm_time_s,
            "total_time_s": self.total_time_s, "level_times_s": self.level_times(),
        }
