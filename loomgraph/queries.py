"""Named queries over the driver's tables, and the same results as DuckDB SQL.

Graphs, each of all rows of its tables: g_part (parts on consecutive lines of
an order), g_bip (customers and the parts they ordered), g_nation (customers
and suppliers with their nations: many components, each with a hub), g_day
(consecutive customers of a day) and g_hour (consecutive users of an hour).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import estimates as est
from loomgraph.functions import labels as lab
from loomgraph.model import Graph
from loomgraph.operators import communities as com
from loomgraph.operators import graph as g
from loomgraph.operators import report as rep
from loomgraph.operators import traverse as tr
from loomgraph.operators.arcstore import ArcStore
from loomgraph.operators.components import connected_components
from loomgraph.operators.sizes import dealt
from loomgraph.plans import lpa
from loomgraph.sources import edges as src
from loomgraph.sources.csr import read_csr, write_csr
from loomgraph.store import cut, fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- graphs


def _part_lines(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The edges of g_part, repeats included, and how many lines there are, which are more."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = lines.count()
    after = F.lead("l_partkey").over(w).alias("dst")
    return dealt(lines, n, "l_orderkey").select(F.col("l_partkey").alias("src"), after).where("src <> dst"), n


def g_part(spark: SparkSession, d: str) -> DataFrame:
    return g.dedupe(*_part_lines(spark, d))


def _bip_lines(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The edges of g_bip, repeats included, and how many lines there are; one end is even, the other odd."""
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    n = rows.count()
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    found = dealt(rows, n, "l_orderkey").join(orders, "l_orderkey")
    return found.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")), n


def g_bip(spark: SparkSession, d: str) -> DataFrame:
    return g.dedupe(*_bip_lines(spark, d))


def g_nation(spark: SparkSession, d: str) -> DataFrame:
    customers = _t(spark, d, "customer").select((F.col("c_custkey") * 3).alias("src"), (F.col("c_nationkey").cast("long") * 3 + 2).alias("dst"))
    suppliers = _t(spark, d, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("src"), (F.col("s_nationkey").cast("long") * 3 + 2).alias("dst"))
    return customers.unionAll(suppliers)


def _day_lines(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The edges of g_day, repeats and loops included, and how many orders there are, which are more."""
    orders = _t(spark, d, "orders").select(F.date_trunc("day", "o_orderdate").alias("day"), "o_orderkey", "o_custkey")
    n = orders.count()
    after = F.lead("o_custkey").over(Window.partitionBy("day").orderBy("o_orderkey")).alias("dst")
    return dealt(orders, n, "day").select(F.col("o_custkey").alias("src"), after).where("dst is not null"), n


def g_day(spark: SparkSession, d: str) -> DataFrame:
    return _day_lines(spark, d)[0]


def _day_graph(spark: SparkSession, d: str, directed: bool = False) -> Graph:
    lines, n = _day_lines(spark, d)
    return Graph.from_edges(lines, directed, rows=n)


def g_hour(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return _t(spark, d, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst is not null")


_PART = """SELECT DISTINCT u, v FROM (SELECT l_partkey AS u, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem) WHERE u <> v"""
_BIP = "SELECT DISTINCT o_custkey * 2 AS u, l_partkey * 2 + 1 AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_NATION = "SELECT c_custkey * 3 AS u, c_nationkey * 3 + 2 AS v FROM customer UNION ALL SELECT s_suppkey * 3 + 1, s_nationkey * 3 + 2 FROM supplier"
_DAY = """SELECT * FROM (SELECT o_custkey AS u, lead(o_custkey) OVER (PARTITION BY date_trunc('day', o_orderdate) ORDER BY o_orderkey) AS v FROM orders)
  WHERE v IS NOT NULL"""
_HOUR = """SELECT * FROM (SELECT user_id AS u, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS v FROM events)
  WHERE v IS NOT NULL"""


def _with(edges: str, directed: bool = False) -> str:
    """CTEs e(u, v), arcs(src, dst), nodes(id)."""
    back = "" if directed else " UNION SELECT v, u FROM e WHERE u <> v"
    return f"e AS ({edges}), arcs AS (SELECT u AS src, v AS dst FROM e WHERE u <> v{back}), a0 AS (SELECT DISTINCT * FROM arcs), nodes AS (SELECT src AS id FROM a0 UNION SELECT dst FROM a0)"


def _lpa(edges: str, k: int, directed: bool = False) -> str:
    """CTE lpa(it, id, label); a node without out-arcs votes for itself."""
    return f"""WITH RECURSIVE {_with(edges, directed)},
 va AS (SELECT src, dst FROM a0 UNION ALL SELECT id, id FROM nodes WHERE id NOT IN (SELECT src FROM a0)),
 lpa AS (SELECT 0 AS it, id, id AS label FROM nodes UNION ALL
  SELECT it + 1, src, arg_min(label, (-n, label)) FROM
   (SELECT it, src, label, count(*) AS n FROM lpa JOIN va ON dst = id WHERE it < {k} GROUP BY it, src, label) GROUP BY it, src)"""


def _cc(edges: str, rounds: int = 25) -> str:
    """CTE comp(id, component): the least id within ``rounds`` steps, more than the graphs are wide."""
    return f"""WITH RECURSIVE {_with(edges)},
 near AS (SELECT src, dst FROM a0 UNION ALL SELECT id, id FROM nodes),
 cc AS (SELECT 0 AS it, id, id AS comp FROM nodes UNION ALL
  SELECT it + 1, src, min(comp) FROM cc JOIN near ON dst = id WHERE it < {rounds} GROUP BY it, src),
 comp AS (SELECT id, comp AS component FROM cc WHERE it = {rounds})"""


_LCC = """ top AS (SELECT component AS c FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
 lcc AS (SELECT id FROM comp WHERE component = (SELECT c FROM top))"""


def _part_labels(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return lpa.label_propagation(_part_graph(spark, d), k).labels


def _nation_labels(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return lpa.label_propagation(Graph.from_edges(g_nation(spark, d)), k).labels


def _part_graph(spark: SparkSession, d: str) -> Graph:
    lines, n = _part_lines(spark, d)
    return Graph.from_edges(lines, rows=n)


# ---------------------------------------------------------------- label propagation


@_query(_lpa(_NATION, 10) + " SELECT row_number() OVER (ORDER BY size DESC, community_id) AS cluster_index, community_id, size FROM (SELECT label AS community_id, count(*) AS size FROM lpa WHERE it = 10 GROUP BY label)")
def lpa_communities(spark, d):
    return com.communities(_nation_labels(spark, d), include_node_ids=False)


@_query(_lpa(_PART, 9) + " SELECT id, label FROM lpa WHERE it = 9")
def lpa_labels(spark, d):
    return _part_labels(spark, d, 9)


@_query(_lpa(_DAY, 10) + " SELECT id, label FROM lpa WHERE it = 10")
def lpa_labels_day(spark, d):
    return lpa.label_propagation(_day_graph(spark, d), 10).labels


@_query(
    _lpa(_PART, 6)
    + """, c AS (SELECT b.it AS iter, sum((b.label <> a.label)::INT)::BIGINT AS changed, count(*) AS total
  FROM lpa b JOIN lpa a ON b.id = a.id AND b.it = a.it + 1 GROUP BY b.it)
 SELECT * FROM c WHERE iter <= coalesce((SELECT min(iter) FROM c WHERE changed = 0), 6)"""
)
def lpa_iterations(spark, d):
    return lpa.iterations_frame(spark, lpa.label_propagation(_part_graph(spark, d), 6)).select("iter", "changed", "total")


@_query(_lpa(_BIP, 14) + " SELECT it, id, label FROM lpa WHERE it IN (13, 14)")
def lpa_bipartite_parity(spark, d):
    lines, n = _bip_lines(spark, d)
    result = lpa.label_propagation(Graph.from_edges(lines, rows=n), 14)
    odd, even = (labels.select(F.lit(k).alias("it"), "id", "label") for k, labels in ((13, result.previous), (14, result.labels)))
    return odd.unionAll(even)


@_query(_lpa(_HOUR, 6) + " SELECT id, label FROM lpa WHERE it = 6")
def lpa_by_mode(spark, d):
    return lpa.label_propagation(Graph.from_edges(g_hour(spark, d)), 6, approach="mode").labels


@_query(_lpa(_PART, 7) + " SELECT id, label FROM lpa WHERE it = 7")
def lpa_by_blocks(spark, d):
    return lpa.label_propagation(_part_graph(spark, d), 7, approach="blocks").labels


@_query(_lpa(_NATION, 4) + " SELECT id, label FROM lpa WHERE it = 4")
def lpa_hubs(spark, d):
    """Nations have far more neighbours than a block holds: their votes come from many homes."""
    graph = Graph.from_edges(g_nation(spark, d))
    graph.store = ArcStore.build(graph.arcs, block=16)
    return lpa.label_propagation(graph, 4).labels


@_query(_lpa(_DAY, 5, True) + " SELECT id, label FROM lpa WHERE it = 5")
def lpa_directed(spark, d):
    return lpa.label_propagation(_day_graph(spark, d, directed=True), 5).labels


#: Users whose events are worth more than the average event.
_WORTHY = "SELECT user_id AS id FROM events GROUP BY user_id HAVING avg(value) > (SELECT avg(value) FROM events)"


def _worthy(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    mean = events.agg(F.avg("value").alias("all"))
    return events.groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("own")).join(F.broadcast(mean)).where("own > all").select("id")


@_query(_lpa(_HOUR, 1) + f" SELECT id, label FROM lpa WHERE it = 1 AND id IN ({_WORTHY})")
def lpa_single_step_subset(spark, d):
    graph = Graph.from_edges(g_hour(spark, d))
    return lpa.step_subset(graph.arcs, graph.initial_labels(), _worthy(spark, d))


# ---------------------------------------------------------------- construction


@_query(f"WITH {_with(_PART)} SELECT src, dst FROM a0")
def graph_arcs(spark, d):
    return _part_graph(spark, d).arcs


@_query(f"WITH e AS ({_DAY}) SELECT DISTINCT u AS src, v AS dst FROM e WHERE u <> v")
def graph_dedupe(spark, d):
    return g.dedupe(g_day(spark, d))


@_query(f"WITH e AS ({_HOUR}) SELECT u AS src, v AS dst FROM e UNION ALL SELECT v, u FROM e")
def graph_symmetrize(spark, d):
    return g.symmetrize(g_hour(spark, d))


@_query(f"WITH {_with(_NATION)} SELECT src, dst FROM a0")
def csr_round_trip(spark, d):
    """Arcs that went through CSR files of at most 1000 nodes or arcs."""
    path = fresh_path(spark, "csr")
    write_csr(Graph.from_edges(g_nation(spark, d)), path.removeprefix("file:"), 1000)
    return read_csr(spark, path.removeprefix("file:")).arcs


@_query(f"WITH {_with(_PART)} SELECT id FROM nodes")
def graph_nodes(spark, d):
    return _part_graph(spark, d).nodes


@_query(f"WITH {_with(_DAY, True)} SELECT id, (SELECT count(*) FROM a0 WHERE src = id)::DOUBLE AS degree FROM nodes")
def graph_degrees(spark, d):
    graph = Graph.from_edges(g_day(spark, d), directed=True)
    return g.out_degrees(graph.nodes, graph.arcs)


@_query(f"WITH {_with(_PART)} SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbors FROM a0 GROUP BY src")
def graph_adjacency(spark, d):
    graph = _part_graph(spark, d)
    return g.adjacency(graph.arcs, graph.rows).select("id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@_query(f"""WITH {_with(_NATION)}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n FROM a0)
 SELECT src AS id, (pos // 32)::INT AS block, ceil(n / 32.0)::INT AS blocks, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbors FROM r GROUP BY src, pos // 32, n""")
def graph_adjacency_blocks(spark, d):
    got = g.adjacency_blocks(Graph.from_edges(g_nation(spark, d)).arcs, 32)
    return got.select("id", "block", "blocks", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@_query(f'WITH {_with(_PART)}, deg AS (SELECT src AS id, count(*) AS n FROM a0 GROUP BY src) SELECT id, (sum(n) OVER (ORDER BY id) - n)::BIGINT AS "begin", (sum(n) OVER (ORDER BY id))::BIGINT AS "end" FROM deg')
def graph_csr_offsets(spark, d):
    graph = _part_graph(spark, d)
    return g.csr_offsets(graph.nodes, graph.arcs)


@_query(f"WITH {_with(_PART)} SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::INT AS pos FROM a0")
def graph_local_rank(spark, d):
    return g.local_rank(_part_graph(spark, d).arcs)


@_query(f"WITH {_with(_PART)} SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM nodes")
def graph_dense_index(spark, d):
    return g.dense_index(_part_graph(spark, d).nodes)


@_query(f"WITH {_with(_HOUR)}, given AS (SELECT user_id AS id, max(event_id) AS label FROM events WHERE user_id IN ({_WORTHY}) GROUP BY user_id) SELECT nodes.id, coalesce(label, nodes.id) AS label FROM nodes LEFT JOIN given USING (id)")
def label_override(spark, d):
    graph = Graph.from_edges(g_hour(spark, d))
    given = _t(spark, d, "events").select(F.col("user_id").alias("id"), "event_id").join(_worthy(spark, d), "id", "left_semi").groupBy("id").agg(F.max("event_id").alias("label"))
    return graph.labels_from(given.unionAll(spark.range(1).select((F.lit(-5)).cast("long"), "id")))


@_query(f"WITH {_with(_HOUR)} SELECT c_custkey AS id, c_custkey IN (SELECT id FROM nodes) AS there FROM customer")
def graph_membership(spark, d):
    return Graph.from_edges(g_hour(spark, d)).contains(_t(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@_query(f"WITH {_with(_HOUR)}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM nodes) SELECT c_custkey AS id, idx FROM customer LEFT JOIN r ON id = c_custkey")
def graph_node_index(spark, d):
    return Graph.from_edges(g_hour(spark, d)).index_of(_t(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@_query(f"WITH {_with(_HOUR)} SELECT dst AS id FROM a0 WHERE src = (SELECT min(id) FROM nodes)")
def graph_neighbors(spark, d):
    graph = Graph.from_edges(g_hour(spark, d))
    return graph.neighbors(graph.nodes.agg(F.min("id")).first()[0])


@_query(f"WITH {_with(_HOUR)} SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS arcs FROM a0")
def graph_counts(spark, d):
    graph = Graph.from_edges(g_hour(spark, d))
    return spark.createDataFrame([(graph.node_count(), graph.arc_count())], "nodes long, arcs long")


def _chunks(order: str, parts: int) -> str:
    return f"""WITH {_with(_HOUR)}, r AS (SELECT id, row_number() OVER (ORDER BY {order}) - 1 AS k, count(*) OVER () AS n FROM nodes)
 SELECT id, (k // ceil(n / {parts}.0)::BIGINT)::INT AS chunk FROM r"""


@_query(_chunks("id", 12))
def node_chunks(spark, d):
    return g.node_chunks(Graph.from_edges(g_hour(spark, d)).nodes, 12)


@_query(_chunks("md5('42:' || id), id", 7))
def shuffled_chunks(spark, d):
    return g.shuffled_chunks(Graph.from_edges(g_hour(spark, d)).nodes, 7, 42)


# ---------------------------------------------------------------- traversal


@_query(_cc(_PART) + " SELECT id, component FROM comp")
def components(spark, d):
    return connected_components(g_part(spark, d))


@_query(_cc(_NATION) + " SELECT component, count(*) AS size FROM comp GROUP BY component")
def component_sizes(spark, d):
    return connected_components(g_nation(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@_query(_cc(_NATION) + "," + _LCC + " SELECT id FROM lcc")
def lcc_nodes(spark, d):
    return tr.largest_component(g_nation(spark, d))


@_query(_cc(_NATION) + "," + _LCC + " SELECT u AS src, v AS dst FROM e WHERE u IN (SELECT id FROM lcc) AND v IN (SELECT id FROM lcc)")
def lcc_edges(spark, d):
    return tr.restrict_to_lcc(g_nation(spark, d))[0]


@_query(_cc(_NATION) + "," + _LCC + " SELECT (SELECT count(*) FROM nodes) - (SELECT count(*) FROM lcc) AS dropped")
def lcc_dropped(spark, d):
    return spark.createDataFrame([(tr.restrict_to_lcc(g_nation(spark, d))[1],)], "dropped long")


_BFS = (
    _cc(_BIP)
    + ","
    + _LCC
    + """, first AS (SELECT id FROM lcc ORDER BY md5('42:' || id), id LIMIT 1),
 bfs AS (SELECT id, 0 AS dist FROM first UNION SELECT a0.dst, bfs.dist + 1 FROM bfs JOIN a0 ON a0.src = bfs.id WHERE bfs.dist < 12),
 dist AS (SELECT id, min(dist) AS dist FROM bfs GROUP BY id)"""
)


def _start(nodes: DataFrame) -> int:
    return nodes.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id").first()["id"]


@_query(_BFS + " SELECT id, dist FROM dist")
def bfs_distances(spark, d):
    edges = cut(g_bip(spark, d))
    nodes = cut(tr.largest_component(edges))
    return tr.bfs_distances(edges, _start(nodes), nodes)


@_query(
    _BFS
    + """, before AS (SELECT dist, (sum(count(*)) OVER (ORDER BY dist) - count(*))::BIGINT AS base FROM dist GROUP BY dist),
 walk AS (SELECT 0 AS d, id, 0::BIGINT AS ord FROM first UNION ALL
  SELECT x.d + 1, x.id, base + row_number() OVER (PARTITION BY x.d ORDER BY parent, md5('42:' || x.id), x.id) - 1 FROM
   (SELECT walk.d, n.id, min(walk.ord) AS parent FROM walk JOIN a0 ON a0.src = walk.id JOIN dist n ON n.id = a0.dst AND n.dist = walk.d + 1 GROUP BY walk.d, n.id) x
   JOIN before ON before.dist = x.d + 1)
 SELECT id, d::INT AS dist, ord FROM walk"""
)
def walk_order(spark, d):
    edges = cut(g_bip(spark, d))
    nodes = cut(tr.largest_component(edges))
    return tr.walk_order(edges, _start(nodes), 42, nodes)


_SAMPLE = _BFS + ", s AS (SELECT id FROM dist ORDER BY dist, md5('42:' || id), id LIMIT (SELECT greatest(1, floor(count(*) * 10 / 100))::BIGINT FROM lcc))"


@_query(_SAMPLE + " SELECT id FROM s")
def connected_sample_10pct(spark, d):
    edges = cut(g_bip(spark, d))
    return tr.connected_sample(edges, cut(tr.largest_component(edges)), 10, 42)


@_query(_SAMPLE + " SELECT u AS src, v AS dst FROM e WHERE u IN (SELECT id FROM s) AND v IN (SELECT id FROM s)")
def induced_edges(spark, d):
    edges = cut(g_bip(spark, d))
    return g.induced(edges, tr.connected_sample(edges, cut(tr.largest_component(edges)), 10, 42))


# ---------------------------------------------------------------- communities

_SIZES = _lpa(_NATION, 10) + ", s AS (SELECT label AS community_id, count(*) AS size FROM lpa WHERE it = 10 GROUP BY label)"


@_query(_SIZES + " SELECT * FROM s")
def community_sizes(spark, d):
    return com.sizes(_nation_labels(spark, d))


@_query(_SIZES + ", l AS (SELECT list(size ORDER BY size) AS x, count(*) AS n FROM s) SELECT n AS communities, x[1] AS min_size, x[n // 2 + 1] AS p50, x[least(n - 1, floor(n * 0.95)::BIGINT) + 1] AS p95, x[n] AS max_size FROM l")
def community_size_stats(spark, d):
    return com.size_stats(_nation_labels(spark, d))


@_query(_SIZES + " SELECT 10 AS k, round((SELECT sum(size) FROM (SELECT size FROM s ORDER BY size DESC, community_id LIMIT 10)) * 100.0 / sum(size), 9) AS share_pct FROM s")
def topk_share(spark, d):
    return com.top_share(_nation_labels(spark, d)).select("k", F.round("share_pct", 9).alias("share_pct"))


@_query(_SIZES + " SELECT size, count(*) AS communities FROM s GROUP BY size")
def fingerprint(spark, d):
    return com.fingerprint(_nation_labels(spark, d))


@_query(_lpa(_NATION, 10) + """, l AS (SELECT id, label FROM lpa WHERE it = 10),
 p AS (SELECT a.label AS c, count(*) AS deg, sum((a.label = b.label)::INT) AS inner_ FROM a0 JOIN l a ON a.id = src JOIN l b ON b.id = dst GROUP BY a.label)
 SELECT round(sum(inner_ / m2 - (deg / m2) ** 2), 9) AS modularity FROM p, (SELECT sum(deg)::DOUBLE AS m2 FROM p)""")
def modularity(spark, d):
    graph = Graph.from_edges(g_nation(spark, d))
    return com.modularity(graph.arcs, lpa.label_propagation(graph, 10).labels).select(F.round("modularity", 9).alias("modularity"))


# ---------------------------------------------------------------- reports, on metric rows made from events

_METRICS = """m AS (SELECT event_type AS approach, (1 + user_id % 3)::DOUBLE AS fraction_pct, (event_id % 5)::INT AS run_index, (2 + 2 * (user_id % 2))::INT AS workers_requested,
  value AS total_time_s, value / 2 AS algorithm_time_s, value * 3 AS peak_process_tree_rss_mb, value * 2 AS peak_driver_rss_mb, 1000 / (1 + value) AS throughput_nodes_per_s,
  user_id AS num_communities, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 7 = 0 THEN 'event ' || event_id END AS error_message FROM events)"""


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").selectExpr(
        "event_type as approach", "cast(1 + user_id % 3 as double) as fraction_pct", "cast(event_id % 5 as int) as run_index", "cast(2 + 2 * (user_id % 2) as int) as workers_requested",
        "value as total_time_s", "value / 2 as algorithm_time_s", "value * 3 as peak_process_tree_rss_mb", "value * 2 as peak_driver_rss_mb", "1000 / (1 + value) as throughput_nodes_per_s",
        "user_id as num_communities", "if(event_id % 7 = 0, 'failed', 'success') as status", "if(event_id % 7 = 0, concat('event ', event_id), null) as error_message",
    )


@_query(f"""WITH {_METRICS} SELECT approach, fraction_pct, count(*) AS runs, round(avg(total_time_s), 6) AS total_mean, round(stddev_pop(total_time_s), 6) AS total_sd,
 round(avg(algorithm_time_s), 6) AS algo_mean, round(stddev_pop(algorithm_time_s), 6) AS algo_sd, round(avg(peak_process_tree_rss_mb), 6) AS tree_mean, round(stddev_pop(peak_process_tree_rss_mb), 6) AS tree_sd,
 round(avg(peak_driver_rss_mb), 6) AS driver_mean, round(stddev_pop(peak_driver_rss_mb), 6) AS driver_sd, round(avg(throughput_nodes_per_s), 6) AS throughput_mean, round(stddev_pop(throughput_nodes_per_s), 6) AS throughput_sd,
 round(avg(num_communities), 6) AS communities_mean FROM m WHERE status = 'success' GROUP BY ALL""")
def report_group_stats(spark, d):
    out = rep.group_stats(metric_rows(spark, d))
    return out.select(*(F.round(c, 6).alias(c) if c.endswith(("_mean", "_sd")) else c for c in out.columns))


_PIVOT = "SELECT fraction_pct, round(avg({0}) FILTER (workers_requested = 2), 6) AS w2, round(avg({0}) FILTER (workers_requested = 4), 6) AS w4 FROM m WHERE status = 'success' AND approach = 'click' GROUP BY fraction_pct"


@_query(f"WITH {_METRICS} " + _PIVOT.format("throughput_nodes_per_s"))
def report_pivot_throughput(spark, d):
    return rep.scalability_pivot(metric_rows(spark, d), "click", "throughput_nodes_per_s", workers=[2, 4]).select("fraction_pct", F.round("w2", 6).alias("w2"), F.round("w4", 6).alias("w4"))


@_query(f"WITH {_METRICS} " + _PIVOT.format("peak_process_tree_rss_mb / 1024"))
def report_pivot_memory(spark, d):
    return rep.scalability_pivot(metric_rows(spark, d), "click", "peak_process_tree_rss_mb", 1 / 1024, workers=[2, 4]).select("fraction_pct", F.round("w2", 6).alias("w2"), F.round("w4", 6).alias("w4"))


@_query(f"WITH {_METRICS} SELECT approach, fraction_pct, run_index, error_message FROM m WHERE status <> 'success'")
def report_failures(spark, d):
    return rep.failures(metric_rows(spark, d))


@_query(f"WITH {_METRICS} SELECT approach, fraction_pct, run_index, status FROM m WHERE NOT (approach = 'click' AND fraction_pct = 1 AND run_index = 0) UNION ALL SELECT 'click', 1.0, 0, 'replaced'")
def report_override_merge(spark, d):
    base = metric_rows(spark, d).select("approach", "fraction_pct", "run_index", "status")
    new = spark.createDataFrame([("click", 1.0, 0, "replaced")], base.schema)
    return rep.override_merge(base, new, ["approach", "fraction_pct", "run_index"])


@_query("SELECT event_id AS run_index, (k - 1)::INT AS iter, round(value * k, 6) AS seconds FROM events, range(1, 4) t(k)")
def iteration_series(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("run_index"), F.to_json(F.array(*(F.round(F.col("value") * k, 6) for k in (1, 2, 3)))).alias("level_times_json"))
    return rep.iteration_series(rows)


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.format_string("2026-01-01T00:00:00Z [x] [%s][iter=%d] changed=%d/%d (1.0%%) workers=4 elapsed=%.2fs", "event_type", 1 + F.col("event_id") % 9, "user_id", F.col("user_id") + F.col("event_id"), (F.col("event_id") % 60) / 4.0)
    return _t(spark, d, "events").select(line.alias("value"))


@_query("SELECT event_type AS backend, (1 + event_id % 9)::INT AS iter, user_id AS changed, user_id + event_id AS total, (event_id % 60) / 4.0::DOUBLE AS elapsed_s FROM events")
def log_parse(spark, d):
    return rep.parse_log(_log_lines(spark, d))


@_query("SELECT event_type AS backend, (1 + event_id % 9)::INT AS iter, round(avg(user_id), 6) AS changed FROM events GROUP BY ALL")
def convergence_series(spark, d):
    return rep.convergence_series(_log_lines(spark, d)).withColumn("changed", F.round("changed", 6))


@_query(f"WITH {_METRICS} SELECT approach, run_index, total_time_s FROM m WHERE fraction_pct = 2")
def metrics_by_fraction(spark, d):
    return rep.by_fraction(metric_rows(spark, d), 2).select("approach", "run_index", "total_time_s")


@_query("SELECT event_id, CASE WHEN props IS NULL OR props = '' THEN event_type ELSE props END AS given FROM events")
def first_given(spark, d):
    return _t(spark, d, "events").select("event_id", lab.first_given(F.col("props"), F.col("event_type")).alias("given"))


@_query("SELECT event_type AS approach, round(min(value), 6) AS min_s, round(median(value), 6) AS median_s, round(max(value), 6) AS max_s, round(sum(value), 4) AS sum_s FROM events GROUP BY event_type")
def timing_stats(spark, d):
    out = rep.timing_stats(_t(spark, d, "events").select(F.col("event_type").alias("approach"), F.col("value").alias("seconds")))
    return out.select("approach", *(F.round(c, 4 if c == "sum_s" else 6).alias(c) for c in ("min_s", "median_s", "max_s", "sum_s")))


@_query("SELECT 'host' || user_id % 5 AS host, max(value) AS peak_rss_mb FROM events GROUP BY ALL")
def vm_peaks(spark, d):
    return rep.max_per_host(_t(spark, d, "events").select(F.concat(F.lit("host"), F.col("user_id") % 5).alias("host"), F.col("value").alias("peak_rss_mb")))


@_query("SELECT sum(p) AS peak_cluster_rss_mb FROM (SELECT max(value) AS p FROM events GROUP BY user_id % 5)")
def cluster_peak(spark, d):
    rows = _t(spark, d, "events").select(F.concat(F.lit("host"), F.col("user_id") % 5).alias("host"), F.col("value").alias("peak_rss_mb"))
    return rep.cluster_peak(rep.merge_peaks(rows, rows.where("false"), 0.0))


# ---------------------------------------------------------------- estimates and scalars

_SIZES_OF = "n AS (SELECT c_custkey AS nodes, c_custkey * 76 AS arcs FROM customer)"


def _size_rows(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("nodes"), (F.col("c_custkey") * 76).alias("arcs"))


@_query(f"WITH {_SIZES_OF} SELECT nodes, arcs, 8 * nodes + 4 + 4 * arcs AS steady_bytes, 8 * nodes + 4 + 16 * arcs AS peak_bytes FROM n")
def estimate_csr(spark, d):
    return est.csr_bytes(_size_rows(spark, d))


@_query(f"WITH {_SIZES_OF} SELECT arcs, round(420.0 * arcs / 234370166 * 0.7, 9) AS load_low_s, round(420.0 * arcs / 234370166 * 1.4, 9) AS load_high_s FROM n")
def estimate_time(spark, d):
    out = est.load_time(_size_rows(spark, d))
    return out.select("arcs", F.round("load_low_s", 9).alias("load_low_s"), F.round("load_high_s", 9).alias("load_high_s"))


#: The calibration figures of functions.estimates, spelled out.
@_query(f"""WITH {_SIZES_OF} SELECT arcs, round(84.57 * pow(arcs / 1880997.0, ln(84.57 / 2.26) / ln(1880997.0 / 3910)), 6) AS low_s, round(84.57 * (arcs / 1880997.0), 6) AS high_s FROM n""")
def estimate_extrapolated(spark, d):
    out = est.extrapolate(_size_rows(spark, d), "ray")
    return out.select("arcs", F.round("low_s", 6).alias("low_s"), F.round("high_s", 6).alias("high_s"))


@_query(f"""WITH {_SIZES_OF}, f AS (SELECT *, CASE WHEN nodes % 3 = 0 THEN 100.0 ELSE 10.0 END::DOUBLE AS fraction_pct FROM n)
 SELECT fraction_pct, arcs, round(CASE WHEN fraction_pct >= 100 THEN 110.36 * pow(234000000 / 1880997.0, ln(110.36 / 7.76) / ln(1880997.0 / 3910)) ELSE arcs / 1880997.0 * 110.36 * 0.6 END, 6) AS low_s,
 round(CASE WHEN fraction_pct >= 100 THEN 110.36 * (234370166 / 1880997.0) ELSE arcs / 1880997.0 * 110.36 END, 6) AS high_s FROM f""")
def estimate_for_fraction(spark, d):
    rows = _size_rows(spark, d).withColumn("fraction_pct", F.expr("cast(if(nodes % 3 = 0, 100, 10) as double)"))
    return est.for_fraction(rows, "dask").select("fraction_pct", "arcs", F.round("low_s", 6).alias("low_s"), F.round("high_s", 6).alias("high_s"))


@_query(f"""WITH {_SIZES_OF}, g AS (SELECT *, (8 * nodes + 4 + 4 * arcs) / 1048576.0 AS mb, (8 * 163280 + 4 + 4 * 1880997) / 1048576.0 AS ref FROM n)
 SELECT nodes, arcs, round((8 * nodes + 4 + 16 * arcs) / 1048576.0 * 0.9 + 300, 6) AS load_peak_mb, round(greatest(200.0, 567.0 - ref) + mb * 1.1, 6) AS driver_mb, round(greatest(1.0, mb / ref) * 1578.0, 6) AS tree_mb FROM g""")
def estimate_host(spark, d):
    out = est.host_memory(_size_rows(spark, d), "ray")
    return out.select("nodes", "arcs", *(F.round(c, 6).alias(c) for c in ("load_peak_mb", "driver_mb", "tree_mb")))


@_query(f"WITH {_SIZES_OF} SELECT arcs, round((8 * nodes + 4 + 4 * arcs) / 1048576.0, 9) AS mb, round(arcs / 60.0, 9) AS minutes FROM n")
def unit_conversions(spark, d):
    rows = _size_rows(spark, d)
    size = est.steady_bytes(F.col("nodes"), F.col("arcs"))
    return rows.select("arcs", F.round(est.to_mb(size), 9).alias("mb"), F.round(est.to_minutes(F.col("arcs")), 9).alias("minutes"))


@_query("SELECT o_orderkey, [o_orderkey::DOUBLE, o_custkey / 2] AS numbers FROM orders")
def number_lists(spark, d):
    text = F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(", ,"), (F.col("o_custkey") / 2).cast("string"), F.lit(","))
    return _t(spark, d, "orders").select("o_orderkey", lab.number_list(text).alias("numbers"))


@_query("SELECT c_custkey AS k, CASE WHEN c_custkey >= 400 THEN '100pct' ELSE replace(rtrim(rtrim(printf('%.2f', c_custkey / 4), '0'), '.'), '.', 'p') || 'pct' END AS label FROM customer")
def figure_labels(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), lab.figure_label(F.col("c_custkey") / F.lit(4.0)).alias("label"))


@_query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey // 4)::VARCHAR ELSE replace((c_custkey / 4.0)::DOUBLE::VARCHAR, '.', 'p') END AS label, c_custkey / 4.0::DOUBLE AS fraction FROM customer")
def fraction_labels(spark, d):
    f = (F.col("c_custkey") / F.lit(4.0)).alias("f")
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), f)
    return rows.select("k", lab.fraction_label(F.col("f")).alias("label")).withColumn("fraction", lab.parse_fraction_label(F.col("label")))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%S') AS stamp FROM orders")
def run_stamps(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", lab.run_stamp(F.col("o_orderdate")).alias("s"))
    return rows.select("o_orderkey", lab.stamp_of_file(F.concat(F.lit("metrics_raw_"), "s", F.lit(".csv"))).alias("stamp"))


@_query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_orderkey / (o_custkey % 10)::DOUBLE END AS throughput FROM orders")
def throughput(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", lab.throughput(F.col("o_orderkey"), (F.col("o_custkey") % 10).cast("double")).alias("throughput"))


@_query(f"""WITH {_METRICS} SELECT f AS fraction_pct, w AS workers, a AS approach, r::INT AS run_index, 42 + r AS seed
 FROM (SELECT DISTINCT fraction_pct AS f FROM m), (SELECT DISTINCT workers_requested AS w FROM m), (SELECT DISTINCT approach AS a FROM m), range(3) x(r)""")
def grid_plan(spark, d):
    return rep.grid_again(metric_rows(spark, d), 3, 42)


@_query("SELECT user_id AS src, event_id AS dst FROM events WHERE event_id % 4 < 2 AND user_id <> event_id")
def edge_list_parse(spark, d):
    kind = F.col("event_id") % 4
    line = F.when(kind == 0, F.format_string("%d\t%d", "user_id", "event_id")).when(kind == 1, F.format_string("  %d   %d extra", "user_id", "event_id")).when(kind == 2, F.format_string("# %d %d", "user_id", "event_id")).otherwise(F.format_string("%d.5 x", "user_id"))
    return src.parse_lines(_t(spark, d, "events").select(line.alias("value")))


@_query(f"WITH {_with(_HOUR)} SELECT src, dst FROM a0 WHERE src IN ({_WORTHY}) AND dst IN ({_WORTHY})")
def edge_list_subset(spark, d):
    return Graph.from_edges(g.induced(g_hour(spark, d), _worthy(spark, d))).arcs
