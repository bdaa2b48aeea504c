"""Construction, traversal, sources, reports and queries."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph import queries
from loomgraph.functions import estimates as est
from loomgraph.model import Graph
from loomgraph.operators import communities as com
from loomgraph.operators import graph as g
from loomgraph.operators import report as rep
from loomgraph.operators import traverse as tr
from loomgraph.operators.components import connected_components
from loomgraph.operators.skew import join_keyed
from loomgraph.sources import edges as src
from loomgraph.sources.generate import preferential_attachment

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_parser(spark, tmp_path):
    lines = ["# c", "1 2", "3\t4 9", "x 1", "", "5", "1.5 2", "+7 8", " 6 7 ", "\t6\t7", "3 3", " # 1", "1_0 2"]
    (tmp_path / "e.txt").write_text("\n".join(lines))
    assert pairs(src.read_edge_list(spark, str(tmp_path / "e.txt"))) == [(1, 2), (3, 4), (6, 7), (6, 7), (7, 8)]


def test_construction(spark):
    graph = Graph.from_edges(frame(spark, [(1, 1), (1, 2), (1, 2), (3, 1)]))
    assert pairs(graph.arcs) == [(1, 2), (1, 3), (2, 1), (3, 1)]
    assert pairs(g.csr_offsets(graph.nodes, graph.arcs)) == [(1, 0, 2), (2, 2, 3), (3, 3, 4)]
    assert pairs(g.dense_index(graph.nodes)) == [(1, 0), (2, 1), (3, 2)]


@pytest.mark.parametrize(("n", "d", "want"), [(10, 4, [3, 3, 3, 1]), (9, 6, [2, 2, 2, 2, 1]), (3, 100, [1, 1, 1]), (1, 8, [1]), (0, 4, [])])
def test_chunks(spark, n, d, want):
    got = g.node_chunks(spark.range(n), d).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == want


def test_components_of_a_random_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert dict(pairs(connected_components(frame(spark, edges)))) == {x: find(x) for x in root}
    assert connected_components(frame(spark, [])).count() == 0


def test_sample_of_a_path_is_connected(spark):
    path = frame(spark, [(i, i + 1) for i in range(99)])
    got = sorted(r["id"] for r in tr.connected_sample(path, g.endpoints(path), 10, 42).collect())
    assert len(got) == 10 and got == list(range(got[0], got[0] + 10))


def test_artifact_round_trip_and_reuse(spark, tmp_path):
    (tmp_path / "e.txt").write_text("\n".join(f"{i} {i + 1}" for i in range(60)))
    at = str(tmp_path / "a")
    assert src.ensure_fraction(spark, str(tmp_path / "e.txt"), at, "path", 20.0, 7)
    assert not src.ensure_fraction(spark, str(tmp_path / "e.txt"), at, "path", 20.0, 7)
    assert src.ensure_fraction(spark, str(tmp_path / "e.txt"), at, "path", 20.0, 8)
    got = src.load_graph(spark, at, format="artifact")
    assert got.node_count == 12 and got.fraction_pct == 20.0
    with pytest.raises(ValueError):
        src.ensure_fraction(spark, "x", at, "path", 100.0, 7)


def test_artifact_paths_and_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        src.read_artifact(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        src.load_graph(spark, str(tmp_path), format="other")
    (tmp_path / "e.txt").write_text("0 1\n1 2\n0 2\n5 6\n")
    whole = src.load_for_benchmark(spark, str(tmp_path / "e.txt"), 100.0, 1, "e", samples_dir=str(tmp_path / "s"))
    assert (whole.node_count, whole.edge_count) == (3, 6) and not (tmp_path / "s").exists()
    loose = src.load_graph(spark, str(tmp_path / "e.txt"), restrict=False, directed=True)
    assert (loose.node_count, loose.edge_count) == (5, 4)
    src.write_artifact(whole.graph, str(tmp_path / "a"), {"fraction_pct": 100.0})
    again = src.load_for_benchmark(spark, str(tmp_path / "a"), 10.0, 1, "e")  # an artifact carries its own fraction
    assert again.fraction_pct == 100.0 and pairs(again.graph.arcs) == pairs(whole.graph.arcs)


def test_edge_reads(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n2 3\n2 3\n3 9\n")
    some = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert pairs(src.read_edges(spark, str(tmp_path / "e.txt"), directed=True)) == [(1, 2), (2, 3), (2, 3), (3, 9)]
    assert pairs(src.read_edges(spark, str(tmp_path / "e.txt"), nodes=some)) == [(1, 2), (2, 1), (2, 3), (2, 3), (3, 2), (3, 2)]
    assert src.read_edges(spark, str(tmp_path / "e.txt"), nodes=some.where("false")).count() == 0
    assert sorted(r["id"] for r in src.collect_node_set(spark, str(tmp_path / "e.txt")).collect()) == [1, 2, 3, 9]


def test_graph_lookups(spark):
    graph = Graph.from_csr(spark, [3, 5, 9], [0, 2, 2, 3], [1, 2, 0])
    assert pairs(graph.arcs) == [(3, 5), (3, 9), (9, 3)] and graph.degree(3) == 2.0 and graph.degree(5) == graph.degree(77) == 0.0
    assert [r["id"] for r in graph.neighbors(3).collect()] == [5, 9] and graph.neighbors(77).count() == 0
    asked = spark.createDataFrame([(9,), (4,)], "id long")
    assert dict(pairs(graph.contains(asked))) == {9: True, 4: False} and dict(pairs_or_none(graph.index_of(asked))) == {9: 2, 4: None}
    with pytest.raises(ValueError):
        Graph.from_csr(spark, [1], [0], [])


def pairs_or_none(df):
    return [tuple(r) for r in df.collect()]


def test_generated_graph(spark):
    edges = preferential_attachment(spark, 200, 3, 7)
    graph = Graph.from_edges(edges)
    assert edges.count() == 3 * 197 and graph.node_count() == 200 and graph.arc_count() == 6 * 197
    assert pairs(edges) == pairs(preferential_attachment(spark, 200, 3, 7))
    assert connected_components(edges).select("component").distinct().count() == 1


def test_components_with_a_hot_centre(spark):
    star = [(0, k) for k in range(1, 3000)] + [(5000, 5001), (5002, 5001)]
    got = dict(pairs(connected_components(frame(spark, star))))
    assert set(got.values()) == {0, 5000} and got[2999] == 0 and got[5002] == 5000


def test_join_to_a_hot_key(spark):
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(5000)] + [(None, -1), (99, -2)], "k long, v long")
    keyed = rows.where("k < 7").groupBy("k").count().withColumn("name", F.concat(F.lit("n"), "k"))
    got = {r["v"]: r["name"] for r in join_keyed(rows, keyed, ["k"], "count", 5000).collect()}
    assert len(got) == 5002 and got[-1] is None and got[-2] is None and got[0] == "n0" and got[13] == "n6"


def test_layers_of_a_long_path(spark):
    path = frame(spark, [(i, i + 1) for i in range(40)])
    assert dict(pairs(tr.bfs_distances(path, 0))) == {i: i for i in range(41)}


def test_communities(spark):
    labels = spark.createDataFrame([(1, 100), (2, 100), (3, 200), (4, 200), (5, 200)], "id long, label long")
    first = com.payload(labels)["clusters"][0]
    assert first["size"] == 3 and first["node_ids"] == [3, 4, 5] and first["cluster_index"] == 1
    assert tuple(com.size_stats(labels).first()) == (2, 2, 3, 3, 3)
    assert com.payload_of(spark, {1: 100, 2: 100, 3: 200}, "frame")["approach"] == "frame" and com.payload_of(spark, {})["clusters"] == []
    tie = com.payload_of(spark, {0: 10, 1: 10, 2: 20, 3: 20})["clusters"]
    assert [c["community_id"] for c in tie] == [10, 20]
    many = spark.createDataFrame([(i * 100 + j, i) for i in range(1, 41) for j in range(i)], "id long, label long")
    assert tuple(com.size_stats(many).first()) == (40, 1, 21, 39, 40)
    assert tuple(com.size_stats(labels.where("false")).first()) == (0, 0, 0, 0, 0)


def test_memory_model(spark):
    got = est.csr_bytes(spark.createDataFrame([(163280, 1880997), (1632, 9774), (3072441, 234370166)], "nodes long, arcs long")).collect()
    assert [(r[2], r[3]) for r in got] == [(8830232, 31402196), (52156, 169444), (962060196, 3774502188)]


def test_peaks(spark):
    s = "host string, peak_rss_mb double"
    many = rep.merge_peaks(spark.createDataFrame([("a", 600.0), ("b", 400.0)], s), spark.createDataFrame([("c", 350.0)], s), 900.0)
    assert rep.cluster_peak(many).first()[0] == 1350
    one = rep.merge_peaks(spark.createDataFrame([("a", 500.0)], s), spark.createDataFrame([("a", 450.0)], s), 1400.0)
    assert rep.cluster_peak(one).first()[0] == 1400


@pytest.mark.parametrize("name", ["lpa_labels", "graph_csr_offsets", "components", "induced_edges", "community_size_stats", "modularity", "report_group_stats", "log_parse", "edge_list_parse", "lpa_bipartite_parity", "lpa_iterations", "number_lists", "estimate_host", "estimate_for_fraction"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.ORACLES) <= set(entry.oracle_sql()) and set(queries.QUERIES) <= set(entry.queries())


def test_tasks_of_large_graphs_hold_few_rows(spark, monkeypatch):
    """Spark joins a shuffle's small partitions up to one a core; arcs and lists are dealt by their number instead."""
    from loomgraph.operators import sizes

    monkeypatch.setattr(sizes, "TASK_ROWS", 500)
    edges = spark.range(4000).selectExpr("id as src", "(id * 7 + 1) % 4000 as dst")
    graph = Graph.from_edges(edges, rows=4000)
    for frame in (graph.arcs, g.adjacency(graph.arcs, graph.rows)):
        rows = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
        assert len(rows) >= 12 and max(rows) <= 1000
    want = {(a, b) for r in edges.collect() for a, b in ((r[0], r[1]), (r[1], r[0])) if a != b}
    assert {tuple(r) for r in graph.arcs.collect()} == want and graph.arcs.count() == len(want)


def test_a_search_moves_no_edges_outside_its_nodes(spark, monkeypatch):
    """Edges are restricted before both directions are dealt into buckets, of which there are as many as these arcs need."""
    seen = []
    real = tr.bucketed
    monkeypatch.setattr(tr, "bucketed", lambda df, key, n, sort: seen.append((df.count(), n)) or real(df, key, n, sort))
    inner = [(i, i + 1) for i in range(10)]
    edges = spark.createDataFrame(inner + inner[:3] + [(i, i + 1) for i in range(100, 900)], "src long, dst long")
    nodes = spark.range(11)
    got = {r["id"]: r["dist"] for r in tr.bfs_distances(edges, 4, nodes).collect()}
    walk = {r["id"]: r["dist"] for r in tr.walk_order(edges, 4, 42, nodes).collect()}
    assert got == walk == {i: abs(i - 4) for i in range(11)}
    assert seen == [(26, spark.sparkContext.defaultParallelism)] * 2


def test_tasks_of_the_day_graph_hold_few_rows(spark, monkeypatch):
    from loomgraph.operators import sizes

    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    monkeypatch.setattr(sizes, "TASK_ROWS", n // 8)
    graph = queries._day_graph(spark, SF)
    assert graph.rows == 2 * n
    rows = [r["count"] for r in graph.arcs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= 12 and max(rows) <= n // 4
