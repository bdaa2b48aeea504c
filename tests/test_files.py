"""CSR files, clusters as files, walks and ties that follow the order of the text, and peaks of executors."""

import json
import random
from collections import deque
from hashlib import md5

import numpy as np
import pytest

from loomgraph import model
from loomgraph.functions import names
from loomgraph.model import Graph
from loomgraph.operators import traverse as tr
from loomgraph.plans import memory
from loomgraph.sources import csr, edges, results
from loomgraph.store import cut
from tests.test_lpa import graph_of


def arcs_of(graph):
    return sorted(tuple(r) for r in graph.arcs.collect())


def test_csr_parts(spark, tmp_path):
    rng = random.Random(3)
    graph = graph_of(spark, [(900, k) for k in range(60)] + [(rng.randrange(80), rng.randrange(2**40)) for _ in range(50)])
    nodes = cut(graph.nodes.unionAll(spark.createDataFrame([(10**12,)], "id long")))  # one without arcs
    csr.write_csr(Graph(nodes, cut(graph.arcs)), str(tmp_path / "g"), 25)
    again = csr.read_csr(spark, str(tmp_path / "g"))
    assert arcs_of(again) == arcs_of(graph) and sorted(r["id"] for r in again.nodes.collect()) == sorted(r["id"] for r in nodes.collect())
    files = sorted((tmp_path / "g").iterdir())
    assert len(files) > 8 and not [f for f in files if f.name.startswith("_")]
    parts = [np.load(f) for f in files if f.name.startswith("arcs")]
    assert {len(p["neighbors"]) for p in parts[:-1]} == {25}
    hub = sorted(r["id"] for r in nodes.collect()).index(900)
    assert sum(hub in p["rows"] for p in parts) >= 3  # its arcs go on in the next part
    csr.write_csr(graph_of(spark, [(1, 2)]), str(tmp_path / "g"), 25)  # replaces
    assert arcs_of(csr.read_csr(spark, str(tmp_path / "g"))) == [(1, 2), (2, 1)] and len(list((tmp_path / "g").iterdir())) == 2


def test_csr_of_a_single_file(spark, tmp_path):
    np.savez_compressed(tmp_path / "x.npz", node_ids=np.array([5, 7, 9], np.int32), indptr=np.array([0, 2, 2, 3], np.int32), neighbors=np.array([1, 2, 0], np.int32), m=np.array(3.0))
    got = csr.read_csr(spark, str(tmp_path / "x.npz"))
    assert arcs_of(got) == [(5, 7), (5, 9), (9, 5)] and got.node_count() == 3


def test_an_unfinished_write_leaves_no_part(tmp_path):
    import pyarrow as pa

    writer = csr.CsrWriter(str(tmp_path / "g"), "nodes", True)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 1]), pa.array([0, 0, 2]), pa.array([0, 1, 2]), pa.array([4, 5, 6])], names=["part", "first", "a", "b"])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch.slice(0, 1), batch.slice(1)]))
    assert len(lost.files) == len(kept.files) == 2 and not list((tmp_path / "g").glob("*.npz"))
    writer.commit([kept])  # the other task was run again
    assert [np.load(f)["ids"].tolist() for f in sorted((tmp_path / "g").iterdir())] == [[4, 5], [6]]


def test_clusters_of_a_large_graph(spark, tmp_path, monkeypatch):
    labels = spark.createDataFrame([(k, k % 7 if k < 60 else k) for k in range(90)], "id long, label long")
    small = json.loads(results.write_communities(tmp_path, "a", labels).read_text())
    monkeypatch.setattr(model, "LISTED_NODES", 89)
    at = results.write_communities(tmp_path, "b", labels, "blocks")
    manifest = json.loads(at.read_text())
    assert manifest["num_communities"] == small["num_communities"] == 37 and manifest["approach"] == "blocks" and not manifest["include_node_ids"]
    assert manifest["clusters_path"] == names.clusters_dir(at)
    clusters, told = results.read_clusters(spark, manifest["clusters_path"])
    assert told == manifest and clusters.columns == ["cluster_index", "community_id", "size"]
    want = [(c["cluster_index"], c["community_id"], c["size"]) for c in small["clusters"]]
    assert [tuple(r) for r in clusters.orderBy("cluster_index").collect()] == want
    ends = [(f["first"], f["last"]) for f in manifest["files"]]
    assert ends[0][0] == 1 and ends[-1][1] == 37 and all(a[1] + 1 == b[0] for a, b in zip(ends, ends[1:], strict=False))
    nested = results.write_clusters(labels, str(tmp_path / "c"), include_node_ids=True)
    members = {r["community_id"]: r["node_ids"] for r in results.read_clusters(spark, nested["clusters_path"])[0].collect()}
    assert members == {c["community_id"]: c["node_ids"] for c in small["clusters"]}
    assert results.write_clusters(labels.where("false"), str(tmp_path / "d"))["num_communities"] == 0


def walk_by_hand(pairs, start, seed):
    near = {}
    for u, v in pairs:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    key = lambda x: (md5(f"{seed}:{x}".encode()).hexdigest(), x)
    order, seen, queue = [], {start}, deque([(start, 0)])
    while queue:
        u, d = queue.popleft()
        order.append((u, d))
        for v in sorted(near.get(u, ()), key=key):
            if v not in seen:
                seen.add(v)
                queue.append((v, d + 1))
    return [(u, d, k) for k, (u, d) in enumerate(order)]


def test_walk_visits_as_a_queue_does(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(200, 201)]
    frame = cut(spark.createDataFrame(pairs, "src long, dst long"))
    got = sorted((tuple(r) for r in tr.walk_order(frame, 7, 3).collect()), key=lambda r: r[2])
    want = walk_by_hand(pairs, 7, 3)
    assert got == want and len(want) > 40
    nodes = spark.createDataFrame([(u,) for u, _, _ in want], "id long")
    assert {r["id"] for r in tr.walk_sample(frame, nodes, 30.0, 3, 7).collect()} == {u for u, _, _ in want[: int(len(want) * 0.3)]}


def test_ties_go_to_the_earliest_edge(spark, tmp_path):
    """Components of one size, over several files that are read in small splits."""
    folder = tmp_path / "e"
    folder.mkdir()
    rng = random.Random(1)
    chains = [[(100 * k + j, 100 * k + j + 1) for j in range(20)] for k in range(8)]
    lines = [e for c in chains for e in c]
    rng.shuffle(lines)
    for k in range(3):
        (folder / f"part{k}.txt").write_text("# text\n" + "".join(f"{u} {v}\n" for u, v in lines[k::3]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        numbered = cut(edges.read_numbered(spark, str(folder)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    text = [e for k in range(3) for e in lines[k::3]]
    assert [(r["src"], r["dst"]) for r in numbered.orderBy("place").collect()] == text
    first = text[0][0] // 100
    assert {r["id"] for r in tr.earliest_largest_component(numbered).collect()} == {x for e in chains[first] for x in e}
    loaded = edges.load_graph(spark, str(folder), ties="text")
    assert loaded.node_count == 21 and {r["id"] // 100 for r in loaded.graph.nodes.collect()} == {first}


def test_every_executor_has_a_peak(spark):
    rows = memory.executor_peaks(spark).collect()
    assert [r["executor"] for r in rows] == ["driver"] and rows[0]["peak_mb"] >= 0


def test_a_campaign_in_a_store(spark, tmp_path, monkeypatch):
    """All outputs by paths with a scheme, which only Hadoop's file systems open."""
    from loomgraph import cli
    from loomgraph.sources import shared

    (tmp_path / "toy.txt").write_text("0 1\n1 2\n0 2\n")
    store = f"file://{tmp_path}/out"
    monkeypatch.setattr(cli, "_session", lambda workers: spark)
    monkeypatch.setenv("LOOMGRAPH_OUTPUT_DIR", store)
    args = ["benchmark", f"file://{tmp_path}/toy.txt", "--workers", "2", "--runs", "1", "--max-iter", "2"]
    assert cli.main([*args, "--approaches", "frame", "--run-stamp", "20260613T205342"]) == 0
    assert cli.main([*args, "--approaches", "blocks", "--append"]) == 0
    assert names.read_stamp(store, spark) == "20260613T205342"
    at = names.latest_metrics_csv(store, spark)
    assert at == names.metrics_csv(store, "20260613T205342")
    rows = edges.read_metrics(spark, at).collect()
    assert sorted(r["approach"] for r in rows) == ["blocks", "frame"] and {r["status"] for r in rows} == {"success"}
    found = json.loads(shared.get(spark, rows[0]["communities_json"]))
    assert found["clusters"][0]["node_ids"] == [0, 1, 2]
    assert cli.main(["report"]) == 0 and "## Runs" in shared.get(spark, names.comparison_md(store, "20260613T205342"))
    log = shared.get(spark, names.run_log(store, "20260613T205342"))
    assert log.count('"campaign"') >= 2 and "[blocks][done]" in log
    older = f"{store}/metrics_raw_20200101T000000.csv"
    shared.put(spark, older, "approach\n")
    (tmp_path / "out" / "metrics_raw_20200101T000000.csv").touch()
    assert names.latest_metrics_csv(store, spark) == older  # by the time it was written, not by its name
    assert cli.main(["benchmark", f"{store}/none.txt"]) == 1
    with pytest.raises(FileNotFoundError):
        names.latest_metrics_csv(f"{store}/nowhere", spark)


def test_unknown_approaches_exit_1(tmp_path, capsys):
    from loomgraph import cli

    (tmp_path / "toy.txt").write_text("0 1\n")
    assert cli.main(["benchmark", str(tmp_path / "toy.txt"), "--approaches", "frame,other"]) == 1
    assert cli.main(["lpa", str(tmp_path / "toy.txt"), "--approach", "other"]) == 1
    assert "no such approach: other" in capsys.readouterr().err
