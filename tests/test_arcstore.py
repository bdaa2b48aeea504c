"""Arcs in two indexes: what they hold, that rounds don't move them, and labels across hubs, approaches and artifacts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.operators import arcstore
from loomgraph.operators import graph as g
from loomgraph.operators.arcstore import ArcStore, arcs_of, co_partitioned
from loomgraph.plans import lpa
from loomgraph.sources import edges as src
from loomgraph.store import cut
from tests.test_lpa import graph_of, simulate


@pytest.fixture(scope="module")
def hubs():
    """Two hubs among sparse random edges."""
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)]
    return edges + [(500, k) for k in range(0, 120, 2)] + [(501, k) for k in range(0, 120, 3)]


def test_store_holds_each_arc_once_and_a_mirror_for_each_home(spark, hubs):
    graph = graph_of(spark, hubs)
    store = ArcStore.build(graph.arcs, block=8)
    arcs = [tuple(r) for r in arcs_of(store.blocks).collect()]
    assert sorted((s, d) for _, s, _, d in arcs) == sorted(tuple(r) for r in graph.arcs.collect())
    degree = {r["src"]: r["count"] for r in graph.arcs.groupBy("src").count().collect()}
    assert {s for _, s, cut, _ in arcs if cut} == {s for s, n in degree.items() if n > 8} and store.hubs == sum(n > 8 for n in degree.values())
    assert len({h for h, s, _, _ in arcs if s == 500}) > 3  # spread out
    assert sorted((r["id"], r["at"]) for r in store.mirrors.collect()) == sorted({(d, h) for h, _, _, d in arcs})
    store.close()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_arcs(plan):
    """Exchanges that have a scan of arc blocks below them."""
    found, depth = [], None
    for line in plan.splitlines():
        at = len(re.match(r"[\s:|+\-*()\d]*", line)[0])
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "Exchange" in line and "ReusedExchange" not in line:
            depth = at
        if depth is not None and "FileScan" in line and "dsts" in line:
            found.append(line)
    return found


@pytest.mark.parametrize("approach", ["frame", "blocks"])
def test_rounds_move_no_arc(spark, approach):
    graph = graph_of(spark, [(k, (k * 7 + 3) % 200) for k in range(200)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with co_partitioned(spark):
            store = ArcStore.build(graph.arcs)
            state = cut(graph.nodes.select(store.home("id"), "id", "id", "id", "id").toDF("home", "id", "label", "prev", "base"))
            rounds = lpa.Rounds(store, lpa.APPROACHES[approach])
            for few in (False, True):
                based, votes = rounds.next(state, few, False)
                # what comes out of Python has no known partitions, so its winners (a row a node) move to the states
                plan = plan_of(votes[0] if approach == "blocks" else based.join(votes[0], ["home", "id"], "left"))
                assert "dsts" in plan and not shuffled_arcs(plan)
                assert len(votes) == 1  # no hub, nothing to add up
            assert shuffled_arcs(plan_of(arcs_of(store.blocks).groupBy("src").count()))  # the test sees them
            rounds.forget()
            store.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_count_home():
    rng = random.Random(5)
    lists = [[rng.randrange(30) for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    cut = [k % 5 == 0 for k in range(40)]
    labels = {k: rng.randrange(6) for k in range(30)}
    ids = list(labels)
    rng.shuffle(ids)
    blocks = pa.table({"home": pa.array([7] * 40), "src": pa.array(range(100, 140)), "cut": cut, "dsts": pa.chunked_array([pa.array(lists[:15]), pa.array(lists[15:])])})
    view = pa.table({"home": pa.array([7] * 30), "dst": pa.array(ids), "label": pa.array([labels[k] for k in ids])})
    got = sorted(zip(*(lpa.count_home(blocks, view).column(c).to_pylist() for c in ("src", "label", "n")), strict=True))
    want = []
    for k, dsts in enumerate(lists):
        votes = sorted((-sum(labels[d] == x for d in dsts), x) for x in {labels[d] for d in dsts})
        want += [(100 + k, x, -n) for n, x in (votes if cut[k] else votes[:1])]
    assert got == sorted(want)
    assert lpa.count_home(blocks.slice(0, 0), view).num_rows == 0


@pytest.mark.parametrize("approach", list(lpa.APPROACHES))
def test_hubs_vote_from_many_homes(spark, hubs, approach):
    graph = graph_of(spark, hubs)
    graph.store = ArcStore.build(graph.arcs, block=8)
    got = lpa.label_propagation(graph, 4, approach=approach)
    assert got.labels_dict() == simulate(hubs, False, 4)


@pytest.mark.parametrize("directed", [False, True])
def test_few_changes_spread(spark, monkeypatch, directed):
    """Rounds in which few nodes vote, with a base that is renewed, give the labels of full rounds."""
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(40)] + [(50 + k, 50 + j) for k in range(8) for j in range(k)] + [(rng.randrange(40), rng.randrange(90)) for _ in range(25)]
    kinds = []
    real = lpa.Rounds.next
    monkeypatch.setattr(lpa.Rounds, "next", lambda self, state, few, drifted: kinds.append((few, drifted)) or real(self, state, few, drifted))
    monkeypatch.setattr(lpa, "DELTA_SHARE", 0.9 if directed else 2.0)
    graph = graph_of(spark, edges, directed)
    graph.store = ArcStore.build(graph.arcs, block=5)
    got = lpa.label_propagation(graph, 7)
    assert got.labels_dict() == simulate(edges, directed, 7)
    assert any(few for few, _ in kinds)


def test_blocks_of_a_hub(spark, hubs):
    graph = graph_of(spark, hubs)
    rows = g.adjacency_blocks(graph.arcs, 7).collect()
    near = {r["id"]: r["neighbors"] for r in g.adjacency(graph.arcs).collect()}
    for node, want in near.items():
        mine = sorted((r for r in rows if r["id"] == node), key=lambda r: r["block"])
        assert [x for r in mine for x in r["neighbors"]] == want
        assert [len(r["neighbors"]) for r in mine[:-1]] == [7] * (len(mine) - 1) and all(r["blocks"] == len(mine) for r in mine)
    assert sorted((r["src"], r["dst"], r["pos"]) for r in g.local_rank(graph.arcs).collect()) == sorted((n, d, k) for n, ds in near.items() for k, d in enumerate(ds))
    assert g.adjacency_blocks(graph.arcs.where("false")).count() == 0


def test_artifact_brings_its_buckets(spark, hubs, tmp_path, monkeypatch):
    graph = graph_of(spark, hubs)
    src.write_artifact(graph, str(tmp_path / "a"), {"fraction_pct": 100.0})
    again, meta = src.read_artifact(spark, str(tmp_path / "a"))
    assert meta["store"] == again.store.sizes()
    monkeypatch.setattr(ArcStore, "build", None)  # nothing is built anew
    assert lpa.label_propagation(again, 5).labels_dict() == simulate(hubs, False, 5)
    with co_partitioned(spark):
        plan = plan_of(again.store.blocks.groupBy("home", "src").count())
    assert "Bucketed: true" in plan and "Exchange" not in plan
    assert lpa.label_propagation(src.read_artifact(spark, str(tmp_path / "a"))[0], 5, approach="blocks").labels_dict() == simulate(hubs, False, 5)


def test_samples_of_other_settings_are_their_own(spark, tmp_path):
    (tmp_path / "e.txt").write_text("".join(f"0 {k}\n" for k in range(1, 31)))
    got = [src.load_for_benchmark(spark, str(tmp_path / "e.txt"), 50.0, 1, "e", directed, str(tmp_path / "s")) for directed in (False, True)]
    assert got[0].edge_count == 2 * got[1].edge_count and got[1].graph.directed
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["e_50pct", "e_50pct_directed"]
    path = str(tmp_path / "s" / "e_50pct")
    assert not src.ensure_fraction(spark, str(tmp_path / "e.txt"), path, "e", 50.0, 1)
    assert src.ensure_fraction(spark, str(tmp_path / "e.txt"), path, "e", 50.0, 1, restrict=False)


@pytest.mark.parametrize("approach", ["frame", "blocks"])
def test_buckets_follow_from_the_arcs(spark, hubs, monkeypatch, approach):
    """Twice the arcs are twice the buckets, so that no task's memory grows with the graph."""
    monkeypatch.setattr(arcstore, "BUCKET_ARCS", 60)
    graph = graph_of(spark, hubs)
    graph.store = ArcStore.build(graph.arcs, block=8)
    assert graph.store.buckets == -(-graph.arcs.count() // 60) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lpa.label_propagation(graph, 3, approach=approach).labels_dict() == simulate(hubs, False, 3)


def test_labels_are_sent_as_lists(spark, hubs):
    """A round's labels are a row for each pair of homes, without ids."""
    graph = graph_of(spark, hubs)
    store = ArcStore.build(graph.arcs, block=8)
    sent = lpa.send_packed(store, store.ends(False).withColumn("label", arcstore.F.col("id") - 70))
    rows = sent.collect()
    assert sent.columns == ["home", "sender", "least", "width", "labels"] and len({(r["home"], r["sender"]) for r in rows}) == len(rows) == store.lists.count()
    want = {(r["at"], r["home"]): r["ids"] for r in store.lists.collect()}
    assert all([int(x) + r["least"] for x in np.frombuffer(r["labels"], f"<i{r['width']}")] == [k - 70 for k in want[r["home"], r["sender"]]] for r in rows)
    assert sorted(r["id"] for r in store.ends(False).collect()) == sorted(r["id"] for r in store.ends(True).collect()) == sorted(r["id"] for r in graph.nodes.collect())
    store.close()


@pytest.mark.parametrize("labels", [[-3, 5, 9], [0, 300, 7], [10**9, 5, 0], [-(2**63), 2**63 - 1, 0], [2**40, 1, -(2**40)]])
def test_packed_labels_of_any_size(labels):
    lists = pa.table({"home": [4, 4], "at": [1, 2], "ids": pa.array([[10, 12], [11, 12]], pa.list_(pa.int64()))})
    got = lpa.pack_labels(lists, pa.table({"id": [12, 10, 11], "label": pa.array(labels, pa.int64())}))
    whole = [(np.frombuffer(r["labels"], f"<i{r['width']}") + np.int64(r["least"])).tolist() for r in got.to_pylist()]
    assert whole == [[labels[1], labels[0]], [labels[2], labels[0]]]
    # both kinds of sort agree: one key where it fits, two where it doesn't
    blocks = pa.table({"home": [4, 4], "src": [7, 8], "cut": [False, True]})
    won = lpa._elect(blocks, np.array([3, 2]), np.array([labels[0], labels[1], labels[0], labels[2], labels[1]]))
    assert sorted(zip(*(won.column(c).to_pylist() for c in ("src", "label", "n")), strict=True)) == sorted([(7, labels[0], 2), (8, labels[1], 1), (8, labels[2], 1)])


def test_few_changes_spread_by_rows(spark, monkeypatch):
    """The other approaches deliver changes alone once these are few."""
    rng = random.Random(12)
    edges = [(k, k + 1) for k in range(30)] + [(rng.randrange(30), rng.randrange(60)) for _ in range(20)]
    monkeypatch.setattr(lpa, "DELTA_SHARE", 2.0)
    assert lpa.label_propagation(graph_of(spark, edges), 5, approach="frame").labels_dict() == simulate(edges, False, 5)


def test_first_round_sends_no_labels(spark, hubs):
    graph = graph_of(spark, hubs)
    with co_partitioned(spark):
        store = ArcStore.build(graph.arcs, block=8)
        rounds = lpa.Rounds(store, lpa.packed_votes)
        ids = store.ends(False)
        state = cut(ids.select("home", "id", *(ids["id"].alias(c) for c in ("label", "prev", "base"))))
        sent = rounds.next(state, False, False)[1]
        rounds.own = True
        first = rounds.next(state, False, False)[1]
        assert len(first) == len(sent) == 2
        assert "FlatMapCoGroups" in plan_of(sent[0]) and "FlatMapCoGroups" not in plan_of(first[0])
        assert "Exchange" not in plan_of(first[0])
        for a, b in zip(first, sent, strict=True):
            assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())
        store.close()


def test_homes_of_arcs_are_not_shuffled(spark, hubs, monkeypatch):
    plans = []
    write = arcstore.bucketed
    monkeypatch.setattr(arcstore, "bucketed", lambda df, *a, **k: (plans.append(plan_of(df)), write(df, *a, **k))[1])
    for block in (8, 1000):
        ArcStore.build(graph_of(spark, hubs).arcs, block=block).close()
        placed = [x for x in plans[-2].splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" in x]
        assert len(placed) == 1 and "xxhash64" in placed[0]
