"""Label propagation against golden results and a plain simulation."""

import random
from collections import Counter, defaultdict

import pytest

from loomgraph.model import Graph
from loomgraph.plans.lpa import label_propagation, step_subset

#: Small graphs with their known rounds and labels.
EDGES = {
    "triangle": ([(0, 1), (1, 2), (0, 2)], False, [3, 1, 0], {0: 0, 1: 0, 2: 0}),
    "two_cliques": ([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)], False, [6, 2, 0], {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}),
    "chain10": ([*((i, i + 1) for i in range(9)), (0, 5), (5, 9)], False, [10, 10, 10, 8, 6, 5, 3, 1, 0], dict.fromkeys(range(10), 0)),
    "square": ([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)], False, [4, 1, 0], dict.fromkeys(range(4), 0)),
    "directed_in": ([(0, 1), (2, 0)], True, [2, 1, 0], {0: 1, 1: 1, 2: 1}),
    "directed_chain": ([(0, 1), (1, 2)], True, [2, 1, 0], {0: 2, 1: 2, 2: 2}),
}


def graph_of(spark, edges, directed=False):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), directed)


def simulate(edges, directed, k):
    near = defaultdict(set)
    nodes = set()
    for u, v in edges:
        if u != v:
            nodes |= {u, v}
            near[u].add(v)
            if not directed:
                near[v].add(u)
    lab = {n: n for n in nodes}
    for _ in range(k):
        new = {n: min(((-c, x) for x, c in Counter(lab[m] for m in near[n]).items()), default=(0, lab[n]))[1] for n in nodes}
        if new == lab:
            break
        lab = new
    return lab


@pytest.mark.parametrize("name", EDGES)
def test_golden(spark, name):
    edges, directed, changes, labels = EDGES[name]
    r = label_propagation(graph_of(spark, edges, directed), 100)
    assert [x[1] for x in r.iterations] == changes
    assert r.converged and r.num_levels == len(changes)
    assert r.labels_dict() == labels


@pytest.mark.parametrize("k", [1, 2, 99, 100])
def test_oscillation_is_read_off_by_parity(spark, k):
    r = label_propagation(graph_of(spark, [(0, 1)]), k)
    assert not r.converged and r.num_levels == k
    assert r.labels_dict() == ({0: 0, 1: 1} if k % 2 == 0 else {0: 1, 1: 0})


def test_tie_takes_smallest_label(spark):
    assert label_propagation(graph_of(spark, [(1, 0), (2, 0)]), 1).labels_dict() == {0: 1, 1: 0, 2: 0}


def test_isolated_and_empty(spark):
    r = label_propagation(Graph.from_nodes(spark.createDataFrame([(5,)], "id long")), 100)
    assert r.converged and r.num_levels == 1 and r.labels_dict() == {5: 5}
    e = label_propagation(graph_of(spark, [(1, 1)]), 100)
    assert e.converged and e.num_levels == 0 and e.node_count == 0
    z = label_propagation(graph_of(spark, [(0, 1)]), 0)
    assert not z.converged and z.num_levels == 0 and z.labels_dict() == {0: 0, 1: 1}


@pytest.mark.parametrize("directed", [False, True])
def test_random_graph(spark, directed):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)]
    assert label_propagation(graph_of(spark, edges, directed), 9).labels_dict() == simulate(edges, directed, 9)


@pytest.mark.parametrize("approach", ["frame", "mode"])
def test_approaches_agree(spark, approach):
    rng = random.Random(8)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    lines = []
    r = label_propagation(graph_of(spark, edges), 5, log=lines.append, approach=approach, track_memory=True)
    assert r.labels_dict() == simulate(edges, False, 5) and {x["id"]: x["label"] for x in r.previous.collect()} == simulate(edges, False, 4)
    assert lines[0].startswith(f"[{approach}][start]") and len(lines) == 1 + sum(x[3] is not None for x in r.iterations)
    assert r.host_peaks and min(r.host_peaks.values()) > 0


def test_own_round(spark):
    r = label_propagation(graph_of(spark, [(0, 1), (1, 2)]), 3, run_step=lambda arcs, labels: labels.selectExpr("id", "0L as label"))
    assert r.labels_dict() == {0: 0, 1: 0, 2: 0} and r.converged and [x[1] for x in r.iterations] == [2, 0]


@pytest.mark.parametrize("k", [4, 5])
def test_rounds_that_did_not_run_have_no_time(spark, k):
    r = label_propagation(graph_of(spark, [(0, 1)]), k)
    assert len(r.level_times()) < r.num_levels == k and r.algorithm_time_s == sum(r.level_times())
    assert {x["id"]: x["label"] for x in r.previous.collect()} == ({0: 1, 1: 0} if k % 2 == 0 else {0: 0, 1: 1})


def test_subset_step(spark):
    g = graph_of(spark, EDGES["chain10"][0])
    some = g.nodes.where("id < 4")
    got = {r["id"]: r["label"] for r in step_subset(g.arcs, g.initial_labels(), some).collect()}
    whole = simulate(EDGES["chain10"][0], False, 1)
    assert got == {n: whole[n] for n in range(4)}
