"""Synchronous label propagation as an iterative join and aggregation.

New label of a node: the most frequent label among its out-neighbours in the
previous round, the smallest of equals; a node without out-neighbours keeps
its label. Stops when nothing changes or after max_iter rounds.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import Graph, LpaResult
from loomgraph.operators.arcstore import ArcStore, arcs_of, co_partitioned, flat
from loomgraph.plans.memory import worker_peaks
from loomgraph.store import bucketed, cut, drop

#: Below this share of changed nodes only the nodes that see a change vote again.
DELTA_SHARE = 0.2


def votes(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, best): the winning label of each node with out-neighbours.

    Labels are counted per (node, label) with a map-side combine before the
    winner is picked, so hubs cost one row per distinct label and task.
    """
    seen = arcs.join(labels.select(F.col("id").alias("dst"), "label"), "dst")
    count = seen.groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
    best = count.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("neg"), "label")).alias("b"))
    return best.select(F.col("src").alias("id"), F.col("b.label").alias("best"))


def step(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) after one round."""
    return labels.join(votes(arcs, labels), "id", "left").select("id", F.coalesce("best", "label").alias("label"))


def step_subset(arcs: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label) after one round for ``nodes`` only, against the frozen labels of all."""
    mine = nodes.select("id").distinct()
    part = arcs.join(mine.withColumnRenamed("id", "src"), "src", "left_semi")
    return labels.join(mine, "id", "left_semi").join(votes(part, labels), "id", "left").select("id", F.coalesce("best", "label").alias("label"))


# Approaches: (blocks, view) -> (home, src, cut, label, n). For a node whose arcs lie together the winning label;
# for a cut hub each label that one of its homes has seen and how often, to be added up.


def _seen(blocks: DataFrame, view: DataFrame) -> DataFrame:
    return arcs_of(blocks).join(view, ["home", "dst"])


def _split() -> Column:
    """Null for a node as a whole, the label for a cut hub."""
    return F.when(F.col("cut"), F.col("label")).alias("split")


def frame_votes(blocks: DataFrame, view: DataFrame) -> DataFrame:
    """Counts per node and label, then the most frequent label, the least of equals."""
    count = _seen(blocks, view).groupBy("home", "src", "cut", "label").agg(F.count(F.lit(1)).alias("n"))
    best = count.groupBy("home", "src", "cut", _split()).agg(F.min(F.struct((-F.col("n")).alias("neg"), "label")).alias("b"))
    return best.select("home", "src", "cut", F.col("b.label").alias("label"), (-F.col("b.neg")).alias("n"))


def mode_votes(blocks: DataFrame, view: DataFrame) -> DataFrame:
    """One aggregate a node."""
    return _seen(blocks, view).groupBy("home", "src", "cut", _split()).agg(F.mode("label", True).alias("label"), F.count(F.lit(1)).alias("n")).drop("split")


def count_home(blocks: pa.Table, view: pa.Table) -> pa.Table:
    """Votes of one home's blocks by its labels, in arrays."""
    dsts, size = flat(blocks.column("dsts"))
    return _elect(blocks, size, _labels(view.column("dst").to_numpy(), view.column("label").to_numpy(), dsts))


def _labels(ids: np.ndarray, labels: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    by_id = np.argsort(ids)
    return labels[by_id][np.searchsorted(ids, wanted, sorter=by_id)] if len(wanted) else np.zeros(0, np.int64)


def _elect(blocks: pa.Table, size: np.ndarray, label: np.ndarray) -> pa.Table:
    """Votes of one home's blocks, whose neighbours' labels lie end to end, ``size`` of them a block."""
    row = np.repeat(np.arange(len(size)), size)
    least = int(label.min()) if len(row) else 0
    span = int(label.max()) - least + 1 if len(row) else 1
    if span <= (1 << 62) // max(len(size), 1):
        both = np.sort(row * span + (label - least))  # one key sorts faster than two
        runs = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(row) else np.zeros(0, np.int64)
        n = np.diff(np.append(runs, len(row)))
        row, label = both[runs] // span, both[runs] % span + least
    else:
        order = np.lexsort((label, row))
        row, label = row[order], label[order]
        runs = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])]))
        n, row, label = np.diff(np.append(runs, len(row))), row[runs], label[runs]
    keep = blocks.column("cut").to_numpy()[row].astype(bool)
    if len(row):
        firsts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        most = np.repeat(np.maximum.reduceat(n, firsts), np.diff(np.append(firsts, len(row))))
        top = np.flatnonzero(n == most)
        keep[top[np.unique(row[top], return_index=True)[1]]] = True  # labels ascend, so the first is the least
    row = pa.array(row[keep])
    return pa.table({"home": blocks.column("home").take(row), "src": blocks.column("src").take(row), "cut": blocks.column("cut").take(row), "label": pa.array(label[keep]), "n": pa.array(n[keep])})


def pack_labels(lists: pa.Table, labels: pa.Table) -> pa.Table:
    """One home's labels for each of its lists, in the order of the ids: offsets from the least label, in as few bytes as they all need."""
    ids, size = flat(lists.column("ids"))
    label = _labels(labels.column("id").to_numpy(), labels.column("label").to_numpy(), ids)
    least = int(label.min()) if len(label) else 0
    span = int(label.max()) - least if len(label) else 0
    width = next((w for w in (1, 2, 4) if span < 1 << (8 * w - 1)), 8)
    least = least if width < 8 else 0  # their difference may not fit
    data = pa.py_buffer((label - least).astype(f"<i{width}").tobytes())
    ends = pa.py_buffer((np.append(0, np.cumsum(size)) * width).astype(np.int32).tobytes())
    packed = pa.Array.from_buffers(pa.binary(), len(size), [None, ends, data])
    same = [pa.array(np.full(len(size), x)) for x in (least, width)]
    return pa.Table.from_arrays([lists.column("at"), lists.column("home"), *same, packed], ["home", "sender", "least", "width", "labels"])


def count_packed(blocks: pa.Table, sent: pa.Table) -> pa.Table:
    """Votes of one home's blocks by the packed labels sent to it."""
    at, size = flat(blocks.column("dsts_at"))
    rows = sorted(zip(*(sent.column(c).to_pylist() for c in ("sender", "least", "width", "labels")), strict=True))
    view = [np.frombuffer(data, f"<i{width}") + np.int64(least) for _, least, width, data in rows]
    return _elect(blocks, size, np.concatenate(view)[at] if len(at) else np.zeros(0, np.int64))


def packed_votes(blocks: DataFrame, sent: DataFrame) -> DataFrame:
    """Blocks and packed labels of a home side by side, counted in arrays; a bucket has a bounded number of arcs (BUCKET_ARCS)."""
    both = blocks.select("home", "src", "cut", "dsts_at").groupBy("home").cogroup(sent.groupBy("home"))
    return both.applyInArrow(count_packed, "home long, src long, cut boolean, label long, n long")


def count_own(blocks: pa.Table) -> pa.Table:
    """Votes of one home's blocks where each neighbour's label is its own id."""
    dsts, size = flat(blocks.column("dsts"))
    return _elect(blocks, size, dsts)


def own_votes(blocks: DataFrame) -> DataFrame:
    """Votes of the first round, whose labels are the ids that the blocks hold: nothing is sent."""
    return blocks.select("home", "src", "cut", "dsts").groupBy("home").applyInArrow(count_own, "home long, src long, cut boolean, label long, n long")


def send_packed(store: ArcStore, labels: DataFrame) -> DataFrame:
    """(home, sender, least, width, labels): the labels (home, id, label) of all nodes at every home that needs them, a row for each pair of homes."""
    both = store.lists.groupBy("home").cogroup(labels.groupBy("home"))
    return both.applyInArrow(pack_labels, "home long, sender long, least long, width long, labels binary")


#: Ways to count the votes of a round. ``blocks`` takes what ``send_packed`` has sent, the others rows (home, dst, label).
APPROACHES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"frame": frame_votes, "mode": mode_votes, "blocks": packed_votes}


class Rounds:
    """Rounds over an arc store; ``next`` gives the votes of all nodes that may change.

    A full round delivers every label to the homes that need it. The approach
    ``blocks`` has full rounds only: whole lists without ids are fewer bytes
    and less work than rows of changes. By the others, once few
    nodes change, the labels delivered so far are kept at their homes as the
    base; a round then delivers only labels that differ from the base or have
    just changed, and only nodes with a changed neighbour vote, against the
    base with those labels put in. No arc is shuffled in either.
    """

    def __init__(self, store: ArcStore, vote: Callable[[DataFrame, DataFrame], DataFrame]):
        self.store, self.vote, self.base = store, vote, None
        self.own = False  # whether the labels are the ids, as they are before the first round

    def _votes(self, blocks: DataFrame, view: DataFrame | None) -> DataFrame:
        return own_votes(blocks) if view is None else self.vote(blocks, view)

    def _elected(self, blocks: DataFrame, view: DataFrame | None, hubs: DataFrame) -> list[DataFrame]:
        """Frames (home, id, new): of nodes at one home and, where there are any, of cut hubs. No view: labels are the ids."""
        whole = self._votes(blocks, view).select("home", F.col("src").alias("id"), F.col("label").alias("new"))
        if not self.store.hubs:
            return [whole]
        total = self._votes(hubs, view).groupBy("src", "label").agg(F.sum("n").alias("n"))
        best = total.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("neg"), "label")).alias("b"))
        return [whole, best.select(self.store.home("id"), "id", F.col("b.label").alias("new"))]

    def _rebase(self, state: DataFrame) -> None:
        self.forget()
        self.base = bucketed(self.store.deliver(state.select("home", "id", "label")), "home", self.store.buckets, ["home", "dst"])

    def forget(self) -> None:
        if self.base is not None:
            drop(self.base)
        self.base = None

    def next(self, state: DataFrame, few: bool, drifted: bool) -> tuple[DataFrame, list[DataFrame]]:
        """``state`` (home, id, label, prev, base) and the votes. few: few nodes changed; drifted: many differ from the base."""
        blocks, hubs = self.store.blocks.where("not cut"), self.store.blocks.where("cut")
        labels = state.select("home", "id", "label")
        if self.vote is packed_votes:
            return state, self._elected(blocks, None if self.own else send_packed(self.store, labels), hubs)
        if not few:
            self.forget()
            return state, self._elected(blocks, self.store.deliver(labels), hubs)
        if self.base is None or drifted:
            self._rebase(state)
            state = state.withColumn("base", F.col("label"))
        news = self.store.deliver(state.where("label <> base or label <> prev").select("home", "id", F.col("label").alias("new"), (F.col("label") != F.col("prev")).alias("moved")))
        near = arcs_of(blocks).join(news.where("moved").select("home", "dst"), ["home", "dst"], "left_semi").select("home", "src").distinct()
        view = self.base.join(news.select("home", "dst", "new"), ["home", "dst"], "left").select("home", "dst", F.coalesce("new", "label").alias("label"))
        return state, self._elected(blocks.join(near, ["home", "src"], "left_semi"), view, hubs)


def label_propagation(
    graph: Graph,
    max_iter: int = 100,
    log: Callable[[str], None] | None = None,
    run_step: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    approach: str = "blocks",
    track_memory: bool = False,
) -> LpaResult:
    """Runs up to ``max_iter`` rounds; the last, unchanged round counts as one.

    Exact shortcuts: a node votes again only if an out-neighbour has changed,
    once few have; and if a round restores the labels of two rounds before,
    the rest alternates, so it is read off by parity; rounds that did not run
    have no time. Arcs lie in an ``ArcStore``, the graph's own or one that is
    built here, and never move; see ``Rounds``. ``run_step`` replaces the
    round, for other strategies: from (src, dst) arcs and (id, label) it
    returns (id, label) of the nodes that vote. Each round's labels are written
    to the shared folder, which survives lost executors, and counted as they
    are; one row comes to the driver.
    """
    began = time.time()
    spark = graph.nodes.sparkSession
    vote = APPROACHES[approach]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with co_partitioned(spark):
        store = None if run_step else graph.store or ArcStore.build(graph.arcs)
        arcs = cut(graph.arcs, "arcs") if run_step else None
        rounds = None if run_step else Rounds(store, vote)
        home = F.lit(0).cast("long").alias("home") if run_step else store.home("id")
        try:
            nodes = store.ends(graph.directed) if store and graph.joined else graph.nodes.select(home, "id")
            state = cut(nodes.select("home", "id", *(F.col("id").alias(c) for c in ("label", "prev", "base"))), "labels")
            total = state.count()
            result = LpaResult(state.select("id", "label"), node_count=total, init_time_s=time.time() - began, workers=n)
            result.previous = result.labels
            if total and log:
                log(run_start(approach, total, n, max_iter, result.init_time_s))
            result.converged, changed, drift = not total, total, 0
            for it in range(1, max_iter + 1 if total else 1):
                t = time.time()
                if run_step:
                    based, new = state, [run_step(arcs, state.select("id", "label")).select(home, "id", F.col("label").alias("new"))]
                else:
                    placed = state.repartition(store.buckets, "home")  # as many tasks as the arcs need, not as the session has
                    based, new = rounds.next(placed, it > 1 and changed < DELTA_SHARE * total, drift > DELTA_SHARE * total)
                for k, votes_ in enumerate(new):
                    based = based.join(votes_.withColumnRenamed("new", f"new{k}"), ["home", "id"], "left")
                label = F.coalesce(*(f"new{k}" for k in range(len(new))), "label")
                off = F.lit(it == 1) | (label != F.col("prev"))
                nxt = based.select("home", "id", label.alias("label"), F.col("label").alias("prev"), "base", off.alias("off"))
                # counted by the tasks that write, of which each counts once
                seen = Observation()
                counts = [F.count_if(F.expr("label <> prev")).alias("changed"), F.count_if("off").alias("off"), F.count_if(F.expr("label <> base")).alias("drift")]
                nxt = cut(nxt.observe(seen, *counts), "labels")
                drop(state)
                state, row = nxt.drop("off"), seen.get
                changed, drift = row["changed"], row["drift"]
                result.iterations.append((it, changed, total, time.time() - t))
                if log:
                    log(iteration_line(it, changed, total, n, result.iterations[-1][3], approach))
                if track_memory:
                    result.add_peaks(worker_peaks(spark))
                if not changed:
                    result.converged = True
                    break
                if not row["off"] and not run_step:
                    # labels(it) == labels(it - 2): what follows alternates between the two
                    left = max_iter - it
                    result.iterations += [(it + k, changed, total, None) for k in range(1, left + 1)]
                    if left % 2:
                        state = state.withColumns({"label": F.col("prev"), "prev": F.col("label")})
                    break
        finally:
            if rounds:
                rounds.forget()
            if store and store is not graph.store:
                store.close()
    result.labels = state.select("id", "label")
    result.previous = state.select("id", F.col("prev").alias("label"))
    result.num_communities = result.labels.agg(F.count_distinct("label")).first()[0] if total else 0
    return result


def iterations_frame(spark: SparkSession, result: LpaResult) -> DataFrame:
    """(iter, changed, total, elapsed_s); a round that was read off has no time."""
    return spark.createDataFrame(result.iterations, "iter int, changed long, total long, elapsed_s double")


# ---------------------------------------------------------------- fixed formats: what a run logs


def runtime_line(backend: str, event: str, **fields: object) -> str:
    return " ".join([f"[{backend}][{event}]", *(f"{k}={v}" for k, v in fields.items())])


def run_start(backend: str, nodes: int, chunks: int, max_iter: int, init_s: float, seed: int | None = None) -> str:
    given = {} if seed is None else {"seed": seed}
    return runtime_line(backend, "start", nodes=nodes, chunks=chunks, max_iter=max_iter, init_s=f"{init_s:.2f}s", **given)


def iteration_line(it: int, changed: int, total: int, workers: int, elapsed: float, backend: str = "lpa") -> str:
    pct = 100.0 * changed / total if total else 0.0
    return f"[{backend}][iter={it}] changed={changed}/{total} ({pct:.1f}%) workers={workers} elapsed={elapsed:.2f}s"


def peaks_line(backend: str, peaks: dict[str, float]) -> str:
    return runtime_line(backend, "vm-peaks", **{host: f"{mb:.0f}MB" for host, mb in sorted(peaks.items())})


def summary_lines(result: LpaResult, backend: str = "lpa") -> list[str]:
    """The end of a run: rounds and communities, sizes, times, and a warning where it did not converge."""
    from loomgraph.operators.communities import size_stats

    s = size_stats(result.labels).first()
    times = sorted(x[3] for x in result.iterations if x[3] is not None) or [0.0]
    half = len(times) // 2
    middle = times[half] if len(times) % 2 else (times[half - 1] + times[half]) / 2
    lines = [
        runtime_line(backend, "done", iters=result.num_levels, converged=str(result.converged).lower(), communities=s["communities"]),
        runtime_line(backend, "sizes", min=s["min_size"], p50=s["p50"], p95=s["p95"], max=s["max_size"]),
        runtime_line(backend, "timing", iter_min=f"{times[0]:.2f}s", iter_median=f"{middle:.2f}s", iter_max=f"{times[-1]:.2f}s", total=f"{sum(times):.2f}s"),
    ]
    return lines if result.converged else [*lines, f"[{backend}][warn] max_iter reached, not converged"]
