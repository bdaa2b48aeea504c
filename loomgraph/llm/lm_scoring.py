"""LM scoring: a causal self-attention model over subword ids, trained in numpy.

The probability of a subword id is that of its outcome class given the context
times its share of the class in the training corpus, after the class before
it. Outcome classes come in groups: a group is predicted, then its member, by
the corpus's class bigrams and the output of one causal self-attention layer
over the ids before it. Texts are cut into overlapping context windows of SPAN
ids, in which the last HALF are scored, so each id is scored once with HALF or
more ids of context (from the text's second window on); windows are scored in
masked batches.

What is learned covers every training document: word counts, subword counts,
class bigrams, and windows that tile whole texts for the attention weights.
Texts are tokenised once; training and scoring read their ids. Training takes
STEPS steps, each on the summed gradient of a part of all texts, dealt by
hash, so scores do not depend on how the rows lie in partitions.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, small_batches
from loomgraph.llm.tokens import END, encoder, read_ranks
from loomgraph.llm.words import Words, slices
from loomgraph.store import cut, fresh_path

#: A public vocabulary for texts in many languages; its ids and the end mark.
VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
VOCABULARY = 50257
#: Classes of ids as context; groups of outcome classes and members of each; width of the layer (its last place adds up the weights); ids of a window and of its scored half.
CLASSES, GROUPS, MEMBERS, WIDTH, SPAN, HALF = 256, 16, 16, 16, 32, 16
OUTCOMES = GROUPS * MEMBERS
#: Windows that go through the layer together.
BATCH = 256
#: Training steps, the first step size, and how long means of gradients and of their squares last.
STEPS, RATE, MEAN, SQUARE = 24, 0.3, 0.8, 0.9
#: Groups in which the tasks' gradients are added before the driver adds those.
SUMS = 64
#: Partitions of small files, one for each step and task, that one task sums up.
FILES = 8
#: Bound of logits before exp, which then stays finite in float32.
PEAK = 30.0
#: Weights that the plain share of an outcome may have against what the class before it says; training counts choose.
WEIGHTS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0)
#: Words from this share of the corpus on are looked up in the broadcast table (at most 1 / share of them).
FREQUENT_SHARE = 1e-6
LN10 = math.log(10)


def keep_freed() -> None:
    """Has glibc keep freed arrays of a step for the next (at most 32 MB); else each step faults its pages in anew, a quarter of its time."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD


class _Ids(dict):
    """Subword ids of lower-cased words with their blank, encoded once; emptied when many have passed."""

    def __init__(self, ranks: bytes):
        super().__init__()
        self.enc = encoder(ranks)
        self.opens = np.zeros(VOCABULARY, bool)  # ids that begin with a blank, as each word's first does
        for i in range(END):
            self.opens[i] = self.enc.decode_single_token_bytes(i)[:1] == b" "

    def all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as int32 bytes. New words are encoded together, one by one only if one holds a Unicode blank."""
        if len(self) > 200_000:  # about 40 MB
            self.clear()
        new = [w for w in words if w not in self]
        if new:
            text = (b" " + b" ".join(new)).decode()
            ids = np.array(self.enc.encode_ordinary(text) if len(text.split()) == len(new) else [], np.int32)
            at = np.flatnonzero(self.opens[ids]).tolist()
            if len(at) == len(new):
                raw = ids.tobytes()
                self.update((w, raw[4 * i : 4 * j]) for w, i, j in zip(new, at, [*at[1:], len(ids)], strict=True))
            else:
                self.update((w, np.array(self.enc.encode_ordinary(" " + w.decode()), np.int32).tobytes()) for w in new)
        return [self[w] for w in words]


class Subwords:
    """Words and subword ids of a column of texts, each distinct word encoded once.

    A word is a run of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z. ``ids``
    are the texts' ids one after the other, each text closed by the end mark.
    """

    def __init__(self, texts: pa.Array, cache: _Ids | None):
        self.words = w = Words(texts, lower=True)
        self.which, kinds = pd.factorize(w.hash)
        first = np.empty(len(kinds), np.int64)
        first[self.which[::-1]] = np.arange(len(self.which))[::-1]
        data = w.data.tobytes()
        self.distinct = [data[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
        if cache is None:
            return
        pieces = cache.all(self.distinct)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), np.int32)
        begin = np.cumsum(size) - size
        each = size[self.which]
        self.lengths = np.bincount(w.doc, each, len(w.count)).astype(np.int64) + 1
        ends = np.cumsum(self.lengths)
        self.ids = np.full(int(ends[-1]) if len(ends) else 0, END, np.int32)
        inner = np.ones(len(self.ids), bool)
        inner[ends - 1] = False
        at = np.cumsum(each) - each
        self.ids[inner] = flat[np.arange(int(each.sum())) + np.repeat(begin[self.which] - at, each)]
        self.begins = ends - self.lengths


def classes_of(counts: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id and the log of its share of the class.

    The most frequent ids are classes of their own; the others are dealt to
    classes of about equal mass by frequency. Counts are smoothed by 0.1, so
    every id has a probability and the shares of a class sum to one.
    """
    smooth = counts + 0.1
    order = np.argsort(-smooth, kind="stable")
    alone = classes * 3 // 4
    cls = np.empty(len(counts), np.int32)
    cls[order[:alone]] = np.arange(alone)
    rest = order[alone:]
    mass = np.cumsum(smooth[rest])
    cls[rest] = alone + np.minimum((mass - smooth[rest]) / mass[-1] * (classes - alone), classes - alone - 1).astype(np.int32)
    total = np.bincount(cls, smooth, classes)
    return cls, (np.log(smooth) - np.log(total[cls])).astype(np.float32)


def outcomes_of(nexts: np.ndarray, axes: int = 12, active: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Outcome class of each id, by what it follows, and the log of its share of the class.

    ``nexts`` counts ids (columns) after classes (rows). Ids are clustered by
    k-means on the main axes of the square roots of their distributions over
    the classes before them, beginning from the most frequent ids. Classes are
    numbered so that those of a group, number // MEMBERS, lie near each other.
    """
    freq = nexts.sum(0)
    order = np.argsort(-freq, kind="stable")
    x = np.sqrt(nexts / np.maximum(freq, 1)).T
    top = order[:active]
    mean = (x[top] * freq[top, None]).sum(0) / max(freq[top].sum(), 1)
    weight = np.sqrt(freq[top, None] / max(freq.max(), 1))
    basis = np.linalg.svd((x[top] - mean) * weight, full_matrices=False)[2][:axes]
    x = (x - mean) @ basis.T
    x[freq == 0] = 0
    centre = x[order[:OUTCOMES]].copy()
    for _ in range(12):
        cls = (-2 * x @ centre.T + (centre**2).sum(1)).argmin(1)
        mass = np.bincount(cls, freq + 1e-3, OUTCOMES)
        for a in range(axes):
            centre[:, a] = np.where(mass > 0, np.bincount(cls, x[:, a] * (freq + 1e-3), OUTCOMES) / np.maximum(mass, 1e-9), centre[:, a])
    # bands along the first axis, each cut along the second
    bands = math.isqrt(GROUPS)
    number = np.empty(OUTCOMES, np.int64)
    for i, band in enumerate(np.array_split(np.argsort(centre[:, 0], kind="stable"), bands)):
        number[band[np.argsort(centre[band, 1], kind="stable")]] = np.arange(len(band)) + i * (OUTCOMES // bands)
    cls = number[cls]
    smooth = freq + 0.1
    total = np.bincount(cls, smooth, OUTCOMES)
    return cls, (np.log(smooth) - np.log(total[cls])).astype(np.float32)


def plain_weight(n: np.ndarray, total: np.ndarray, plain: np.ndarray) -> float:
    """The one of WEIGHTS that predicts each occurrence best from all others (leaving one out).

    n: occurrences of an outcome after a class; total: of all outcomes after
    it; plain: the outcome's share whatever comes before.
    """
    n, total, plain = (np.asarray(x, np.float64) for x in (n, total, plain))
    return max(WEIGHTS, key=lambda w: float(n @ (np.log(n - 1 + w * plain) - np.log(total - 1 + w))))


def laid_out(lengths: np.ndarray, lead: np.ndarray | int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts' ids where each text begins ``lead`` after a multiple of ``unit``, and the units of each text."""
    units = -(-(lengths + lead) // unit)
    begin = (np.cumsum(units) - units) * unit + lead
    return np.arange(int(lengths.sum())) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths), units


def contexts(classes: np.ndarray, lengths: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """The class before each id at the id's place; the pad before a text's first id and wherever no id is."""
    out = np.full(size, CLASSES, np.int64)
    inner = np.ones(len(classes), bool)
    inner[np.cumsum(lengths) - 1] = False
    out[place[inner] + 1] = classes[inner]
    return out


def tiles(classes: np.ndarray, goals: np.ndarray, lengths: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, goals and weights of windows of SPAN ids that tile whole texts, the first beginning ``shift`` before the text.

    Each id of a text is a goal of weight 1 in exactly one of its windows.
    """
    place, units = laid_out(lengths, shift, SPAN)
    size = int(units.sum()) * SPAN
    y, w = np.zeros(size, np.int64), np.zeros(size, np.float32)
    y[place], w[place] = goals, 1
    return tuple(v.reshape(-1, SPAN) for v in (contexts(classes, lengths, place, size), y, w))


class AttentionModel:
    """One causal self-attention layer over class embeddings, added to class bigram logits of groups and of their members.

    Tables of the parameters are made once. An attention weight before
    normalising is exp(query . key) times ``near[gap]``. Class CLASSES
    pads before a text: no class but the pad's meets the pad.
    """

    SHAPES = (
        ("q", (CLASSES + 1, WIDTH)), ("k", (CLASSES + 1, WIDTH)), ("v", (CLASSES + 1, WIDTH - 1)), ("d", (SPAN,)),
        ("o", (WIDTH - 1, GROUPS)), ("b", (GROUPS,)), ("s", (GROUPS, WIDTH - 1, MEMBERS)), ("t", (GROUPS, MEMBERS)),
    )
    SIZE = sum(math.prod(s) for _, s in SHAPES)

    def __init__(self, cls: np.ndarray, out: np.ndarray, share: np.ndarray | None, groups: np.ndarray, members: np.ndarray, flat: np.ndarray | None = None, seed: int = 3):
        """``groups`` (contexts x GROUPS) and ``members`` (contexts x GROUPS x MEMBERS) are log probabilities; ``flat`` all parameters."""
        self.cls, self.out, self.share, self.groups, self.members = cls, out, share, groups, members
        if flat is None:
            flat = np.zeros(self.SIZE)
            random = (CLASSES + 1) * (3 * WIDTH - 1)
            flat[:random] = np.random.default_rng(seed).normal(0, 0.3, random)
        self.flat, at, p = flat, 0, {}
        for n, s in self.SHAPES:
            p[n] = flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
        gap = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
        self.gap = np.maximum(gap, 0)

        def table(x: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(x, np.float32)

        self.near = table(np.exp(np.clip(p["d"], -PEAK, PEAK))[self.gap] * (gap >= 0))
        self.q, self.k = table(p["q"]), table(p["k"])
        self.q[CLASSES] = self.k[CLASSES] = 0
        self.values = table(np.hstack([p["v"], np.ones((CLASSES + 1, 1))]))
        # of a group: logits of all groups, then of its members
        both = np.concatenate([np.broadcast_to(p["o"], (GROUPS, WIDTH - 1, GROUPS)), p["s"]], 2)
        self.to_both = table(np.concatenate([both, np.zeros((GROUPS, 1, GROUPS + MEMBERS))], 1))
        odds = np.exp(groups + p["b"])[:, None, :], np.exp(members + p["t"])
        self.odds = table(np.concatenate([np.broadcast_to(odds[0], (len(groups), GROUPS, GROUPS)), odds[1]], 2).reshape(-1, GROUPS + MEMBERS))
        self.cells = np.arange(CLASSES + 1)[:, None] * WIDTH + np.arange(WIDTH)
        self.levels = np.repeat(np.eye(2, dtype=np.float32), (GROUPS, MEMBERS), 0)

    def _attend(self, x: np.ndarray, rows: slice) -> tuple:
        """Of windows ``x`` (windows x SPAN): queries at the positions ``rows``, keys, weights, values, means, and what normalises them."""
        # all numbers are in range; the mode clip does not look first
        last = x[:, rows]
        q, k = self.q.take(last, 0, mode="clip"), self.k.take(x, 0, mode="clip")
        a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        np.clip(a, -PEAK, PEAK, out=a)
        np.exp(a, out=a)
        a *= self.near[rows]
        pads = x == CLASSES
        some = np.flatnonzero(pads.any(1))
        if len(some):
            a[some] *= pads[some][:, rows, None] == pads[some][:, None, :]
        v = self.values.take(x, 0, mode="clip")
        z = (a @ v).reshape(-1, WIDTH)
        scale = 1 / z[:, -1]
        z *= scale[:, None]
        return q, k, a, v, z, scale

    def _levels(self, context: np.ndarray, z: np.ndarray, y: np.ndarray) -> tuple:
        """Odds of groups and of the members of the right group, with rows sorted by group, their sums, where ``y`` lies in them, and its log probability."""
        order = np.argsort((y // MEMBERS).astype(np.uint8), kind="stable")
        y, context, z = y.take(order), context.take(order), z.take(order, 0, mode="clip")
        g = y // MEMBERS
        ends = np.searchsorted(g, np.arange(GROUPS + 1))
        both = np.empty((len(z), GROUPS + MEMBERS), np.float32)
        for i in range(GROUPS):
            np.matmul(z[ends[i] : ends[i + 1]], self.to_both[i], out=both[ends[i] : ends[i + 1]])
        np.clip(both, -PEAK, PEAK, out=both)
        np.exp(both, out=both)
        both *= self.odds.take(context * GROUPS + g, 0, mode="clip")
        sums = both @ self.levels
        row = np.arange(0, both.size, GROUPS + MEMBERS)
        at = row + g, row + (y - g * MEMBERS + GROUPS)
        lp = sum(np.log(both.ravel().take(x) / sums[:, i]) for i, x in enumerate(at))
        return order, at, z, ends, both, sums, lp

    def score(self, x: np.ndarray, y: np.ndarray, rows: slice) -> np.ndarray:
        """Log probability of the outcomes ``y`` (windows x scored positions) at the positions ``rows`` of the context classes ``x``."""
        z = self._attend(x, rows)[4]
        order, *_, lp = self._levels(x[:, rows].ravel(), z, y.ravel())
        out = np.empty(len(lp), np.float32)
        out[order] = lp
        return out.reshape(y.shape)

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and its gradient by all parameters, summed over positions of weight ``w``."""
        q, k, a, v, z, scale = self._attend(x, slice(0, SPAN))
        order, at, zs, ends, both, sums, lp = self._levels(x.ravel(), z, y.ravel())
        w = w.ravel().take(order)
        both.reshape(-1, 2, GROUPS)[:] *= (w[:, None] / sums)[:, :, None]
        for i in at:
            both.ravel()[i] -= w
        back, s = np.empty_like(z), np.empty(self.to_both.shape, np.float32)
        for i in range(GROUPS):
            part = slice(ends[i], ends[i + 1])
            np.matmul(zs[part].T, both[part], out=s[i])
            np.matmul(both[part], self.to_both[i].T, out=back[part])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        gz = back.take(place, 0, mode="clip")
        # the last place, so far 0, takes off the mean, as weights are normalised
        gz[:, -1] = -np.einsum("ij,ij->i", gz, z)
        gz *= scale[:, None]
        gz = gz.reshape(len(x), SPAN, WIDTH)
        gv = a.transpose(0, 2, 1) @ gz
        gs = gz @ np.ascontiguousarray(v.transpose(0, 2, 1))
        gs *= a
        gq, gk = gs @ k, gs.transpose(0, 2, 1) @ q
        cells, sums = self.cells.take(x, 0, mode="clip").ravel(), np.zeros((3, (CLASSES + 1) * WIDTH), np.float32)
        for total, g in zip(sums, (gq, gk, gv), strict=True):
            np.add.at(total, cells, g.ravel())
        q, k, v = sums.reshape(3, -1, WIDTH)
        d = np.bincount(self.gap.ravel(), gs.sum(0).ravel(), SPAN)
        q[CLASSES] = k[CLASSES] = 0  # the pad meets itself alone
        # the last place of zs is 1, so what it adds up are biases
        one, two = s[:, :, :GROUPS].sum(0), s[:, :, GROUPS:]
        parts = q, k, v[:, :-1], d, one[:-1], one[-1], two[:, :-1], two[:, -1]
        return -float(lp @ w), np.concatenate([x.ravel() for x in parts], dtype=np.float64)

    def log_prob(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural-log probability of each text; ``ids`` are the texts' ids one after the other.

        Every id is scored once. Position t of a text sees ids before it: the
        contexts of HALF consecutive ids end a window of SPAN.
        """
        place, units = laid_out(lengths, HALF, HALF)  # of pads first
        size = int(units.sum()) * HALF
        halves = contexts(self.cls.take(ids).astype(np.int64), lengths, place, size).reshape(-1, HALF)
        goals, there = np.zeros(size, np.int64), np.zeros(size, bool)
        goals[place], there[place] = ids, True
        goals, there = goals.reshape(-1, HALF), there.reshape(-1, HALF)
        scored = np.ones(len(halves), bool)
        scored[np.cumsum(units) - units] = False
        scored = np.flatnonzero(scored)
        doc = np.repeat(np.arange(len(lengths)), units - 1)
        out = np.zeros(len(lengths))
        for at in range(0, len(scored), BATCH):
            some = scored[at : at + BATCH]
            last, goal = halves.take(some, 0), goals.take(some, 0)
            x = np.concatenate([halves.take(some - 1, 0), last], 1)
            lp = self.score(x, self.out.take(goal), slice(SPAN - HALF, SPAN))
            lp += self.share.take(last * VOCABULARY + goal)
            lp *= there.take(some, 0)
            out += np.bincount(doc[at : at + BATCH], lp.sum(1, dtype=np.float64), len(lengths))
        return out


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column of uint16 bytes one after the other, and each row's number of them."""
    lengths = np.asarray(pc.binary_length(ids)).astype(np.int64) // 2
    return np.frombuffer(b"".join(x.as_buffer() for x in ids), np.uint16).astype(np.int64), lengths


def _added(table: pa.Table) -> pa.Table:
    """The sum of rows of numbers as bytes."""
    total = sum(np.frombuffer(x.as_buffer()) for x in table.column("w"))
    return pa.table({"g": table.column("g").slice(0, 1).combine_chunks(), "w": pa.array([total.tobytes()], pa.binary())})


def few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in tasks of FILES partitions each, but one a core: for passes whose tasks give sums, which are then fewer."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.rdd.getNumPartitions() // FILES)))


def train_model(texts: DataFrame, counts: DataFrame, ends: int, ranks: bytes, steps: int = STEPS) -> AttentionModel | None:
    """Learns the model from all rows of ``texts`` (step, shift, ids) and their word counts (w, c); None without any.

    ``ends`` is the number of texts; ``step`` and ``shift`` are numbers below
    STEPS and SPAN that depend on nothing but the text's id.
    """
    if not ends:
        return None
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(ranks)

    def id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = _Ids(held.value), np.zeros(VOCABULARY)
        for batch in batches:
            pieces = cache.all(batch.column(0).to_pylist())
            size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
            total += np.bincount(np.frombuffer(b"".join(pieces), np.int32), np.repeat(batch.column(1).to_numpy(), size), VOCABULARY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    seen = np.zeros(VOCABULARY)
    for r in counts.mapInArrow(id_counts, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most VOCABULARY rows
        seen[r["id"]] = r["n"]
    seen[END] = ends
    cls, _ = classes_of(seen)
    table = spark.sparkContext.broadcast(cls)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class and next id in whole texts, summed over the task."""
        total = np.zeros((CLASSES + 1) * VOCABULARY, np.int32)
        one = np.int32(1)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids, lengths = _flat(part.column(0))
                before = np.empty(len(ids), np.int64)
                before[1:] = table.value.take(ids[:-1])
                before[np.cumsum(lengths) - lengths] = CLASSES
                before *= VOCABULARY
                before += ids
                np.add.at(total, before, one)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            some = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], names=["cell", "n"])

    # at most (CLASSES + 1) * VOCABULARY cells, as columns of numbers
    sums = few_tasks(texts.select("ids")).mapInArrow(gather, "cell long, n long").groupBy("cell").agg(F.sum("n").cast("float").alias("n")).toArrow()
    nexts = np.zeros((CLASSES + 1) * VOCABULARY, np.float32)
    nexts[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    del sums
    nexts = nexts.reshape(CLASSES + 1, VOCABULARY)
    out, share = outcomes_of(nexts)
    cells = np.stack([np.bincount(out, row, OUTCOMES) for row in nexts])
    before, id_ = np.nonzero(nexts)
    smooth = np.float32(plain_weight(nexts[before, id_], cells[before, out[id_]], np.exp(share[id_])))
    del before, id_
    nexts += smooth * np.exp(share)
    np.log(nexts, out=nexts)
    for before, row in enumerate(nexts):
        row -= np.log(cells[before] + smooth)[out].astype(np.float32)
    share = nexts.astype(np.float16)  # of an id in its outcome, after each class
    del nexts
    start = (cells.sum(0) + 0.5) / (cells.sum() + 0.5 * OUTCOMES)
    before, outcome = np.nonzero(cells)
    plain = plain_weight(cells[before, outcome], cells.sum(1)[before], start[outcome])
    joint = ((cells + plain * start) / (cells.sum(1, keepdims=True) + plain)).reshape(-1, GROUPS, MEMBERS)
    whole = joint.sum(2)
    groups, members = np.log(whole), np.log(joint / whole[:, :, None])
    flat = AttentionModel(cls, out, None, groups, members).flat
    mean, square, done = np.zeros_like(flat), np.zeros_like(flat), 0
    fixed = spark.sparkContext.broadcast((cls, out, groups, members))
    for r in range(steps):
        now = spark.sparkContext.broadcast(flat)

        def slope(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            """The task's summed gradient and weight."""
            keep_freed()
            cls, out, groups, members = fixed.value
            model = AttentionModel(cls, out, None, groups, members, now.value)
            total, weight = np.zeros(AttentionModel.SIZE + 1), 0.0
            for batch in batches:
                for part in slices(batch, "ids", 1 << 20):
                    ids, lengths = _flat(part.column(0))
                    windows = tiles(cls.take(ids), out.take(ids), lengths, part.column(1).to_numpy().astype(np.int64))
                    weight += len(ids)
                    for k in range(0, len(windows[0]), BATCH):
                        total[:-1] += model.gradient(*(v[k : k + BATCH] for v in windows))[1]
            if weight:
                total[-1] = weight
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "w"])

        part = texts.where(F.col("step") == r) if steps > 1 else texts
        sums = part.select("ids", "shift").mapInArrow(slope, "g int, w binary").groupBy("g").applyInArrow(_added, "g int, w binary")
        sums = sum((np.frombuffer(x["w"]) for x in sums.collect()), np.zeros(len(flat) + 1))  # at most SUMS rows
        now.destroy()
        if not sums[-1]:  # no text in this step
            continue
        done += 1
        g = sums[:-1] / sums[-1]
        mean, square = MEAN * mean + (1 - MEAN) * g, SQUARE * square + (1 - SQUARE) * g * g
        rate = RATE * (1 - r / steps)
        flat = flat - rate * (mean / (1 - MEAN**done)) / (np.sqrt(square / (1 - SQUARE**done)) + 1e-8)
    for b in (held, table, fixed):
        b.destroy()
    return AttentionModel(cls, out, share, groups, members, flat)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = VOCABULARY_FILE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    held_out: crc32 of the id as text modulo 7 is 2; such texts are never
    learned from. Tokens are the words after lower-casing A-Z and one end.
    base_score is the add-one unigram log10 probability, score the attention
    model's log10 probability of the same words and end as subword ids. A null
    text is empty: one token, the end. A null id is not held out. Without
    training texts base_score and score are 0. Repeated rows score alike (and
    count twice in training); other columns are ignored; an empty table gives
    no rows. A long text is one row of ids, scored batch by batch.
    """
    spark = docs.sparkSession
    ranks = read_ranks(tokenizer)
    docs = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    held = F.coalesce(F.pmod(crc, F.lit(7)) == 2, F.lit(False))
    docs = docs.select(
        "doc_id", held.alias("held_out"), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(STEPS)).cast("int").alias("step"),
        F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(SPAN)).cast("int").alias("shift"), "text",
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                t = Subwords(part.column(0), None)
                n = np.bincount(t.which, minlength=len(t.distinct))
                yield pa.RecordBatch.from_arrays([pa.array(t.distinct, pa.binary()), pa.array(n.astype(np.int64))], names=["w", "c"])

    with small_batches(spark):
        counts = cut(docs.where(~F.col("held_out")).select("text").mapInArrow(words, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")), "counts")
    ends = docs.where(~F.col("held_out")).count()
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    often = {bytes(r["w"]): math.log10(r["c"] + 1) for r in counts.where(F.col("c") >= max(1.0, FREQUENT_SHARE * total)).toLocalIterator()}
    known = spark.sparkContext.broadcast((often, ranks))
    floor = math.log10(total + distinct + 1) if total else 0.0
    end_score = math.log10(ends + 1) - floor if total else 0.0

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of each text, the base score of its frequent words, and its other words with their counts."""
        logs, ranks = known.value
        cache, row = _Ids(ranks), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                t = Subwords(part.column(4), cache)
                docs_, doc = len(t.words.count), t.words.doc
                lg = np.array([logs.get(x, -1.0) for x in t.distinct])
                seen = lg[t.which] >= 0 if len(lg) else np.zeros(0, bool)
                tokens = t.words.count + 1
                hits = np.bincount(doc[seen], minlength=docs_) + int(ends > 0)
                base = np.bincount(doc[seen], lg[t.which[seen]], docs_) + (end_score + floor) * (total > 0) - floor * tokens
                width = max(len(t.distinct), 1)
                pair, n = np.unique(doc[~seen] * width + t.which[~seen], return_counts=True)
                cuts = pa.array(np.searchsorted(pair, np.arange(docs_ + 1) * width).astype(np.int32))
                rare = pa.ListArray.from_arrays(cuts, pa.array([t.distinct[i] for i in (pair % width).tolist()], pa.binary()))
                times = pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int64)))
                flat = t.ids.astype(np.uint16)
                ids = pa.Array.from_buffers(pa.binary(), docs_, [None, pa.py_buffer(np.append(0, 2 * np.cumsum(t.lengths)).astype(np.int32)), pa.py_buffer(flat)])
                arrays = [
                    pa.array(np.arange(row, row + docs_)), *part.columns[:4], pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), ids, rare, times,
                ]
                row += docs_
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "held_out", "step", "shift", "n_tokens", "hits", "base", "ids", "rare", "times"])

    schema = f"key long, doc_id {kind}, held_out boolean, step int, shift int, n_tokens long, hits long, base double, ids binary, rare array<binary>, times array<long>"
    with small_batches(spark):
        # by step, so that a training step reads its own texts only
        path = fresh_path(spark, "encoded")
        docs.mapInArrow(encode, schema).write.partitionBy("step").parquet(path)
        encoded = spark.read.schema(schema).parquet(path)
        known.destroy()
        model = train_model(encoded.where(~F.col("held_out")).select("step", "shift", "ids"), counts, ends, ranks)
    judge = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        model = judge.value
        for batch in batches:
            for part in slices(batch, "ids"):
                ids, lengths = _flat(part.column(6))
                lp = model.log_prob(ids, lengths) / LN10 if model else np.zeros(len(lengths))
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(lp, pa.float64())], names=["key", "doc_id", "held_out", "n_tokens", "hits", "base", "score"])

    scored = encoded.select("key", "doc_id", "held_out", "n_tokens", "hits", "base", "ids")
    with small_batches(spark):
        scored = cut(scored.mapInArrow(score, f"key long, doc_id {kind}, held_out boolean, n_tokens long, hits long, base double, score double"), "scored")
    judge.destroy()
    # words below the share are looked up by a join
    pieces = encoded.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("w"), F.col("x.times").alias("t"))
    found = pieces.join(counts, "w").groupBy("key").agg(F.sum("t").alias("more"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("plus"))
    out = scored.join(found, "key", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("plus", F.lit(0.0))).alias("base_score"), "score",
    )
