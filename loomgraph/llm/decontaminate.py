"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact check.

Every window of an item's length that holds one of the items' shingles gets a
SimHash (a window without any shares nothing and has similarity 0). The
multi-index finds all items of that length whose fingerprints lie within
RADIUS bits: cut in BLOCKS parts, two such fingerprints differ in at most
RADIUS // BLOCKS bits of one part. Candidates are verified by exact
weighted-shingle similarity. A shingle weighs as much as it has letters, so
weights need no statistics of the benchmark, and items can be dealt to passes.

At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, unrelated
ones in 32: a radius of 23 is over four standard deviations from the former
and passes under 2 in 100 of the latter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, filtered, small_batches
from loomgraph.llm.words import mix, slices
from loomgraph.store import cut

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 23, 8
#: Items and bytes of item text that are broadcast at a time (an index of under 100 MB); a larger benchmark goes in several passes.
PASS_ITEMS, PASS_BYTES = 50_000, 8 << 20  # about; an item's texts stay together
#: Words of a document whose fingerprints are added up at a time.
STRETCH = 1 << 14

_WORD = re.compile(r"\w+")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


class _Hashes(dict):
    """64-bit word hashes, computed once a word; emptied when many words have passed."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = v = xxhash.xxh3_64_intdigest(word)
        return v


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    v = np.zeros(n, np.uint64)
    for j in range(k):
        v = mix(v ^ h[j : j + n], 41 + j)
    return v


def weights(sizes: np.ndarray, k: int) -> np.ndarray:
    """Letters of all runs of k words of these sizes."""
    return np.convolve(sizes, np.ones(k, np.int64), "valid") if len(sizes) >= k else np.zeros(0, np.int64)


def prints_of(s: np.ndarray, w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Weighted SimHashes of the windows of ``n`` shingles that begin at ``at`` (ascending) among shingles ``s`` of weights ``w``."""
    out = np.zeros(len(at), np.uint64)
    done = 0
    while done < len(at):  # stretch by stretch, as each shingle takes 64 numbers
        begin = int(at[done])
        end = max(done + 1, int(np.searchsorted(at, begin + STRETCH, "right")))
        part = slice(begin, int(at[end - 1]) + n)
        bits = np.unpackbits(s[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        total = np.zeros((len(bits) + 1, 64), np.int64)
        np.cumsum((2 * bits - 1) * w[part, None], axis=0, out=total[1:])
        some = at[done:end] - begin
        out[done:end] = np.packbits(total[some + n] - total[some] > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
        done = end
    return out


class MultiIndex:
    """Finds all 64-bit fingerprints within ``radius`` bits of given ones; holds ``blocks`` numbers a fingerprint."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.blocks, self.bits = prints, radius, blocks, 64 // blocks
        self.near = np.array([m for m in range(1 << self.bits) if m.bit_count() <= radius // blocks])
        self.order, self.begin = [], []
        for b in range(blocks):
            part = self._part(prints, b)
            self.order.append(np.argsort(part, kind="stable").astype(np.int32))
            self.begin.append(np.searchsorted(part[self.order[b]], np.arange((1 << self.bits) + 1)))

    def _part(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> _U(b * self.bits)) & _U((1 << self.bits) - 1)).astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``prints``, place in the index), in order."""
        found = [np.zeros(0, np.int64)]
        for b in range(self.blocks):
            probe = (self._part(prints, b)[:, None] ^ self.near).ravel()
            low, n = self.begin[b][probe], self.begin[b][probe + 1] - self.begin[b][probe]
            each = np.repeat(np.arange(len(probe)), n)
            item = self.order[b][low[each] + np.arange(len(each)) - (np.cumsum(n) - n)[each]]
            window = each // len(self.near)
            close = np.bitwise_count(self.prints[item] ^ prints[window]) <= self.radius
            found.append(window[close] * len(self.prints) + item[close])
        both = np.unique(np.concatenate(found))
        return np.divmod(both, max(len(self.prints), 1))


class ItemIndex:
    """The items of one pass: their bags of shingles, and fingerprints by length."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes = _Hashes()
        self.ids, self.bags = [], []
        self.vocabulary: set[str] = set()
        lengths, prints, known = [], [], defaultdict(set)
        for item, text in items:
            w = words_of(text)
            if not w:
                continue
            self.vocabulary.update(w)
            k = min(SHINGLE, len(w))
            s = shingles(np.array([hashes[x] for x in w], np.uint64), k)
            weight = weights(np.array([len(x) for x in w]), k)
            self.ids.append(item)
            self.bags.append(_bag(s, weight))
            lengths.append(len(w))
            prints.append(prints_of(s, weight, np.zeros(1, np.int64), len(s))[0])
            known[len(w)].update(s.tolist())
        by = defaultdict(list)
        for i, n in enumerate(lengths):
            by[n].append(i)
        # by length: the items, their fingerprints, and all their shingles
        self.by_length = {n: (np.array(v), MultiIndex(np.array([prints[i] for i in v], np.uint64)), np.array(sorted(known[n]), np.uint64)) for n, v in sorted(by.items())}
        self.known = {k: np.array(sorted(set().union(*(x for n, x in known.items() if min(n, SHINGLE) == k))), np.uint64) for k in {min(n, SHINGLE) for n in known}}

    def matches(self, words: list[str], hashes: _Hashes, least: float) -> dict[int, tuple[float, int, int]]:
        """Item -> (similarity, first word, words) of the best window of one document, the first of equals."""
        if self.vocabulary.isdisjoint(words):
            return {}
        h, sizes = np.array([hashes[x] for x in words], np.uint64), np.array([len(x) for x in words])
        n = len(h)
        grams, places = {}, {}
        for k, known in self.known.items():
            s = grams[k] = shingles(h, k)
            places[k] = np.flatnonzero(_in(s, known)) if len(s) else np.zeros(0, np.int64)
        best: dict[int, tuple[float, int, int]] = {}
        for length, (items, index, own) in self.by_length.items():
            k = min(SHINGLE, length)
            s, shared = grams[k], places[k]
            if not len(shared):
                continue
            shared = shared[_in(s[shared], own)]
            size = min(length, n)
            m = size - k + 1  # shingles of a window
            # all windows that hold a shared shingle
            open_ = np.zeros(len(s) + 1, np.int64)
            np.add.at(open_, np.maximum(shared - m + 1, 0), 1)
            np.add.at(open_, shared + 1, -1)
            at = np.flatnonzero(np.cumsum(open_)[: len(s) - m + 1])
            if not len(at):
                continue
            w = weights(sizes, k)
            for window, item in zip(*(x.tolist() for x in index.within(prints_of(s, w, at, m))), strict=True):
                begin = int(at[window])
                sim = _similarity(_bag(s[begin : begin + m], w[begin : begin + m]), self.bags[items[item]])
                name = self.ids[items[item]]
                if sim >= least and sim > best.get(name, (0.0, 0, 0))[0]:
                    best[name] = (sim, begin, size)
        return best


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the ascending ``known``, which is not empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _bag(s: np.ndarray, w: np.ndarray) -> dict[int, int]:
    """Weight of each shingle, as often as it occurs."""
    bag: Counter = Counter()
    for x, y in zip(s.tolist(), w.tolist(), strict=True):
        bag[x] += y
    return dict(bag)


def _similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = sum(min(x, b[s]) for s, x in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _passes(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator:
    """Broadcast indexes of all items; all texts of an item are in one pass, so passes change no hit."""
    spark = benchmark.sparkSession
    items = cut(benchmark.select(column(item_col).alias("item_id"), column(item_text_col).alias("text")).where("text is not null").distinct(), "items")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    passes = max(1, -(-size["n"] // PASS_ITEMS), -(-(size["b"] or 0) // PASS_BYTES))
    for k in range(passes):
        mine = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        yield spark.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in mine.sort("item_id", "text").toLocalIterator()]))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of a document for each item it holds.

    Words are lower-case ``\\w+``; shingles have five words, an item of fewer
    words is one shingle. A window has as many words as the item (a shorter
    document is one window) and counts from a weighted Jaccard similarity of
    ``least``; a shingle weighs its letters. Of equal windows the first is
    reported; texts that share an item id are one item. Null and empty texts
    and items match nothing; null ids are reported as null; equal rows give
    equal hits; empty tables give no rows; other columns are ignored. Whole
    texts are scanned, a long one in stretches of STRETCH words.
    """
    docs = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word long, n_words long"
    out = None
    for held in _passes(benchmark, item_col, item_text_col):

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index, hashes = held.value, _Hashes()
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = []
                    for d, text in enumerate(part.column(1)):
                        for item, (sim, at, n) in index.matches(words_of(text.as_py()), hashes, least).items():
                            rows.append((d, item, sim, at, n))
                    if rows:
                        d, item, sim, at, n = zip(*rows, strict=True)
                        arrays = [part.column(0).take(pa.array(d)), pa.array(item), pa.array(sim), pa.array(at, pa.int64()), pa.array(n, pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = docs.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts hold no item; columns and other rows as they are.

    Each row is judged by its own text and passes through once for each pass
    over the benchmark. Nulls, empty tables and long texts as in
    ``contaminated``.
    """
    place = docs.columns.index(text_col)
    with small_batches(docs.sparkSession):
        for held in _passes(benchmark, "item_id", "text"):

            def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                index, hashes = held.value, _Hashes()
                for batch in batches:
                    clean = [not index.matches(words_of(text.as_py()), hashes, least) for text in batch.column(place)]
                    yield batch.filter(pa.array(clean, pa.bool_()))

            docs = filtered(docs, keep)
        return docs
