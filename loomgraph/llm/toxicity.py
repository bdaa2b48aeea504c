"""Toxicity by noisy-channel deobfuscation.

Words are taken for the output of a channel that replaces letters by signs
(leetspeak), puts signs between letters, spaces them out and repeats them. A
Viterbi decoder finds the likeliest letters behind each word that has a sign
or a repeated letter, and letters and word breaks behind each run of single
characters, under a character language model of the corpus; the restored words
are scored by a model of the labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, filtered, small_batches
from loomgraph.llm.words import slices
from loomgraph.store import cut

#: Labelled rows of each label on which the classifier is fitted, at most; the lowest hashes of the ids.
FIT_ROWS = 6000
#: Documents of the sample in which a feature must occur to count.
LEAST_DOCS = 2
#: Standard errors by which a log odds ratio may be lowered, as few documents prove little; out-of-fold loss decides.
DOUBTS = (0.0, 0.5, 1.0, 2.0)
#: Score from which a document is rejected.
REJECT = 0.3

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: log probabilities of the channel: a sign for a letter, a sign put in, a letter repeated
_SIGN, _INSERTED, _REPEATED, _KEPT = -1.0, -6.0, -1.5, 0.0
#: a sign that stands for nothing, or is punctuation where it stands; a blank between words in a run of single characters
_DROPPED, _BREAK = -0.5, 0.0

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SIZE = 28  # the edge of a word, 26 letters, any other letter
_SIGNS = "".join(re.escape(x) for x in LEET)
_NOTHING = re.compile(rf"(?:[^\w\s{_SIGNS}]|_)+")  # what stands for no letter wherever it is
_COVERED = re.compile(rf"[{_SIGNS}]|(.)\1")  # a sign for a letter, or a repeated character
_OPENING, _CLOSING = "(", "!"  # signs that are punctuation before and after a word


def _codes() -> np.ndarray:
    """Code of each code point below 0x250; later letters count as other."""
    table = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        ch = chr(c).lower()
        if ch.isalpha():
            table[c] = _LETTERS.index(ch) + 1 if len(ch) == 1 and ch in _LETTERS else 27
    return table


_CODE = _codes()


def _code(ch: str) -> int:
    return int(_CODE[ord(ch)]) if ord(ch) < 0x250 else 27 if ch.isalpha() else 0


def letter_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams (with word edges) over all texts: a table of fixed size.

    Each task sums its own table; tables are added cell by cell.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                text = " ".join(pc.fill_null(part.column(0), "").to_pylist())
                points = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
                code = np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], 27).astype(np.int32)
                total += np.bincount((code[:-2] * _SIZE + code[1:-1]) * _SIZE + code[2:], minlength=_SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    table = np.zeros(_SIZE**3)
    for r in docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r["cell"]] = r["n"]
    return table.reshape(_SIZE, _SIZE, _SIZE)


def _arcs(ch: str) -> tuple[tuple[str, int, float], ...]:
    """The letters that a character may stand for, with their codes and costs."""
    if ch.isalpha():
        return ((ch, _code(ch), _KEPT),)
    return tuple((x, _code(x), _SIGN) for x in LEET.get(ch, ""))


class Decoder:
    """Viterbi decoding of character lattices under the letter trigrams."""

    def __init__(self, counts: np.ndarray):
        smooth = counts + 0.05 + 20.0 * (counts.sum(0) + 0.5) / max(counts.sum() + 1, 1) * 1.0
        self.lm = np.log(smooth / smooth.sum(2, keepdims=True)).tolist()
        self.arcs: dict[str, tuple[tuple[str, int, float], ...]] = {}  # of characters met
        self.merged = False  # whether the last word read could have left a letter out

    def decode(self, word: str, repeats: bool = True) -> str:
        """The likeliest lower-case letters behind ``word``; other signs that stay are dropped.

        States are the last two letters. At each character the lattice
        offers the letter itself, the letters a sign stands for, nothing for a
        sign put in, and (with ``repeats``) nothing for a letter that repeats
        the last one; at a blank, nothing or a word break. What is read so far
        is a chain of (chain before, letter), so the time is linear.
        """
        word = word.lower()
        head, tail = len(word) - len(word.lstrip(_OPENING)), len(word.rstrip(_CLOSING))
        lm, self.merged = self.lm, False
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for at, ch in enumerate(word):
            nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
            if ch == " ":
                nxt = dict(states)
                for (p, q), (score, out) in states.items():
                    value = score + _BREAK + lm[p][q][0]
                    if q and ((0, 0) not in nxt or value > nxt[0, 0][0]):
                        nxt[0, 0] = (value, (out, " "))
                states = nxt
                continue
            arcs = self.arcs.get(ch) or self.arcs.setdefault(ch, _arcs(ch))
            nothing = None if ch.isalpha() else _INSERTED if ch in LEET and head <= at < tail else _DROPPED
            for (p, q), (score, out) in states.items():
                row, last = lm[p][q], out[1] if out else ""
                for letter, c, cost in arcs:
                    key, value = (q, c), score + cost + row[c]
                    if key not in nxt or value > nxt[key][0]:
                        nxt[key] = (value, (out, letter))
                    if last == letter:  # the same letter again, once more
                        self.merged = True
                        again = score + _REPEATED + cost
                        if repeats and ((p, q) not in nxt or again > nxt[p, q][0]):
                            nxt[p, q] = (again, out)
                if nothing is not None and ((p, q) not in nxt or score + nothing > nxt[p, q][0]):
                    nxt[p, q] = (score + nothing, out)
            states = nxt
        out = max(states.items(), key=lambda s: s[1][0] + lm[s[0][0]][s[0][1]][0])[1][1]
        letters = []
        while out:
            out, letter = out
            letters.append(letter)
        return "".join(reversed(letters))


class _Restored(dict):
    """Restored forms of words and of runs of single characters, each decoded once; emptied when many have passed.

    A word's forms, with repeated letters kept and with them left out where that is
    likelier, are one string with a blank between: they are evidence of one word.
    """

    def __init__(self, decoder: Decoder):
        super().__init__()
        self.decoder = decoder

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        bare = _NOTHING.sub("", word.lower())
        if " " in word:  # a run: its words by the lattice, and all of it as one word
            found = {self.forms(bare.replace(" ", ""))}
            for repeats in (False, True):
                found.update(self.forms(w) for w in self.decoder.decode(bare, repeats).split())
            self[word] = got = tuple(sorted(found))
        else:
            self[word] = got = (self.forms(bare),)
        return got

    def forms(self, bare: str) -> str:
        if not _COVERED.search(bare):
            return bare
        best = self.decoder.decode(bare)
        if not self.decoder.merged:
            return best
        kept = bare if bare.isalpha() else self.decoder.decode(bare, False)
        return best if best == kept else f"{kept} {best}"


def restored_words(text: str | None, cache: _Restored) -> set[str]:
    """The distinct restored words; runs of three or more single letters or signs are decoded together as well."""
    words = (text or "").split()
    out: set[str] = set()
    for w in set(words):
        out.update(cache[w])
    singles: list[str] = []
    if sum(len(w) == 1 for w in words) >= 3:
        for w in [*words, ""]:
            if len(w) == 1:
                singles.append(w)
                continue
            if len(singles) >= 3:
                out.update(cache[" ".join(singles)])
            singles = []
    return out


def features(word: str) -> list[str]:
    """The forms of a word and their beginnings and ends, by which unseen forms are known."""
    return [f for x in word.split() for f in (["=" + x, "^" + x[:4], "^" + x[:5], x[-5:] + "$"] if len(x) >= 5 else ["=" + x])]


class Model:
    """Evidence of words for label 1, and its calibration to a probability."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, ...]):
        self.weights, self.curve = weights, curve

    def evidence(self, words: set[str], cache: dict[str, float]) -> tuple[float, float, float]:
        """The strongest and second strongest word for label 1, and the log of their number."""
        first = second = 0.0
        n = 0
        for w in words:
            e = cache.get(w)
            if e is None:
                if len(cache) > 300_000:
                    cache.clear()
                e = cache[w] = max((self.weights.get(f, 0.0) for f in features(w)), default=0.0)
            if e > 1.0:
                n += 1
            if e > first:
                first, second = e, first
            elif e > second:
                second = e
        return first, second, math.log1p(n)

    def score(self, evidence: tuple[float, float, float]) -> float:
        b, *w = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, b + sum(x * y for x, y in zip(w, evidence, strict=True))))))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, fold) of at most ``fit_rows`` ids of each label, and the number of usable rows of each label.

    Ids are chosen by their hashes alone, numbers of a fixed size, and their
    texts are joined afterwards, one of each id.
    """
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = known.where(F.pmod(crc, F.lit(4)) != 2).select("doc_id", "toxic", F.xxhash64(F.lit(5), "doc_id").alias("order"))
    usable = usable.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    usable = cut(usable, "labels")
    ids = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy("order", "doc_id").limit(fit_rows)
        ids = part if ids is None else ids.unionByName(part)
    prior = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    rows = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "order").agg(F.min("text").alias("text"))
    fold = F.col("order").bitwiseAND(F.lit(1)).cast("int").alias("fold")
    return cut(rows.select("text", "toxic", fold), "fit").repartition(docs.sparkSession.sparkContext.defaultParallelism), prior


def _newton(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of a logistic regression of ``y`` on ``x``, and its mean log loss."""
    w = np.zeros(x.shape[1])
    ridge = 1e-3 * np.array([0] + [1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + np.diag(ridge + 1e-6)
        w -= np.linalg.solve(hess, grad)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(sample: DataFrame, decoder: Decoder, prior: dict[int, int]) -> Model:
    """Fits the model on the rows (text, toxic, fold) of ``sample``.

    Word features are counted on the executors over the documents of the
    sample, those of LEAST_DOCS documents and up get a smoothed log odds
    ratio lowered by some standard errors, and the driver fits three
    coefficients and an intercept by Newton steps on out-of-fold evidence (two
    folds by hash). The number of standard errors is that of DOUBTS with the
    least out-of-fold log loss, so nothing is chosen by rows that are held
    out. The intercept moves to the share of label 1 among all rows
    (``prior``).
    """
    spark = sample.sparkSession
    held = spark.sparkContext.broadcast(decoder)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Restored(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                counts: Counter = Counter()
                for text, toxic, fold in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    counts.update((f, fold, toxic) for f in {f for w in restored_words(text, cache) for f in features(w)})
                if counts:
                    f, fold, toxic = zip(*counts, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(fold, pa.int32()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["f", "fold", "toxic", "n"])

    per = sample.mapInArrow(parts, "f string, fold int, toxic int, n long").groupBy("f").agg(
        *(F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{k}{t}") for k in (0, 1) for t in (0, 1))
    )
    sizes = Counter()
    for r in sample.groupBy("fold", "toxic").count().collect():
        sizes[r["fold"], r["toxic"]] = r["count"]

    def weight(n0: float, n1: float, d0: float, d1: float, doubt: float) -> float:
        odds = math.log((n1 + 0.5) / (d1 + 1.0)) - math.log((n0 + 0.5) / (d0 + 1.0))
        return odds - doubt * math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))

    fold: list[list[dict[str, float]]] = [[{} for _ in DOUBTS] for _ in (0, 1)]
    whole: list[dict[str, float]] = [{} for _ in DOUBTS]
    d = [[sizes[k, t] for t in (0, 1)] for k in (0, 1)]
    # features of the bounded sample that label 1 has
    for r in per.where(F.col("n01") + F.col("n11") >= 1).where(f"n00 + n01 + n10 + n11 >= {LEAST_DOCS}").toLocalIterator():
        for i, doubt in enumerate(DOUBTS):
            for k in (0, 1):
                if r[f"n{k}1"] and (x := weight(r[f"n{k}0"], r[f"n{k}1"], *d[k], doubt)) > 0:
                    fold[k][i][r["f"]] = x
            if (x := weight(r["n00"] + r["n10"], r["n01"] + r["n11"], d[0][0] + d[1][0], d[0][1] + d[1][1], doubt)) > 0:
                whole[i][r["f"]] = x
    flat = (0.0, 0.0, 0.0, 0.0)
    other = spark.sparkContext.broadcast([[Model(w, flat) for w in fold[1 - k]] for k in (0, 1)])

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = _Restored(held.value), [[{} for _ in DOUBTS] for _ in (0, 1)]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, k in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = restored_words(text, cache)
                    rows.append([x for m, seen in zip(other.value[k], known[k], strict=True) for x in m.evidence(words, seen)])
                yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = sample.mapInArrow(held_out, "toxic int, x array<double>").toPandas()
    y = got["toxic"].to_numpy(float) if len(got) else np.zeros(0)
    share = (prior.get(1, 0) + 0.5) / (prior.get(0, 0) + prior.get(1, 0) + 1.0)
    if not len(y) or y.min() == y.max():
        return Model({}, (math.log(share / (1 - share)) if prior else -3.0, 0.0, 0.0, 0.0))
    x = np.stack(got["x"].to_numpy())
    tried = [_newton(np.column_stack([np.ones(len(y)), x[:, 3 * i : 3 * i + 3]]), y) for i in range(len(DOUBTS))]
    best = min(range(len(DOUBTS)), key=lambda i: (tried[i][1], -DOUBTS[i]))
    own, w = y.mean(), tried[best][0]
    offset = math.log(own / (1 - own)) - math.log(share / (1 - share))  # the sample holds more of label 1
    return Model(whole[best], (float(w[0] - offset), *map(float, w[1:])))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Broadcast:
    """The decoder and the model of all texts (doc_id, text) and of the labels that may be used."""
    with small_batches(docs.sparkSession):
        decoder = Decoder(letter_trigrams(docs))
        sample, prior = _sample(docs, labels, fit_rows)
        return docs.sparkSession.sparkContext.broadcast((decoder, fit(sample, decoder, prior)))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    held_out: crc32 of the id as text modulo 4 is 2; the labels of such rows
    are never used. predicted is 1 from a score of REJECT. Whole texts are
    scored, from their words only. Null and empty texts get the score of no
    evidence; a null id is not held out and has no label; labels that are null
    or neither 0 nor 1 are ignored, so are further labels of an id (the
    largest counts); without labels every score is low. Repeated rows score
    alike (of an id with several texts the fit takes the least); other columns
    are ignored; an empty table gives no rows.
    """
    docs = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    model = learn(docs, labels, fit_rows)
    base = docs.select("doc_id", F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, judge = model.value
        cache, known_words = _Restored(decoder), {}
        for batch in batches:
            for part in slices(batch, "text"):
                scores = [judge.score(judge.evidence(restored_words(t, cache), known_words)) for t in part.column(2).to_pylist()]
                predicted = pa.array([int(s >= REJECT) for s in scores], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), predicted], names=["doc_id", "held_out", "score", "predicted"])

    return base.mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; columns as they are.

    Each row is judged by its own text. Nulls and empty tables as in
    ``score_toxicity``; a null or empty text is never rejected while labels of
    0 are the more frequent.
    """
    place = docs.columns.index(text_col)
    model = learn(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, judge = model.value
        cache, known_words = _Restored(decoder), {}
        for batch in batches:
            scores = [judge.score(judge.evidence(restored_words(t.as_py(), cache), known_words)) for t in batch.column(place)]
            yield batch.filter(pa.array([s < REJECT for s in scores], pa.bool_()))

    with small_batches(docs.sparkSession):
        return filtered(docs, keep)
