"""Target-distribution importance resampling by hashed n-gram features, in two Arrow passes.

The first pass counts the buckets of all features: ``np.bincount`` gives a
vector of BUCKETS counts a partition and ``treeReduce`` adds the vectors on
the executors. From the two count vectors every bucket has a gain, its
log-odds under the target against the corpus. The second pass gathers the
gains (a broadcast of BUCKETS numbers) and sums them by document with weighted
bincounts. Seeded Gumbel noise makes the highest scores a sample drawn by
weight without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, small_batches
from loomgraph.llm.words import Words, slices
from loomgraph.operators.ranks import placed
from loomgraph.store import cut

BUCKETS = 10_000
#: Features are runs of 1 to RUN words.
RUN = 3
SEED = 42
#: Documents of at least so many words may be drawn, and this percentage of them is.
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of a word whose checksum is taken column by column; the rest of longer words goes through zlib.
COLUMNS = 64

#: Bytes of words: digits, small letters, and all bytes of characters beyond ASCII.
_KEPT = np.zeros(256, bool)
_KEPT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def feature_buckets(w: Words, run: int = RUN) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k of 1 to ``run``: document and bucket of each run of k words, its words joined by one space.

    A run's checksum goes on from that of the run without its last word, so
    all runs that end at a word take the same walk over the word's bytes.
    """
    size = w.ends - w.starts
    order = np.argsort(-size, kind="stable")
    first, size = w.starts[order], size[order]
    cols = [w.data[first[: np.searchsorted(-size, -k)] + k] for k in range(min(COLUMNS, int(size[0]) if len(size) else 0))]
    rest = [(int(i), w.data[w.starts[i] + COLUMNS : w.ends[i]].tobytes()) for i in order[: np.searchsorted(-size, -COLUMNS)]]
    out, n = [], len(order)
    at, state = np.arange(n), np.full(n, _ONES)
    for k in range(1, run + 1):
        if k > 1:
            at = at[(w.doc[at] == w.doc[np.maximum(at - k + 1, 0)]) & (at >= k - 1)]
            space = np.empty(n, np.uint32)
            space[1:] = state[:-1]
            space[:1] = _ONES
            state = _CRC[(space ^ np.uint32(32)) & np.uint32(255)] ^ (space >> np.uint32(8))
        walk = state[order]
        for c in cols:
            part = walk[: len(c)]
            walk[: len(c)] = _CRC[(part ^ c) & np.uint32(255)] ^ (part >> np.uint32(8))
        state = np.empty(n, np.uint32)
        state[order] = walk
        for i, tail in rest:
            state[i] = zlib.crc32(tail, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        out.append((w.doc[at], ((state[at] ^ _ONES) % np.uint32(BUCKETS)).astype(np.int32)))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            for _, bucket in feature_buckets(Words(part.column(0), lower=True, kept=_KEPT)):
                total += np.bincount(bucket, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all ``texts`` (column text) each bucket holds."""
    vectors = texts.mapInArrow(_count, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([0], 1).map(lambda _: np.zeros(BUCKETS, np.int64))
    return vectors.union(none).treeReduce(np.add)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log-odds) of each bucket, counts raised by one."""
    s, t = float(corpus.sum()), float(target.sum())
    both = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in both], np.int64)


def _weigh(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), lower=True, kept=_KEPT)
                total, found = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                for doc, bucket in feature_buckets(w):
                    total += np.bincount(doc, weights=gain[bucket], minlength=part.num_rows)
                    found += np.bincount(doc, minlength=part.num_rows)
                arrays = [part.column(0), pa.array(w.count), pa.array(found), pa.array(total.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight"])

    return run


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null: not drawn).

    Words are runs of digits, letters a-z (after lower-casing A-Z) and
    characters beyond ASCII. Of the rows with ``least_words`` words at least,
    ``percent`` (rounded down) are drawn by highest score, ties to the smaller
    id. The weight is the sum of the gains of all features, 0 without any;
    null texts have no words. Rows that repeat an id are drawn on their own,
    in any order where their scores are equal; a null id draws its noise as an
    empty text and sorts last. An empty table gives no rows, an empty target
    counts of zero. Ids are whole numbers; other columns are ignored. Long
    texts are read in one piece, memory following the text.
    """
    spark = docs.sparkSession
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    with small_batches(spark):
        shared = spark.sparkContext.broadcast(gains(bucket_counts(rows.select("text")), bucket_counts(target.select(column("text").alias("text")))))
        weighed = rows.mapInArrow(_weigh(shared), "doc_id long, n_words long, n_features long, weight long")
        id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        digest = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((digest + 0.5) / 4294967296.0)))
        scored = cut(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked, _ = placed(able, [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.withColumn("rank", rank).select(cols).unionByName(others.select(cols))


#: CRC-32 (polynomial EDB88320, bits reflected) over distinct features, as DuckDB has no function for it.
_CRC_BIT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"

ORACLE = r"""
WITH bit_steps AS (SELECT i, {steps} FROM range(256) t(i)),
crc_table AS (SELECT list(s8 ORDER BY i) AS crc FROM bit_steps),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')),
                                      list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS f FROM words),
counted AS (SELECT f, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM runs GROUP BY f),
bytes AS (SELECT f, s, t, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT) AS data FROM counted),
hashed AS (
  SELECT f, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, data), lambda c, x: xor(c >> 8, crc[(xor(c & 255, x) + 1)::INT])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
buckets AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t, sum(sum(s)) OVER ()::DOUBLE AS all_s, sum(sum(t)) OVER ()::DOUBLE AS all_t FROM hashed GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM buckets),
weighed AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM runs JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || id), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (id) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM placed
""".format(steps=", ".join(f"{_CRC_BIT.format(f's{k}' if k else 'i')} AS s{k + 1}" for k in range(8)))
