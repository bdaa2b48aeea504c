"""Substring dedup by fixed-block anchors.

Reference blocks of ANCHOR words without overlap are indexed and probed with
every rolling window of as many words. A window of 2 * ANCHOR - 1 words or
more always holds a whole block, so repeats of that length leave a hit in each
copy. Hits are extended: the windows of the required length around them are
compared as a whole, and runs of repeated windows are the maximal repeats.

Hashes travel packed, one row for each packet of documents and bucket of the
hash space; a hash that repeats inside a packet is sent once. So a passage
that a third of all documents share costs a few bytes for each packet. A row
holds a window at least, so there are never more rows than windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, is_small, small_batches
from loomgraph.llm.words import Words, slices
from loomgraph.store import cut

WINDOW = 35
ANCHOR = 18
#: Text of a bucket (about two million windows) and of a packet, in bytes.
BUCKET_BYTES = 16 << 20
PACKET_BYTES = 4 << 20

_PACKED = "bucket int, packet long, kind int, data binary, rids array<binary>, counts array<int>"
_NAMES = ["bucket", "packet", "kind", "data", "rids", "counts"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
_FLAG = np.uint32(1 << 31)
#: kinds of packed rows: windows to compare, a packet's documents, known hits
_ASK, _DOCS, _HITS = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _pack(packet: int, buckets: int, h: np.ndarray, more: np.ndarray | None, at: np.ndarray, block: np.ndarray, rids: list, counts: np.ndarray) -> pa.RecordBatch:
    """The rows of one packet: windows ``at`` (word indexes) with hash ``h`` (and 64 bits ``more``)."""
    order = np.argsort(h, kind="stable") if more is None else np.lexsort((more, h))
    h, at, block = h[order], at[order].astype(np.uint32), block[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if more is not None:
        more = more[order]
        new[1:] |= more[1:] != more[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(h)))
    many = n > 1
    known = at[np.repeat(many, n)]
    key, loc = h[first], at[first] | np.where(block[first] | many, _FLAG, np.uint32(0))
    # buckets by the high bits, so that each is a run of the sorted hashes
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    parts = [(key & np.uint64(0xFFFFFFFF)).astype(np.uint32)] if more is None else [key, more[first]]
    parts.append(loc)
    rows = [
        (b, packet, _ASK, b"".join(x[ends[b] : ends[b + 1]].tobytes() for x in parts), None, None)
        for b in range(buckets)
        if ends[b + 1] > ends[b]
    ]
    rows.append((packet % buckets, packet, _DOCS, None, rids, counts.astype(np.int32).tolist()))
    if len(known):
        rows.append((packet % buckets, packet, _HITS, known.tobytes(), None, None))
    return _batch(rows)


def _compare(wide: bool):
    """Of one bucket: the locations of hashes that two or more rows have, one of them flagged.

    ``wide`` keys are 128 bits, so windows that are told equal are equal but
    for a chance of 1e-12 on 1e13 windows; the anchors' 32 bits (of a bucket)
    only pick candidates.
    """
    size = 16 if wide else 4

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        ask = table.filter(pa.array(kinds == _ASK))
        out = [table.filter(pa.array(kinds != _ASK)).combine_chunks()]
        packets = ask.column("packet").to_numpy()
        keys, more, locs, src = [], [], [], []
        for k, data in enumerate(ask.column("data")):
            buf = data.as_buffer()
            n = buf.size // (size + 4)
            keys.append(np.frombuffer(buf, np.uint64 if wide else np.uint32, n))
            if wide:
                more.append(np.frombuffer(buf, np.uint64, n, 8 * n))
            locs.append(np.frombuffer(buf, np.uint32, n, size * n))
            src.append(np.full(n, k, np.int32))
        if keys:
            key, loc, src = np.concatenate(keys), np.concatenate(locs), np.concatenate(src)
            second = np.concatenate(more) if wide else None
            order = np.lexsort((second, key)) if wide else np.argsort(key, kind="stable")
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            if wide:
                second = second[order]
                new[1:] |= second[1:] != second[:-1]
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(key)))
            flagged = np.logical_or.reduceat((loc[order] & _FLAG) > 0, first)
            hit = order[np.repeat((n > 1) & flagged, n)]
            hit = hit[np.argsort(src[hit], kind="stable")]
            ends = np.searchsorted(src[hit], np.arange(len(packets) + 1))
            rows = [
                (-1, int(packets[k]), _HITS, (loc[hit[ends[k] : ends[k + 1]]] & ~_FLAG).tobytes(), None, None)
                for k in range(len(packets))
                if ends[k + 1] > ends[k]
            ]
            if rows:
                out.append(pa.Table.from_batches([_batch(rows)]))
        schema = pa.schema(list(zip(_NAMES, _TYPES, strict=True)))
        return pa.concat_tables([t.select(_NAMES).cast(schema) for t in out])

    return run


def _home(table: pa.Table) -> pa.Table:
    """Of one packet: a row for each document with hits, positions in words of the document."""
    kinds = table.column("kind").to_numpy()
    names = table.filter(pa.array(kinds == _DOCS)).slice(0, 1).to_pylist()
    hits = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.filter(pa.array(kinds == _HITS)).column("data")]
    rid, data = [], []
    if hits and names:
        at = np.unique(np.concatenate(hits))
        first = np.concatenate([[0], np.cumsum(names[0]["counts"])])
        doc = np.searchsorted(first, at, "right") - 1
        for d in np.unique(doc):
            rid.append(names[0]["rids"][d])
            data.append((at[doc == d] - first[d]).astype(np.uint32).tobytes())
    return pa.table({"rid": pa.array(rid, pa.binary()), "hits": pa.array(data, pa.binary())})


def _repeats(packed: DataFrame, wide: bool) -> DataFrame:
    """(rid, hits) of the documents with hashes that occur more than once."""
    found = cut(packed.groupBy("bucket").applyInArrow(_compare(wide), _PACKED), "hits")
    mine = found.groupBy("packet").applyInArrow(_home, "rid binary, hits binary")
    return cut(mine.dropDuplicates(["rid"]), "repeats")  # equal rows have equal hits


def _packet(seq: int) -> int:
    return (TaskContext.get().partitionId() << 32) | seq


def _anchors(anchor: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            for part in slices(batch, "text", PACKET_BYTES):
                w = Words(part.column(1))
                at, h = w.windows(anchor)
                block = (at - w.first[w.doc[at]]) % anchor == 0
                yield _pack(_packet(seq), buckets, h, None, at, block, part.column(0).to_pylist(), w.count)
                seq += 1

    return run


def _candidates(window: int, anchor: int, buckets: int):
    """Windows that hold a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            for part in slices(batch, "text", PACKET_BYTES):
                w = Words(part.column(1))
                hit = np.zeros(len(w.starts) + 1, np.int64)
                for d, x in enumerate(part.column(2)):
                    hit[w.first[d] + np.frombuffer(x.as_buffer(), np.uint32) + 1] = 1
                hit = np.cumsum(hit)
                at, h = w.windows(window, 3)
                near = hit[at + window - anchor + 1] > hit[at]
                more = w.windows(window, 5, True)[1]
                yield _pack(_packet(seq), buckets, h[near], more[near], at[near], np.ones(int(near.sum()), bool), part.column(0).to_pylist(), w.count)
                seq += 1

    return run


_RESULT = "doc_id {}, n_words long, n_removed long, kept_sha256 string, removed array<struct<from:long,to:long>>, kept_text string"
_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _finish(window: int, with_text: bool):
    """Removes the words of repeated windows; column 2, if there, has their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PACKET_BYTES):
                cols: list[list] = [[] for _ in range(5)]
                for k, text in enumerate(part.column(1)):
                    words = (text.as_py() or "").encode().split()
                    n, spans = len(words), []
                    if part.num_columns > 2 and part.column(2)[k].is_valid:
                        at = np.unique(np.frombuffer(part.column(2)[k].as_buffer(), np.uint32)).astype(np.int64)
                        cuts = np.flatnonzero(np.diff(at) > window)
                        begin, end = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)] + window
                        spans = [{"from": int(a), "to": int(b)} for a, b in zip(begin, end, strict=True)]
                        keep = np.ones(n, bool)
                        for s in spans:
                            keep[s["from"] : s["to"]] = False
                        words = [words[i] for i in np.flatnonzero(keep)]
                    kept = b" ".join(words)
                    for c, v in zip(cols, (n, n - len(words), hashlib.sha256(kept).hexdigest(), spans, kept.decode() if with_text else None), strict=True):
                        c.append(v)
                arrays = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], _SPANS), pa.array(cols[4], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (word ranges), kept_text for every row.

    A word is a run of ``[^\\x20\\x09-\\x0D]``, unchanged. Words covered by a
    window of ``window`` words that also starts anywhere else, in the same
    document too, are removed, in all copies, judged on the input. Null,
    blank and short texts lose nothing. Rows that repeat id and text are
    copies of each other like any two documents. Null ids are fine; other
    columns are ignored; an empty table gives no rows. Memory follows the
    packet, or the longest text: a text of more than a packet is one alone.
    """
    with small_batches(docs.sparkSession):
        anchor = (window + 1) // 2
        docs = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
        own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit("")))
        keyed = docs.select(F.unhex(F.md5(F.encode(own, "UTF-8"))).alias("rid"), "text", "doc_id")
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, -(-total // BUCKET_BYTES))
        anchors = keyed.select("rid", "text").mapInArrow(_anchors(anchor, buckets), _PACKED)
        near = _repeats(anchors, False)

        def side(rows: DataFrame, how: str) -> DataFrame:
            ids = rows.select("rid")
            return keyed.join(F.broadcast(ids) if is_small(ids) else ids, "rid", how)

        found = side(near, "left_semi").join(near, "rid").select("rid", "text", "hits")
        repeated = _repeats(found.mapInArrow(_candidates(window, anchor, buckets), _PACKED), True)
        schema = _RESULT.format(docs.schema["doc_id"].dataType.simpleString())
        touched = side(repeated, "left_semi").join(repeated, "rid").select("doc_id", "text", "hits")
        clean = side(repeated, "left_anti").select("doc_id", "text")
        out = clean.mapInArrow(_finish(window, with_text), schema).unionByName(touched.mapInArrow(_finish(window, with_text), schema))
        return out


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM words, range(1, len(w) - 33) t(i)),
twice AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, range(35) t(k)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
