"""Vectorised words and window hashes over Arrow text columns.

A word is a run of ``[^\\x20\\x09-\\x0D]``. All functions work on slices of a
few MB of whole documents, so memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    x = x + _U((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_BYTE2 = mix(np.arange(256, dtype=np.uint64), 17)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(n + 1024, _U(b))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of a column of texts: their spans in ``data``, document and hash."""

    __slots__ = ("data", "offs", "starts", "ends", "doc", "first", "count", "_hash", "_second")

    def __init__(self, texts: pa.Array, lower: bool = False, kept: np.ndarray | None = None):
        """``kept``: which of the 256 bytes belong to words; default: all but blanks."""
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        n = len(texts)
        bufs = texts.buffers()
        offs = np.frombuffer(bufs[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        if lower and len(data):
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13))) if kept is None else kept[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(offs))
        begin[offs[full]] = inside[offs[full]]
        stop[offs[full + 1] - 1] = inside[offs[full + 1] - 1]
        self.data, self.offs = data, offs
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(offs, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=n).astype(np.int64)[:n] if n else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        self._hash = self._second = None

    def _hashed(self, table: np.ndarray, seed: int) -> np.ndarray:
        p, q = powers(len(self.data) + 1)
        c = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * p[:-1], out=c[1:])
        return mix((c[self.ends] - c[self.starts]) * q[self.starts], seed)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self._hashed(_BYTE, 1)
        return self._hash

    @property
    def second(self) -> np.ndarray:
        """Hashes from another table of bytes, which collide apart from the first."""
        if self._second is None:
            self._second = self._hashed(_BYTE2, 4)
        return self._second

    def windows(self, k: int, seed: int = 2, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Start (word index) and hash of each window of k words inside one document."""
        w = self.second if second else self.hash
        n = len(w)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        p, q = powers(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(w * p[:-1], out=c[1:])
        return at, mix((c[at + k] - c[at]) * q[at], seed)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``max_bytes`` of text each (one row at least)."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) + 1)
    at = 0
    while at < len(total):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + max_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


def shingle_sets(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document: hashes sorted by (document, hash), bounds, documents' counts.

    A document with 1 to k-1 words has one shingle, its whole word sequence.
    """
    at, h = w.windows(k)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        hs = []
        for d in short:
            x = w.hash[w.first[d] : w.first[d + 1]]
            v = _U(0)
            for y in x:
                v = mix(np.array([v ^ y], np.uint64), 11)[0]
            hs.append(v)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(hs, np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
    n = np.bincount(doc, minlength=len(w.count)).astype(np.int64) if len(w.count) else np.zeros(0, np.int64)
    return h, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), n
