"""Secret scans: format rules, and guess cost of values in a credential context.

The guess cost of a value is the cheapest way to cut it into words, dates,
repeats, keyboard walks, sequences and brute-force spans, by dynamic
programming over its characters. A value that costs more guesses than people
choose on their own is taken for a generated secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column
from loomgraph.llm.words import slices
from loomgraph.store import cut

#: The base rules, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Where a value may be a credential: a name, a separator, the value up to a blank or quote.
CONTEXT = re.compile(
    r"""(?:passphrase|password|passwd|pass|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?[\x20\t]{0,4}(?:[:=]|\bis\b)[\x20\t]{0,4}["']?([^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
HINT = re.compile(r"pass|pwd|pin|secret|token|key|credential|auth", re.ASCII | re.IGNORECASE)

#: log10 of the guesses from which a value counts as a secret.
LEAST_COST = 10.0
#: Share of the corpus's words from which a guesser has a word in the dictionary.
LEAST_SHARE = 1e-5

#: Rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Signs that stand for letters.
LEET = str.maketrans("4@8310!5$7", "aabeloisst")
_KEYS = {c: (y, x) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")


def _near(a: str, b: str) -> bool:
    p, q = _KEYS.get(a), _KEYS.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _pool(c: str) -> float:
    """log10 of the size of the class a brute-force guesser draws this character from."""
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses for ``value``: the cheapest segmentation; 0 for an empty one.

    Each segment but the first costs log10(2) more, for the choice of its
    kind. Walks, sequences and repeats are carried as states, so the time is
    linear in the length of the value, which is costed whole.
    """
    low = value.lower()
    plain = low.translate(LEET) if len(low.translate(LEET)) == len(low) else low
    n = min(len(value), len(low))
    best = [0.0] + [math.inf] * n
    step, turn = math.log10(2), math.log10(4)
    walk = [math.inf] * 3  # cheapest walk that ends here, of 1, 2, or more keys
    runs = {1: [math.inf] * 3, -1: [math.inf] * 3}  # the same for abc and 987
    sizes = (1, 2, 3, 4, 6, 8)
    period = {k: [0] * (n + 1) for k in sizes}
    for k in sizes:
        for i in range(n - k - 1, -1, -1):
            period[k][i] = period[k][i + 1] + 1 if low[i] == low[i + k] else 0
    for i in range(n):
        base = best[i] + (step if i else 0.0)
        best[i + 1] = min(best[i + 1], best[i] + _pool(value[i]))  # brute force, one character more
        if value[i].isdigit() and (m := _DATE.match(value, i)):  # a day of about 120 years, or a year
            cost = base + math.log10(120 * (365 if m.end() - i > 4 else 1))
            best[m.end()] = min(best[m.end()], cost)
        for j in range(i + 3, min(n, i + 24) + 1):
            for form, extra in ((low, 0.0), (plain, step)):
                if (r := ranks.get(form[i:j])) is not None:
                    case = 0.0 if value[i:j] == low[i:j] else step
                    best[j] = min(best[j], base + math.log10(r + 1) + extra + case)
        near = i > 0 and _near(low[i - 1], low[i])
        walk = [base + math.log10(47), walk[0] + turn if near else math.inf, min(walk[1:]) + turn if near else math.inf]
        best[i + 1] = min(best[i + 1], walk[2])
        for d, run in runs.items():
            on = i > 0 and low[i].isalnum() and ord(low[i]) - ord(low[i - 1]) == d
            runs[d] = [base + math.log10(72), run[0] + 0.05 if on else math.inf, min(run[1:]) + 0.05 if on else math.inf]
            best[i + 1] = min(best[i + 1], runs[d][2])
        for k in sizes:  # a unit said again and again
            times = 1 + period[k][i] // k
            if times > 1 and k * times >= 3:
                cost = base + sum(map(_pool, low[i : i + k])) + math.log10(times)
                best[i + k * times] = min(best[i + k * times], cost)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if HINT.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def guess_spans(text: str, ranks: dict[str, int], least: float = LEAST_COST) -> list[tuple[int, int, str]]:
    if not HINT.search(text):
        return []
    return [(m.start(1), m.end(1), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks) >= least]


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def corpus_ranks(docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE) -> dict[str, int]:
    """Rank of each lower-case word of 3 to 24 letters that makes up ``least_share`` of all of them.

    At most 1 / least_share words can do so, whatever the size of the corpus;
    only those reach the driver (under 3 MB). Words are counted over all
    documents, on each task before the shuffle; a word said once is no guess.
    """
    word = F.explode(F.split(F.lower(column(text_col)), r"[^\p{L}]+")).alias("w")
    counts = docs.select(word).where(F.length("w").between(3, 24)).groupBy("w").count().where("count > 1")
    counts = cut(counts, "words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    rows = counts.where(F.col("count") >= max(2.0, least_share * total)).collect()
    return {r["w"]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r["count"], r["w"])))}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: dict[str, int] | None = None, least: float = LEAST_COST) -> DataFrame:
    """One row per document: doc_id, the spans found as array<struct<kind, start, end>>, and their digests.

    Offsets are code points, the end exclusive. Base rules always count; the
    guess-cost method adds ``guess`` spans. Whole texts are scanned. A null or
    empty text has no spans (base_sha256 is that of the empty string); repeated
    rows and null ids are rows of their own; an empty table gives none; other
    columns are ignored.
    """
    docs = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    ranks = corpus_ranks(docs) if ranks is None else ranks
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "found array<struct<kind:string,start:long,end:long>>"
    )
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                cols: list[list] = [[] for _ in range(6)]
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    every = base + guess_spans(text or "", known, least)
                    for k, kind in enumerate(KINDS[:3]):
                        cols[k].append(sum(s[2] == kind for s in base))
                    cols[3].append(hashlib.sha256(_listed(base).encode()).hexdigest())
                    cols[4].append(_listed(every))
                    cols[5].append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(every, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))])
                arrays = [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:5]), pa.array(cols[5], found)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return docs.mapInArrow(scan, schema)
