"""Filter audit, importance resampling and SimHash components against brute force, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomgraph.llm import filter_audit, resampling, simhash
from loomgraph.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "word " * 30000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "Ünïcode\x85word   x"), (None, "three four"), (7, LONG)]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, vocab=300):
    return " ".join(f"W{rng.randrange(vocab)}" if rng.random() < 0.1 else f"w{rng.randrange(vocab)}" for _ in range(n))


# ---------------------------------------------------------------- filter audit


def audit_by_hand(rows, marks):
    """Applies every order to plain lists, filter by filter."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    kinds = defaultdict(list)
    for i, t, lang in rows:
        t, w = t or "", WORD.findall(t or "")
        first = least.get(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
               "E": first is not None and (i is None or i > first)}
        kinds[lang or ""].append((bad, marks.get(i, (0, 0))))
    out, total = {}, Counter()
    for part, docs in kinds.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                fails = sum(d[0][f] for d in docs)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                out[part, order, step] = (len(left), len(gone), fails - len(gone), alone, sum(d[1][0] for d in gone), sum(d[1][1] for d in gone))
                total[part, f] += len(gone)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, part string, A boolean")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_of_all_orders(spark, monkeypatch):
    made = []
    real = filter_audit.cut
    monkeypatch.setattr(filter_audit, "cut", lambda df, label: made.append((label, df.columns)) or real(df, label))
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([20, 99, 100, 140]), rng.choice([60, 5000])) for _ in range(40)]
    texts += [t + rng.choice([" $", " AAAA" * 30, " #" * 3]) for t in texts[:20]] + [t.upper() for t in texts[:6]]
    rows = [(i, rng.choice(texts), rng.choice(["de", "en", None, ""])) for i in range(150)] + [(500, "", "only")]
    marks = {i: (rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)}
    got = filter_audit.audit(docs_of(spark, rows), labels_of(spark, [(i, *m) for i, m in marks.items()]))
    assert {tuple(r[c] for c in AUDIT) for r in got.collect()} == audit_by_hand(rows, marks)
    assert got.count() == 4 * 600  # zeros too, and no row twice
    edges = [cols for label, cols in made if label == "audit-edges"]
    assert len(edges) == 31 + 1  # each set of fewer than five filters once, then all together
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_audit_of_odd_rows(spark):
    rows = [(i, t, None if i in (1, 4) else "l") for i, t in ODD] + [(None, "one two", "l"), (None, "three four", "l"), (9, "one two", "new")]
    marks = [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1), (9, 7, 1)]
    got = filter_audit.audit(docs_of(spark, rows), labels_of(spark, marks))
    assert {tuple(r[c] for c in AUDIT) for r in got.collect()} == audit_by_hand(rows, {4: (1, 1), 9: (0, 1)})
    assert filter_audit.audit(docs_of(spark, []), labels_of(spark, [])).count() == 0


# ---------------------------------------------------------------- importance resampling


def resampled_by_hand(rows, items):
    def features(text):
        w = PLAIN.findall(lowered(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in items for b in features(x)[1])
    ns, nt = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in range(10000)]
    out = []
    for i, n, found in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((d for d in out if d[1] >= 20), key=lambda d: (-d[4], d[0] is None, d[0] or 0))
    ranks = defaultdict(list)
    for k, d in enumerate(able):
        ranks[d].append(k + 1 if k < 5 * len(able) // 100 else None)
    return sorted(((d[0], *d[2:], ranks[d].pop() if d[1] >= 20 else None) for d in out), key=str)


def resampled(spark, rows, items):
    docs = spark.createDataFrame([(i, t, 5, 0.5) for i, t in rows], "doc_id long, text string, score int, weight double")
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    return sorted((tuple(r) for r in resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_feature_buckets(monkeypatch):
    rng = random.Random(1)
    texts = ["Hello, World! x9 " + "q" * 200 + " z " + "q" * 70, None, "", "é à ÀB-c d", "a"]
    texts += [" ".join("".join(rng.choice("abcÉ1.,") for _ in range(rng.randrange(1, 90))) for _ in range(30)) for _ in range(20)]
    for columns in (64, 3):  # words whose ends go through zlib
        monkeypatch.setattr(resampling, "COLUMNS", columns)
        got = defaultdict(list)
        for k, (doc, bucket) in enumerate(resampling.feature_buckets(Words(pa.array(texts), lower=True, kept=resampling._KEPT)), 1):
            for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
                got[d, k].append(b)
        for i, t in enumerate(texts):
            w = PLAIN.findall(lowered(t))
            for k in (1, 2, 3):
                assert got[i, k] == [zlib.crc32(" ".join(w[j : j + k]).encode()) % 10000 for j in range(len(w) - k + 1)]


def test_resampling(spark):
    rng = random.Random(4)
    items = [prose(rng, 30, 40) for _ in range(20)] + [None, ""]
    rows = [(i, prose(rng, rng.choice([3, 19, 20, 60]), rng.choice([40, 4000]))) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 430)]
    got = resampled(spark, rows, items)
    assert got == resampled_by_hand(rows, items)
    able = sum(len(t.split()) >= 20 for _, t in rows)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 5 * able // 100 + 1))


def test_resampling_of_odd_rows(spark):
    rows = [*ODD, (None, prose(random.Random(8), 40)), *[(11, "a b c " * 20)] * 60]
    assert resampled(spark, rows, ["one two"]) == resampled_by_hand(rows, ["one two"])
    assert resampled(spark, rows, []) == resampled_by_hand(rows, [])
    assert resampled(spark, [], ["one two"]) == []


# ---------------------------------------------------------------- SimHash


def fingerprint_by_hand(text):
    w = WORD.findall(lowered(text))
    runs = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, min(len(w), 1)))]
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components_by_hand(found):
    """(id, fingerprint) to (id, hex, component): flood fill over all pairs."""
    values = sorted({f for _, f in found})
    low, seen = {}, set()
    for f in values:
        if f not in seen:
            group, todo = set(), [f]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += [y for y in values if (x ^ y).bit_count() <= 4 and y not in group]
            seen |= group
            ids = [i for i, g in found if g in group and i is not None]
            low |= dict.fromkeys(group, min(ids, default=None))
    return sorted(((i, f"{f:016x}", low[f]) for i, f in found), key=str)


def simhashed(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, fp int")
    return sorted((tuple(r) for r in simhash.near_components(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def flipped(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def test_simhash_components(spark):
    rng = random.Random(6)
    base = [prose(rng, rng.choice([2, 4, 30, 150])) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 160):  # near copies
        w = base[i % 25].split()
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = "Changed"
        rows.append((i, "  ".join(w)))
    rng.shuffle(rows)
    want = components_by_hand([(i, fingerprint_by_hand(t)) for i, t in rows])
    assert simhashed(spark, rows) == want
    assert 20 < len({r[2] for r in want}) < 140


def test_simhash_of_odd_rows(spark):
    rows = [*ODD, (None, None), (8, "a b c d"), (9, "A  b\tc d\n"), (10, "x y z")]
    assert simhashed(spark, rows) == components_by_hand([(i, fingerprint_by_hand(t)) for i, t in rows])
    assert simhashed(spark, []) == []


def test_pairs_of_positions_find_every_link():
    for same in map(set, combinations(range(8), 4)):
        first = [t for t, p in enumerate(simhash.PAIRS) if set(p) <= same]
        assert first
        assert all(any({*simhash.PAIRS[t], *q} == same for q in simhash.MORE[t]) for t in first)


def test_near_pairs_and_stars():
    rng = random.Random(9)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = [flipped(rng, x, k % 9) for k, x in enumerate(a)]
    got = simhash.near(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [k % 9 <= 4 for k in range(3000)]
    group = np.sort(np.array([rng.randrange(50) for _ in range(400)]))
    fp = np.array([flipped(rng, a[g % 5], rng.randrange(5)) for g in group.tolist()], np.uint64)
    root = {k: k for k in range(400)}
    for x, c in zip(*simhash.linked(group, fp), strict=True):
        root[int(x)] = int(c)
    for x in range(400):
        mine = [y for y in range(400) if group[x] == group[y]]
        reach, todo = set(), [x]
        while todo:
            y = todo.pop()
            reach.add(y)
            todo += [z for z in mine if z not in reach and (int(fp[y]) ^ int(fp[z])).bit_count() <= 4]
        assert root[x] == min(reach)


@pytest.mark.parametrize("block", [4, 16])
def test_simhash_of_clouds(spark, monkeypatch, block):
    """Lists longer than BLOCK: posted again, then cut into blocks that meet by component."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    centre = [rng.getrandbits(64) for _ in range(4)]
    near = [flipped(rng, centre[0], rng.randrange(7)) for _ in range(120)] + [flipped(rng, flipped(rng, c, 9), rng.randrange(4)) for c in centre for _ in range(20)]
    near += [centre[0] ^ (rng.getrandbits(32) << 32) for _ in range(60)]  # four bytes alike
    found = [(i, f) for i, f in enumerate(near)]
    rows = spark.createDataFrame([(i, str(f)) for i, f in found], "doc_id long, text string")

    def sign(batches):
        for b in batches:
            fp = np.array([int(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    monkeypatch.setattr(simhash, "_sign", sign)
    passed = []
    real = simhash._clouds
    monkeypatch.setattr(simhash, "_clouds", lambda *a: passed.append(1) or real(*a))
    got = sorted((tuple(r) for r in simhash.near_components(rows).collect()), key=str)
    assert passed and got == components_by_hand(found)
