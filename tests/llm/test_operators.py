"""The ten operators against brute force on small tables, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import decontaminate, exact_dedup, lm_scoring, minhash, mixing, secrets, sharding, substring_dedup, tokens, toxicity
from loomgraph.llm.words import Words, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "Ünïcode\x85word   x"), (None, "one two"), (7, "word " * 30000)]


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 20, 80, 200]), 4000) for _ in range(60)]
    docs = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(60, 90):  # near copies
        w = base[i % 7 + 20].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w), "s0"))
    shared = prose(rng, 60, 9000)
    docs += [(i, f"{prose(rng, i % 23)} {shared} {prose(rng, 30)}", None) for i in range(90, 110)]
    docs += [(i, base[30], "s9") for i in range(110, 130)]
    rng.shuffle(docs)
    return docs


def test_words_and_slices():
    texts = ["Hello a\tb", "", None, " x  y z\n", "éa\x85b c", "tail"]
    w = Words(pa.array(texts))
    assert [w.word(i).decode() for i in range(len(w.starts))] == [x for t in texts for x in WORD.findall(t or "")]
    assert w.count.tolist() == [len(WORD.findall(t or "")) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert [v for s in slices(batch, "text", 3) for v in s.column(0).to_pylist()] == texts


def targets_by_hand(sizes, weights, share=1.5, most=2.0):
    """Raises a common level step by step: each source gets level * weight, up to ``most`` times its size."""
    goal, low, high = share * sum(sizes), 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        got = sum(min(level * w, most * s) for s, w in zip(sizes, weights, strict=True))
        low, high = (level, high) if got < goal else (low, level)
    return [min(high * w, most * s) for s, w in zip(sizes, weights, strict=True)]


def test_mixing(make, corpus):
    got = mixing.mix(make(corpus)).collect()
    assert len(got) == len(corpus)
    size = {(d, t): len(WORD.findall(t or "")) for d, t, _ in corpus}
    names = sorted({s for *_, s in corpus if s is not None}) + [None]
    total = Counter()
    for (d, t), n in size.items():
        total[next(s for e, _, s in corpus if e == d)] += n
    target = targets_by_hand([total[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"], r["text"]] and r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[names.index(r["source"])])
        assert len(set(r["shards"])) == len(r["shards"])  # copies apart
        taken[r["source"]] += r["taken"]
    assert sum(target) == pytest.approx(1.5 * sum(total.values()))
    for s, t in zip(names, target, strict=True):
        assert abs(taken[s] - t) <= 0.02 * t + 3
    mixed = mixing.mixture(make(corpus), partitions=3)
    assert mixed.columns == [*make(corpus).columns, "mix_shard"]
    parts = mixed.rdd.glom().map(lambda part: [(r["mix_shard"], r["doc_id"]) for r in part]).collect()
    flat = [r for part in parts for r in part]
    assert [x[0] for x in flat] == sorted(x[0] for x in flat)  # shards are contiguous
    assert Counter(flat) == Counter((k, r["doc_id"]) for r in got if r["size"] for k in r["shards"])
    assert Counter(len(set(x)) for x in [[r["doc_id"] for r in got if k in r["shards"]] for k in range(16)])  # every shard has documents
    again = mixing.mix(make(corpus[::-1])).collect()
    assert sorted((r["doc_id"], r["taken"], r["shards"]) for r in again) == sorted((r["doc_id"], r["taken"], r["shards"]) for r in got)


@pytest.mark.parametrize(("sizes", "weights"), [([10, 20, 30], [5, 2, 1]), ([1, 1000, 5, 7], [5, 2, 1, 5]), ([0, 4, 9], [5, 2, 1]), ([3], [5])])
def test_targets_are_filled_by_weight(sizes, weights):
    got = mixing.water_fill(np.array(sizes, float), np.array(weights, float))
    assert got.tolist() == pytest.approx(targets_by_hand(sizes, weights), rel=1e-6)


def test_draws_of_a_block_go_to_different_leaves():
    rng = np.random.default_rng(0)
    for counts in ([250] * 8, [900, 700, 400], [64, 64]):
        at = mixing.deal(np.array(counts), 1024, rng)
        assert np.bincount(at).tolist() == counts
        assert not (at[1024:] == at[: max(len(at) - 1024, 0)]).any()


def test_split_tree_keeps_quotas():
    leaves = mixing.split_tree(np.array([100, 7, 0, 33]), 8, np.random.default_rng(1))
    assert leaves.sum(0).tolist() == [100, 7, 0, 33] and leaves.sum(1).min() >= 17 and leaves.sum(1).max() <= 18


def test_token_counts(make, spark, corpus):
    docs = corpus + [(900 + i, t) for i, (_, t) in enumerate(EDGE)]
    enc = tokens.encoder(tokens.read_ranks())
    want = sorted((d[0], len(enc.encode_ordinary(d[1] or ""))) for d in docs)
    assert sorted(rows(tokens.token_counts(make(docs)))) == want


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    docs = [0, 3, 0, 9, 1, 25, 0, 2]
    ids = np.array([x for n in docs for x in [5] * n + [tokens.END]] + [6, 6], np.uint16)
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    got = tokens.separator_scan(tokens.read_token_files(spark, str(tmp_path), 2, 2 * block))
    assert sorted(rows(got, "ordinal", "n_tokens")) == [*enumerate(docs), (len(docs), 2)]


def every_window(docs, items, least=0.8):
    """(doc, item) -> (similarity, first word, words) over all windows and items, by bags of word tuples."""
    def bag(words):
        k = min(5, len(words))
        out = Counter()
        for i in range(len(words) - k + 1):
            out[tuple(words[i : i + k])] += sum(map(len, words[i : i + k]))
        return out

    best = {}
    for d, text, *_ in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for item, other in items:
            v = re.findall(r"\w+", (other or "").lower())
            if not v or not w:
                continue
            n = min(len(v), len(w))
            k = min(5, len(v))
            for at in range(len(w) - n + 1):
                x = Counter()
                for i in range(at, at + n - k + 1):
                    x[tuple(w[i : i + k])] += sum(map(len, w[i : i + k]))
                y = bag(v)
                both = sum(min(c, y[g]) for g, c in x.items())
                sim = both / (sum(x.values()) + sum(y.values()) - both)
                if sim >= least and sim > best.get((d, item), (0,))[0]:
                    best[d, item] = (sim, at, n)
    return best


def test_decontamination(make, spark, corpus):
    rng = random.Random(9)
    items = [(i, prose(rng, n, 3000)) for i, n in enumerate([3, 12, 30, 60, 30])] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w, v = items[3][1].split(), items[4][1].split()
    docs = [d for d in corpus if len((d[1] or "").split()) < 100][:40]
    docs += [(500, f"a b {items[1][1].upper()} c"), (501, items[2][1].replace(" ", ", ")), (502, " ".join(w[:57] + ["x", "y", "z"])), (503, " ".join(w[:30])), (504, f"k {items[0][1]} k")]
    docs += [(505, " ".join(["q"] * 20 + w[:29] + ["put", "in"] + w[29:] + ["q"] * 20)), (506, f"{items[1][1]} {items[2][1]} {items[1][1]}"), (507, " ".join(v[:28] + v[29:])), (508, " ".join(v[:14] + v[16:] + v))]
    for k in range(509, 540):  # words changed, put in and left out
        x = list(w)
        for _ in range(k % 4):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(3)] = ["new"] * rng.randrange(3)
        docs.append((k, " ".join(["u"] * (k % 7) + x + ["o"] * (k % 5))))
    want = every_window(docs, items)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"], r["n_words"]) for r in decontaminate.contaminated(make(docs), bench).collect()}
    assert {(500, 1), (501, 2), (502, 3), (504, 0), (506, 1), (506, 2), (508, 4)} <= set(want)
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert got[k][0] == pytest.approx(x[0]) and got[k][1:] == x[1:]
    left = Counter(r["doc_id"] for r in decontaminate.drop_contaminated(make(docs), bench).collect())
    assert left == Counter(d[0] for d in docs if d[0] not in {k for k, _ in want})


def test_passes_over_the_benchmark_change_nothing(make, spark, corpus, monkeypatch):
    rng = random.Random(19)
    items = [(i, prose(rng, 20, 300)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(k, f"before {items[k][1]} after") for k in range(12)] + corpus[:20]
    want = sorted(rows(decontaminate.contaminated(make(docs), bench)))
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 5)
    assert sorted(rows(decontaminate.contaminated(make(docs), bench))) == want and len(want) == 12
    assert decontaminate.drop_contaminated(make(docs), bench).count() == 20


def test_multi_index_is_exact():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    index = decontaminate.MultiIndex(prints)
    asked = np.array([*prints[:5].tolist(), int(prints[7]) ^ 0b1011, 12345, *(prints[:40] ^ np.uint64(0x00FF00F0000F0F00)).tolist()], np.uint64)
    near = np.bitwise_count(prints[None, :] ^ asked[:, None]) <= decontaminate.RADIUS
    got = index.within(asked)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)]


def test_fingerprints_tell_near_windows_from_others():
    """Recall of the radius on windows right above the threshold, and the share of unrelated ones it passes."""
    rng = random.Random(3)
    def print_of(words):
        hashes = decontaminate._Hashes()
        s = decontaminate.shingles(np.array([hashes[x] for x in words], np.uint64), 5)
        w = decontaminate.weights(np.array([len(x) for x in words]), 5)
        return decontaminate.prints_of(s, w, np.zeros(1, np.int64), len(s))[0], decontaminate._bag(s, w)

    near = far = found = passed = 0
    for _ in range(1500):
        w = prose(rng, rng.randrange(12, 80), 3000).split()
        v = list(w)
        for _ in range(rng.randrange(1, 4)):
            v[rng.randrange(len(v))] = "zz"
        (p, a), (q, b), (r, _) = print_of(w), print_of(v), print_of(prose(rng, len(w), 3000).split())
        if decontaminate._similarity(a, b) >= 0.8:
            near += 1
            found += int(p ^ q).bit_count() <= decontaminate.RADIUS
        far += 1
        passed += int(p ^ r).bit_count() <= decontaminate.RADIUS
    assert near > 100 and found >= 0.99 * near and passed <= 0.05 * far


def test_exact_dedup(make, corpus):
    docs = [*corpus, (300, "a b"), (301, "ab"), (302, "a  b\n"), *[(700 + d[0], d[1]) for d in EDGE if d[0] is not None]]
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for d in docs:
        groups[norm(d[1])].append(d)
    for r in exact_dedup.exact_dedup(make(docs)).collect():
        text = next(d[1] for d in docs if d[0] == r["doc_id"])
        mine = groups[norm(text)]
        keep = min(mine, key=lambda d: (-len(d[1] or ""), d[0]))[0]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(mine), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(norm(text).encode()).hexdigest()


def test_lm_scores(make, corpus):
    docs = [*corpus, *[(700 + d[0], d[1]) for d in EDGE if d[0] is not None and d[0] != 5]]
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_scoring.score_texts(make(docs)).collect()}
    words = [(d[0], (d[1] or "").encode().lower().split()) for d in docs]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c, ends = Counter(), 0
    for i, w in words:
        if not held(i):
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    for i, w in words:
        r = got[i, len(w) + 1]
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((ends + 1) / (n + v + 1))
        assert r["held_out"] == held(i) and r["train_tokens"] == n and r["n_known"] == sum(x in c for x in w) + 1
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def random_model(seed=2):
    rng = np.random.default_rng(seed)
    cls, _ = lm_scoring.classes_of(rng.random(lm_scoring.VOCABULARY))
    out = rng.integers(0, lm_scoring.OUTCOMES, lm_scoring.VOCABULARY)
    share = rng.normal(size=(lm_scoring.CLASSES + 1, lm_scoring.VOCABULARY)).astype(np.float16)
    joint = rng.random((lm_scoring.CLASSES + 1, lm_scoring.GROUPS, lm_scoring.MEMBERS))
    joint /= joint.sum((1, 2), keepdims=True)
    whole = joint.sum(2)
    flat = rng.normal(0, 0.3, lm_scoring.AttentionModel.SIZE)
    return lm_scoring.AttentionModel(cls, out, share, np.log(whole), np.log(joint / whole[:, :, None]), flat)


def plain_log_prob(m, ids):
    """The score of one text, id by id and in plain loops: positions of a block of HALF see what of SPAN ids lies before them."""
    p, at = {}, 0
    for name, shape in m.SHAPES:
        n = int(np.prod(shape))
        p[name] = m.flat[at : at + n].reshape(shape)
        at += n
    total, cls = 0.0, [lm_scoring.CLASSES] + [int(m.cls[i]) for i in ids]
    for t, y in enumerate(ids):  # cls[t] is the context before id t
        first = t // lm_scoring.HALF * lm_scoring.HALF + lm_scoring.HALF - lm_scoring.SPAN
        places = [k for k in range(max(first, 0), t + 1) if (cls[k] == lm_scoring.CLASSES) == (cls[t] == lm_scoring.CLASSES)]
        w = np.array([np.exp(p["q"][cls[t]] @ p["k"][cls[k]] if cls[t] != lm_scoring.CLASSES else 0.0) * np.exp(p["d"][t - k]) for k in places])
        z = (w[:, None] * np.array([p["v"][cls[k]] for k in places])).sum(0) / w.sum()
        g, j = divmod(int(m.out[y]), lm_scoring.MEMBERS)
        one = z @ p["o"] + m.groups[cls[t]] + p["b"]
        two = z @ p["s"][g] + m.members[cls[t], g] + p["t"][g]
        total += one[g] - np.log(np.exp(one).sum()) + two[j] - np.log(np.exp(two).sum()) + float(m.share[cls[t], y])
    return total


def test_log_prob_against_plain_loops():
    m, rng = random_model(), np.random.default_rng(4)
    texts = [rng.integers(0, lm_scoring.VOCABULARY, n) for n in (1, 2, 15, 16, 17, 31, 33, 100)]
    got = m.log_prob(np.concatenate(texts), np.array([len(x) for x in texts]))
    assert got.tolist() == pytest.approx([plain_log_prob(m, x.tolist()) for x in texts], rel=1e-4)


def test_attention_is_causal_and_normalised():
    m, rng = random_model(), np.random.default_rng(3)
    x = rng.integers(0, lm_scoring.CLASSES, (2, lm_scoring.SPAN))
    x[0, :7] = lm_scoring.CLASSES
    every = np.stack([m.score(x, np.full(x.shape, k), slice(0, lm_scoring.SPAN)) for k in range(lm_scoring.OUTCOMES)])
    assert np.allclose(np.exp(every).sum(0), 1, atol=1e-4)
    y = x.copy()
    y[:, 20:] = 0
    goal = np.zeros((2, 20), int)
    assert np.allclose(m.score(x, goal, slice(0, 20)), m.score(y, goal, slice(0, 20)), atol=1e-5)
    goal = rng.integers(0, lm_scoring.OUTCOMES, x.shape)
    weight = rng.random(x.shape).astype(np.float32)
    weight[0, :3] = 0

    def loss(flat):
        return lm_scoring.AttentionModel(m.cls, m.out, None, m.groups, m.members, flat).gradient(x, goal, weight)

    grad, at = loss(m.flat)[1], 0
    for name, shape in m.SHAPES:
        i = at + int(np.argmax(np.abs(grad[at : at + int(np.prod(shape))])))
        at += int(np.prod(shape))
        up, down = m.flat.copy(), m.flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert (loss(up)[0] - loss(down)[0]) / 2e-2 == pytest.approx(grad[i], rel=0.05), name


def test_class_bigrams_are_summed_in_few_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 8 * lm_scoring.FILES * cores)
    few = lm_scoring.few_tasks(many)
    assert few.rdd.getNumPartitions() == 8 * cores and few.count() == 1000
    assert lm_scoring.few_tasks(spark.range(0, 10, 1, cores)).rdd.getNumPartitions() == cores


def test_weights_of_plain_loops_in_batches_of_any_size(monkeypatch):
    m, rng = random_model(5), np.random.default_rng(6)
    lengths = np.array([3, 40, 1, 700])
    ids = rng.integers(0, lm_scoring.VOCABULARY, lengths.sum())
    windows = lm_scoring.tiles(m.cls.take(ids), m.out.take(ids), lengths, np.array([0, 5, 31, 17]))
    whole, texts = m.gradient(*windows), m.log_prob(ids, lengths)
    parts = [m.gradient(*(v[k : k + 3] for v in windows)) for k in range(0, len(windows[0]), 3)]
    assert sum(p[0] for p in parts) == pytest.approx(whole[0], rel=1e-5)
    assert np.allclose(sum(p[1] for p in parts), whole[1], rtol=1e-3, atol=1e-3)
    monkeypatch.setattr(lm_scoring, "BATCH", 5)
    assert np.allclose(m.log_prob(ids, lengths), texts, rtol=1e-6)


def test_scores_learn_and_do_not_depend_on_partitions(make):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the cat sat on", "a dog ran to", "the mat and", "then home"]) for _ in range(40))) for i in range(60)]
    docs += [(100 + i, " ".join(rng.sample(docs[i][1].split(), 100))) for i in range(20)]
    one = {r["doc_id"]: r for r in lm_scoring.score_texts(make(docs).repartition(1)).collect()}
    many = {r["doc_id"]: r for r in lm_scoring.score_texts(make(docs).repartition(7, "text")).collect()}
    for d, r in one.items():
        assert many[d]["score"] == pytest.approx(r["score"], rel=1e-3) and many[d]["base_score"] == pytest.approx(r["base_score"])
    per = {d: r["score"] / r["n_tokens"] for d, r in one.items()}
    assert min(per[d] for d in range(60) if one[d]["held_out"]) > max(per[d] for d in range(100, 120))  # word order counts


def brute_components(docs, percent):
    sets = {}
    for d in docs:
        w = (d[1] or "").encode().lower().split()
        sets[d[0]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("block", [512, 8])
def test_minhash(make, corpus, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # small blocks: long lists, pivots and pairs of blocks
    docs = [*corpus, *[(600 + i, t) for i, (d, t) in enumerate(EDGE) if d is not None]]
    rng = random.Random(8)
    seed = prose(rng, 150, 5000).split()
    for i in range(1000, 1080):  # a large group of near copies
        w = list(seed)
        for _ in range(1 + i % 2):
            w[rng.randrange(len(w))] = f"z{i}"
        docs.append((i, " ".join(w)))
    want = brute_components(docs, 85)
    for d, n, c, kept in rows(minhash.near_components(make(docs)), "doc_id", "n_shingles", "component_id", "kept"):
        assert (n, c) == want[d] and kept == (c == d)
    left = sorted(r["doc_id"] for r in minhash.drop_near_copies(make([d for d in docs if d[0] != 605]), 85).collect())
    assert left == sorted(d for d, (_, c) in want.items() if c == d and d != 605)


def test_toxicity(make, spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [f"{rng.choice(['lor', 'ip', 'sum', 'dol'])}{rng.choice(['a', 'em', 'or', 'is'])}" for _ in range(30)]
        if bad:
            w[3] = rng.choice(["idiot", "moron", "scum", "stupid"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs += [(700, "lorem 1d10t dola"), (701, "dolor you m o r o n ipa"), (702, "suma stuuuupid lora"), (703, None), (704, "")]
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(make(docs), truth).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in got.items())
    held = [d for d in range(600) if got[d]["held_out"]]
    assert sum(got[d]["predicted"] == (d % 5 == 0) for d in held) >= 0.97 * len(held)
    assert [got[d]["predicted"] for d in (700, 701, 702, 703, 704)] == [1, 1, 1, 0, 0]
    left = {r["doc_id"] for r in toxicity.reject_toxic(make(docs), truth).collect()}
    assert left == {d for d, r in got.items() if not r["predicted"]}
    flipped = truth.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) as toxic")
    assert {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(make(docs), flipped).collect()} == {d: r["score"] for d, r in got.items()}  # held-out labels are not read
    assert {r["predicted"] for r in toxicity.score_toxicity(make(docs[:9]), truth.where("false")).collect()} == {0}


def cut_by_hand(rows_, shards):
    """Shard of each (key, size) row in order: where the middle of the row lies."""
    total, before, out = sum(n for _, n in rows_), 0, []
    for k, n in rows_:
        out.append((k, min(int((before + n / 2) * shards / total), shards - 1)))
        before += n
    return out


def test_sharding(make, corpus):
    docs = [*corpus, *((700 + i, t) for i, (_, t) in enumerate(EDGE[:-1]))]
    got = sharding.shard_by_bytes(make(docs), 8, partitions=3).collect()
    order = sorted(docs, key=lambda d: (hashlib.md5((d[1] or "").encode()).hexdigest(), d[0] is not None, d[0] or 0))
    want = dict(cut_by_hand([(d[0], len((d[1] or "").encode()) + 1) for d in order], 8))
    slot = Counter()
    place = {}
    for d in order:
        place[d[0]] = slot[want[d[0]]]
        slot[want[d[0]]] += 1
    assert len(got) == len(docs)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        assert (r["shard"], r["slot"]) == (want[r["doc_id"]], place[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None
    one = sharding.shard_by_bytes(make([(k, "same text") for k in range(1000)]), 8).groupBy("shard").count().collect()
    assert {r["count"] for r in one} == {125}  # a hot group is cut like any other


def test_stored_order_is_kept(make, spark, tmp_path):
    docs = [(k, "w " * (k % 9)) for k in range(300)]
    make(docs).coalesce(1).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    got = sharding.shard_by_bytes(read, 5, order=sharding.stored_order(read)).select("doc_id", "shard", "slot").collect()
    want = cut_by_hand([(k, len(t) + 1) for k, t in docs], 5)
    assert sorted((r["doc_id"], r["shard"]) for r in got) == want
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == [k for k, _ in docs]
    assert sharding.stored_order(make(docs)) is None


def test_substring_dedup(make, corpus):
    docs = [*corpus, (400, "p q r " * 40), (401, None), (402, "")]
    words = [(d[0], (d[1] or "").encode().split()) for d in docs]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    want = {}
    for i, w in words:
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        kept = b" ".join(x for x, y in zip(w, keep, strict=True) if y)
        want[i] = (len(w), keep.count(False), hashlib.sha256(kept).hexdigest(), kept.decode())
    got = substring_dedup.substring_dedup(make(docs))
    assert {d: tuple(x) for d, *x in rows(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")} == want


def test_secrets(make):
    text = 'é password = "abcDEF123456+/x" AKIA' + "Z" * 14 + " deadbeefdeadbeef0 token: short api_key=Qq7!x pwd: qwertyuiop pwd: Zx9$kLm2@vT8w secret=abcabcabcabc"
    docs = [(1, text), (2, None), (3, ""), (4, "AKIA tokens and secrets"), (4, "AKIA tokens and secrets")]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(make(docs), ranks={"password": 1, "dragon": 2}).collect()}
    r = got[1]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (2, 1, 1)
    assert "guess" not in got[4]["spans"] and got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    found = {text[s["start"] : s["end"]] for s in r["found"] if s["kind"] == "guess"}
    assert "Zx9$kLm2@vT8w" in found and "qwertyuiop" not in found and "abcabcabcabc" not in found


def test_guess_cost_finds_the_cheapest_cut():
    ranks = {"dragon": 9}
    cost = lambda v: secrets.guess_cost(v, ranks)
    assert cost("") == 0 and cost("dragon") == pytest.approx(1)
    assert cost("dr4g0n") < cost("dr5g2n") and cost("qwerty") < cost("qmexty") and cost("19840607") < cost("71840697")
    assert cost("ab" * 20) < cost("ab") + 2 and cost("x" * 100_000) < 10


def plain_spans(text):
    """The base rules read character by character."""
    out, low = [], text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        step = 1
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(name, i):
                continue
            j = i + len(name)
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "=") or j >= len(text):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            k = j
            while k < len(text) and text[k] in value:
                k += 1
            if k > j:
                if k - j >= 12:
                    out.append((i, k, "assign"))
                step = k - i
                break
        i += step
    for start, allowed, least, kind in (("AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18, "access"), ("", set("0123456789abcdef"), 16, "hex")):
        i = 0
        while i < len(text):
            if not text.startswith(start, i):
                i += 1
                continue
            k = i + len(start)
            while k < len(text) and text[k] in allowed:
                k += 1
            if k > i + len(start) and k - i >= least:
                out.append((i, k, kind))
            i = max(k, i + 1) if k > i + len(start) else i + 1
    return sorted(out)


def test_base_rules_against_a_plain_scanner():
    rng = random.Random(12)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "apiKey", ":", "=", " ", "  ", "'", '"', "abcDEF123456", "x/y+z=_.-", "AKIA", "AKIAAKIA", "Z" * 14, "0123456789abcdef", "deadbeef", "é", "ſecret", "\t", "\n", "K", "::"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert sorted(secrets.base_spans(text)) == plain_spans(text), text


def every_cut(value, ranks):
    """Guess cost by trying all segmentations into pieces of all kinds."""
    low = value.lower()
    plain = low.translate(secrets.LEET)
    step, turn = np.log10(2), np.log10(4)

    def pieces(i, j):
        part = low[i:j]
        if j == i + 1:
            yield secrets._pool(value[i])
        if (m := secrets._DATE.match(value, i)) and m.end() == j and value[i].isdigit():
            yield np.log10(120 * (365 if j - i > 4 else 1))
        if j - i >= 3:
            for form, extra in ((low, 0.0), (plain, step)):
                if form[i:j] in ranks:
                    yield np.log10(ranks[form[i:j]] + 1) + extra + (0.0 if value[i:j] == part else step)
            if all(secrets._near(a, b) for a, b in zip(part, part[1:], strict=False)):
                yield np.log10(47) + (j - i - 1) * turn
            for d in (1, -1):
                if all(ord(b) - ord(a) == d and b.isalnum() for a, b in zip(part, part[1:], strict=False)):
                    yield np.log10(72) + (j - i - 1) * 0.05
            for k in (1, 2, 3, 4, 6, 8):
                if (j - i) % k == 0 and j - i > k and part == part[:k] * ((j - i) // k):
                    longest = (len(low[i:]) - len(low[i:].removeprefix(part))) // len(part) if part else 0
                    if longest == 1 and not low[j:].startswith(part[:k]):
                        yield sum(map(secrets._pool, part[:k])) + np.log10((j - i) // k)

    best = [0.0] + [np.inf] * len(value)
    for j in range(1, len(value) + 1):
        for i in range(j):
            for cost in pieces(i, j):
                # a brute-force span goes on without another choice of kind
                best[j] = min(best[j], best[i] + cost + (step if i and j > i + 1 else 0.0))
    return best[-1]


def test_guess_cost_against_every_segmentation():
    rng = random.Random(7)
    ranks = {"dragon": 9, "pass": 3, "word": 40, "sun": 11, "password": 1}
    bits = ["dragon", "Dr4g0n", "pass", "word", "sun", "1984", "19840607", "qwe", "asdf", "abc", "987", "aa", "aaa", "abab", "x", "7", "$", "Q", "é"]
    for _ in range(400):
        value = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 5)))
        assert secrets.guess_cost(value, ranks) == pytest.approx(every_cut(value, ranks)), value


@pytest.mark.parametrize("name", ["mix", "tokens", "items", "exact", "lm", "near", "toxic", "shard", "cut", "secrets"])
def test_empty_and_odd_tables(make, spark, name):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    run = {
        "mix": mixing.mix, "tokens": tokens.token_counts, "items": lambda d: decontaminate.contaminated(d, bench), "exact": exact_dedup.exact_dedup,
        "lm": lm_scoring.score_texts, "near": minhash.near_components, "toxic": lambda d: toxicity.score_toxicity(d, labels), "shard": sharding.shard_by_bytes,
        "cut": substring_dedup.substring_dedup, "secrets": lambda d: secrets.scan_secrets(d),
    }[name]
    assert run(make([])).count() == 0
    assert run(make(EDGE)).count() == (0 if name == "items" else len(EDGE))


def test_toxicity_lattice_sees_every_disguise():
    text = " ".join(["you are an idiot", "a killer", "hate", "moron", "asshole", "the class"] * 50)
    points = [toxicity._code(ch) for ch in f" {text} "]
    counts = np.zeros((28, 28, 28))
    for p, q, r in zip(points, points[1:], points[2:]):  # noqa: B905
        counts[p, q, r] += 1
    cache = toxicity._Restored(toxicity.Decoder(counts))
    want = {"hat3": "hate", "idio+": "idiot", "!diot": "idiot", "a$$hole": "asshole", "ki11er": "killer", "iidioot": "idiot", "idiot!": "idiot", "(idiot!!": "idiot", "i.d.i.0.t": "idiot"}
    for word, plain in want.items():
        assert plain in {f for w in toxicity.restored_words(word, cache) for f in w.split()}, word
    assert {"you", "are", "an", "idiot"} <= toxicity.restored_words("y o u a r e a n i d 1 o t", cache)
    assert "=class" in toxicity.features(*toxicity.restored_words("class", cache))


def test_lattice_against_every_path():
    """The decoder's reading costs no more than any other of all readings of the lattice."""
    rng = np.random.default_rng(5)
    decoder = toxicity.Decoder(rng.integers(0, 9, (28, 28, 28)).astype(float))
    lm = decoder.lm

    def readings(word, state, out, score, at=0):
        if at == len(word):
            yield score + lm[state[0]][state[1]][0], out
            return
        p, q = state
        ch = word[at]
        if ch == " ":
            yield from readings(word, state, out, score, at + 1)
            if q:
                yield from readings(word, (0, 0), out + " ", score + toxicity._BREAK + lm[p][q][0], at + 1)
            return
        for letter, c, cost in toxicity._arcs(ch):
            yield from readings(word, (q, c), out + letter, score + cost + lm[p][q][c], at + 1)
            if out.endswith(letter):
                yield from readings(word, state, out, score + toxicity._REPEATED + cost, at + 1)
        if not ch.isalpha():
            yield from readings(word, state, out, score + (toxicity._INSERTED if ch in toxicity.LEET else toxicity._DROPPED), at + 1)

    for word in ["a1b", "1d10t", "aabb", "5c5", "a.b", "i d 1 o t", "m00", "6g6", "b a a", "x$y$"]:
        every = {}
        for score, out in readings(word, (0, 0), "", 0.0):
            every[out] = max(score, every.get(out, -1e9))
        assert every[decoder.decode(word)] == pytest.approx(max(every.values()), abs=1e-9), word


def test_mixing_fills_past_a_long_document(make, spark):
    edge = spark.createDataFrame([(0, k // 1000, k % 1000, 100_000 if k == 300 else 10) for k in range(1001)], "_i int, _fine int, _order long, size long")
    assert sum(r["size"] for r in mixing.fill(edge, {0: 8000.0}).collect()) == 8000
    assert sum(r["size"] for r in mixing.fill(edge, {0: 99_000.0}).collect()) == 103_000  # nearer with the long one than without
    rng = random.Random(6)
    rows_ = [(i, rng.randrange(40), rng.randrange(2**40), rng.choice([3, 7, 50, 900])) for i in (0, 1) for _ in range(300)]
    edge = spark.createDataFrame(rows_, "_i int, _fine int, _order long, size long")
    for gap in (1.0, 2.4, 333.0, 20_001.5):
        got = mixing.fill(edge, {0: gap, 1: gap}).collect()
        assert len(got) == len(set(got)) and all(abs(sum(r["size"] for r in got if r["_i"] == i) - gap) <= 2 for i in (0, 1))
    docs = [(k, "w " * (10_000 if k == 7 else 5), "a") for k in range(3001)]
    got = mixing.mix(make(docs)).collect()
    assert all(r["taken"] == r["size"] * len(r["shards"]) for r in got)
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 5


def test_training_windows_tile_whole_texts():
    lengths = np.array([1, 5, 32, 33, 700, 20_000])
    ids = np.arange(int(lengths.sum()))
    for shift in (0, 7, 31):
        x, y, w = lm_scoring.tiles(ids + 1000, ids, lengths, np.full(len(lengths), shift))
        assert x.shape[1] == lm_scoring.SPAN and w.any(1).all() and sorted(y[w > 0].tolist()) == ids.tolist()
        first = set((np.cumsum(lengths) - lengths).tolist())
        for c, g in zip(x[w > 0].tolist(), y[w > 0].tolist(), strict=True):
            assert c == (lm_scoring.CLASSES if g in first else g - 1 + 1000)
