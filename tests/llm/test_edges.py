"""Defined results for null, empty, blank, long, tied and repeated rows."""

import hashlib

import pytest

from loomgraph.llm import decontaminate, exact_dedup, lm_scoring, minhash, mixing, secrets, sharding, substring_dedup, toxicity

LONG = "word " * 30000
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "Ünïcode\x85word   x"), (None, "three four"), (7, LONG)]
NONE = hashlib.sha256(b"").hexdigest()


def by_id(frame, *cols):
    return {(r["doc_id"], *(r[c] for c in cols)) for r in frame.collect()}


def test_mixing(make):
    got = by_id(mixing.mix(make(ROWS)), "size", "source_size", "target", "taken")
    assert {x[:2] for x in got} == {(1, 0), (2, 0), (3, 0), (4, 2), (5, 2), (6, 2), (None, 2), (7, 30000)}
    assert {x[2:4] for x in got} == {(30010, 45015.0)} and all(x[4] in (0, x[1], 2 * x[1]) for x in got)
    blank = by_id(mixing.mix(make(ROWS[:3])), "size", "source_size", "target", "taken")
    assert blank == {(k, 0, 0, 0.0, 0) for k in (1, 2, 3)}


def test_exact_dedup(make):
    got = by_id(exact_dedup.exact_dedup(make(ROWS)), "keep_id", "group_size", "kept")
    assert got == {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 4, 3, True), (5, 4, 3, False), (6, 6, 1, True), (None, None, 1, True), (7, 7, 1, True)}


def test_lm_scores(make):
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_scoring.score_texts(make(ROWS)).collect()}
    assert {k for k in got} == {(1, 1), (2, 1), (3, 1), (4, 3), (5, 3), (6, 3), (None, 3), (7, 30001)}
    assert got[1, 1]["score"] == pytest.approx(got[2, 1]["score"]) and got[None, 3]["held_out"] is False and all(r["score"] <= 0 for r in got.values())


def test_near_components(make):
    got = by_id(minhash.near_components(make(ROWS)), "n_shingles", "component_id", "kept")
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, None, True), (7, 1, 7, True)}


def test_an_id_with_two_texts_is_one_document(make):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "p q r s t u"), (3, "p q r s t u")]
    assert by_id(minhash.near_components(make(rows)), "component_id") == {(1, 1), (2, 1), (3, 1)}


def test_near_copies_go_by_row(make):
    rows = [(1, "t t t"), (1, "t t t"), (2, "t t t"), (2, "other"), (None, "other"), (None, None), (None, None), (3, "")]
    left = sorted(((r["doc_id"], r["text"]) for r in minhash.drop_near_copies(make(rows)).collect()), key=str)
    assert left == sorted([(1, "t t t"), (2, "other"), (None, None), (3, "")], key=str)


def test_toxicity(make, spark):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, None), (6, 7), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(make(ROWS), labels).collect()
    scores = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(ROWS) and scores[1] == scores[2] == scores[3] and all(0 <= x <= 1 for x in scores.values())
    assert scores[4] == scores[5]  # equal texts


def test_sharding(make):
    got = sharding.shard_by_bytes(make(ROWS), 2).collect()
    size = {r["doc_id"]: r["size"] for r in got}
    assert (size[1], size[2], size[3], size[4], size[7]) == (1, 1, 4, 8, len(LONG) + 1)
    for s in (0, 1):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_substring_dedup(make):
    got = by_id(substring_dedup.substring_dedup(make(ROWS)), "n_words", "n_removed", "kept_sha256")
    assert {(1, 0, 0, NONE), (2, 0, 0, NONE), (3, 0, 0, NONE), (7, 30000, 30000, NONE)} <= got and {x[:3] for x in got} >= {(4, 2, 0), (None, 2, 0)}


def test_decontamination(make, spark):
    items = spark.createDataFrame([(1, "one two"), (1, "three four"), (2, None), (3, " "), (None, "word " * 10)], "item_id long, text string")
    got = by_id(decontaminate.contaminated(make(ROWS), items), "item_id", "similarity", "first_word", "n_words")
    assert got == {(4, 1, 1.0, 0, 2), (5, 1, 1.0, 0, 2), (None, 1, 1.0, 0, 2), (7, None, 1.0, 0, 10)}
    assert sorted(str(r["doc_id"]) for r in decontaminate.drop_contaminated(make(ROWS), items).collect()) == ["1", "2", "3", "6"]


def test_texts_of_an_item_share_a_pass(make, spark, monkeypatch):
    text = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(9)]
    items = spark.createDataFrame([(7, text[0]), (7, text[1]), *[(k, text[k]) for k in range(2, 9)]], "item_id long, text string")
    docs = make([(1, f"{text[0]} and {text[1]}"), (2, text[5])])
    once = by_id(decontaminate.contaminated(docs, items), "item_id", "similarity", "first_word", "n_words")
    assert {x[:2] for x in once} == {(1, 7), (2, 5)}
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 3)
    assert by_id(decontaminate.contaminated(docs, items), "item_id", "similarity", "first_word", "n_words") == once


def test_secrets(make):
    rows = [*ROWS, (8, f"{LONG}token=abcdefABCDEF1234"), (9, "secret = 'k'"), (10, "AKIA" + "Q" * 13)]
    got = by_id(secrets.scan_secrets(make(rows)), "n_assign", "n_access", "n_hex", "base_sha256")
    assert {(k, 0, 0, 0, NONE) for k in (1, 2, 3, 4, 7, 9, 10, None)} <= got
    span = f"assign:{len(LONG)}:{len(LONG) + 22}"
    assert (8, 1, 0, 0, hashlib.sha256(span.encode()).hexdigest()) in got


def test_a_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from loomgraph import store

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}

    Session.conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
    with pytest.raises(RuntimeError):
        store.shared_dir(Session)
