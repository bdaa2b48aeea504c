import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, h string, kept boolean, sig string"


@pytest.fixture
def make(spark):
    """A documents frame from (doc_id, text[, source]) with columns whose names clash with the operators' own."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 7, 1, "x", False, "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build
