"""Exact dedup: group by 128-bit content hash, compare bytes inside groups, keep one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, semi_small
from loomgraph.operators.skew import join_keyed
from loomgraph.store import cut

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _groups(digest: DataFrame) -> DataFrame:
    rank = F.struct(F.col("doc_id").isNotNull().cast("int").alias("some"), "points", (-F.col("doc_id")).alias("neg"))
    top = digest.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("top"))
    return top.select("h", "group_size", (-F.col("top.neg")).alias("keep_id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. The row with the most
    code points in its original text stays, then the smallest id. Null and
    blank texts are one group (the empty text). Rows that repeat id and text
    are members of the group; each is kept if its id is. A null id sorts after
    every other and is kept only if its group has no other id (keep_id null).
    An empty table gives an empty result; other columns are ignored. Ids are
    whole numbers. A long text is compared as a whole, in one row.

    A hot group's digests meet its keeper by a broadcast (see ``join_keyed``).
    Only digests are shuffled: a text moves once if another text has its
    hash, to be compared byte by byte (min = max, combined before the
    shuffle, so a hot group costs one row per task).
    """
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    norm = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("points"), normalised(F.col("text")).alias("norm"))
    digest = cut(
        norm.select("doc_id", "points", F.unhex(F.md5("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256")),
        "dedup",
    )
    groups = _groups(digest)
    many = cut(groups.where("group_size > 1").select("h"), "dedup-many")
    compared = semi_small(norm.select(F.unhex(F.md5("norm")).alias("h"), "norm"), many, "h").groupBy("h").agg(
        F.min("norm").alias("lo"), F.max("norm").alias("hi")
    )
    clash = cut(compared.where("lo <> hi").select("h"), "dedup-clash")
    if not clash.isEmpty():
        # different bytes under one 128-bit hash: the second digest tells them apart
        key = F.when(F.col("clash").isNotNull(), F.unhex("text_sha256")).otherwise(F.col("h"))
        digest = cut(
            digest.join(clash.withColumn("clash", F.lit(1)), "h", "left").withColumn("h", key).drop("clash"), "dedup"
        )
        groups = _groups(digest)
    alone = F.col("group_size").isNull()
    copied = groups.where("group_size > 1").withColumn("n", F.col("group_size"))
    out = join_keyed(digest, copied, ["h"], "n", digest.count())
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         sha256(norm) AS text_sha256
  FROM n)
"""
