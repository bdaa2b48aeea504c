"""The corpus pipeline: STAGES over documents, each written as Parquet and reread by the next (the first writes itself)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.stages import contaminated_out, near_copies_out, shard, toxic_out, weigh_sources
from loomgraph.store import cut

STAGES = [
    ("toxicity", toxic_out),
    ("minhash near-dedup", near_copies_out),
    ("benchmark decontamination", contaminated_out),
    ("mixing to target weights", weigh_sources),
    ("sharding", shard),
]

#: Learned scores and a random mix have no SQL form; tests/llm/test_pipeline.py holds run() against a plain version on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that STAGES leave of ``documents``, with size, text_crc32, law, shard, slot and grown_shard.

    Each row is judged by its own text; of rows that repeat one stays. Texts
    without words are judged clean but have no words to mix, so the mix takes
    none of them. Extra columns pass through, whatever their names, but for
    those that the last stage adds. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if 0 < k < len(STAGES) - 1:
            docs = cut(docs, "pipeline")
    return docs
