"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

A stage judges each row of ``docs`` by itself and returns the columns of
``docs`` as they are, whatever their names; the last adds its own. Null and
empty texts are clean, no copies of anything, hold no benchmark passage and
have no words to mix, so mixing takes none of them. Very long texts are judged
whole, like any other. Empty tables give empty tables. The first writes what
it leaves, so that its texts pass in small batches beside its word caches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import written

#: Output shards of the mix and of the last stage.
SHARDS = 8


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; equal texts are judged alike."""
    from loomgraph.llm.toxicity import reject_toxic

    return written(reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "clean")


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, rows that repeat included; documents without words all stay."""
    from loomgraph.llm.minhash import drop_near_copies

    return drop_near_copies(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    from loomgraph.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weigh_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, repeated where a source is upsampled, in the order of the mix's shards."""
    from loomgraph.llm.mixing import mixture

    return mixture(docs, shards=SHARDS, with_shard=False)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot.

    Shards are contiguous in the order in which the documents are stored, the
    order of the mix; a frame that isn't read from files is taken in the order
    of its texts' hashes.
    """
    from loomgraph.llm.sharding import shard_by_bytes, stored_order

    return shard_by_bytes(docs, SHARDS, order=stored_order(docs))
