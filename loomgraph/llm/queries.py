"""The queries of the thirteen operators, each over its whole tables, and their SQL where SQL can express them.

Nulls, empty and long texts, ties, repeated rows and empty tables are dealt
with as the operators' docstrings say; columns that a query does not name are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the shards of its copies."""
    from loomgraph.llm.mixing import mix

    return mix(_docs(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword ids of each text."""
    from loomgraph.llm.tokens import token_counts

    return token_counts(_docs(spark, sf_dir))


def op3_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in documents, the best window for each item."""
    from loomgraph.llm.decontaminate import contaminated

    return contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document, and which stays."""
    from loomgraph.llm.exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of each text under the word counts and under the attention model."""
    from loomgraph.llm.lm_scoring import score_texts

    return score_texts(_docs(spark, sf_dir))


def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-copy component of each document."""
    from loomgraph.llm.minhash import near_components

    return near_components(_docs(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    from loomgraph.llm.toxicity import score_toxicity

    return score_toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, by equal bytes."""
    from loomgraph.llm.sharding import shard_by_bytes

    return shard_by_bytes(_docs(spark, sf_dir), carry=["doc_id"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated windows of 35 words leave of each document."""
    from loomgraph.llm.substring_dedup import substring_dedup

    return substring_dedup(_docs(spark, sf_dir), with_text=False).drop("kept_text", "removed")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document."""
    from loomgraph.llm.secrets import scan_secrets

    return scan_secrets(_docs(spark, sf_dir)).drop("found")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of each order, by language."""
    from loomgraph.llm.filter_audit import audit

    return audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place in the sample of each document, resampled towards the benchmark."""
    from loomgraph.llm.resampling import resample

    return resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-copy component of each document."""
    from loomgraph.llm.simhash import near_components

    return near_components(_docs(spark, sf_dir))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from loomgraph.llm import exact_dedup, filter_audit, minhash, resampling, sharding, substring_dedup

    return {
        "op4_exact_dedup": exact_dedup.ORACLE, "op6_minhash_components": minhash.ORACLE, "op8_shard_by_bytes": sharding.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE, "op12_importance_resampling": resampling.ORACLE,
    }
