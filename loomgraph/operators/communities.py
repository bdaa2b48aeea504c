"""Communities of a label frame: ranks, sizes, modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.model import LISTED_NODES
from loomgraph.operators.graph import dense_index
from loomgraph.store import cut


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("label").alias("community_id")).agg(F.count(F.lit(1)).alias("size"))


def communities(labels: DataFrame, include_node_ids: bool = True) -> DataFrame:
    """(cluster_index, community_id, size[, node_ids]): largest first, then smallest id; members ascending.

    Ranks are prefix sums over ranges of (size, id), so no task sees all
    communities. A member list is one row: leave them out of large graphs.
    """
    aggs = [F.count(F.lit(1)).alias("size")]
    if include_node_ids:
        aggs.append(F.sort_array(F.collect_list("id")).alias("node_ids"))
    got = labels.groupBy(F.col("label").alias("community_id")).agg(*aggs)
    got = cut(got, "communities")
    rank = dense_index(got.select(F.struct((-F.col("size")).alias("neg"), "community_id").alias("id")))
    rank = rank.select(F.col("id.community_id").alias("community_id"), (F.col("idx") + 1).cast("int").alias("cluster_index"))
    return got.join(rank, "community_id").select("cluster_index", "community_id", "size", *(["node_ids"] if include_node_ids else []))


def payload(labels: DataFrame, approach: str | None = None) -> dict:
    """The nested result; node ids are listed up to LISTED_NODES nodes."""
    listed = labels.limit(LISTED_NODES + 1).count() <= LISTED_NODES
    clusters = [r.asDict() for r in communities(labels, listed).orderBy("cluster_index").toLocalIterator()]
    out = {"num_communities": len(clusters), "include_node_ids": listed, "clusters": clusters}
    return out | ({"approach": approach} if approach else {})


def payload_of(spark: SparkSession, mapping: dict[int, int], approach: str | None = None) -> dict:
    """The nested result of a label map; an empty map has no clusters."""
    return payload(spark.createDataFrame(list(mapping.items()), "id long, label long"), approach)


def size_stats(labels: DataFrame) -> DataFrame:
    """(communities, min, p50, p95, max): p50 and p95 by index into the ascending sizes.

    Sizes are counted per distinct size first, so the sorted list has a row
    per distinct size and not per community.
    """
    by = sizes(labels).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    run = by.withColumn("upto", F.sum("n").over(Window.orderBy("size")))
    total = run.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("t"))
    x = run.join(F.broadcast(total))

    def at(place):
        return F.coalesce(F.min(F.when(F.col("upto") > place, F.col("size"))), F.lit(0))

    return x.agg(
        F.coalesce(F.max("t"), F.lit(0)).alias("communities"), F.coalesce(F.min("size"), F.lit(0)).alias("min_size"),
        at(F.floor(F.col("t") / 2)).alias("p50"), at(F.least(F.col("t") - 1, F.floor(F.col("t") * 0.95))).alias("p95"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
    )


def top_share(labels: DataFrame, k: int = 10) -> DataFrame:
    """(k, share_pct): share of the nodes in the k largest communities."""
    s = sizes(labels)
    top = s.orderBy(F.desc("size"), "community_id").limit(k).agg(F.sum("size").alias("top"))
    return s.agg(F.sum("size").alias("all")).join(F.broadcast(top)).select(F.lit(k).alias("k"), (F.col("top") * 100.0 / F.col("all")).alias("share_pct"))


def fingerprint(labels: DataFrame) -> DataFrame:
    """(size, communities): how many communities have each size."""
    return sizes(labels).groupBy("size").agg(F.count(F.lit(1)).alias("communities"))


def modularity(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity) of symmetric arcs: internal share minus squared degree share, summed over communities."""
    a = arcs.join(labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    per = a.groupBy("ls").agg(F.count(F.lit(1)).alias("deg"), F.count_if(F.col("ls") == F.col("ld")).alias("inner"))
    m = per.agg(F.sum("deg").alias("m2"))
    return per.join(F.broadcast(m)).agg(F.sum(F.col("inner") / F.col("m2") - F.pow(F.col("deg") / F.col("m2"), F.lit(2))).alias("modularity"))
