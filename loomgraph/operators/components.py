"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.operators.sizes import dealt
from loomgraph.operators.skew import join_keyed
from loomgraph.store import cut, drop


def _marks() -> list[Column]:
    """What tells a round's pairs from those of the round before: how many there are, and the sum of their hashes."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(*_marks()).first()
    return row["n"], row["h"]


def _with_low(rows: DataFrame, total: int) -> DataFrame:
    """Each row (u, v) with the least neighbour m of u; a hot centre meets it by a broadcast."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_keyed(rows, low, ["u"], "n", total)


def _large_star(e: DataFrame, total: int) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_low(both, 2 * total).withColumn("m", F.least("m", "u"))
    return near.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, total: int) -> DataFrame:
    near = _with_low(e, total)
    # (v, m) for the other neighbours, and (u, m) itself
    return near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every endpoint; component = smallest id reachable.

    Edge direction, repeated edges and self-loops do not matter; nulls are
    ignored. Work per round is linear in the edges, the rounds logarithmic in
    practice. A hot centre is pre-aggregated, and its neighbours stay where
    they are: its least neighbour is broadcast to them.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).dropna()
    ids = cut(e.select("a").unionAll(e.select(F.col("b").alias("a"))).distinct().select(F.col("a").alias("id")), "cc-ids")
    e = cut(e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = _fingerprint(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        star = cut(dealt(_large_star(e, seen[0]), seen[0], "u", "v").distinct(), "cc")
        # counted by the tasks that write
        counted = Observation()
        nxt = cut(dealt(_small_star(star, seen[0]), seen[0], "u", "v").distinct().observe(counted, *_marks()), "cc")
        drop(star)
        drop(e)
        e, before = nxt, seen
        seen = counted.get["n"], counted.get["h"]
        if seen == before:
            break
    else:
        raise RuntimeError("connected components did not settle; raise max_rounds")
    return ids.join(e, ids["id"] == e["u"], "left").select("id", F.coalesce("v", "id").alias("component"))
