"""Synthetic graphs for tests and trials."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession


def preferential_attachment(spark: SparkSession, n: int = 1632, m: int = 3, seed: int = 42) -> DataFrame:
    """(src, dst) of ``m`` * (``n`` - ``m``) edges: each new node joins ``m`` others, drawn by their degrees; made on the driver."""
    rng, ends, edges = random.Random(seed), list(range(m)), []
    for new in range(m, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(rng.choice(ends))
        for old in sorted(chosen):
            edges.append((old, new))
            ends += [old, new]
    return spark.createDataFrame(edges, "src long, dst long")
