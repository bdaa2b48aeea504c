"""Rough estimates of memory and time from node and arc counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arcs of the full graph, and as the low estimate takes them; seconds of its measured load, and their range.
FULL_ARCS_LOW = 234_000_000
FULL_ARCS, FULL_LOAD_S, LOAD_LOW, LOAD_HIGH = 234_370_166, 420.0, 0.7, 1.4
#: Nodes and arcs of the two calibration runs, and seconds, driver and tree memory (MB) of each backend in them.
CALIBRATED_NODES = (1632, 163_280)
CALIBRATED_ARCS = (3910, 1_880_997)
CALIBRATED = {
    "ray": {"time": (2.26, 84.57), "driver": (177.0, 567.0), "tree": (1018.0, 1578.0)},
    "dask": {"time": (7.76, 110.36), "driver": (209.0, 708.0), "tree": (517.0, 1202.0)},
}
#: Share of the linear estimate that a part of a graph takes at least; least driver MB besides the graph; graph copies in the driver; load peak and what Python adds to it.
PART_LOW, LEAST_DRIVER_MB, DRIVER_COPIES, LOAD_SHARE, LOAD_MB = 0.6, 200.0, 1.1, 0.9, 300.0
MB = 1024.0**2


def steady_bytes(nodes, arcs):
    """Ids, row pointers and neighbours in 4-byte integers."""
    return nodes * 8 + 4 + arcs * 4


def peak_bytes(nodes, arcs):
    """The same at the peak of a build: 12 bytes an arc more."""
    return steady_bytes(nodes, arcs) + arcs * 12


def csr_bytes(rows: DataFrame) -> DataFrame:
    n, m = F.col("nodes"), F.col("arcs")
    return rows.select("nodes", "arcs", steady_bytes(n, m).alias("steady_bytes"), peak_bytes(n, m).alias("peak_bytes"))


def to_mb(size: Column) -> Column:
    return size / F.lit(MB)


def to_minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def load_time(rows: DataFrame) -> DataFrame:
    mid = F.col("arcs") * FULL_LOAD_S / FULL_ARCS
    return rows.select("arcs", (mid * LOAD_LOW).alias("load_low_s"), (mid * LOAD_HIGH).alias("load_high_s"))


def exponent(backend: str) -> float:
    """Slope of time over arcs on log axes between the calibration runs."""
    (x1, x2), (y1, y2) = CALIBRATED_ARCS, CALIBRATED[backend]["time"]
    return math.log(y2 / y1) / math.log(x2 / x1)


def extrapolate(rows: DataFrame, backend: str) -> DataFrame:
    """(arcs, low_s, high_s): power law and linear growth from the larger calibration run."""
    scale = F.col("arcs") / F.lit(float(CALIBRATED_ARCS[1]))
    at = CALIBRATED[backend]["time"][1]
    return rows.select("arcs", (F.pow(scale, F.lit(exponent(backend))) * at).alias("low_s"), (scale * at).alias("high_s"))


def for_fraction(rows: DataFrame, backend: str) -> DataFrame:
    """(fraction_pct, arcs, low_s, high_s): the full graph by extrapolation, parts in proportion to the larger run's arcs."""
    at, low, full = CALIBRATED[backend]["time"][1], FULL_ARCS_LOW / CALIBRATED_ARCS[1], FULL_ARCS / CALIBRATED_ARCS[1]
    mid = F.col("arcs") / F.lit(float(CALIBRATED_ARCS[1])) * at
    whole = F.col("fraction_pct") >= 100
    return rows.select(
        "fraction_pct", "arcs", F.when(whole, F.lit(at * low ** exponent(backend))).otherwise(mid * PART_LOW).alias("low_s"), F.when(whole, F.lit(at * full)).otherwise(mid).alias("high_s")
    )


def host_memory(rows: DataFrame, backend: str) -> DataFrame:
    """(nodes, arcs, load_peak_mb, driver_mb, tree_mb): scaled from the larger calibration run, with floors; rough."""
    c, n, m = CALIBRATED[backend], F.col("nodes"), F.col("arcs")
    own = steady_bytes(CALIBRATED_NODES[1], CALIBRATED_ARCS[1]) / MB
    graph = to_mb(steady_bytes(n, m))
    driver = F.lit(max(LEAST_DRIVER_MB, c["driver"][1] - own)) + graph * DRIVER_COPIES
    return rows.select(
        "nodes", "arcs", (to_mb(peak_bytes(n, m)) * LOAD_SHARE + LOAD_MB).alias("load_peak_mb"), driver.alias("driver_mb"),
        (F.greatest(F.lit(1.0), graph / own) * c["tree"][1]).alias("tree_mb"),
    )


@dataclass
class Estimate:
    """What is expected of a run, by backend where it differs."""

    fraction_pct: float
    nodes: int
    arcs: int
    steady_mb: float
    load_mb: float
    load_s: tuple[float, float]
    minutes: dict[str, tuple[float, float]]
    driver_mb: dict[str, float]
    tree_mb: dict[str, float]


def estimate(spark, fraction_pct: float, nodes: int, arcs: int) -> Estimate:
    """The estimates of one graph, by the same expressions."""
    one = spark.createDataFrame([(fraction_pct, nodes, arcs)], "fraction_pct double, nodes long, arcs long")
    size, load = csr_bytes(one).first(), load_time(one).first()
    time = {b: for_fraction(one, b).first() for b in CALIBRATED}
    host = {b: host_memory(one, b).first() for b in CALIBRATED}
    return Estimate(
        fraction_pct, nodes, arcs, size["steady_bytes"] / MB, host["ray"]["load_peak_mb"], (load["load_low_s"], load["load_high_s"]),
        {b: (r["low_s"] / 60, r["high_s"] / 60) for b, r in time.items()}, {b: r["driver_mb"] for b, r in host.items()}, {b: r["tree_mb"] for b, r in host.items()},
    )


def report(e: Estimate) -> str:
    """The estimate as text, a line for each figure."""
    lines = [
        f"Estimate for {e.fraction_pct:g}% of the graph", f"  {e.nodes:,} nodes, {e.arcs:,} arcs", f"  row pointers and neighbours: {e.steady_mb:.0f} MB, {e.load_mb:.0f} MB at the peak of the load",
        f"  load: {e.load_s[0]:.0f} to {e.load_s[1]:.0f} s",
    ]
    for b, (low, high) in e.minutes.items():
        lines.append(f"  {b}: {low:.0f} to {high:.0f} min, driver {e.driver_mb[b]:.0f} MB, process tree {e.tree_mb[b]:.0f} MB")
    return "\n".join([*lines, "  from two calibration runs of local workers; memory of large graphs is overestimated"])
