"""Aggregates over metric rows, logs and memory samples."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.shared import put

_MEASURES = {
    "total": "total_time_s", "algo": "algorithm_time_s", "tree": "peak_process_tree_rss_mb", "driver": "peak_driver_rss_mb", "throughput": "throughput_nodes_per_s",
}


def group_stats(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of the successes per approach and fraction."""
    aggs = [f(c).alias(f"{n}_{x}") for n, c in _MEASURES.items() for x, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    ok = metrics.where("status = 'success'").groupBy("approach", "fraction_pct")
    return ok.agg(F.count(F.lit(1)).alias("runs"), *aggs, F.avg("num_communities").alias("communities_mean"))


def scalability_pivot(metrics: DataFrame, approach: str, value: str, scale: float = 1.0, workers: list[int] | None = None) -> DataFrame:
    """Rows by fraction, a column w<n> per worker count: the scaled mean of the successes."""
    rows = metrics.where((F.col("status") == "success") & (F.col("approach") == approach))
    got = rows.groupBy("fraction_pct").pivot("workers_requested", workers).agg(F.avg(F.col(value) * scale))
    return got.select("fraction_pct", *(F.col(c).alias(f"w{c}") for c in got.columns[1:]))


def failures(metrics: DataFrame) -> DataFrame:
    return metrics.where("status <> 'success'").select("approach", "fraction_pct", "run_index", "error_message")


def override_merge(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` without the rows that ``new`` has, and ``new``."""
    return base.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def iteration_series(metrics: DataFrame) -> DataFrame:
    """(run_index, iter, seconds) of the JSON lists of iteration times."""
    return metrics.select("run_index", F.posexplode(F.from_json("level_times_json", "array<double>")).alias("iter", "seconds"))


#: Fixed format: what a run logs of an iteration.
LOG_LINE = r"\[([\w-]+)\]\[iter=(\d+)\] changed=(\d+)/(\d+) \([\d.]+%\) workers=\d+ elapsed=([\d.]+)s"


def parse_log(lines: DataFrame) -> DataFrame:
    """(backend, iter, changed, total, elapsed_s) of the iteration lines of a log."""

    def part(k):
        return F.regexp_extract("value", LOG_LINE, k)

    return lines.where(F.col("value").rlike(LOG_LINE)).select(
        part(1).alias("backend"), part(2).cast("int").alias("iter"), part(3).cast("long").alias("changed"), part(4).cast("long").alias("total"), part(5).cast("double").alias("elapsed_s")
    )


def convergence_series(lines: DataFrame) -> DataFrame:
    """(backend, iter, changed): the mean number of nodes that changed in an iteration over the logged runs."""
    return parse_log(lines).groupBy("backend", "iter").agg(F.avg("changed").alias("changed"))


def by_fraction(metrics: DataFrame, fraction_pct: float) -> DataFrame:
    """The rows of one fraction, compared as numbers."""
    return metrics.where(F.col("fraction_pct").cast("double") == F.lit(float(fraction_pct)))


def timing_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("approach").agg(F.min("seconds").alias("min_s"), F.median("seconds").alias("median_s"), F.max("seconds").alias("max_s"), F.sum("seconds").alias("sum_s"))


def max_per_host(samples: DataFrame) -> DataFrame:
    return samples.groupBy("host").agg(F.max("peak_rss_mb").alias("peak_rss_mb"))


def merge_peaks(workers: DataFrame, driver: DataFrame, tree_mb: float) -> DataFrame:
    """Highest of worker and driver per host; a single host is raised to the process tree's peak."""
    both = max_per_host(workers.unionByName(driver))
    hosts = both.agg(F.count(F.lit(1)).alias("hosts"))
    raised = F.when(F.col("hosts") <= 1, F.greatest("peak_rss_mb", F.lit(tree_mb))).otherwise(F.col("peak_rss_mb"))
    return both.join(F.broadcast(hosts)).select("host", raised.alias("peak_rss_mb"))


def cluster_peak(peaks: DataFrame) -> DataFrame:
    return peaks.agg(F.sum("peak_rss_mb").alias("peak_cluster_rss_mb"))


def grid_plan(spark: SparkSession, fractions: list[float], workers: list[int], approaches: list[str], runs: int, seed: int) -> DataFrame:
    """(fraction_pct, workers, approach, run_index, seed): every run of a campaign."""
    return _grid(spark.createDataFrame([(fractions, workers, approaches)], "f array<double>, w array<int>, a array<string>"), runs, seed)


def grid_again(metrics: DataFrame, runs: int, seed: int) -> DataFrame:
    """The runs that a campaign needs which covers all settings found in ``metrics``; settings are few."""
    return _grid(metrics.agg(*(F.collect_set(c).alias(n) for n, c in zip("fwa", ("fraction_pct", "workers_requested", "approach"), strict=True))), runs, seed)


def _grid(one: DataFrame, runs: int, seed: int) -> DataFrame:
    grid = one.select(F.explode("f").alias("fraction_pct"), "w", "a").select("fraction_pct", F.explode("w").alias("workers"), "a").select("fraction_pct", "workers", F.explode("a").alias("approach"))
    return grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run_index")).withColumn("seed", (F.col("run_index") + seed).cast("long"))


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table; missing values are dashes."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    show = lambda v: "—" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    return "\n".join([*lines, *("| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows)])


def _titled(title: str, rows: list[dict], columns: list[str]) -> list[str]:
    return ["", f"## {title}", "", markdown_table(rows, columns)] if rows else []


def write_report(metrics: DataFrame, path: str | Path) -> None:
    """A Markdown report of a campaign: statistics per group, memory per host, partitions, throughput and memory by workers, failures.

    Groups are in the order of their fractions as numbers.
    """
    ok = metrics.where("status = 'success'")
    stats = [r.asDict() for r in group_stats(metrics).orderBy("approach", "fraction_pct").collect()]
    names = ["total_mean", "total_sd", "algo_mean", "algo_sd", "tree_mean", "tree_sd", "driver_mean", "driver_sd", "throughput_mean", "throughput_sd", "communities_mean"]
    parts = ["# Benchmark report", *_titled("Runs", stats, ["approach", "fraction_pct", "runs", *names])]

    def runs(column: str) -> list[dict]:
        return [r.asDict() for r in ok.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).orderBy("approach", "fraction_pct", "run_index").collect()]

    parts += _titled("Memory per host (peak MB)", runs("peak_cluster_rss_mb"), ["approach", "fraction_pct", "run_index", "peak_cluster_rss_mb", "vm_peaks_json"])
    parts += _titled("Partitions", runs("communities_json"), ["approach", "fraction_pct", "run_index", "num_communities", "communities_json"])
    if "workers_requested" in metrics.columns:
        for title, value, scale in (("Throughput by workers (nodes a second)", "throughput_nodes_per_s", 1.0), ("Memory by workers (GB)", "peak_process_tree_rss_mb", 1 / 1024)):
            for a in sorted({s["approach"] for s in stats}):
                pivot = scalability_pivot(metrics, a, value, scale)
                parts += _titled(f"{title}: {a}", [r.asDict() for r in pivot.orderBy("fraction_pct").collect()], pivot.columns)
    parts += _titled("Failed runs", [r.asDict() for r in failures(metrics).collect()], ["approach", "fraction_pct", "run_index", "error_message"])
    put(metrics.sparkSession, path, "\n".join([*parts, "", "Seeds change the order of work, never the labels: runs differ in time and memory alone.", ""]))
