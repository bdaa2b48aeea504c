"""Repeated runs over a grid of fractions, workers and approaches; a failed run is a row, not the end."""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from loomgraph.config import Config, run_seeds
from loomgraph.functions import estimates, names
from loomgraph.model import METRICS_SCHEMA, LoadResult, LpaResult
from loomgraph.plans import lpa
from loomgraph.plans.memory import host_id, memory_peaks, worker_peaks
from loomgraph.plans.runlog import CampaignLog
from loomgraph.sources.edges import is_artifact, load_for_benchmark, load_graph
from loomgraph.sources.results import write_partition
from loomgraph.sources.shared import Rows

COLUMNS = [f.name for f in METRICS_SCHEMA]


def merge_host_peaks(workers: dict[str, float], driver: dict[str, float], tree_mb: float) -> dict[str, float]:
    """Highest of worker and driver per host; a single host is raised to the process tree's peak."""
    both = {h: max(workers.get(h, 0.0), driver.get(h, 0.0)) for h in workers.keys() | driver.keys()}
    return {h: max(mb, tree_mb) for h, mb in both.items()} if len(both) <= 1 else both


def result_row(result: LpaResult, load_s: float, peaks: dict[str, float], hosts: dict[str, float]) -> dict:
    """What a run adds to its row."""
    algo = result.algorithm_time_s
    return {
        "node_count": result.node_count, "init_time_s": result.init_time_s, "algorithm_time_s": algo, "total_time_s": load_s + result.total_time_s,
        "peak_driver_rss_mb": peaks["driver"], "peak_process_tree_rss_mb": peaks["tree"], "peak_memory_mb": peaks["driver"],
        "throughput_nodes_per_s": result.node_count / algo if algo > 0 else 0.0, "num_communities": result.num_communities, "num_levels": result.num_levels,
        "converged": result.converged, "level_times_json": json.dumps(result.level_times()), "vm_peaks_json": json.dumps(hosts, sort_keys=True),
        "peak_cluster_rss_mb": sum(hosts.values()), "status": "success",
    }


def failed_row(error: Exception) -> dict:
    return {"status": "failed", "error_message": (str(error).splitlines() or [type(error).__name__])[0][:300]}


def run_once(spark: SparkSession, loaded: LoadResult, approach: str, cfg: Config, seed: int, folder: Path, stem: str, say: Callable[[str], None]) -> dict:
    """One run: label propagation, its communities and summary as files, and what it adds to its row."""
    say(lpa.runtime_line(approach, "cluster", master=spark.sparkContext.master, cores=spark.sparkContext.defaultParallelism, seed=seed))
    with memory_peaks() as peaks:
        result = lpa.label_propagation(loaded.graph, cfg.max_iter, say, approach=approach)
        result.add_peaks(worker_peaks(spark))
    hosts = merge_host_peaks(result.host_peaks, {host_id(): peaks["driver"]}, peaks["tree"])
    for line in (*lpa.summary_lines(result, approach), lpa.peaks_line(approach, hosts)):
        say(line)
    row = result_row(result, loaded.load_time_s, peaks, hosts)
    summary, communities = write_partition(folder, stem, result.labels, {"approach": approach, "fraction_pct": loaded.fraction_pct, "seed": seed} | result.summary())
    return row | {"partition_summary": str(summary), "communities_json": str(communities)}


def run_campaign(
    spark: SparkSession,
    path: str,
    output_csv: str | Path,
    cfg: Config,
    fractions: list[float],
    workers: list[int],
    runs: int,
    append: bool = False,
    approaches: list[str] | None = None,
    log_path: str | Path | None = None,
    stamp: str | None = None,
    samples_dir: str | None = None,
) -> list[dict]:
    """Runs fractions x workers x approaches x runs and writes each row as soon as it is known.

    A graph is loaded once per fraction, parts from a cached sample below
    ``samples_dir``; an artifact carries its own fraction. Workers are the
    shuffle partitions of a run. With ``append`` rows and log go on. Outputs may
    lie in a store that only Spark reaches (see ``sources.shared``).
    """
    approaches = approaches or list(lpa.APPROACHES)
    if unknown := [a for a in approaches if a not in lpa.APPROACHES]:
        raise ValueError(f"no such approach: {', '.join(unknown)}")
    seeds, rows = run_seeds(cfg, runs), []
    slug, stamp = os.path.splitext(os.path.basename(path.rstrip("/")))[0], stamp or names.stamp_of(output_csv) or names.stamp_now()
    folder = names.partitions_dir(names.above(output_csv), stamp)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with contextlib.ExitStack() as stack:
        log = stack.enter_context(CampaignLog(log_path, append, spark)) if log_path else None
        stack.callback(spark.conf.set, "spark.sql.shuffle.partitions", before)
        out = stack.enter_context(Rows(spark, output_csv, append))
        if log:
            log.event("campaign", stamp=stamp, graph=path, directed=cfg.directed, seed=cfg.seed, max_iter=cfg.max_iter, fractions=fractions, workers=workers, approaches=approaches)
        for fraction in fractions:
            if is_artifact(spark, path):
                loaded = load_graph(spark, path, format="artifact")
            else:
                loaded = load_for_benchmark(spark, path, fraction, cfg.seed, slug, cfg.directed, samples_dir, cfg.restrict_to_lcc)
            print(f"{loaded.node_count:,} nodes, {loaded.edge_count:,} arcs in {loaded.load_time_s:.1f} s")
            print(estimates.report(estimates.estimate(spark, loaded.fraction_pct, loaded.node_count, loaded.edge_count)))
            for w in workers:
                spark.conf.set("spark.sql.shuffle.partitions", w)
                for approach in approaches:
                    for run, seed in enumerate(seeds, 1):
                        row = dict.fromkeys(COLUMNS) | {
                            "approach": approach, "fraction_pct": loaded.fraction_pct, "run_index": run, "node_count": loaded.node_count, "graph_load_time_s": loaded.load_time_s,
                            "max_iter": float(cfg.max_iter), "seed": seed, "workers_requested": w, "workers_actual": min(w, max(loaded.node_count, 1)),
                        }
                        if log:
                            log.event("run", of=approach, fraction_pct=loaded.fraction_pct, partitions=w, run=run, seed=seed)
                        try:
                            with log.running(approach) if log else contextlib.nullcontext():
                                row |= run_once(spark, loaded, approach, cfg, seed, folder, names.partition_stem(approach, slug, loaded.fraction_pct, w, run), print)
                        except Exception as e:
                            row |= failed_row(e)
                        if log:
                            log.event("row", row=row)
                        rows.append(row)
                        out.add(row)
    return rows
