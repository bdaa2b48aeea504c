"""Command line: lpa, benchmark, report."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from loomgraph.config import load_config, worker_count
from loomgraph.functions import names
from loomgraph.sources.shared import exists


def _session(workers: int):
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{workers}]")).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def numbers(text: str, kind: type = float) -> list:
    """'1, 10,,100' -> numbers; blanks are skipped."""
    return [kind(x) for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("lpa", help="one run of label propagation on an edge list or a graph artifact")
    bench = sub.add_parser("benchmark", help="repeated runs over a grid")
    for q in (run, bench):
        q.add_argument("input")
        q.add_argument("--config")
        q.add_argument("--max-iter", type=int)
        q.add_argument("--seed", type=int)
        q.add_argument("--directed", action="store_true")
    run.add_argument("--fraction", type=float)
    run.add_argument("--approach", default="blocks", help="frame, mode or blocks")
    run.add_argument("--workers", type=int, help="cores of the local session")
    run.add_argument("--output-partition", help="folder and stem of the communities and summary files")
    bench.add_argument("--fractions", default="100")
    bench.add_argument("--workers", default="")
    bench.add_argument("--approaches", default="", help="comma-separated; default: all")
    bench.add_argument("--runs", type=int)
    bench.add_argument("--append", action="store_true", help="go on with the latest campaign's files")
    bench.add_argument("--run-stamp")
    bench.add_argument("--output-csv")
    bench.add_argument("--samples", help="folder of cached samples")
    rep = sub.add_parser("report", help="a Markdown report of a metrics file")
    rep.add_argument("--config")
    rep.add_argument("--input-csv")
    rep.add_argument("--output-md")
    return p


def emit(result, load_s: float, arcs: int, stem: str | None, approach: str) -> None:
    """The result as one JSON line and, with ``stem``, as files."""
    print(json.dumps(result.summary() | {"graph_load_time_s": load_s, "edge_count": arcs}))
    if stem:
        from loomgraph.sources.results import write_partition

        write_partition(names.above(stem), Path(stem).name, result.labels, {"approach": approach} | result.summary())


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    cfg = load_config(a.config)
    if a.command == "report":
        from loomgraph.operators.report import write_report
        from loomgraph.sources.edges import read_metrics

        spark = _session(worker_count(cfg))
        source, target = names.report_paths(cfg.output_dir, a.input_csv, a.output_md, spark)
        write_report(read_metrics(spark, str(source)), target)
        print(f"Wrote {target}")
        return 0
    # only a path in a store needs a session to be looked up
    if not (exists(_session(worker_count(cfg)), a.input) if names.is_remote(a.input) else os.path.exists(a.input)):
        print(f"no such input: {a.input}", file=sys.stderr)
        return 1
    from loomgraph.plans.lpa import APPROACHES

    asked = [a.approach] if a.command == "lpa" else [x.strip() for x in a.approaches.split(",") if x.strip()]
    if unknown := [x for x in asked if x not in APPROACHES]:
        print(f"no such approach: {', '.join(unknown)}; there are {', '.join(APPROACHES)}", file=sys.stderr)
        return 1
    for name in ("max_iter", "seed"):
        if getattr(a, name) is not None:  # 0 is a value
            setattr(cfg, name, getattr(a, name))
    cfg.directed = cfg.directed or a.directed
    if a.command == "benchmark":
        from loomgraph.plans.campaign import run_campaign

        spark = _session(worker_count(cfg))
        kept = names.read_stamp(cfg.output_dir, spark) if a.append else None
        stamp = a.run_stamp or kept or names.stamp_now()
        out = a.output_csv or names.metrics_csv(cfg.output_dir, stamp)
        if not a.output_csv and not a.append:
            names.write_stamp(cfg.output_dir, stamp, spark)
        workers = numbers(a.workers, int) or [worker_count(cfg)]
        log = names.run_log(cfg.output_dir, stamp)
        run_campaign(
            spark, a.input, out, cfg, numbers(a.fractions), workers, cfg.runs if a.runs is None else a.runs, a.append, asked or None, log, stamp, a.samples
        )
        print(f"Wrote {out}\nWrote {log}\nPartitions: {names.partitions_dir(names.above(out), stamp)}\nRun stamp: {stamp}")
        return 0
    from loomgraph.functions import estimates
    from loomgraph.plans.lpa import label_propagation
    from loomgraph.sources.edges import load_graph

    spark = _session(worker_count(cfg, a.workers))
    loaded = load_graph(spark, a.input, cfg.fraction_pct if a.fraction is None else a.fraction, cfg.seed, cfg.directed, cfg.restrict_to_lcc)
    print(estimates.report(estimates.estimate(spark, loaded.fraction_pct, loaded.node_count, loaded.edge_count)), file=sys.stderr)
    emit(label_propagation(loaded.graph, cfg.max_iter, log=lambda x: print(x, file=sys.stderr), approach=a.approach), loaded.load_time_s, loaded.edge_count, a.output_partition, a.approach)
    return 0


if __name__ == "__main__":
    sys.exit(main())
