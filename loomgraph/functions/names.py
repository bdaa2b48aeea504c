"""Names and places of a campaign's files. Formats are fixed, so that files of earlier campaigns are found."""

from __future__ import annotations

import os
import re
import time
from pathlib import Path
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

MARKER = "latest_run.txt"


def stamp_now() -> str:
    """Start of a run by the local clock, for file names."""
    return time.strftime("%Y%m%dT%H%M%S")


def is_remote(path: str | Path) -> bool:
    """Whether a path names a store by its scheme."""
    return "://" in str(path)


def below(folder: str | Path, name: str) -> str | Path:
    """A path in a folder: a text if it has a scheme, else a Path."""
    return f"{str(folder).rstrip('/')}/{name}" if is_remote(folder) else Path(folder, name)


def above(path: str | Path) -> str | Path:
    return str(path).rpartition("/")[0] if is_remote(path) else Path(path).parent


def metrics_csv(folder: str | Path, stamp: str) -> str | Path:
    return below(folder, f"metrics_raw_{stamp}.csv")


def comparison_md(folder: str | Path, stamp: str) -> str | Path:
    return below(folder, f"comparison_{stamp}.md")


def run_log(folder: str | Path, stamp: str) -> str | Path:
    return below(folder, f"benchmark_run_{stamp}.log")


def partitions_dir(folder: str | Path, stamp: str) -> str | Path:
    return below(folder, f"partitions_{stamp}")


def stamp_of(path: str | Path) -> str | None:
    """The stamp in a metrics file's name; None for other names."""
    found = re.fullmatch(r"metrics_raw_(\d{8}T\d{6})\.csv", Path(path).name)
    return found and found[1]


def write_stamp(folder: str | Path, stamp: str, spark: SparkSession | None = None) -> str | Path:
    from loomgraph.sources.shared import put

    return put(spark, below(folder, MARKER), stamp + "\n")


def read_stamp(folder: str | Path, spark: SparkSession | None = None) -> str | None:
    """The stamp of the latest campaign; None if there is none."""
    from loomgraph.sources.shared import get

    return (get(spark, below(folder, MARKER)) or "").strip() or None


def latest_metrics_csv(folder: str | Path, spark: SparkSession | None = None) -> str | Path:
    if is_remote(folder):
        from loomgraph.sources.shared import newest

        return newest(spark, str(below(folder, "metrics_raw_*.csv")))
    found = list(Path(folder).glob("metrics_raw_*.csv"))
    if not found:
        raise FileNotFoundError(f"no metrics_raw_*.csv in {folder}")
    return max(found, key=lambda p: p.stat().st_mtime)


def report_paths(folder: str | Path, csv: str | Path | None = None, md: str | Path | None = None, spark: SparkSession | None = None) -> tuple[str | Path, str | Path]:
    """The metrics file (default: the newest) and the report that belongs to it by its stamp."""
    own = lambda path: path if is_remote(path) else Path(path)
    source = own(csv) if csv else latest_metrics_csv(folder, spark)
    if md:
        return source, own(md)
    stamp = stamp_of(source) or read_stamp(folder, spark)
    if stamp is None:
        raise ValueError(f"{source} has no run stamp in its name; name the report")
    return source, comparison_md(folder, stamp)


def fraction_name(fraction_pct: float) -> str:
    """100.0 -> 100, 0.1 -> 0p1."""
    return str(int(fraction_pct)) if float(fraction_pct).is_integer() else str(fraction_pct).replace(".", "p")


def figure_name(fraction_pct: float) -> str:
    """As figures are named: 100pct from 100 on, else at most six digits."""
    return "100pct" if fraction_pct >= 100 else f"{fraction_pct:g}".replace(".", "p") + "pct"


def sample_stem(slug: str, fraction_pct: float) -> str:
    return f"{slug}_{fraction_name(fraction_pct)}pct"


def sample_path(slug: str, fraction_pct: float, folder: str | None = None, directed: bool = False, restrict: bool = True) -> str:
    """Where a cached sample lies; any folder that Spark reads. Samples that aren't made by default settings say so."""
    made = "_directed" * directed + "_whole" * (not restrict)
    return f"{(folder or default_samples_dir()).rstrip('/')}/{sample_stem(slug, fraction_pct)}{made}"


def default_samples_dir() -> str:
    return os.path.join(os.getcwd(), "data", "artifacts")


def artifact_paths(base: str) -> tuple[str, str, str]:
    """Nodes, arcs and metadata below an artifact's path."""
    base = base.rstrip("/")
    return f"{base}/nodes", f"{base}/arcs", f"{base}/meta"


def store_path(base: str) -> str:
    """The bucketed arcs of an artifact."""
    return f"{base.rstrip('/')}/store"


def partition_stem(approach: str, slug: str, fraction_pct: float, workers: int, run: int) -> str:
    return f"{approach}_{slug}_{fraction_name(fraction_pct)}pct_w{workers}_run{run}"


def summary_json(folder: str | Path, stem: str) -> str | Path:
    return below(folder, f"{stem}.summary.json")


def communities_json(folder: str | Path, stem: str) -> str | Path:
    return below(folder, f"{stem}.communities.json")


def clusters_dir(communities: str | Path) -> str:
    """The folder of a large graph's clusters, beside the document that names it."""
    return str(communities if is_remote(communities) else communities.resolve()).removesuffix(".json") + ".lines"
