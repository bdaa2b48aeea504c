"""Peaks of memory: of the driver and its process tree while something runs, and of the executors."""

from __future__ import annotations

import contextlib
import os
import resource
import socket
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.report import max_per_host


@contextlib.contextmanager
def memory_peaks(poll: float = 0.25) -> Iterator[dict]:
    """Peak resident MB of the driver's Python and of its whole process tree (the JVM is a child)."""
    import psutil

    own, peak, done = psutil.Process(), {"driver": 0.0, "tree": 0.0}, threading.Event()

    def look() -> None:
        while not done.is_set():
            with contextlib.suppress(psutil.Error):
                mine = own.memory_info().rss / 1e6
                tree = mine + sum(p.memory_info().rss for p in own.children(recursive=True)) / 1e6
                peak["driver"], peak["tree"] = max(peak["driver"], mine), max(peak["tree"], tree)
            done.wait(poll)

    t = threading.Thread(target=look, daemon=True)
    t.start()
    try:
        yield peak
    finally:
        done.set()
        t.join()


def process_peak_mb() -> float:
    """Highest resident MB of this process so far, and of the executor's JVM above it where that can be read."""
    peak, pid = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, os.getppid()
    with contextlib.suppress(OSError, ValueError):
        while pid > 1:
            with open(f"/proc/{pid}/status") as f:
                fields = dict(line.split(":", 1) for line in f if ":" in line)
            if fields["Name"].strip() == "java":
                return peak + int(fields["VmHWM"].split()[0]) / 1024
            pid = int(fields["PPid"])
    return peak


def host_id() -> str:
    return socket.gethostname()


def executor_peaks(spark: SparkSession) -> DataFrame:
    """(host, executor, peak_mb) of every executor that ever registered, the driver's as well.

    Read from Spark's own status store: the highest JVM heap and off-heap use,
    and where ``spark.executor.processTreeMetrics.enabled`` is set, the
    resident memory of the JVM and its Python workers instead. An executor
    appears once, lost ones too; one that has not reported yet has 0.
    """
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    rows = []
    for k in range(found.size()):
        x = found.apply(k)
        peak, mb = x.peakMemoryMetrics(), 0.0
        if peak.isDefined():
            value = peak.get().getMetricValue
            tree = sum(value(m) for m in ("ProcessTreeJVMRSSMemory", "ProcessTreePythonRSSMemory", "ProcessTreeOtherRSSMemory"))
            mb = (tree or value("JVMHeapMemory") + value("JVMOffHeapMemory")) / 1e6
        rows.append((x.hostPort().rsplit(":", 1)[0], x.id(), mb))
    return spark.createDataFrame(rows, "host string, executor string, peak_mb double")


def worker_samples(spark: SparkSession, tasks: int | None = None) -> DataFrame:
    """(host, peak_rss_mb) from ``tasks`` tasks, by default two a core: a sample that reaches each host in practice."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([host_id()]), pa.array([process_peak_mb()])], names=["host", "peak_rss_mb"])

    n = tasks or 2 * spark.sparkContext.defaultParallelism
    return spark.range(0, n, 1, n).mapInArrow(sample, "host string, peak_rss_mb double")


def worker_peaks(spark: SparkSession) -> dict[str, float]:
    """Peak MB by host: what tasks see of their processes, and of hosts that no task reached what their executors report."""
    seen = {r["host"]: r["peak_rss_mb"] for r in max_per_host(worker_samples(spark)).collect()}
    if spark.sparkContext.master.startswith("local"):
        return seen  # one process, under a name that tasks don't use
    told = executor_peaks(spark).where("executor <> 'driver'").groupBy("host").agg({"peak_mb": "sum"}).collect()
    return {r["host"]: r["sum(peak_mb)"] for r in told} | seen
