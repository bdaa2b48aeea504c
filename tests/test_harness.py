"""Configuration, names, logs, command line, estimates and campaigns."""

import csv
import json
import logging
import os
import re
from pathlib import Path

import pytest

from loomgraph import cli
from loomgraph.config import Config, load_config, run_seeds, worker_count
from loomgraph.functions import estimates as est
from loomgraph.functions import names
from loomgraph.model import METRICS_SCHEMA, LpaResult
from loomgraph.operators.report import markdown_table, write_report
from loomgraph.plans import campaign, lpa
from loomgraph.plans.memory import host_id, memory_peaks, process_peak_mb, worker_peaks, worker_samples
from loomgraph.plans.runlog import CampaignLog
from loomgraph.sources import edges as src
from loomgraph.sources.results import write_communities, write_partition

STAMP = "20260613T205342"


@pytest.fixture
def toy(tmp_path):
    (tmp_path / "toy.txt").write_text("# toy\n0 1\n1 2\n0 2\n2 3\n")
    return tmp_path


def test_config_precedence(tmp_path):
    (tmp_path / "c.yaml").write_text("max_iter: 7\nseed: 5\ndirected: 'yes'\nworkers: null\n")
    c = load_config(str(tmp_path / "c.yaml"), {"LOOMGRAPH_SEED": "0", "LOOMGRAPH_RUNS": ""})
    assert (c.max_iter, c.seed, c.directed, c.workers, c.runs) == (7, 0, True, None, 3)
    assert worker_count(Config(workers=3)) == 3 and worker_count(Config(workers=3), 2) == 2 and worker_count(Config()) == (os.cpu_count() or 1)


def test_seeds():
    assert run_seeds(Config(), 3) == [42, 43, 44]
    assert run_seeds(Config(seeds="1,2"), 2) == [1, 2]
    for cfg, n in ((Config(seeds="1"), 2), (Config(), 0)):
        with pytest.raises(ValueError):
            run_seeds(cfg, n)


def test_names(tmp_path):
    assert re.fullmatch(r"\d{8}T\d{6}", names.stamp_now())
    at = names.metrics_csv(tmp_path, STAMP)
    assert at.name == f"metrics_raw_{STAMP}.csv" and names.stamp_of(at) == STAMP and names.stamp_of("metrics.csv") is None
    assert names.comparison_md(tmp_path, STAMP).name == f"comparison_{STAMP}.md" and names.run_log(tmp_path, STAMP).name == f"benchmark_run_{STAMP}.log"
    assert names.partitions_dir(tmp_path, STAMP).name == f"partitions_{STAMP}"
    assert [names.fraction_name(x) for x in (100.0, 1, 0.1)] == ["100", "1", "0p1"] and [names.figure_name(x) for x in (100, 10.0, 0.1)] == ["100pct", "10pct", "0p1pct"]
    assert names.sample_stem("orkut", 0.1) == "orkut_0p1pct" and names.sample_path("g", 10.0, "/x/") == "/x/g_10pct" and names.sample_path("g", 1.0).endswith("data/artifacts/g_1pct")
    assert names.artifact_paths("/x/g/") == ("/x/g/nodes", "/x/g/arcs", "/x/g/meta")
    assert names.partition_stem("frame", "g", 0.1, 4, 1) == "frame_g_0p1pct_w4_run1"


def test_newest_metrics_and_their_report(tmp_path):
    with pytest.raises(FileNotFoundError):
        names.latest_metrics_csv(tmp_path)
    assert names.read_stamp(tmp_path) is None
    for k, stamp in enumerate((STAMP, "20250101T000000")):
        at = names.metrics_csv(tmp_path, stamp)
        at.write_text("x")
        os.utime(at, (1000 + k, 1000 + k))
    assert names.latest_metrics_csv(tmp_path) == names.metrics_csv(tmp_path, "20250101T000000")
    assert names.report_paths(tmp_path) == (names.metrics_csv(tmp_path, "20250101T000000"), names.comparison_md(tmp_path, "20250101T000000"))
    with pytest.raises(ValueError):
        names.report_paths(tmp_path, tmp_path / "other.csv")
    names.write_stamp(tmp_path, STAMP)
    assert names.read_stamp(tmp_path) == STAMP
    assert names.report_paths(tmp_path, tmp_path / "other.csv")[1] == names.comparison_md(tmp_path, STAMP)
    assert names.report_paths(tmp_path, tmp_path / "other.csv", tmp_path / "r.md")[1] == tmp_path / "r.md"


def test_campaign_log(tmp_path, capsys):
    at = tmp_path / "a" / "run.log"
    with CampaignLog(at) as log:
        log.event("campaign", stamp=STAMP, graph="g.txt")
        with log.running("frame"):
            print("first\n\nsecond", end="")
            logging.getLogger("other").warning("careful")
        print("not in it")
        log.event("row", row={"status": "success"})
    lines = [json.loads(x) for x in at.read_text().splitlines()]
    assert [x["text"] for x in lines] == ["campaign", "first", "", "careful", "second", "row", "end"]
    assert lines[0]["stamp"] == STAMP and lines[5]["row"] == {"status": "success"}
    assert [x["approach"] for x in lines] == [None] + ["frame"] * 4 + [None, None] and lines[3]["source"] == "other"
    assert capsys.readouterr().out == "first\n\nsecond\nnot in it\n"
    with CampaignLog(at, append=True) as log:
        assert log.goes_on
    assert len(at.read_text().splitlines()) == 8


def test_log_lines(spark):
    assert lpa.iteration_line(3, 5, 20, 4, 0.126, "ray") == "[ray][iter=3] changed=5/20 (25.0%) workers=4 elapsed=0.13s"
    assert lpa.iteration_line(1, 0, 0, 1, 0.0).startswith("[lpa][iter=1] changed=0/0 (0.0%)")
    assert lpa.run_start("dask", 10, 4, 100, 1.5, 42) == "[dask][start] nodes=10 chunks=4 max_iter=100 init_s=1.50s seed=42"
    assert lpa.run_start("dask", 10, 4, 100, 1.5).endswith("init_s=1.50s")
    assert lpa.runtime_line("ray", "cluster", cpus=4) == "[ray][cluster] cpus=4" and lpa.runtime_line("ray", "down") == "[ray][down]"
    assert lpa.peaks_line("ray", {"b": 2.4, "a": 1.6}) == "[ray][vm-peaks] a=2MB b=2MB"
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, label long")
    got = lpa.summary_lines(LpaResult(labels, [(1, 2, 3, 0.5), (2, 1, 3, 0.25), (3, 1, 3, None)], False), "x")
    assert got == [
        "[x][done] iters=3 converged=false communities=2", "[x][sizes] min=1 p50=2 p95=2 max=2",
        "[x][timing] iter_min=0.25s iter_median=0.38s iter_max=0.50s total=0.75s", "[x][warn] max_iter reached, not converged",
    ]


def test_estimates(spark):
    assert est.exponent("ray") == pytest.approx(0.586497, abs=1e-6) and est.exponent("dask") == pytest.approx(0.429851, abs=1e-6)
    whole = spark.createDataFrame([(100.0, 3072441, 234370166)], "fraction_pct double, nodes long, arcs long")
    for backend, low, high in (("ray", 1431.613, 10537.329), ("dask", 877.555, 13750.735)):
        r = est.for_fraction(whole, backend).first()
        assert (r["low_s"], r["high_s"]) == (pytest.approx(low, abs=1e-2), pytest.approx(high, abs=1e-2))
        assert est.extrapolate(whole, backend).first()["high_s"] == pytest.approx(high, abs=1e-2)
    r = est.host_memory(whole, "ray").first()
    assert r["load_peak_mb"] == pytest.approx(3599.6 * 0.9 + 300, abs=0.5) and r["tree_mb"] == pytest.approx(171924, rel=1e-3)
    small, large = (est.estimate(spark, 10.0, n, 20 * n) for n in (1000, 100_000))
    assert small.load_mb < large.load_mb and all(small.minutes[b][0] < small.minutes[b][1] <= large.minutes[b][1] and small.tree_mb[b] <= large.tree_mb[b] for b in est.CALIBRATED)
    text = est.report(large)
    assert "100,000 nodes, 2,000,000 arcs" in text and "ray:" in text and "dask:" in text


def test_memory_probes(spark):
    with memory_peaks(0.01) as peaks:
        x = bytearray(8_000_000)
    assert peaks["tree"] >= peaks["driver"] > 0 and len(x)
    assert process_peak_mb() > 10
    samples = worker_samples(spark, 3).collect()
    assert len(samples) == 3 and {r["host"] for r in samples} == {host_id()}
    assert worker_peaks(spark)[host_id()] >= max(r["peak_rss_mb"] for r in samples) * 0.5


def test_host_peaks_merge():
    assert campaign.merge_host_peaks({"a": 600.0, "b": 400.0}, {"b": 450.0, "c": 350.0}, 900.0) == {"a": 600.0, "b": 450.0, "c": 350.0}
    assert campaign.merge_host_peaks({"a": 500.0}, {"a": 450.0}, 1400.0) == {"a": 1400.0}


def test_partition_files(spark, tmp_path):
    labels = spark.createDataFrame([(1, 100), (2, 100), (3, 200), (4, 200), (5, 200)], "id long, label long")
    at = write_communities(tmp_path / "p", "x", labels, "frame")
    got = json.loads(at.read_text())
    assert at.name == "x.communities.json" and got["approach"] == "frame" and got["clusters"][0] == {"cluster_index": 1, "community_id": 200, "size": 3, "node_ids": [3, 4, 5]}
    summary, communities = write_partition(tmp_path / "p", "y", labels, {"approach": "mode", "num_communities": 99})
    assert json.loads(summary.read_text()) == {"approach": "mode", "num_communities": 2, "communities_json": "y.communities.json", "node_count": 5}
    assert communities.exists() and summary.name == "y.summary.json"


def test_missing_input_exits_1(capsys):
    assert cli.main(["lpa", "/nowhere/x.txt"]) == 1 and "no such input" in capsys.readouterr().err
    assert cli.numbers("1, 10,,100") == [1.0, 10.0, 100.0] and cli.numbers("2,4", int) == [2, 4] and cli.numbers("") == []


def test_command_line_run(spark, toy, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda workers: spark)
    assert cli.main(["lpa", str(toy / "toy.txt"), "--max-iter", "5", "--output-partition", str(toy / "out" / "toy")]) == 0
    shown = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (shown["node_count"], shown["edge_count"], shown["num_communities"], shown["converged"]) == (4, 8, 1, True)
    assert json.loads((toy / "out" / "toy.summary.json").read_text())["node_count"] == 4
    assert cli.main(["lpa", str(toy / "toy.txt"), "--max-iter", "0"]) == 0  # 0 is a value
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["num_levels"] == 0


def test_command_line_campaign_and_report(spark, toy, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda workers: spark)
    monkeypatch.setenv("LOOMGRAPH_OUTPUT_DIR", str(toy / "results"))
    args = ["benchmark", str(toy / "toy.txt"), "--workers", "2", "--runs", "1", "--max-iter", "4"]
    assert cli.main([*args, "--approaches", "frame", "--run-stamp", STAMP]) == 0
    assert cli.main([*args, "--approaches", "mode", "--append"]) == 0  # goes on with the stamp
    at = names.metrics_csv(toy / "results", STAMP)
    rows = list(csv.DictReader(open(at)))
    assert [r["approach"] for r in rows] == ["frame", "mode"] and {r["status"] for r in rows} == {"success"}
    assert cli.main(["report"]) == 0
    assert "## Runs" in names.comparison_md(toy / "results", STAMP).read_text()
    log = names.run_log(toy / "results", STAMP).read_text()
    assert log.count('"text": "campaign"') == 2 and "[frame][iter=1]" in log and "[mode][done]" in log


def test_campaign_grid_and_report(spark, toy):
    at = toy / f"metrics_raw_{STAMP}.csv"
    got = campaign.run_campaign(spark, str(toy / "toy.txt"), at, Config(max_iter=10), [100.0], [2, 4], 1, approaches=["frame"])
    campaign.run_campaign(spark, str(toy / "toy.txt"), at, Config(max_iter=10), [100.0], [2], 1, True, ["mode"])
    rows = list(csv.DictReader(open(at)))
    assert list(rows[0]) == [f.name for f in METRICS_SCHEMA] and len(got) == 2
    assert [(r["workers_requested"], r["workers_actual"], r["approach"]) for r in rows] == [("2", "2", "frame"), ("4", "4", "frame"), ("2", "2", "mode")]
    assert sum(c["size"] for c in json.load(open(rows[0]["communities_json"]))["clusters"]) == 4
    assert Path(rows[0]["partition_summary"]).parent == names.partitions_dir(toy, STAMP)
    write_report(src.read_metrics(spark, str(at)), toy / "r.md")
    text = (toy / "r.md").read_text()
    for title in ("Runs", "Memory per host", "Partitions", "Throughput by workers", "Memory by workers"):
        assert f"## {title}" in text
    with pytest.raises(ValueError):
        campaign.run_campaign(spark, str(toy / "toy.txt"), at, Config(), [100.0], [2], 1, approaches=["other"])


def test_a_failed_run_is_a_row(spark, toy, monkeypatch):
    monkeypatch.setitem(lpa.APPROACHES, "broken", lambda arcs, labels: (_ for _ in ()).throw(RuntimeError("out of luck\nat line 1")))
    at = toy / "metrics.csv"
    rows = campaign.run_campaign(spark, str(toy / "toy.txt"), at, Config(max_iter=3), [100.0], [2], 1, approaches=["broken", "frame"])
    assert [(r["status"], r["error_message"]) for r in rows] == [("failed", "out of luck"), ("success", None)]
    write_report(src.read_metrics(spark, str(at)), toy / "r.md")
    assert "## Failed runs" in (toy / "r.md").read_text() and "out of luck" in (toy / "r.md").read_text()


def test_campaign_reuses_the_sample(spark, tmp_path):
    (tmp_path / "path.txt").write_text("\n".join(f"{i} {i + 1}" for i in range(60)))
    for _ in range(2):
        rows = campaign.run_campaign(spark, str(tmp_path / "path.txt"), tmp_path / "m.csv", Config(max_iter=2), [20.0], [2], 1, approaches=["frame"], samples_dir=str(tmp_path / "s"))
        assert rows[0]["node_count"] == 12 and rows[0]["fraction_pct"] == 20.0
        stamp = os.stat(tmp_path / "s" / "path_20pct" / "meta").st_mtime_ns
        first = stamp if _ == 0 else first
    assert stamp == first  # built once


def test_report_sorts_fractions_as_numbers(spark, tmp_path):
    cols = ["approach", "fraction_pct", "run_index", "total_time_s", "algorithm_time_s", "throughput_nodes_per_s", "num_communities", "status"]
    with open(tmp_path / "m.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(cols)
        for fraction in ("10.0", "2.0", "100.0"):
            out.writerow(["frame", fraction, 1, 2.0, 1.0, 5.0, 3, "success"])
    write_report(src.read_metrics(spark, str(tmp_path / "m.csv")), tmp_path / "r.md")
    lines = [x for x in (tmp_path / "r.md").read_text().splitlines() if x.startswith("| frame")]
    assert [float(x.split("|")[2]) for x in lines[:3]] == [2.0, 10.0, 100.0]
    assert markdown_table([{"a": None, "b": 1.5}], ["a", "b"]).splitlines()[-1] == "| — | 1.50 |"
