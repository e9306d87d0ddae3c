import json

from timberline.operators import detectors as dx
from timberline.operators.rollups import minute_rollup, source_stats, summary
from timberline.params import Params
from timberline.plans.analyze import analyze, logger
from timberline.sources import reports
from timberline.sources.logs import log_entries, read_entries, read_lines, read_logs, read_timeseries
from timberline.streaming.detectors import burst_stream, minute_stream, rare_ip_stream, rate_outlier_stream, spike_stream

DATA = "/root/testdata/sf0.001/events.parquet"


def test_reports_and_files(spark, tmp_path):
    entries = log_entries(spark.read.parquet(DATA))
    found = dx.online_anomalies(entries, Params(burst_seconds=864000, burst_repeats=3))
    text = reports.anomalies_csv(found, limit=5)
    assert text.startswith("WindowStart,") and text.count("\r\n") == 6
    data = json.loads(reports.report_json(found, summary(entries), "now", limit=3))
    assert data["anomalyCount"] == 3 and data["summary"]["totalEvents"] == entries.count()
    assert reports.summary_csv(summary(entries)).startswith("Metric,Value")
    text = reports.console(summary(entries), source_stats(entries), found, verbosity=reports.VERBOSE, colours=True)
    first = found.orderBy("seq", "step", "description").first()
    assert "Top Sources (Top 10)" in text and f"showing 25 of {found.count()}" in text and "\033[" in text
    assert next(x for x in text.split("\n") if "[sev=" in x).endswith(first["description"])
    assert reports.console(summary(entries), source_stats(entries), found.limit(0), verbosity=reports.QUIET) == ""
    assert "SUMMARY STATISTICS" in reports.ReportGenerator(summary(entries), source_stats(entries), found).text("summary")
    series, listed = str(tmp_path / "series"), str(tmp_path / "entries")
    reports.write_timeseries(minute_rollup(entries), series)
    assert read_timeseries(spark, series).count() == minute_rollup(entries).count()
    assert read_entries(spark, str(tmp_path / "none")).count() == 0
    reports.write_entries(entries, listed)
    assert read_entries(spark, listed).count() == entries.count()
    (tmp_path / "log.txt").write_text('2026-02-14 16:12:40 ERROR [a] x y\n\nbroken\n{"time":"2026-02-14 16:12:40","level":"INFO","msg":"m"}\n')
    assert sorted((r["malformed"], r["level"]) for r in read_logs(spark, str(tmp_path / "log.txt")).select("malformed", "level").fillna(-1).collect()) == [(False, 2), (False, 4), (True, -1)]


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet(DATA)
    source.limit(400).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = log_entries(spark.read.parquet(str(tmp_path / "in")))
    stream = log_entries(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    p = Params(burst_seconds=864000, burst_repeats=3)

    def run(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = run(minute_stream(stream), "minutes", "update")
    assert got.groupBy().sum("total").first()[0] == 400
    assert sorted(map(tuple, run(rare_ip_stream(stream, p), "ips").select("seq", "occurrence").collect())) == sorted(map(tuple, dx.rare_ips(batch, p).select("seq", "occurrence").collect()))
    wide = Params(spike_short=3600, spike_baseline=360000, spike_min_short=2, spike_min_baseline=3, rate_window=36000, z_threshold=1.5)
    some = lambda df: sorted(map(tuple, df.select("seq", "source").collect()))
    assert some(run(spike_stream(stream, wide), "spikes")) == some(dx.spikes(batch, wide)) != []
    assert some(run(rate_outlier_stream(stream, wide), "outliers")) == some(dx.rate_outliers(batch, wide)) != []
    assert sorted(r["seq"] for r in run(burst_stream(stream, p), "bursts").collect()) == sorted(r["seq"] for r in dx.bursts(batch, p).collect())


def test_all_producers_reach_the_ranked_table(spark):
    from timberline.plans import catalog

    d = DATA.rsplit("/", 1)[0]
    found = catalog._all_anomalies(spark, d).persist()
    got = {r["detector"]: r["count"] for r in found.groupBy("detector").count().collect()}
    assert got["malformed"] == catalog._parsed(spark, d).filter("malformed").count() > 0
    assert got["pattern"] > 0 and got["time_window"] > 0 and got["burst"] > 0
    ranked = dx.ranked(found, 0).collect()
    assert len(ranked) == sum(got.values()) and {r["detector"] for r in ranked} == set(got)


def test_lines_keep_the_order_of_files(spark, tmp_path):
    """Spark packs larger files first; seq goes by name."""
    sizes = [3, 500, 40, 2000, 1]
    for k, n in enumerate(sizes):
        (tmp_path / f"{k}.log").write_text("".join(f"{k}:{i} {'x' * 60}\n" for i in range(n)))
    got = [r["value"].split()[0] for r in read_lines(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [f"{k}:{i}" for k, n in enumerate(sizes) for i in range(n)]


def test_a_whole_run(spark, tmp_path):
    lines = [f"2026-02-14 16:{k // 60:02d}:{k % 60:02d} {'ERROR' if k % 3 else 'INFO'} [svc{k % 2}] login failed from 10.0.0.{k % 4}" for k in range(400)]
    lines[7:7] = ["broken", "also broken"]
    log, out = tmp_path / "a.log", tmp_path / "out"
    log.write_text("\n".join(lines))
    found = analyze(spark, str(log), str(out), graphs=True, level="WARN")
    assert found.counts[:2] == (400, 2) and found.exit_code == found.counts[2] == found.anomalies.count() > 20
    assert {p.name for p in out.iterdir()} >= {"analysis-report.txt", "analysis-report.json", "analysis-report.csv", "index.html", "benchmark_runs.csv", "entries", "timeseries_per_minute"}
    data = json.loads((out / "analysis-report.json").read_text())
    assert data["summary"]["totalEvents"] == 400 and data["topSources"][0] == {"source": "svc0", "count": 200}
    assert (out / "benchmark_runs.csv").read_text().split("\n")[1].split(",")[1:] == [str(log.stat().st_size), *(out / "benchmark_runs.csv").read_text().split("\n")[1].split(",")[2:3], "400", "2", str(found.counts[2])]
    series = read_timeseries(spark, str(out / "timeseries_per_minute")).toPandas()
    assert series["total"].sum() == 400 and series["malformed"].sum() == 2 and len(series.columns) == 11
    text = (out / "analysis-report.txt").read_text()
    assert "TOP ANOMALIES (50)" in text and "Level 4: " in text and "#50 " in text


def test_logger_writes_lines(tmp_path):
    import re

    out = logger("WARN", str(tmp_path / "run.log"), console=False)
    out.info("no")
    out.warning("yes %d", 1)
    assert re.fullmatch(r"\[\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\] \[WARN\] yes 1\n", (tmp_path / "run.log").read_text())
