"""A whole run: parse a log, find anomalies, write reports and tables."""

from __future__ import annotations

import logging
import os
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators import anomalies as an
from timberline.operators import dashboard as db
from timberline.operators import rollups as ru
from timberline.operators.detectors import anomalies_by_minute
from timberline.params import Params
from timberline.sources import reports
from timberline.sources.logs import read_logs

_LEVELS = {"TRACE": 5, "DEBUG": logging.DEBUG, "INFO": logging.INFO, "WARN": logging.WARNING, "ERROR": logging.ERROR, "CRITICAL": logging.CRITICAL}


def logger(level: str = "INFO", path: str | None = None, console: bool = True) -> logging.Logger:
    """Lines of "[time] [LEVEL] message" to the console and a file."""
    out = logging.getLogger("timberline")
    for x in [*out.handlers]:
        out.removeHandler(x)
        x.close()
    for name, number in _LEVELS.items():
        logging.addLevelName(number, name)
    out.setLevel(_LEVELS[level])
    out.propagate = False
    for x in [logging.StreamHandler(sys.stderr)] * console + ([logging.FileHandler(path, encoding="utf-8")] if path else []):
        x.setFormatter(logging.Formatter("[%(asctime)s] [%(levelname)s] %(message)s", "%Y-%m-%d %H:%M:%S"))
        out.addHandler(x)
    return out


@dataclass(frozen=True)
class Analysis:
    """The tables of a run, and how many rows were parsed, malformed and emitted as anomalies."""

    entries: DataFrame
    parsed: DataFrame
    anomalies: DataFrame
    summary: DataFrame
    sources: DataFrame
    counts: tuple[int, int, int]

    @property
    def exit_code(self) -> int:
        """The number of anomalies, as far as an exit code of 32 bits holds it."""
        return min(self.counts[2], 2**31 - 1)


def dashboard(entries: DataFrame, p: Params = Params()) -> dict[str, DataFrame]:
    """The twelve dashboard tables; those over minutes without a partial last one."""
    series = db.drop_partial_minute(ru.minute_rollup(entries), entries, p)
    return {
        "01 log volume": db.log_volume(series, p),
        "02 error rate": db.error_rate(series, p),
        "03 levels": db.level_areas(series),
        "04 moving average": db.moving_average(series, p),
        "05 z-scores": db.zscores(series, p),
        "06 level distribution": db.level_distribution(entries),
        "07 service activity": db.service_activity(entries),
        "08 top errors": db.top_errors(entries),
        "09 top addresses": db.top_ips(entries),
        "10 heatmap": db.heatmap(series),
        "11 service correlation": db.service_correlation(entries),
        "12 isolation forest": db.isolation_forest(entries),
    }


def analyze(spark: SparkSession, path: str, output: str | None = None, p: Params = Params(), json: bool = True, csv: bool = True, graphs: bool = False, level: str = "INFO", **options) -> Analysis:
    """Read and parse the log at path, find the anomalies of all producers, and, with output (a local folder), write reports
    there; with graphs, the per-minute and entry tables and the dashboard too. Parsed rows and anomalies are read often and
    are kept in Spark's cache, which spills to disk."""
    began, now = time.monotonic(), int(time.time())
    log = logger(level)
    parsed = read_logs(spark, path, **options).persist()
    entries = parsed.filter("NOT malformed").withColumn("ts_sec", F.unix_timestamp("ts"))
    n = ru.parse_counts(parsed).first()
    anomalies = an.all_anomalies(entries, parsed, p, now).persist()
    found = Analysis(entries, parsed, anomalies, ru.summary(entries), ru.source_stats(entries), (n["parsed"], n["malformed"], anomalies.count()))
    wall = int((time.monotonic() - began) * 1000)
    log.info("Parsed entries: %d, malformed: %d, anomalies: %d, in %d ms", *found.counts, wall)
    if output is None:
        return found
    os.makedirs(output, exist_ok=True)
    levels = ru.level_counts_with_anomalies(entries, anomalies.filter(F.col("phase") == an.ONLINE))
    report = reports.ReportGenerator(found.summary, found.sources, anomalies, levels, processed_file=path)
    files = {"analysis-report.txt": lambda: report.text("console")}
    if json:
        files["analysis-report.json"] = lambda: reports.report_json(anomalies, found.summary, time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()), path, sources=found.sources)
    if csv:
        files["analysis-report.csv"] = lambda: reports.anomalies_csv(anomalies)
    if graphs:
        files["index.html"] = lambda: reports.dashboard_html(dashboard(entries, p))
        stamp = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(now))
        series = ru.full_timeseries(entries, ru.malformed_by_minute(parsed, stamp), anomalies_by_minute(anomalies.filter(F.col("phase") == an.ONLINE)))
        reports.write_timeseries(series, os.path.join(output, "timeseries_per_minute"))
        reports.write_entries(entries, os.path.join(output, "entries"))
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        reports.append_run(os.path.join(output, "benchmark_runs.csv"), size, wall, *found.counts)
    for name, text in files.items():
        with open(os.path.join(output, name), "w", encoding="utf-8", newline="") as f:
            f.write(text())
        log.info("Saved: %s", os.path.join(output, name))
    log.info("ANALYSIS SUMMARY:\n%s", report.text("summary"))
    return found
