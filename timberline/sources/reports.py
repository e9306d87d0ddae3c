"""Reports: console, summary, CSV and JSON text from limited, ranked tables, and files written by Spark."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.timestamps import iso8601
from timberline.operators.detectors import ranked

# Headers, keys and formats, so that files can be exchanged with other tools.
ANOMALY_HEADER = ["WindowStart", "WindowEnd", "Type", "Severity", "Score", "Source", "Description"]
RUNS_HEADER = "run_time_iso,file_size_bytes,wall_ms,parsed,malformed,emitted_anomalies"
QUIET, NORMAL, VERBOSE = range(3)
_COLOURS = ((0.75, "\033[91m"), (0.5, "\033[93m"), (0.25, "\033[33m"), (0.0, "\033[97m"))


def _cell(x) -> str:
    x = "" if x is None else str(x)
    return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\r\n') else x


def _stamp(seconds) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%S")


def _time(t) -> str:
    return t.strftime("%Y-%m-%d %H:%M:%S") if t else ""


def _rows(lines: list[list], end: str = "\r\n") -> str:
    return "".join(",".join(map(_cell, line)) + end for line in lines)


def _top(sources: DataFrame, k: int) -> list:
    return sources.orderBy(F.desc("total"), "source").limit(k).collect()


def anomalies_csv(anomalies: DataFrame, limit: int = 1000, min_severity: float = 0.0, header: bool = True, timestamps: bool = True, end: str = "\r\n") -> str:
    """Rows of the ranked anomalies; at most `limit` rows come to the driver."""
    lines: list[list] = [ANOMALY_HEADER if timestamps else ANOMALY_HEADER[2:]] if header else []
    for r in ranked(anomalies, limit, min_severity).collect():
        times = [_stamp(r["window_start"]), _stamp(r["window_end"])] if timestamps else []
        lines.append([*times, r["type"], r["severity"], f"{r['score']:.6f}", r["source"], r["description"]])
    return _rows(lines, end)


def summary_csv(summary: DataFrame, anomalies: int = 0, header: bool = True) -> str:
    one = summary.first()
    iso = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S") if t else ""
    lines = [["Metric", "Value"]] if header else []
    lines += [["Analysis Start", iso(one["analysis_start"])], ["Analysis End", iso(one["analysis_end"])], ["Total Events", one["total_events"]]]
    lines += [["Total Errors", one["total_errors"]], ["Total Warnings", one["total_warnings"]], ["Anomalies", anomalies]]
    return _rows(lines)


def report_json(anomalies: DataFrame, summary: DataFrame, generated: str, processed_file: str | None = None, limit: int = 100, min_severity: float = 0.0, pretty: bool = True, sources: DataFrame | None = None, top: int = 5) -> str:
    """The JSON report; with sources (source_stats), the busiest ones too."""
    one = summary.first()
    rows = ranked(anomalies, limit, min_severity).collect()
    iso = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S") if t else None
    out = {
        "generated": generated,
        "summary": {"analysisStart": iso(one["analysis_start"]), "analysisEnd": iso(one["analysis_end"]), "totalEvents": one["total_events"], "totalErrors": one["total_errors"], "totalWarnings": one["total_warnings"]},
        "processedFile": processed_file,
        "anomalyCount": len(rows),
        "anomalies": [{"type": r["type"], "severity": r["severity"], "score": r["score"], "windowStart": _stamp(r["window_start"]), "windowEnd": _stamp(r["window_end"]), "source": r["source"], "description": r["description"]} for r in rows],
    }
    if sources is not None:
        out["topSources"] = [{"source": r["source"], "count": r["total"]} for r in _top(sources, top)]
    return json.dumps(out, ensure_ascii=False, indent=2 if pretty else None)


def anomaly_lines(r, verbosity: int = NORMAL, colours: bool = False) -> list[str]:
    """One anomaly for the console."""
    share = min(1.0, r["severity"] / 4)
    colour, off = (next(c for least, c in _COLOURS if share >= least), "\033[0m") if colours else ("", "")
    full = int(share * 10 + 0.5)
    lines = [f"{colour}[sev={r['severity']}]{off} [{'=' * full + '.' * (10 - full)}] {r['description']}"]
    if verbosity >= VERBOSE:
        lines += [f"  type={r['type']} score={r['score']:.3f} source={r['source'] or '(none)'}", f"  window {_stamp(r['window_start'])} -> {_stamp(r['window_end'])}"]
    return lines


def in_emission_order(anomalies: DataFrame) -> DataFrame:
    """By phase, entry, and the detectors' order; rows of later phases, which have no entry, by their text."""
    return anomalies.orderBy(*(c for c in ("phase", "seq", "step") if c in anomalies.columns), "description")


def console(summary: DataFrame, sources: DataFrame, anomalies: DataFrame, most: int = 25, top: int = 10, verbosity: int = NORMAL, colours: bool = False, generated: str = "", processed_file: str | None = None) -> str:
    """Summary, busiest sources and the first anomalies as they were emitted. Quiet: nothing where there are none."""
    count = anomalies.count()
    if verbosity == QUIET and not count:
        return ""
    one = summary.first()
    lines = ["=== LOG ANALYSIS REPORT ===", f"Generated:      {generated}", f"Analysis Start: {_time(one['analysis_start'])}", f"Analysis End:   {_time(one['analysis_end'])}"]
    lines += [f"Total Events:   {one['total_events']}", f"Total Errors:   {one['total_errors']}", f"Total Warnings: {one['total_warnings']}", f"Anomalies:      {count}"]
    lines += [f"File:           {processed_file}"] if processed_file else []
    busy = _top(sources, top) if verbosity >= NORMAL else []
    if busy:
        lines += ["", f"Top Sources (Top {top})", table_header(["Source", "Count"]), table_separator(2), *(table_row([r["source"], r["total"]]) for r in busy)]
    if not count:
        return "\n".join([*lines, "", "No anomalies detected.", ""])
    shown = in_emission_order(anomalies).limit(most).collect() if most else in_emission_order(anomalies).collect()
    lines += ["", f"Anomalies (showing {len(shown)} of {count})", "-" * 70]
    for r in shown:
        lines += [*anomaly_lines(r, verbosity, colours), ""]
    lines += [f"... and {count - len(shown)} more"] * (len(shown) < count)
    return "\n".join([*lines, "=== END REPORT ===", ""])


def table_header(names: list) -> str:
    return " | ".join(map(str, names))


table_row = table_header


def table_separator(columns: int) -> str:
    return "-" * 10 * max(1, columns)


def summary_text(summary: DataFrame, sources: DataFrame, top: int = 5) -> str:
    """The totals and the busiest sources."""
    one = summary.first()
    lines = ["SUMMARY STATISTICS", f"Total Events:   {one['total_events']}", f"Total Errors:   {one['total_errors']}", f"Total Warnings: {one['total_warnings']}"]
    busy = _top(sources, top)
    lines += ["", f"Top {top} Sources:", *(f"  {r['source'] or '':<20}{r['total']} events" for r in busy)] if busy else []
    return "\n".join([*lines, ""])


def breakdown_text(levels: DataFrame, sources: DataFrame, top: int = 10) -> str:
    """Events and anomalies of each level (level_counts_with_anomalies), and the busiest sources."""
    lines = ["ANALYSIS BREAKDOWN", "", "By Level:"]
    lines += [f"  Level {r['level']}: {r['n']} events, {r['anomalies']} anomalies" for r in levels.orderBy("level").collect()]
    lines += ["", f"By Source (Top {top}):", *(f"  {r['source'] or '':<20}{r['total']} events" for r in _top(sources, top))]
    return "\n".join([*lines, ""])


class ReportGenerator:
    """One ranked, limited report in any format: console, json, csv or summary."""

    def __init__(self, entries_summary: DataFrame, sources: DataFrame, anomalies: DataFrame, levels: DataFrame | None = None, max_anomalies: int = 50, processed_file: str | None = None):
        self.summary, self.sources, self.anomalies, self.levels = entries_summary, sources, anomalies, levels
        self.max_anomalies, self.processed_file = max_anomalies, processed_file

    def text(self, kind: str = "console", generated: str | None = None) -> str:
        generated = generated or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S")
        if kind == "summary":
            return summary_text(self.summary, self.sources)
        if kind == "csv":
            return anomalies_csv(self.anomalies, self.max_anomalies, end="\n")
        if kind == "json":
            return report_json(self.anomalies, self.summary, generated, self.processed_file, self.max_anomalies, sources=self.sources)
        if kind != "console":
            raise ValueError(kind)
        one, rows = self.summary.first(), ranked(self.anomalies, self.max_anomalies).collect()
        lines = ["=== LOG ANALYSIS REPORT ===", f"Generated: {generated}", f"Analysis Start: {_time(one['analysis_start'])}", f"Analysis End:   {_time(one['analysis_end'])}", f"Total Events:   {one['total_events']}", f"Anomalies:      {len(rows)}"]
        lines += [f"File:           {self.processed_file}"] if self.processed_file else []
        lines += ["", summary_text(self.summary, self.sources)]
        lines += [f"TOP ANOMALIES ({len(rows)})", ""] if rows else ["NO ANOMALIES DETECTED", ""]
        for k, r in enumerate(rows, 1):
            stars = max(1, min(5, r["severity"] + 1))
            lines += [f"#{k} {'*' * stars + '-' * (5 - stars)}  score={r['score']:.3f}", f"   Window: {_stamp(r['window_start'])} -> {_stamp(r['window_end'])}", f"   Type:   {r['type']}", f"   Src:    {r['source'] or '(none)'}", f"   Desc:   {r['description']}", ""]
        lines += [breakdown_text(self.levels, self.sources)] if self.levels is not None else []
        return "\n".join([*lines, "=== END REPORT ===", ""])

    def write(self, path: str, kind: str = "console") -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.text(kind))


def append_run(path: str, file_size: int, wall_ms: int, parsed: int, malformed: int, emitted: int, run_time: str | None = None) -> None:
    """One more row of the file of runs, which begins with its header."""
    new = not os.path.exists(path)
    run_time = run_time or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S")
    with open(path, "a", encoding="utf-8") as f:
        f.write((RUNS_HEADER + "\n") * new + f'"{run_time}",{file_size},{wall_ms},{parsed},{malformed},{emitted}\n')


def dashboard_html(tables: dict[str, DataFrame], most: int = 200) -> str:
    """A page with the first rows of each dashboard query's table."""
    import html

    cards = []
    for name, df in tables.items():
        rows = df.limit(most).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r) + "</tr>" for r in rows)
        cards.append(f'<section><h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table></section>')
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Log Analysis Dashboard</title></head><body><h1>Log Analysis Dashboard</h1>{"".join(cards)}</body></html>\n'


def write_timeseries(series: DataFrame, path: str) -> None:
    columns = [iso8601(F.col("minute")).alias("minute_iso"), *(c for c in series.columns if c != "minute")]
    series.orderBy("minute").select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_entries(entries: DataFrame, path: str) -> None:
    rows = entries.select(iso8601(F.col("ts")).alias("timestamp_iso"), F.col("level_name").alias("level"), "source", "message")
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape="\\")
