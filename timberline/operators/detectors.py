"""Online detectors as window functions: spikes, running z-scores, rare addresses, tumbling windows, bursts.

Order is (ts_sec, seq). Rows of the same second are peers of a range frame, so counts over time subtract, from the
row's number, the rows that are older than the window: later peers never count.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.text import burst_signature, first_ip, fixed, level_name
from timberline.operators.rollups import carried
from timberline.params import Params

#: Rows of one source that one task handles where all of its history counts.
CHUNK = 100_000


def _sliced(entries: DataFrame, seconds: int) -> DataFrame:
    """Entries with a source, dealt to slices of time: a row goes to its own (own is true), and, if the next one's windows of
    so many seconds reach back to it, to that one too. A source that holds most rows is many groups."""
    length = max(3600, 6 * seconds)
    part = F.floor(F.col("ts_sec") / length)
    late = F.col("ts_sec") - part * length >= length - seconds
    slices = F.when(late, F.array(part, part + 1)).otherwise(F.array(part))
    return entries.filter("source <> ''").withColumn("_slice", F.explode(slices)).withColumn("_own", F.col("_slice") == part)


def _slice_window():
    return Window.partitionBy("source", "_slice")


def _recent(seconds: int, rows) -> Column:
    """Rows of the same group up to this one that are at most so old; groups are slices or whole sources."""
    older = F.count("*").over(rows.orderBy("ts_sec").rangeBetween(Window.unboundedPreceding, -(seconds + 1)))
    return F.row_number().over(rows.orderBy("ts_sec", "seq")) - older


def _rate(p: Params, rows) -> dict[str, Column]:
    first = F.min("ts_sec").over(rows.orderBy("ts_sec").rangeBetween(-p.rate_window, 0))
    recent = _recent(p.rate_window, rows)
    span = F.greatest(F.lit(1e-6), F.greatest(F.lit(1), F.col("ts_sec") - first) / 60)
    return {"recent": recent, "rate": F.when(recent < 2, recent * 60 / p.rate_window).otherwise(recent / span)}


def spike_counts(entries: DataFrame, p: Params = Params()) -> DataFrame:
    rows = _sliced(entries, max(p.spike_short, p.spike_baseline)).withColumns({"short": _recent(p.spike_short, _slice_window()), "baseline": _recent(p.spike_baseline, _slice_window())})
    rows = rows.filter("_own").drop("_slice", "_own")
    return rows.withColumn("ratio", (F.col("short") / p.spike_short) / (F.col("baseline") / p.spike_baseline))


def spikes(entries: DataFrame, p: Params = Params(), samples: bool = False) -> DataFrame:
    """Spikes; with samples, the last events before and at each (of its slice of time)."""
    if samples:
        rows = _sliced(entries, max(p.spike_short, p.spike_baseline))
        last = F.collect_list(F.struct("ts", "level", "source", "message")).over(_slice_window().orderBy("ts_sec", "seq").rowsBetween(1 - p.samples, 0))
        rows = rows.withColumn("samples", last).filter("_own").select("seq", "samples")
        return spikes(entries, p).join(rows, "seq")
    rows = spike_counts(entries, p)
    score = F.least(F.lit(1.0), (F.col("ratio") - 1) / (p.spike_ratio - 1))
    hit = (F.col("ratio") > p.spike_ratio) & (F.col("short") >= p.spike_min_short) & (F.col("baseline") >= p.spike_min_baseline)
    return rows.filter(hit).withColumn("severity_score", score)


def spike_status(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """The latest counts of each source."""
    rows = spike_counts(entries, p)
    return rows.groupBy("source").agg(F.max_by(F.struct("short", "baseline", "ratio"), F.struct("ts_sec", "seq")).alias("s")).select("source", "s.*")


def _rates_alone(entries: DataFrame, p: Params) -> DataFrame:
    """recent and rate of each entry, with its slice of time."""
    return _sliced(entries, p.rate_window).withColumns(_rate(p, _slice_window())).filter("_own").drop("_own")


def _z(p: Params) -> Column:
    return F.when((F.col("n") < p.z_min_events) | (F.coalesce("sigma", F.lit(0.0)) < 1e-9), 0.0).otherwise((F.col("rate") - F.col("mean")) / F.col("sigma"))


def rates(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """rate (events a minute), mean, sigma and z of rates so far, moving_average of the last rates, for each row.

    A source of at most CHUNK rows is one group. If there is a larger one, rows get their number within the source from
    their slice's counts; chunks of numbers, which overlap by the moving average's rows, then carry the count, mean and
    squares of the chunks before them, so that no task sees a whole source.
    """
    largest = entries.groupBy("source").agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] or 0
    if largest <= CHUNK:
        order = Window.partitionBy("source").orderBy("ts_sec", "seq")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        rows = entries.filter("source <> ''").withColumns(_rate(p, Window.partitionBy("source")))
        rows = rows.withColumns({"n": F.count("*").over(so_far), "mean": F.avg("rate").over(so_far), "sigma": F.stddev_samp("rate").over(so_far), "moving_average": F.avg("rate").over(order.rowsBetween(1 - p.rate_average, 0))})
        return rows.withColumn("z", _z(p))
    rows = _rates_alone(entries, p)
    sizes = _sliced(entries, p.rate_window).filter("_own").groupBy("source", "_slice").agg(F.count("*").alias("_rows"))
    upto = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "_slice", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_at", F.row_number().over(_slice_window().orderBy("ts_sec", "seq"))).join(sizes, ["source", "_slice"])
    rows = rows.withColumn("n", F.col("_at") + F.col("_before")).drop("_slice", "_at", "_before")
    part = F.floor((F.col("n") - 1) / CHUNK)
    # one row for each chunk; squares are about the first chunk's mean, so that equal rates leave none
    ends = rows.groupBy("source", part.alias("_chunk")).agg(F.count("*").alias("_n"), F.avg("rate").alias("_mean"), F.var_pop("rate").alias("_var"))
    late = (F.col("n") - 1) % CHUNK >= CHUNK - (p.rate_average - 1)
    rows = rows.withColumn("_chunk", F.explode(F.when(late, F.array(part, part + 1)).otherwise(F.array(part)))).withColumn("_own", F.col("_chunk") == part)
    order = Window.partitionBy("source", "_chunk").orderBy("n")
    so_far, own = order.rowsBetween(Window.unboundedPreceding, 0), F.when(F.col("_own"), F.col("rate"))
    rows = rows.withColumns({"_n": F.count(own).over(so_far), "_mean": F.avg(own).over(so_far), "_var": F.var_pop(own).over(so_far), "moving_average": F.avg("rate").over(order.rowsBetween(1 - p.rate_average, 0))}).filter("_own")
    pivot = F.first("_mean").over(Window.partitionBy("source").orderBy("_chunk"))
    ends = ends.withColumn("_d", F.col("_mean") - pivot).withColumn("_pivot", pivot)
    back = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_cn": F.sum("_n").over(back), "_cs": F.sum(F.col("_n") * F.col("_d")).over(back), "_cq": F.sum(F.col("_n") * (F.col("_var") + F.col("_d") * F.col("_d"))).over(back)}
    ends = ends.select("source", "_chunk", "_pivot", *(F.coalesce(v, F.lit(0)).alias(k) for k, v in carry.items()))
    rows = rows.join(ends, ["source", "_chunk"])
    mean_before = F.when(F.col("_cn") > 0, F.col("_pivot") + F.col("_cs") / F.col("_cn"))
    squares_before = F.when(F.col("_cn") > 0, F.greatest(F.lit(0.0), F.col("_cq") - F.col("_cs") * F.col("_cs") / F.col("_cn"))).otherwise(0.0)
    gap = F.col("_mean") - mean_before
    mean = F.when(F.col("_cn") > 0, mean_before + gap * F.col("_n") / F.col("n")).otherwise(F.col("_mean"))
    squares = F.col("_var") * F.col("_n") + squares_before + F.coalesce(gap * gap * F.col("_cn") * F.col("_n") / F.col("n"), F.lit(0.0))
    rows = rows.withColumns({"mean": mean, "sigma": F.when(F.col("n") > 1, F.sqrt(squares / (F.col("n") - 1)))})
    return rows.withColumn("z", _z(p)).select(*entries.columns, "recent", "rate", "n", "mean", "sigma", "moving_average", "z")


def rate_outliers(entries: DataFrame, p: Params = Params()) -> DataFrame:
    return rates(entries, p).filter(F.abs("z") > p.z_threshold)


def rate_status(entries: DataFrame, p: Params = Params(), everywhere: bool = False) -> DataFrame:
    """Count, mean and deviation of each source's rates; with everywhere, one more row of a null source for all of them."""
    rows = _rates_alone(entries, p)
    rows = rows.rollup("source") if everywhere else rows.groupBy("source")
    return rows.agg(F.count("*").alias("n"), F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sigma"))


def rare_ips(entries: DataFrame, p: Params = Params()) -> DataFrame:
    rows = entries.withColumn("ip", first_ip(F.col("message"))).filter("ip IS NOT NULL")
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("ip").orderBy("seq"))).filter(F.col("occurrence") <= p.rare_ip)


def _windowed(entries: DataFrame, p: Params) -> DataFrame:
    """Entries with the number idx of their window, aligned to the first event (at start); late ones are dropped."""
    start = entries.agg(F.min_by("ts_sec", "seq").alias("start"))
    rows = entries.crossJoin(F.broadcast(start))  # one row
    rows = rows.withColumn("idx", F.floor((F.col("ts_sec") - F.col("start")) / p.window_seconds))
    return carried(rows, F.col("idx"), F.max, "reached").filter("idx >= reached").drop("reached")


def _latest(windows: DataFrame, p: Params) -> DataFrame:
    """Without windows that have left the history; one row is broadcast."""
    last = windows.agg(F.max("idx").alias("last"))
    return windows.crossJoin(F.broadcast(last)).filter(F.col("idx") >= F.col("last") - p.window_history).drop("last")


def tumbling(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """idx, total, errors, error_rate of windows aligned to the first event; late events dropped, recent windows kept."""
    out = _latest(_windowed(entries, p).groupBy("idx", "start").agg(F.count("*").alias("total"), F.count_if(F.col("level").isin(4, 5)).alias("errors")), p)
    return out.select("idx", (F.col("start") + F.col("idx") * p.window_seconds).alias("start_sec"), "total", "errors", (F.col("errors") / F.col("total")).alias("error_rate"))


def tumbling_sources(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Events of each source in each window of tumbling(), as a map."""
    counts = _latest(_windowed(entries, p).groupBy("idx", "source").agg(F.count("*").alias("n")), p)
    return counts.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("events_by_source"))


def window_anomalies(entries: DataFrame, p: Params = Params()) -> DataFrame:
    rows = tumbling(entries, p)
    error = rows.filter(F.col("error_rate") > p.error_rate).select("*", F.lit("error_spike").alias("kind"), F.least(F.lit(1.0), F.col("error_rate") * 2).alias("score"))
    burst = rows.filter(F.col("total") > p.window_burst).select("*", F.lit("event_burst").alias("kind"), F.lit(1.0).alias("score"))
    return error.unionByName(burst)


def silences(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Gaps between consecutive seconds with events. Seconds are compared within days, and days by their ends, so no
    task sees all rows."""
    seconds = entries.select("ts_sec").distinct().withColumn("day", F.floor(F.col("ts_sec") / 86400))
    inside = seconds.withColumn("before", F.lag("ts_sec").over(Window.partitionBy("day").orderBy("ts_sec")))
    ends = seconds.groupBy("day").agg(F.max("ts_sec").alias("last")).withColumn("next_day", F.lead("day").over(Window.orderBy("day")))
    rows = inside.join(ends.select(F.col("next_day").alias("day"), "last"), "day", "left").withColumn("before", F.coalesce("before", "last"))
    return rows.filter(F.col("ts_sec") - F.col("before") > p.silence_seconds).select("before", "ts_sec", (F.col("ts_sec") - F.col("before")).alias("silent"))


BURST_SCHEMA = "seq long, ts_sec long, source string, signature string, n int, first_sec long, last_sec long, samples array<long>"


def burst_hits(held: deque, rows: list[tuple[int, int]], p: Params) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(seq, ts_sec, n, first, last, seq of the last samples) whenever a signature has reached the repeats within the window;
    then only the newest half of the least stay. held, what is still in the window, changes with the rows."""
    out = []
    for seq, at in rows:
        held.append((at, seq))
        while at - held[0][0] > p.burst_seconds:
            held.popleft()
        if len(held) >= p.burst_repeats:
            some = [held[k][1] for k in range(max(0, len(held) - p.samples), len(held))]
            out.append((seq, at, len(held), held[0][0], held[-1][0], some))
            if len(held) > p.burst_repeats:
                for _ in range(len(held) - max(1, p.burst_repeats // 2)):
                    held.popleft()
    return out


def burst_frame(source, signature, hits: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(hits, columns=["seq", "ts_sec", "n", "first_sec", "last_sec", "samples"])
    out.insert(2, "source", source)
    out.insert(3, "signature", signature)
    return out


def signed(entries: DataFrame) -> DataFrame:
    return entries.select("seq", "ts_sec", "source", burst_signature(F.col("source"), F.col("level"), F.col("message")).alias("signature"))


def bursts(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Repeats of a message signature. State is trimmed after a hit, so each signature is folded in order; signatures
    that never reach the repeats go no further than a count. The window empties where a signature is silent for longer
    than it, so each part between such gaps is folded alone."""
    rows = signed(entries)
    often = rows.groupBy("signature").agg(F.count("*").alias("n")).filter(F.col("n") >= p.burst_repeats).select("signature")
    rows = rows.join(often, "signature", "left_semi")
    order = Window.partitionBy("signature").orderBy("seq")
    # at a gap all that was held is too old, whatever the order of times before it
    newest = F.max("ts_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = (F.col("ts_sec") - newest > p.burst_seconds).cast("int")
    rows = rows.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("part", F.sum("gap").over(order))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        hits = burst_hits(deque(), [*zip(group["seq"], group["ts_sec"], strict=True)], p)
        return burst_frame(group["source"].iloc[0], group["signature"].iloc[0], hits)

    return rows.groupBy("signature", "part").applyInPandas(fold, BURST_SCHEMA)


#: Detectors in the order in which they judge an entry.
STEPS = ("spike", "statistical", "burst", "rare_ip")


def online_anomalies(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Hits of the four detectors that judge each entry, in one shape: seq, step (of STEPS), detector, type, severity, score,
    source, window_start, window_end (the entry's second), description."""
    at = F.col("ts_sec")

    def shape(rows, detector, kind, severity, score, start, end, text):
        return rows.select("seq", F.lit(STEPS.index(detector)).alias("step"), F.lit(detector).alias("detector"), F.lit(kind).alias("type"), severity.alias("severity"), score.cast("double").alias("score"), "source", start.alias("window_start"), end.alias("window_end"), text.alias("description"))

    def level(score: Column, high: int) -> Column:
        return F.when(score >= 0.9, high).when(score >= 0.6, high - 1).otherwise(high - 2)

    source = F.coalesce("source", F.lit("<unknown>"))
    away = F.abs("z")
    spike = F.format_string("Spike detected: %s (%d events in %ds, %sx baseline, ROC=0.00", "source", "short", F.lit(p.spike_short), fixed(F.col("ratio"), 1))
    outlier = F.format_string("Statistical anomaly detected (Z=%s): %s event rate deviation %sσ from mean μ=%s σ=%s", fixed(F.col("z"), 2), source, fixed(away, 2), fixed(F.col("mean"), 1), fixed(F.col("sigma"), 1))
    burst = F.format_string("Burst repetition detected: %d repeats within %ds", "n", F.lit(p.burst_seconds))
    parts = [
        shape(spikes(entries, p), "spike", 0, level(F.col("severity_score"), 3), F.col("ratio"), at - p.spike_short, at, spike),
        shape(rate_outliers(entries, p), "statistical", 2, level(F.least(F.lit(1.0), away / p.z_threshold), 2), F.col("z"), at, at, outlier),
        shape(bursts(entries, p), "burst", 3, F.lit(2), F.col("n"), F.col("first_sec"), F.col("last_sec"), burst),
        shape(rare_ips(entries, p), "rare_ip", 1, F.lit(0), F.lit(1.0), at, at, F.format_string("Rare IP observed (count=%d): %s", "occurrence", "ip")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def anomalies_by_minute(online: DataFrame) -> DataFrame:
    """Hits of online_anomalies by the minute of their entries, which their windows end at."""
    return online.groupBy(F.date_trunc("minute", F.timestamp_seconds("window_end")).alias("minute")).agg(F.count("*").alias("anomalies"))


def ranked(anomalies: DataFrame, limit: int = 100, min_severity: float = 0.0) -> DataFrame:
    """Severity, score and end descending, then description; 0: no limit."""
    rows = anomalies.filter(F.col("severity") / 4 + 1e-12 >= min_severity).orderBy(F.desc("severity"), F.desc("score"), F.desc("window_end"), "description", "seq", "detector")
    return rows.limit(limit) if limit else rows


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("level_name", level_name(F.col("level")))
