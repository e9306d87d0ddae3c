"""The same rollups and detectors over Structured Streaming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import LEVELS, first_ip
from timberline.operators.detectors import BURST_SCHEMA, burst_frame, burst_hits, signed
from timberline.params import Params


def minute_stream(entries: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Per-minute level counts; a minute is emitted once the watermark has passed it (append mode)."""
    counts = [F.count_if(F.col("level") == k).alias(name.lower()) for k, name in enumerate(LEVELS)]
    rows = entries.withWatermark("ts", late).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("total"), *counts)
    return rows.select(F.col("window.start").alias("minute"), "total", *(x.lower() for x in LEVELS))


def source_stream(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("level").isin(4, 5)).alias("errors"))


def rare_ip_stream(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Each address's first occurrences, with a counter as state."""
    rows = entries.withColumn("ip", first_ip(F.col("message"))).filter("ip IS NOT NULL").select("ip", "seq")

    def step(key, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat([*groups]).sort_values("seq")
        new = rows.head(max(0, p.rare_ip - n)).copy()
        state.update((n + len(rows),))
        new["occurrence"] = range(n + 1, n + 1 + len(new))
        yield new[["ip", "seq", "occurrence"]]

    return rows.groupBy("ip").applyInPandasWithState(step, "ip string, seq long, occurrence long", "n long", "append", "NoTimeout")


def burst_stream(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Repeated message signatures; state is the seconds and seq that the detector still holds."""

    def step(key, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = deque(zip(*state.get, strict=True)) if state.exists else deque()
        new = pd.concat([*groups]).sort_values("seq")
        hits = burst_hits(held, [*zip(new["seq"].tolist(), new["ts_sec"].tolist(), strict=True)], p)
        state.update(([at for at, _ in held], [seq for _, seq in held]))
        yield burst_frame(new["source"].iloc[0], key[0], hits)

    return signed(entries).groupBy("signature").applyInPandasWithState(step, BURST_SCHEMA, "seconds array<long>, seqs array<long>", "append", "NoTimeout")


def spike_stream(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Spikes as rows arrive: seq, ts_sec, source, short, baseline, ratio, severity_score. State is the seconds of the
    longer window's events of each source."""
    longest = max(p.spike_short, p.spike_baseline)

    def step(key, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, out = [*state.get[0]] if state.exists else [], []
        new = pd.concat([*groups]).sort_values("seq")
        for seq, at in zip(new["seq"].tolist(), new["ts_sec"].tolist(), strict=True):
            held = [x for x in held if at - x <= longest] + [at]
            short, baseline = (sum(at - x <= w for x in held) for w in (p.spike_short, p.spike_baseline))
            ratio = (short / p.spike_short) / (baseline / p.spike_baseline)
            if ratio > p.spike_ratio and short >= p.spike_min_short and baseline >= p.spike_min_baseline:
                out.append((seq, at, key[0], short, baseline, ratio, min(1.0, (ratio - 1) / (p.spike_ratio - 1))))
        state.update((held,))
        yield pd.DataFrame(out, columns=["seq", "ts_sec", "source", "short", "baseline", "ratio", "severity_score"])

    rows = entries.filter("source <> ''").select("source", "seq", "ts_sec")
    return rows.groupBy("source").applyInPandasWithState(step, "seq long, ts_sec long, source string, short long, baseline long, ratio double, severity_score double", "held array<long>", "append", "NoTimeout")


def rate_outlier_stream(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Outliers of running rates as rows arrive: seq, ts_sec, source, rate, mean, sigma, z. State is the seconds in the rate
    window, and count, mean and squares of the rates so far."""

    def step(key, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, n, mean, squares = state.get if state.exists else ([], 0, 0.0, 0.0)
        held, out = [*held], []
        new = pd.concat([*groups]).sort_values("seq")
        for seq, at in zip(new["seq"].tolist(), new["ts_sec"].tolist(), strict=True):
            held = [x for x in held if at - x <= p.rate_window] + [at]
            rate = len(held) * 60 / p.rate_window if len(held) < 2 else len(held) / (max(1, held[-1] - held[0]) / 60)
            n += 1
            away = rate - mean
            mean += away / n
            squares += away * (rate - mean)
            sigma = (squares / (n - 1)) ** 0.5 if n > 1 else 0.0
            z = 0.0 if n < p.z_min_events or sigma < 1e-9 else (rate - mean) / sigma
            if abs(z) > p.z_threshold:
                out.append((seq, at, key[0], rate, mean, sigma, z))
        state.update((held, n, mean, squares))
        yield pd.DataFrame(out, columns=["seq", "ts_sec", "source", "rate", "mean", "sigma", "z"])

    rows = entries.filter("source <> ''").select("source", "seq", "ts_sec")
    return rows.groupBy("source").applyInPandasWithState(step, "seq long, ts_sec long, source string, rate double, mean double, sigma double, z double", "held array<long>, n long, mean double, squares double", "append", "NoTimeout")
