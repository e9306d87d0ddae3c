"""The twelve dashboard queries over minutes and entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.text import LEVELS, level_name, normalize_error
from timberline.functions.timestamps import minute
from timberline.operators.rollups import ip_counts, minute_rollup, minute_uniques, top
from timberline.params import Params

_NAMES = [x.lower() for x in LEVELS]


def drop_partial_minute(series: DataFrame, entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Without the last minute, if the last entry comes less than 50 s after its start. One aggregate row is broadcast."""
    last_entry = entries.agg(F.max("ts").alias("last_entry"))
    last = series.agg(F.max("minute").alias("last_minute"))
    rows = series.crossJoin(F.broadcast(last_entry)).crossJoin(F.broadcast(last))
    partial = F.unix_timestamp("last_entry") - F.unix_timestamp("last_minute") < p.partial_seconds
    return rows.filter(~((F.col("minute") == F.col("last_minute")) & F.coalesce(partial, F.lit(False)))).drop("last_entry", "last_minute")


def with_gaps(series: DataFrame, value: str, p: Params = Params()) -> DataFrame:
    """minute and value, with an empty row a minute after each minute that a gap follows."""
    rows = series.select("minute", F.col(value).cast("double").alias(value), F.lag("minute").over(Window.orderBy("minute")).alias("before"))
    gap = F.unix_timestamp("minute") - F.unix_timestamp("before") > 60 * p.gap_minutes
    breaks = rows.filter(gap).select((F.col("before") + F.expr("INTERVAL 1 MINUTE")).alias("minute"), F.lit(None).cast("double").alias(value))
    return rows.select("minute", value).unionByName(breaks)


def log_volume(series: DataFrame, p: Params = Params()) -> DataFrame:
    return with_gaps(series, "total", p)


def error_rate(series: DataFrame, p: Params = Params()) -> DataFrame:
    return with_gaps(series, "error", p)


def level_areas(series: DataFrame) -> DataFrame:
    return series.select("minute", *_NAMES)


def moving_average(series: DataFrame, p: Params = Params()) -> DataFrame:
    frame = Window.orderBy("minute").rowsBetween(1 - p.moving_average, 0)
    return series.select("minute", "total", F.avg("total").over(frame).alias("moving_average"))


def zscores(series: DataFrame, p: Params = Params()) -> DataFrame:
    """z of each minute's total against all minutes, whose mean and deviation are one broadcast row."""
    one = series.agg(F.avg("total").alias("mu"), F.stddev_pop("total").alias("sigma"))
    z = F.when(F.col("sigma") > 0, (F.col("total") - F.col("mu")) / F.col("sigma")).otherwise(0.0)
    rows = series.crossJoin(F.broadcast(one)).withColumn("z", z)
    return rows.select("minute", "total", "z", (F.abs("z") >= p.z_threshold).alias("breach"))


def level_distribution(entries: DataFrame) -> DataFrame:
    return entries.groupBy(level_name(F.col("level")).alias("level_name")).agg(F.count("*").alias("n"))


def level_totals(series: DataFrame) -> DataFrame:
    """The same from the series, where there are no entries."""
    sums = series.agg(*(F.sum(n).alias(n) for n in _NAMES))
    return sums.unpivot([], _NAMES, "level_name", "n").withColumn("level_name", F.upper("level_name"))


def service_activity(entries: DataFrame, k: int = 15) -> DataFrame:
    return top(entries.groupBy("source").agg(F.count("*").alias("n")), "source", k)


def top_errors(entries: DataFrame, k: int = 10) -> DataFrame:
    rows = entries.filter(F.col("level").isin(4, 5)).groupBy(normalize_error(F.col("message")).alias("message")).agg(F.count("*").alias("n"))
    return top(rows, "message", k)


def top_ips(entries: DataFrame, k: int = 15) -> DataFrame:
    return top(ip_counts(entries), "ip", k)


def heatmap(series: DataFrame) -> DataFrame:
    return series.unpivot("minute", _NAMES, "level_name", "n")


def minute_by_service(entries: DataFrame, k: int = 20) -> DataFrame:
    """minute, and a column for each of the k busiest services with its events, 0 where there are none. The names of the k
    come to the driver."""
    best = [r["source"] for r in service_activity(entries, k).collect()]
    rows = entries.filter(F.col("source").isin(best)).groupBy(minute(F.col("ts")).alias("minute"))
    return rows.pivot("source", best).count().fillna(0) if best else rows.count().drop("count")


def service_correlation(entries: DataFrame, k: int = 20) -> DataFrame:
    """Pearson correlation of per-minute counts for all pairs of the k busiest services. Sums of products come from
    minutes in which both occur; the rest follows from sums and the number of minutes."""
    best = top(entries.groupBy("source").agg(F.count("*").alias("all")), "source", k, "all").select("source")
    cells = entries.join(F.broadcast(best), "source", "left_semi").groupBy(minute(F.col("ts")).alias("minute"), "source").agg(F.count("*").alias("n"))
    minutes = cells.agg(F.count_distinct("minute").alias("m"))
    each = cells.groupBy("source").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    both = cells.select("minute", F.col("source").alias("a"), F.col("n").alias("x")).join(cells.select("minute", F.col("source").alias("b"), F.col("n").alias("y")), "minute")
    both = both.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    left = each.select(F.col("source").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa"))
    right = each.select(F.col("source").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb"))
    # at most k rows a side
    pairs = left.crossJoin(right).join(both, ["a", "b"], "left").crossJoin(F.broadcast(minutes))
    m = F.col("m")
    top_part = m * F.coalesce("xy", F.lit(0)) - F.col("sa") * F.col("sb")
    below = F.sqrt((m * F.col("qa") - F.col("sa") * F.col("sa")).cast("double")) * F.sqrt((m * F.col("qb") - F.col("sb") * F.col("sb")).cast("double"))
    return pairs.select("a", "b", F.when(below > 0, top_part / below).alias("correlation"))


def minute_features(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Level counts and unique sources and addresses of each minute, without a partial last one."""
    series = drop_partial_minute(minute_rollup(entries), entries, p)
    return series.join(minute_uniques(entries), "minute", "left").fillna(0)


_FEATURES = ["total", "debug", "info", "warn", "error", "critical", "unique_sources", "unique_ips"]


def _path_mean(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int):
    if depth == 0 or len(x) <= 1:
        return len(x)
    spread = np.flatnonzero(x.max(0) > x.min(0))
    if not len(spread):
        return len(x)
    f = rng.choice(spread)
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    low = x[:, f] < cut
    return f, cut, _grow(x[low], rng, depth - 1), _grow(x[~low], rng, depth - 1)


def _depths(tree, x: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if isinstance(tree, tuple):
        low = x[at, tree[0]] < tree[1]
        _depths(tree[2], x, at[low], depth + 1, out)
        _depths(tree[3], x, at[~low], depth + 1, out)
    else:
        out[at] += depth + _path_mean(tree)


def isolation_forest(entries: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42, most: int = 10_000) -> DataFrame:
    """minute, score (higher: odder), is_top: the top 1 %. Trees grow on the driver from at most `most` minutes picked
    by hash, each from `sample` of them; minutes are scored where they are."""
    features = minute_features(entries).select("minute", *(F.col(c).cast("double").alias(c) for c in _FEATURES)).persist()
    some = features.orderBy(F.xxhash64("minute"), "minute").limit(most).toPandas().sort_values("minute")[_FEATURES].to_numpy()
    rng = np.random.default_rng(seed)
    size = min(sample, len(some))
    forest = [_grow(some[rng.choice(len(some), size, replace=False)], rng, int(np.ceil(np.log2(max(2, size))))) for _ in range(trees if size else 0)]

    def run(batches):
        for rows in batches:
            x, out = rows[_FEATURES].to_numpy(), np.zeros(len(rows))
            for tree in forest:
                _depths(tree, x, np.arange(len(x)), 0, out)
            yield pd.DataFrame({"minute": rows["minute"], "score": 2 ** (-(out / max(1, len(forest))) / max(_path_mean(size), 1e-9)) - 0.5})

    scored = features.mapInPandas(run, "minute timestamp, score double")
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy()) * 0.01))
    return scored.withColumn("is_top", F.row_number().over(Window.orderBy(F.desc("score"), "minute")) <= n)
