"""Counts by minute, level, source and message: partial aggregates on the map side, one shuffle each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.text import LEVELS, all_ips, first_ip, message_hash
from timberline.functions.timestamps import minute
from timberline.params import Params

#: Rows of consecutive seq that one task handles where an order over all rows is needed.
CHUNK = 100_000


def minute_rollup(entries: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("level") == k).alias(name.lower()) for k, name in enumerate(LEVELS)]
    return entries.groupBy(minute(F.col("ts")).alias("minute")).agg(F.count("*").alias("total"), *counts)


def level_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("level").agg(F.count("*").alias("n"))


def level_counts_with_anomalies(entries: DataFrame, anomalies: DataFrame) -> DataFrame:
    """level, n and anomalies, the count of a table's rows that name the entries by seq."""
    hits = anomalies.filter("seq IS NOT NULL").groupBy("seq").agg(F.count("*").alias("hits"))
    rows = entries.select("seq", "level").join(hits, "seq", "left")
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("anomalies"))


def source_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("level").isin(4, 5)).alias("errors"), F.count_if(F.col("level") == 3).alias("warnings"))


def summary(entries: DataFrame) -> DataFrame:
    return entries.agg(F.min("ts").alias("analysis_start"), F.max("ts").alias("analysis_end"), F.count("*").alias("total_events"), F.count_if(F.col("level").isin(4, 5)).alias("total_errors"), F.count_if(F.col("level") == 3).alias("total_warnings"))


def parse_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(~F.col("malformed")).alias("parsed"), F.count_if("malformed").alias("malformed"))


def carried(rows: DataFrame, value, merge, name: str) -> DataFrame:
    """rows with merge of value over all rows up to their seq: within chunks of seq by a window, and of the chunks
    before by a second window over one row for each chunk."""
    rows = rows.withColumn("_chunk", F.floor(F.col("seq") / CHUNK)).withColumn("_v", value)
    own = Window.partitionBy("_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", merge("_v").over(own))
    last = rows.groupBy("_chunk").agg(F.max_by("_own", "seq").alias("_last"))
    before = merge("_last").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = last.select("_chunk", before.alias("_before"))
    rows = rows.join(before, "_chunk")
    joined = F.greatest("_own", "_before") if merge is F.max else F.coalesce("_own", "_before")
    return rows.withColumn(name, joined).drop("_chunk", "_v", "_own", "_before")


def malformed_by_minute(parsed: DataFrame, now: str = "1970-01-01 00:00:00") -> DataFrame:
    """Malformed lines in the minute of the last parsed line before them; those before any, in the minute of `now`."""
    at = F.when(~F.col("malformed"), minute(F.col("ts")))
    rows = carried(parsed, at, lambda c: F.last(c, ignorenulls=True), "at").filter("malformed")
    return rows.groupBy(F.coalesce("at", F.date_trunc("minute", F.lit(now).cast("timestamp"))).alias("minute")).agg(F.count("*").alias("malformed"))


def full_timeseries(entries: DataFrame, malformed: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """minute_rollup with malformed and anomalies (each minute and its count), 0 where there are none."""
    out = minute_rollup(entries)
    for other, name in ((anomalies, "anomalies"), (malformed, "malformed")):
        if other is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            out = out.join(other.select("minute", F.col(name)), "minute", "full_outer")
    return out.fillna(0)


def message_hashes(entries: DataFrame, p: Params = Params()) -> DataFrame:
    return entries.groupBy(message_hash(F.col("message"), p.hash_words).alias("hash")).agg(F.count("*").alias("n"))


def rare_messages(entries: DataFrame, p: Params = Params()) -> DataFrame:
    return message_hashes(entries, p).filter(F.col("n") < p.min_occurrences)


def source_spikes(entries: DataFrame, p: Params = Params()) -> DataFrame:
    """Sources whose count is over the multiplier times the mean of their last ten running counts, in closed form."""
    counts = entries.groupBy("source").agg(F.count("*").alias("n"))
    mean = F.when(F.col("n") <= 10, (F.col("n") + 1) / 2).otherwise(F.col("n") - 4.5)
    return counts.withColumn("ratio", F.col("n") / mean).filter(F.col("ratio") > p.source_spike_multiplier)


def top(counts: DataFrame, key: str, k: int, by: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(by), key).limit(k)


def ip_counts(entries: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "message", "source")
    return entries.select(F.explode(all_ips(text)).alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))


def minute_uniques(entries: DataFrame) -> DataFrame:
    return entries.groupBy(minute(F.col("ts")).alias("minute")).agg(F.count_distinct("source").alias("unique_sources"), F.count_distinct(first_ip(F.col("message"))).alias("unique_ips"))
