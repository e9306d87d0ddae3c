"""Where log rows come from: text files, the events table, exported CSV files, key=value settings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions.text import level_name
from timberline.operators.parsing import parse_lines


#: Bits of seq for a line's place in its part of a file; the part's place takes those above.
_LINE_BITS = 33


def read_lines(spark: SparkSession, path: str, strip_cr: bool = False) -> DataFrame:
    """value and seq of the non-empty lines. seq ascends by file name, by part of a file, and by line in it; lines of a
    part are read in order by one task, whatever files its task holds besides."""
    rows = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    rows = rows.withColumn("_key", F.xxhash64("_file", "_start"))
    value = F.regexp_replace("value", "\r$", "") if strip_cr else F.col("value")
    # one row of numbers for each part of a file (some 128 MB): its first line's number, and its place among all parts
    parts = rows.groupBy("_file", "_start", "_key").agg(F.min("_id").alias("_first"))
    parts = parts.select("_key", "_first", (F.row_number().over(Window.orderBy("_file", "_start")) - 1).alias("_part"))
    rows = rows.join(F.broadcast(parts), "_key")
    seq = F.shiftleft(F.col("_part").cast("long"), _LINE_BITS) + F.col("_id") - F.col("_first")
    return rows.select(value.alias("value"), seq.alias("seq")).filter(F.length("value") > 0)


def read_logs(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_lines(read_lines(spark, path), **options)


def log_entries(events: DataFrame) -> DataFrame:
    """The events table as log rows: seq, ts, ts_sec, level, level_name, source, message."""
    kind = F.col("event_type")
    level = F.when(kind == "error", 4).when(kind == "signup", 3).when(kind == "purchase", 2).when(kind == "click", 1).otherwise(0)
    user = F.col("user_id")
    message = F.concat(kind, F.lit(" user "), user, F.lit(" from 10.0."), F.floor(user / 256), F.lit("."), user % 256)
    rows = events.select(F.col("event_id").alias("seq"), F.date_trunc("second", "ts").alias("ts"), level.alias("level"), F.concat(F.lit("svc-"), user % 8).alias("source"), message.alias("message"))
    return rows.select("seq", "ts", F.unix_timestamp("ts").alias("ts_sec"), "level", level_name(F.col("level")).alias("level_name"), "source", "message")


def raw_lines(entries: DataFrame) -> DataFrame:
    """Entries written out as lines of all kinds: every seventh broken, of the others every third JSON."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    as_json = F.concat(F.lit('{"timestamp":"'), stamp, F.lit('","level":"'), "level_name", F.lit('","service":"'), "source", F.lit('","message":"'), "message", F.lit('"}'))
    as_text = F.concat(stamp, F.lit(" "), "level_name", F.lit(" ["), "source", F.lit("] "), "message")
    value = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("broken "), "message")).when(F.col("seq") % 3 == 0, as_json).otherwise(as_text)
    return entries.select("seq", value.alias("value"))


def read_timeseries(spark: SparkSession, path: str) -> DataFrame:
    """An exported per-minute file: bad times dropped, bad numbers 0, in order of time."""
    rows = spark.read.csv(path, header=True)
    numbers = {c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)) for c in rows.columns if c != "minute_iso"}
    minute = F.try_to_timestamp("minute_iso", F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return rows.withColumns(numbers | {"minute": minute}).filter("minute IS NOT NULL").drop("minute_iso").orderBy("minute")


_ENTRY_COLUMNS = "timestamp_iso string, level string, source string, message string"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Exported entries with their times; a missing file holds none."""
    try:
        rows = spark.read.csv(path, header=True, quote='"', escape="\\", multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _ENTRY_COLUMNS)
    return rows.withColumn("ts", F.try_to_timestamp("timestamp_iso", F.lit("yyyy-MM-dd'T'HH:mm:ss"))).filter("ts IS NOT NULL")


def read_settings(text: str) -> dict[str, str]:
    """key = value lines; # and ; begin comments; the first = splits; the last of equal keys counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#;" and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if key:
                out[key] = value
    return out


class Settings:
    """Typed reading of settings; None or the default where a value is missing or of another kind."""

    def __init__(self, values: dict[str, str]):
        self.values = dict(values)

    def string(self, key: str, default: str | None = None) -> str | None:
        return self.values.get(key, default)

    def _as(self, key: str, kind, default):
        try:
            return kind(self.values[key])
        except (KeyError, ValueError):
            return default

    def integer(self, key: str, default: int | None = None) -> int | None:
        return self._as(key, int, default)

    def number(self, key: str, default: float | None = None) -> float | None:
        return self._as(key, float, default)

    def boolean(self, key: str, default: bool | None = None) -> bool | None:
        known = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}
        return known.get(self.values.get(key, "").lower(), default)
