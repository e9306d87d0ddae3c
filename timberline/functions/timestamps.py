"""Timestamps: 19 characters with any separators and fields that may run over, and conversions. Times are UTC."""

from __future__ import annotations

from contextlib import contextmanager
from time import monotonic

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELDS = r"^(\d{4}).(\d{2}).(\d{2}).(\d{2}).(\d{2}).(\d{2})"


def parse_seconds(c: Column) -> Column:
    """Seconds since the epoch of YYYY?MM?DD?HH?MM?SS at the start; months, days and hours over their range carry."""
    y, mo, d, h, mi, s = (F.regexp_extract(c, _FIELDS, k).try_cast("int") for k in range(1, 7))
    month = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1)
    days = F.unix_date(month).cast("long") + d - 1
    return F.when(c.rlike(_FIELDS), days * 86400 + h * 3600 + mi * 60 + s)


def parse_timestamp(c: Column) -> Column:
    return F.timestamp_seconds(parse_seconds(c))


def parse_unix_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c.try_cast("long"))


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def diff_millis(start: Column, end: Column) -> Column:
    return millis(end) - millis(start)


def diff_seconds(start: Column, end: Column) -> Column:
    return F.floor(diff_millis(start, end) / 1000)


def in_window(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


@contextmanager
def timed(name: str, told=print):
    """Tells the milliseconds that the block took."""
    start = monotonic()
    try:
        yield
    finally:
        told(f"{name}: {(monotonic() - start) * 1000:.0f} ms")
