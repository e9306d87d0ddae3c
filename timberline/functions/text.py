"""Text columns: trimming, splitting, normal forms of messages, addresses, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "CRITICAL", "UNKNOWN"]
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
_WHITE = r"[ \t\n\x0B\f\r]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WHITE}+|{_WHITE}+$", "")


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WHITE}+", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, rf"{_WHITE}+$", "")


def iequals(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def starts_with(c: Column, prefix: str, case_sensitive: bool = True) -> Column:
    return F.startswith(c, F.lit(prefix)) if case_sensitive else F.startswith(F.lower(c), F.lit(prefix.lower()))


def ends_with(c: Column, suffix: str, case_sensitive: bool = True) -> Column:
    return F.endswith(c, F.lit(suffix)) if case_sensitive else F.endswith(F.lower(c), F.lit(suffix.lower()))


def split(c: Column, by: str, keep_empty: bool = False) -> Column:
    parts = F.split(c, "\\Q" + by + "\\E")
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def split_and_trim(c: Column, by: str, keep_empty: bool = False) -> Column:
    parts = F.transform(split(c, by, True), trim)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def split_whitespace(c: Column) -> Column:
    return F.filter(F.split(c, rf"{_WHITE}+"), lambda x: x != "")


def join(parts: Column, by: str) -> Column:
    return F.array_join(parts, by)


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def contains(c: Column, needle: str) -> Column:
    return F.contains(c, F.lit(needle))


def parse_integer(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*-?\d+\s*$"), trim(c).try_cast("long"))


def parse_float(c: Column) -> Column:
    return trim(c).try_cast("double")


def fixed(c: Column, places: int) -> Column:
    """With so many decimals, as C and SQL print it: the nearest to the exact binary value, of two equally near the even one.
    Java's %f, and so format_string, takes the upper one."""
    return F.call_function("format_number", c, F.lit("0." + "0" * places))


def escape_csv(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\\r\\n]'), quoted).otherwise(c)


def escape_json(c: Column) -> Column:
    body = F.to_json(F.struct(c.alias("v")))
    return F.regexp_extract(body, r'(?s)^\{"v":"(.*)"\}$', 1)


def message_hash(message: Column, words: int = 3) -> Column:
    """First words in upper case, or EMPTY."""
    out = F.upper(F.array_join(F.slice(split_whitespace(message), 1, words), " "))
    return F.when(out == "", F.lit("EMPTY")).otherwise(out)


def normalize_message(message: Column) -> Column:
    """Lower case; hexadecimal ids and numbers as marks; single spaces."""
    out = F.regexp_replace(F.lower(message), "[0-9a-f]{8,}", "<id>")
    out = F.regexp_replace(out, r"\b\d+\b", "<n>")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalize_error(message: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(message, r"\b\d+\b", "0"), r"\s+", " "))


def burst_signature(source: Column, level: Column, message: Column) -> Column:
    return F.concat_ws("|", F.coalesce(source, F.lit("unknown")), level.cast("string"), normalize_message(message))


def first_ip(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, IP, 0), F.lit(""))


def all_ips(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IP), F.lit(0))


def pattern_token(source: Column, level: Column, message: Column) -> Column:
    """source:level:prefix, where prefix is the first three words, at most 20 bytes; a character that the cut parts is
    the replacement character, as strings are whole characters here."""
    words = F.filter(F.transform(F.split(message, " "), trim), lambda x: x != "")
    joined = F.array_join(F.slice(words, 1, 3), " ")
    prefix = F.when(F.octet_length(joined) <= 20, joined).otherwise(F.decode(F.substring(joined.cast("binary"), 1, 20), "UTF-8"))
    return F.concat_ws(":", F.coalesce(source, F.lit("")), level.cast("string"), prefix)


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


def safe_title(c: Column, most: int = 60) -> Column:
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)
