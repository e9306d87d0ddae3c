"""Registered queries of the log engine over the driver's tables, each with the DuckDB SQL that has the same rows.

All read the log view of the events table (sources.logs.log_entries). Events lie days apart there, so detectors run with
windows sixty times the defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import text as tx
from timberline.functions import timestamps as dt
from timberline.operators import anomalies as an
from timberline.operators import dashboard as db
from timberline.operators import detectors as dx
from timberline.operators import ngrams as ng
from timberline.operators import rollups as ru
from timberline.operators.parsing import parse_lines
from timberline.operators.rules import Rule, RuleSet
from timberline.params import Params
from timberline.sources.logs import log_entries, raw_lines

WIDE = Params(spike_short=3600, spike_baseline=36000, rate_window=36000, window_seconds=3600, error_rate=0.4, window_burst=20, window_history=200, burst_seconds=864000, burst_repeats=4, silence_seconds=600, gap_minutes=5)

E = """WITH e AS (SELECT event_id AS seq, date_trunc('second', ts) AS ts, CAST(floor(epoch(ts)) AS BIGINT) AS ts_sec,
CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS level,
'svc-' || (user_id % 8) AS source, event_type || ' user ' || user_id || ' from 10.0.' || (user_id // 256) || '.' || (user_id % 256) AS message FROM events)"""
_M = "date_trunc('minute', ts)"
_NAMES = [x.lower() for x in tx.LEVELS]
_LEVEL_COUNTS = ", ".join(f"count(*) FILTER (level = {k}) AS {n}" for k, n in enumerate(_NAMES))
_SERIES = f"s AS (SELECT {_M} AS minute, count(*) AS total, {_LEVEL_COUNTS} FROM e GROUP BY 1)"
#: The series of the dashboard: without a last minute whose entries end before its 50th second.
_PARTIAL = "(minute = (SELECT max(minute) FROM s0) AND epoch((SELECT max(ts) FROM e)) - epoch((SELECT max(minute) FROM s0)) < 50)"
_DASH = f"s0 AS (SELECT {_M} AS minute, count(*) AS total, {_LEVEL_COUNTS} FROM e GROUP BY 1), s AS (SELECT * FROM s0 WHERE NOT {_PARTIAL})"
_LEVEL_NAME = "CASE level WHEN 0 THEN 'TRACE' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN' WHEN 4 THEN 'ERROR' ELSE 'UNKNOWN' END"
_HASH = "upper(array_to_string(list_filter(string_split(message, ' '), lambda x: x <> '')[1:3], ' '))"
_IP = r"'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'"
_TOKEN = "source || ':' || level || ':' || substr(array_to_string(list_filter(string_split(message, ' '), lambda x: x <> '')[1:3], ' '), 1, 20)"
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(message), '[0-9a-f]{8,}', '<id>', 'g'), '\b\d+\b', '<n>', 'g'), '\s+', ' ', 'g'))"


def _recent(seconds: int) -> str:
    return f"(row_number() OVER (PARTITION BY source ORDER BY ts_sec, seq) - count(*) OVER (PARTITION BY source ORDER BY ts_sec RANGE BETWEEN UNBOUNDED PRECEDING AND {seconds + 1} PRECEDING))"


_SPIKES = f"c AS (SELECT *, {_recent(3600)} AS short, {_recent(36000)} AS baseline FROM e), r AS (SELECT *, (short / 3600.0) / (baseline / 36000.0) AS ratio FROM c)"
_RATES = f"""c AS (SELECT *, {_recent(36000)} AS recent, min(ts_sec) OVER (PARTITION BY source ORDER BY ts_sec RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS first FROM e),
q AS (SELECT *, CASE WHEN recent < 2 THEN recent * 60 / 36000.0 ELSE recent / greatest(1e-6, greatest(1, ts_sec - first) / 60.0) END AS rate FROM c),
w AS (SELECT *, count(*) OVER o AS n, avg(rate) OVER o AS mean, stddev_samp(rate) OVER o AS sigma, avg(rate) OVER (PARTITION BY source ORDER BY ts_sec, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS ma FROM q WINDOW o AS (PARTITION BY source ORDER BY ts_sec, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
z AS (SELECT *, CASE WHEN n < 10 OR coalesce(sigma, 0) < 1e-9 THEN 0.0 ELSE (rate - mean) / sigma END AS z FROM w)"""
_WINDOWS = """f AS (SELECT arg_min(ts_sec, seq) AS start FROM e), i AS (SELECT e.*, start, CAST(floor((ts_sec - start) / 3600.0) AS BIGINT) AS idx FROM e, f),
k AS (SELECT *, max(idx) OVER (ORDER BY seq) AS reached FROM i), t AS (SELECT idx, start, count(*) AS total, count(*) FILTER (level IN (4, 5)) AS errors FROM k WHERE idx >= reached GROUP BY 1, 2),
u AS (SELECT idx, start + idx * 3600 AS start_sec, total, errors, errors / total AS error_rate FROM t WHERE idx >= (SELECT max(idx) FROM t) - 200)"""
_LINES = f"""l AS (SELECT seq, ts, ts_sec, level, source, message, seq % 7 = 0 AS malformed, seq % 7 <> 0 AND seq % 3 = 0 AS was_json FROM e)"""

#: Each signature's rows one after another: what its window holds (seconds and seq), and whether it has reached the repeats.
_BURSTS = f"""WITH RECURSIVE {E.removeprefix("WITH ")}, s1 AS (SELECT seq, ts_sec, source, source || '|' || level || '|' || {_NORMAL} AS signature FROM e),
s2 AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY seq) AS k FROM s1),
f AS (SELECT signature, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS ts_sec, CAST(NULL AS VARCHAR) AS source, CAST([] AS STRUCT(t BIGINT, q BIGINT)[]) AS held FROM s2 WHERE k = 1
UNION ALL SELECT s2.signature, s2.k, s2.seq, s2.ts_sec, s2.source, list_append(list_filter(CASE WHEN len(held) > 4 THEN held[-2:] ELSE held END, lambda x: s2.ts_sec - x.t <= 864000), {{'t': s2.ts_sec, 'q': s2.seq}})
FROM f JOIN s2 ON s2.signature = f.signature AND s2.k = f.k + 1),
b AS (SELECT seq, ts_sec, source, signature, CAST(len(held) AS INTEGER) AS n, held[1].t AS first_sec, held[-1].t AS last_sec, array_to_string(list_transform(held[-5:], lambda x: x.q), ',') AS samples FROM f WHERE len(held) >= 4)"""
_ONLINE = f"""{_BURSTS}, {_SPIKES}, {_RATES.replace("c AS", "c2 AS").replace("FROM c)", "FROM c2)")}, ips AS (SELECT *, regexp_extract(message, {_IP}) AS ip FROM e),
online AS (SELECT seq, 0 AS step, 'spike' AS detector, 0 AS type, 3 AS severity, ratio AS score, source, ts_sec - 3600 AS window_start, ts_sec AS window_end, printf('Spike detected: %s (%d events in 3600s, %.1fx baseline, ROC=0.00', source, short, ratio) AS description
FROM r WHERE ratio > 3 AND short >= 5 AND baseline >= 10
UNION ALL SELECT seq, 1, 'statistical', 2, 2, z, source, ts_sec, ts_sec, printf('Statistical anomaly detected (Z=%.2f): %s event rate deviation %.2fσ from mean μ=%.1f σ=%.1f', z, source, abs(z), mean, sigma) FROM z WHERE abs(z) > 3
UNION ALL SELECT seq, 2, 'burst', 3, 2, n, source, first_sec, last_sec, printf('Burst repetition detected: %d repeats within 864000s', n) FROM b
UNION ALL SELECT seq, 3, 'rare_ip', 1, 0, 1.0, source, ts_sec, ts_sec, printf('Rare IP observed (count=%d): %s', occurrence, ip) FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY seq) AS occurrence FROM ips WHERE ip <> '') WHERE occurrence <= 5)"""
_NGRAMS = f"""t AS (SELECT row_number() OVER (ORDER BY seq) AS pos, ts_sec, {_TOKEN} AS token FROM e), a AS (SELECT pos, (SELECT count(*) FROM t) AS N, list(token) OVER w AS tokens, list(ts_sec) OVER w AS secs FROM t WINDOW w AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), x AS (SELECT *, unnest([2, 3, 4]) AS length FROM a),
g AS (SELECT array_to_string(tokens[1:length], '->') AS pattern, length, CAST(sum(least(N - pos - length + 2, 5 - length)) AS BIGINT) AS freq, min(secs[length]) AS first_seen, max(secs[len(secs)]) AS last_seen FROM x WHERE length <= len(tokens) GROUP BY 1, 2)"""


def _entries(spark, d):
    return log_entries(spark.read.parquet(f"{d}/events.parquet"))


def _series(spark, d):
    return ru.minute_rollup(_entries(spark, d))


def _dash(spark, d):
    return db.drop_partial_minute(_series(spark, d), _entries(spark, d))


def _parsed(spark, d):
    return parse_lines(raw_lines(_entries(spark, d)))


def _all_anomalies(spark, d):
    parsed = _parsed(spark, d).persist()
    entries = _entries(spark, d).join(parsed.filter("NOT malformed").select("seq"), "seq", "left_semi").persist()
    return an.all_anomalies(entries, parsed, WIDE)


def _gaps(column: str) -> str:
    return f"""{E}, {_DASH}, g AS (SELECT minute, CAST({column} AS DOUBLE) AS {column}, lag(minute) OVER (ORDER BY minute) AS before FROM s)
SELECT minute, {column} FROM g UNION ALL SELECT before + INTERVAL 1 MINUTE, NULL FROM g WHERE epoch(minute) - epoch(before) > 300"""


def _string_columns(entries):
    return entries.select(
        "seq",
        tx.trim(F.concat(F.lit(" \t"), "message", F.lit("\n "))).alias("trimmed"),
        tx.replace_all(F.col("message"), "user", "account").alias("replaced"),
        tx.starts_with(F.col("message"), "ERR", False).alias("starts"),
        tx.ends_with(F.col("message"), "1").alias("ends"),
        F.size(tx.split_whitespace(F.col("message"))).cast("long").alias("words"),
        tx.join(tx.split(F.col("message"), " "), "|").alias("joined"),
        tx.escape_csv(F.concat("message", F.lit(',"x"'))).alias("csv"),
    )


def _text_columns(entries):
    word = F.get(tx.split_whitespace(F.col("message")), 2)
    return entries.select(
        "seq",
        tx.ltrim(F.concat(F.lit(" \t"), "message")).alias("left_trimmed"),
        tx.rtrim(F.concat("message", F.lit("\n "))).alias("right_trimmed"),
        tx.iequals(F.col("source"), F.upper("source")).alias("same"),
        tx.join(tx.split_and_trim(F.concat("source", F.lit(" , ,"), "message"), ","), "|").alias("pieces"),
        tx.parse_integer(F.concat(F.lit(" "), word)).alias("number"),
        tx.parse_float(F.concat(word, F.lit(".5"))).alias("fraction"),
        tx.parse_integer(F.col("source")).alias("no_number"),
        tx.escape_json(F.concat("message", F.lit('"\n'))).alias("json"),
        tx.safe_title(F.col("message"), 12).alias("title"),
        tx.pattern_token(F.col("source"), F.col("level"), F.col("message")).alias("token"),
    )


def _joined(df, name):
    return df.withColumn(name, F.array_join(F.col(name).cast("array<string>"), ","))


def _rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


_RULES = (
    Rule("purchases", "purchases", "KEYWORD", "purchase", 0.9, "HIGH"),
    Rule("errors", "errors", "LEVEL", "4", 0.7, "CRITICAL"),
    Rule("one", "one", "SOURCE", "SVC-3", 0.5, "LOW"),
    Rule("named", "named", "LEVEL", "ERROR", 0.5, "LOW"),
    Rule("busy", "busy", "THRESHOLD", "", 0.6, "MEDIUM", frequency=40, seconds=7200),
)

#: name -> (query, SQL or None)
QUERIES = {
    "log_entries": (
        lambda s, d: _entries(s, d).select("seq", "ts", "ts_sec", "level", "level_name", "source", "message"),
        f"{E} SELECT seq, ts, ts_sec, level, {_LEVEL_NAME} AS level_name, source, message FROM e",
    ),
    "minute_rollup": (_series, f"{E}, {_SERIES} SELECT * FROM s"),
    "level_counts": (lambda s, d: ru.level_counts(_entries(s, d)), f"{E} SELECT level, count(*) AS n FROM e GROUP BY 1"),
    "source_stats": (
        lambda s, d: ru.source_stats(_entries(s, d)),
        f"""{E}
SELECT source, count(*) AS total, count(*) FILTER (level IN (4, 5)) AS errors, count(*) FILTER (level = 3) AS warnings FROM e
GROUP BY 1""",
    ),
    "summary": (
        lambda s, d: ru.summary(_entries(s, d)),
        f"""{E}
SELECT min(ts) AS analysis_start, max(ts) AS analysis_end, count(*) AS total_events, count(*) FILTER (level IN (4, 5)) AS total_errors, count(*) FILTER (level = 3) AS total_warnings
FROM e""",
    ),
    "message_hashes": (lambda s, d: ru.message_hashes(_entries(s, d)), f"{E} SELECT {_HASH} AS hash, count(*) AS n FROM e GROUP BY 1"),
    "rare_messages": (
        lambda s, d: ru.rare_messages(_entries(s, d)),
        f"{E} SELECT {_HASH} AS hash, count(*) AS n FROM e GROUP BY 1 HAVING count(*) < 2",
    ),
    "source_spikes": (
        lambda s, d: _rounded(ru.source_spikes(_entries(s, d), Params(source_spike_multiplier=1.0)), "ratio"),
        f"""{E},
c AS (SELECT source, count(*) AS n FROM e GROUP BY 1)
SELECT source, n, round(n / (CASE WHEN n <= 10 THEN (n + 1) / 2.0 ELSE n - 4.5 END), 6) AS ratio FROM c
WHERE n / (CASE WHEN n <= 10 THEN (n + 1) / 2.0 ELSE n - 4.5 END) > 1""",
    ),
    "parse_lines": (
        lambda s, d: _parsed(s, d).select("seq", "was_json", "malformed", "error", "ts", "level", "source", "message"),
        f"""{E}, {_LINES} SELECT seq, was_json, malformed, CASE WHEN malformed THEN 'No matching pattern' END AS error, CASE WHEN NOT malformed THEN ts END AS ts, CASE WHEN NOT malformed THEN level END AS level, CASE WHEN NOT malformed THEN source END AS source, CASE WHEN NOT malformed THEN message END AS message
FROM l""",
    ),
    "parse_counts": (
        lambda s, d: ru.parse_counts(_parsed(s, d)),
        f"""{E}, {_LINES} SELECT count(*) FILTER (NOT malformed) AS parsed, count(*) FILTER (malformed) AS malformed FROM l""",
    ),
    "malformed_by_minute": (
        lambda s, d: ru.malformed_by_minute(_parsed(s, d)),
        f"""{E}, {_LINES},
m AS (SELECT malformed, last_value(CASE WHEN NOT malformed THEN {_M} END IGNORE NULLS) OVER (ORDER BY seq) AS carried FROM l)
SELECT coalesce(carried, TIMESTAMP '1970-01-01') AS minute, count(*) AS malformed FROM m WHERE malformed GROUP BY 1""",
    ),
    "spikes": (
        lambda s, d: _rounded(dx.spikes(_entries(s, d), WIDE).select("seq", "source", "short", "baseline", "ratio", "severity_score"), "ratio", "severity_score"),
        f"""{E}, {_SPIKES} SELECT seq, source, short, baseline, round(ratio, 6) AS ratio, round(least(1.0, (ratio - 1) / 2), 6) AS severity_score
FROM r WHERE ratio > 3 AND short >= 5 AND baseline >= 10""",
    ),
    "spike_counts": (
        lambda s, d: dx.spike_counts(_entries(s, d), WIDE).select("seq", "short", "baseline"),
        f"{E}, {_SPIKES} SELECT seq, short, baseline FROM r",
    ),
    "spike_status": (
        lambda s, d: _rounded(dx.spike_status(_entries(s, d), WIDE), "ratio"),
        f"""{E}, {_SPIKES} SELECT source, short, baseline, round(ratio, 6) AS ratio FROM r QUALIFY row_number() OVER (PARTITION BY source
ORDER BY ts_sec DESC, seq DESC) = 1""",
    ),
    "rates": (
        lambda s, d: _rounded(dx.rates(_entries(s, d), WIDE).select("seq", "recent", "rate", "mean", "z", "moving_average"), "rate", "mean", "z", "moving_average"),
        f"""{E}, {_RATES} SELECT seq, recent, round(rate, 6) AS rate, round(mean, 6) AS mean, round(z, 6) AS z, round(ma, 6) AS moving_average
FROM z""",
    ),
    "rate_outliers": (
        lambda s, d: _rounded(dx.rate_outliers(_entries(s, d), WIDE).select("seq", "source", "rate", "z"), "rate", "z"),
        f"{E}, {_RATES} SELECT seq, source, round(rate, 6) AS rate, round(z, 6) AS z FROM z WHERE abs(z) > 3",
    ),
    "rate_status": (
        lambda s, d: _rounded(dx.rate_status(_entries(s, d), WIDE, everywhere=True), "mean", "sigma"),
        f"""{E}, {_RATES} SELECT source, count(*) AS n, round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS sigma FROM z
GROUP BY ROLLUP (source)""",
    ),
    "rare_ips": (
        lambda s, d: dx.rare_ips(_entries(s, d)).select("seq", "ip", "occurrence"),
        f"""{E},
i AS (SELECT seq, regexp_extract(message, {_IP}) AS ip FROM e)
SELECT seq, ip, row_number() OVER (PARTITION BY ip ORDER BY seq) AS occurrence FROM i WHERE ip <> '' QUALIFY occurrence <= 5""",
    ),
    "tumbling": (
        lambda s, d: _rounded(dx.tumbling(_entries(s, d), WIDE), "error_rate"),
        f"{E}, {_WINDOWS} SELECT idx, start_sec, total, errors, round(error_rate, 6) AS error_rate FROM u",
    ),
    "tumbling_sources": (
        lambda s, d: dx.tumbling_sources(_entries(s, d), WIDE).select("idx", F.explode("events_by_source").alias("source", "n")),
        f"""{E}, {_WINDOWS} SELECT idx, source, count(*) AS n FROM k WHERE idx >= reached AND idx >= (SELECT max(idx) FROM t) - 200
GROUP BY 1, 2""",
    ),
    "window_anomalies": (
        lambda s, d: dx.window_anomalies(_entries(s, d), WIDE).select("idx", "kind", F.round("score", 6).alias("score")),
        f"""{E}, {_WINDOWS} SELECT idx, 'error_spike' AS kind, round(least(1.0, error_rate * 2), 6) AS score FROM u WHERE error_rate > 0.4
UNION ALL SELECT idx, 'event_burst', 1.0 FROM u WHERE total > 20""",
    ),
    "silences": (
        lambda s, d: dx.silences(_entries(s, d), WIDE),
        f"""{E},
g AS (SELECT ts_sec, lag(ts_sec) OVER (ORDER BY ts_sec) AS before FROM (SELECT DISTINCT ts_sec FROM e))
SELECT before, ts_sec, ts_sec - before AS silent FROM g WHERE ts_sec - before > 600""",
    ),
    "ngrams": (lambda s, d: ng.ngram_counts(_entries(s, d), Params(ngram_window=4)), f"{E}, {_NGRAMS} SELECT * FROM g"),
    "ngrams_whole_window": (lambda s, d: ng.ngram_counts(_entries(s, d)), None),
    "rule_matches": (
        lambda s, d: RuleSet(_RULES).matches(_entries(s, d)).select("seq", "rule_id", "score", "priority"),
        f"""{E}, n AS (SELECT *, row_number() OVER (PARTITION BY ts_sec ORDER BY seq) + coalesce(count(*) OVER (ORDER BY ts_sec RANGE BETWEEN 7200 PRECEDING AND 1 PRECEDING), 0) AS seen FROM e)
SELECT seq, 'errors' AS rule_id, 0.7 AS score, 'CRITICAL' AS priority FROM n WHERE level = 4 UNION ALL SELECT seq, 'purchases', 0.9, 'HIGH' FROM n WHERE contains(upper(message), 'PURCHASE') UNION ALL SELECT seq, 'busy', 0.6, 'MEDIUM' FROM n WHERE least(seen, 1000) >= 40 UNION ALL SELECT seq, 'one', 0.5, 'LOW' FROM n WHERE lower(source) = 'svc-3'""",
    ),
    "rule_statistics": (
        lambda s, d: RuleSet(_RULES[:3]).statistics(_entries(s, d)),
        f"""{E}
SELECT 'errors' AS rule_id, count(*) AS matches FROM e WHERE level = 4 UNION ALL SELECT 'purchases', count(*) FROM e
WHERE contains(message, 'purchase') UNION ALL SELECT 'one', count(*) FROM e WHERE source = 'svc-3'""",
    ),
    "g01_log_volume": (lambda s, d: db.log_volume(_dash(s, d), WIDE), _gaps("total")),
    "g02_error_rate": (lambda s, d: db.error_rate(_dash(s, d), WIDE), _gaps("error")),
    "g03_level_areas": (lambda s, d: db.level_areas(_dash(s, d)), f"{E}, {_DASH} SELECT minute, {', '.join(_NAMES)} FROM s"),
    "g04_moving_average": (
        lambda s, d: _rounded(db.moving_average(_dash(s, d)), "moving_average"),
        f"""{E}, {_DASH} SELECT minute, total, round(avg(total) OVER (ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving_average
FROM s""",
    ),
    "g05_zscores": (
        lambda s, d: _rounded(db.zscores(_dash(s, d)), "z"),
        f"""{E}, {_DASH},
o AS (SELECT avg(total) AS mu, stddev_pop(total) AS sigma FROM s)
SELECT minute, total, round((total - mu) / sigma, 6) AS z, abs((total - mu) / sigma) >= 3 AS breach FROM s, o""",
    ),
    "g06_level_distribution": (
        lambda s, d: db.level_distribution(_entries(s, d)),
        f"{E} SELECT {_LEVEL_NAME} AS level_name, count(*) AS n FROM e GROUP BY 1",
    ),
    "g06_level_totals": (
        lambda s, d: db.level_totals(_series(s, d)),
        f"{E}, {_SERIES}, t AS (SELECT " + ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in _NAMES) + " FROM s) " + " UNION ALL ".join(f"SELECT '{n.upper()}' AS level_name, {n} AS n FROM t" for n in _NAMES),
    ),
    "g07_service_activity": (
        lambda s, d: db.service_activity(_entries(s, d)),
        f"{E} SELECT source, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, source LIMIT 15",
    ),
    "g08_top_errors": (
        lambda s, d: db.top_errors(_entries(s, d)),
        f"{E} SELECT " + r"trim(regexp_replace(regexp_replace(message, '\b\d+\b', '0', 'g'), '\s+', ' ', 'g'))" + " AS message, count(*) AS n FROM e WHERE level IN (4, 5) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    ),
    "g09_top_ips": (
        lambda s, d: db.top_ips(_entries(s, d)),
        f"""{E}
SELECT ip, count(*) AS n FROM (SELECT unnest(regexp_extract_all(message || ' ' || source, {_IP})) AS ip FROM e) GROUP BY 1
ORDER BY n DESC, ip LIMIT 15""",
    ),
    "g10_heatmap": (
        lambda s, d: db.heatmap(_dash(s, d)),
        f"{E}, {_DASH} " + " UNION ALL ".join(f"SELECT minute, '{n}' AS level_name, {n} AS n FROM s" for n in _NAMES),
    ),
    "g11_service_correlation": (
        lambda s, d: _rounded(db.service_correlation(_entries(s, d)), "correlation"),
        f"""{E},
m AS (SELECT DISTINCT {_M} AS minute FROM e),
v AS (SELECT DISTINCT source FROM e),
g AS (SELECT m.minute, v.source, coalesce(n, 0) AS n FROM m CROSS JOIN v LEFT JOIN (SELECT {_M} AS minute, source, count(*) AS n
FROM e GROUP BY 1, 2) c ON c.minute = m.minute AND c.source = v.source)
SELECT x.source AS a, y.source AS b, round(corr(x.n, y.n), 6) AS correlation FROM g x JOIN g y USING (minute) GROUP BY 1, 2""",
    ),
    "minute_by_service": (
        lambda s, d: db.minute_by_service(_entries(s, d)),
        f"{E} SELECT {_M} AS minute, " + ", ".join(f"count(*) FILTER (source = 'svc-{k}') AS \"svc-{k}\"" for k in range(8)) + " FROM e GROUP BY 1",
    ),
    "rule_totals": (
        lambda s, d: RuleSet(_RULES[:3]).totals(_entries(s, d)),
        f"""{E},
m AS (SELECT seq FROM e WHERE level = 4 UNION ALL SELECT seq FROM e WHERE contains(message, 'purchase') UNION ALL SELECT seq
FROM e WHERE source = 'svc-3')
SELECT 3 AS rules, (SELECT count(*) FROM e) AS checked, (SELECT count(*) * 3
FROM e) AS evaluations, count(*) AS matches, count(DISTINCT seq) AS matched_entries FROM m""",
    ),
    "g12_minute_features": (
        lambda s, d: db.minute_features(_entries(s, d)),
        f"""{E}, {_DASH},
q AS (SELECT {_M} AS minute, count(DISTINCT source) AS unique_sources, count(DISTINCT regexp_extract(message, {_IP})) AS unique_ips
FROM e GROUP BY 1)
SELECT * FROM s JOIN q USING (minute)""",
    ),
    "g12_isolation_forest": (lambda s, d: db.isolation_forest(_entries(s, d)), None),
    "drop_partial_minute": (lambda s, d: _dash(s, d).select("minute", "total"), f"{E}, {_DASH} SELECT minute, total FROM s"),
    "bursts": (
        lambda s, d: _joined(dx.bursts(_entries(s, d), WIDE), "samples"),
        f"{_BURSTS} SELECT seq, ts_sec, source, signature, n, first_sec, last_sec, samples FROM b",
    ),
    "burst_signatures": (
        lambda s, d: _entries(s, d).groupBy(tx.burst_signature(F.col("source"), F.col("level"), F.col("message")).alias("signature")).agg(F.count("*").alias("n")),
        f"{E} SELECT source || '|' || level || '|' || {_NORMAL} AS signature, count(*) AS n FROM e GROUP BY 1",
    ),
    "online_anomalies": (
        lambda s, d: dx.online_anomalies(_entries(s, d), WIDE).withColumn("score", F.round("score", 6)),
        _ONLINE + " SELECT seq, step, detector, type, severity, round(score, 6) AS score, source, window_start, window_end, description FROM online",
    ),
    "all_anomalies": (lambda s, d: _all_anomalies(s, d).withColumn("score", F.round("score", 6)), None),
    "ngram_summary": (lambda s, d: ng.ngram_summary(ng.ngram_counts(_entries(s, d))), None),
    "ngram_novelties": (lambda s, d: ng.ngram_novelties(ng.ngram_counts(_entries(s, d))), None),
    "top_patterns": (
        lambda s, d: ng.top_patterns(ng.ngram_counts(_entries(s, d), Params(ngram_window=4))),
        f"{E}, {_NGRAMS} SELECT pattern, length, freq FROM g ORDER BY freq DESC, pattern LIMIT 10",
    ),
    "ngram_examples": (
        lambda s, d: _joined(ng.ngram_examples(_entries(s, d), ng.top_patterns(ng.ngram_counts(_entries(s, d), Params(ngram_window=4))), Params(ngram_window=4)), "examples"),
        None,
    ),
    "top_anomalies": (
        lambda s, d: dx.ranked(_all_anomalies(s, d)).select("seq", "detector", "severity", F.round("score", 6).alias("score"), "window_start", "window_end"),
        None,
    ),
    "anomalies_by_minute": (
        lambda s, d: dx.anomalies_by_minute(dx.online_anomalies(_entries(s, d), WIDE)),
        _ONLINE + " SELECT date_trunc('minute', to_timestamp(window_end) AT TIME ZONE 'UTC') AS minute, count(*) AS anomalies FROM online GROUP BY 1",
    ),
    "top_online_anomalies": (
        lambda s, d: dx.ranked(dx.online_anomalies(_entries(s, d), WIDE)).withColumn("score", F.round("score", 6)).drop("step", "type"),
        _ONLINE + " SELECT seq, detector, severity, round(score, 6) AS score, source, window_start, window_end, description FROM online ORDER BY severity DESC, online.score DESC, window_end DESC, description, seq, detector LIMIT 100",
    ),
    "level_counts_with_anomalies": (
        lambda s, d: ru.level_counts_with_anomalies(_entries(s, d), dx.online_anomalies(_entries(s, d), WIDE)),
        _ONLINE + ", h AS (SELECT seq, count(*) AS hits FROM online GROUP BY 1) SELECT level, count(*) AS n, CAST(coalesce(sum(hits), 0) AS BIGINT) AS anomalies FROM e LEFT JOIN h USING (seq) GROUP BY 1",
    ),
    "document_ips": (
        lambda s, d: ru.ip_counts(s.read.parquet(f"{d}/documents.parquet").select(F.col("text").alias("message"), "source")),
        f"""SELECT ip, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text || ' ' || source, {_IP})) AS ip FROM documents) GROUP BY 1""",
    ),
    "string_functions": (
        lambda s, d: _string_columns(_entries(s, d)),
        f"""{E} SELECT seq, message AS trimmed, replace(message, 'user', 'account') AS replaced, starts_with(lower(message), 'err') AS starts, ends_with(message, '1') AS ends, CAST(len(string_split(message, ' ')) AS BIGINT) AS words, replace(message, ' ', '|') AS joined, '"' || message || ',""x""' || '"' AS csv FROM e""",
    ),
    "more_string_functions": (
        lambda s, d: _text_columns(_entries(s, d)),
        f"""{E}, w AS (SELECT *, string_split(message, ' ')[3] AS word FROM e)
SELECT seq, message AS left_trimmed, message AS right_trimmed, true AS same, source || '|' || message AS pieces, CAST(word AS BIGINT) AS number, CAST(word AS DOUBLE) + 0.5 AS fraction, NULL::BIGINT AS no_number,
message || '\\"\\n' AS json, CASE WHEN length(message) > 12 THEN substr(message, 1, 11) || '…' ELSE message END AS title, source || ':' || level || ':' || substr(array_to_string(string_split(message, ' ')[1:3], ' '), 1, 20) AS token FROM w""",
    ),
    "time_functions": (
        lambda s, d: _entries(s, d).select("seq", dt.iso8601(F.col("ts")).alias("iso"), dt.parse_seconds(dt.iso8601(F.col("ts"))).alias("parsed"), dt.millis(F.col("ts")).alias("millis"), dt.minute(F.col("ts")).alias("minute"), dt.in_window(F.col("ts"), dt.minute(F.col("ts")), F.col("ts")).alias("inside")),
        f"""{E}
SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, ts_sec AS parsed, ts_sec * 1000 AS millis, {_M} AS minute, false AS inside
FROM e""",
    ),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
