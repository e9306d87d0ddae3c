import random
from collections import Counter, deque

import pytest

from timberline.operators import detectors as dx
from timberline.operators import ngrams as ng
from timberline.operators.rollups import minute_rollup, source_stats
from timberline.operators.rules import DEFAULT_RULES, Rule, RuleSet
from timberline.params import Params
from timberline.sources.logs import Settings, read_settings

SCHEMA = "seq long, ts_sec long, level int, source string, message string"


@pytest.fixture(scope="module")
def log():
    """In order of time, with many events in the same second."""
    rng, at, out = random.Random(5), 1_700_000_000, []
    for seq in range(600):
        at += rng.choice([0, 0, 1, 7, 200])
        out.append((seq, at, rng.choice([0, 2, 3, 4]), rng.choice(["a", "b"]), f"login {rng.randint(0, 3)} from 10.0.0.{rng.randint(0, 9)}"))
    return out


@pytest.fixture(scope="module")
def entries(spark, log):
    from pyspark.sql import functions as F

    return spark.createDataFrame(log, SCHEMA).withColumn("ts", F.timestamp_seconds("ts_sec")).persist()


def test_spike_counts_follow_arrival(entries, log):
    got = {r["seq"]: (r["short"], r["baseline"]) for r in dx.spike_counts(entries).collect()}
    held = {"a": (deque(), deque()), "b": (deque(), deque())}
    for seq, at, _, source, _ in log:
        for q, seconds in zip(held[source], (60, 600), strict=True):
            q.append(at)
            while at - q[0] > seconds:
                q.popleft()
        assert got[seq] == tuple(map(len, held[source]))


def test_descriptions_round_as_sql_does(spark):
    """17 of 40 events in a tenth of the time: 4.25 times the baseline, which SQL prints as 4.2."""
    import duckdb
    from pyspark.sql import functions as F

    times = [1_700_000_000 + 20 * k for k in range(23)] + [1_700_000_500 + k for k in range(17)]
    rows = spark.createDataFrame([(k, at, 2, "a", f"m {k}") for k, at in enumerate(times)], SCHEMA)
    spikes = [r["description"] for r in dx.online_anomalies(rows).filter("detector = 'spike'").orderBy("seq").collect()]
    assert spikes[-1] == "Spike detected: a (17 events in 60s, 4.2x baseline, ROC=0.00"
    from timberline.functions.text import fixed

    values = [k / 8 for k in range(-40, 400)] + [k / 100 for k in range(3000)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", fixed(F.col("x"), 1), fixed(F.col("x"), 2)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?::DOUBLE[]) AS x", [values])
    assert sorted(map(tuple, got)) == sorted(con.sql("SELECT x, printf('%.1f', x), printf('%.2f', x) FROM v").fetchall())


def test_running_z(entries, log):
    got = {r["seq"]: r["z"] for r in dx.rates(entries).collect()}
    held, stats = {"a": deque(), "b": deque()}, {"a": [0, 0.0, 0.0], "b": [0, 0.0, 0.0]}
    for seq, at, _, source, _ in log:
        q, s = held[source], stats[source]
        q.append(at)
        while at - q[0] > 600:
            q.popleft()
        rate = len(q) * 60 / 600 if len(q) < 2 else len(q) / max(1e-6, max(1, q[-1] - q[0]) / 60)
        s[0] += 1
        d = rate - s[1]
        s[1] += d / s[0]
        s[2] += d * (rate - s[1])
        sigma = (s[2] / (s[0] - 1)) ** 0.5 if s[0] > 1 else 0
        z = 0 if s[0] < 10 or sigma < 1e-9 else (rate - s[1]) / sigma
        assert got[seq] == pytest.approx(z, abs=1e-7)


def test_ngrams_count_as_the_sliding_buffer(entries, log):
    got = {r["pattern"]: r["freq"] for r in ng.ngram_counts(entries).collect()}
    buffer, want = deque(maxlen=10), Counter()
    for _, _, level, source, message in log:
        buffer.append(f"{source}:{level}:{' '.join(message.split()[:3])[:20]}")
        for n in range(2, 11):
            for i in range(len(buffer) - n + 1):
                want["->".join(list(buffer)[i : i + n])] += 1
    assert got == want


def test_burst_cadence():
    hits = dx.burst_hits(deque(), [(i, 100) for i in range(1, 81)], Params())
    assert [h[0] for h in hits] == [20, 21, 31, 32, 42, 43, 53, 54, 64, 65, 75, 76]
    assert hits[0][5] == [16, 17, 18, 19, 20] and hits[2][5] == [27, 28, 29, 30, 31]


def test_bursts_in_parts_are_one_fold(spark):
    """Gaps longer than the window part a signature's rows; times may run back."""
    from pyspark.sql import functions as F

    rng, at, rows = random.Random(17), 10_000, []
    for seq in range(900):
        at += rng.choice([0, 1, 2, -15, 25, 200])
        rows.append((seq, at, 4, rng.choice("ab"), "same text"))
    p = Params(burst_repeats=4)
    got = dx.bursts(spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("ts_sec")), p).collect()
    want = []
    for source in "ab":
        want += [(h[0], source, *h[2:]) for h in dx.burst_hits(deque(), [(x[0], x[1]) for x in rows if x[3] == source], p)]
    assert sorted((r["seq"], r["source"], r["n"], r["first_sec"], r["last_sec"], r["samples"]) for r in got) == sorted(want) and want


def test_a_source_with_most_rows_is_many_groups(spark, monkeypatch):
    """Nine rows in ten come from one source; chunks and slices are small, and the values those of one fold."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(dx, "CHUNK", 150)
    rng, at, rows = random.Random(19), 1_700_000_000, []
    for seq in range(2500):
        at += rng.choice([0, 1, 3, 20, 90])
        rows.append((seq, at, 2, "hot" if rng.random() < 0.9 else "cold", "m"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("ts_sec"))
    assert dx._sliced(df, 600).filter("source = 'hot'").select("_slice").distinct().count() > 10
    got = {r["seq"]: r for r in dx.rates(df).collect()}
    counts = {r["seq"]: (r["short"], r["baseline"]) for r in dx.spike_counts(df).collect()}
    assert len(got) == len(counts) == len(rows)
    for source in ("hot", "cold"):
        held, seen = deque(), []
        for seq, at, _, own, _ in rows:
            if own != source:
                continue
            held.append(at)
            while at - held[0] > 600:
                held.popleft()
            seen.append(len(held) / 10 if len(held) < 2 else len(held) / max(1, held[-1] - held[0]) * 60)
            n = len(seen)
            mean = sum(seen) / n
            sigma = (sum((x - mean) ** 2 for x in seen) / (n - 1)) ** 0.5 if n > 1 else 0
            r = got[seq]
            assert counts[seq] == (sum(at - x <= 60 for x in held), len(held))
            assert (r["n"], r["recent"]) == (n, len(held)) and r["mean"] == pytest.approx(mean) and r["moving_average"] == pytest.approx(sum(seen[-100:]) / len(seen[-100:]))
            assert r["z"] == pytest.approx(0 if n < 10 or sigma < 1e-9 else (seen[-1] - mean) / sigma, abs=1e-6)


def test_ngram_examples_are_the_newest(entries, log):
    p = Params(ngram_window=4)
    top = ng.top_patterns(ng.ngram_counts(entries, p), 5)
    buffer, seen = deque(maxlen=4), {r["pattern"]: [] for r in top.collect()}
    for seq, _, level, source, message in log:
        buffer.append(f"{source}:{level}:{' '.join(message.split()[:3])[:20]}")
        for n in range(2, 5):
            for i in range(len(buffer) - n + 1):
                pattern = "->".join(list(buffer)[i : i + n])
                if pattern in seen:
                    seen[pattern].append(seq)
    assert {r["pattern"]: r["examples"] for r in ng.ngram_examples(entries, top, p).collect()} == {k: v[-3:] for k, v in seen.items()}


def test_late_events_and_windows(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 1000, 4, "a", "m"), (2, 1130, 4, "a", "m"), (3, 1000, 2, "a", "late"), (4, 1131, 2, "a", "m")], SCHEMA)
    got = {r["idx"]: (r["total"], r["errors"]) for r in dx.tumbling(rows.withColumn("ts", F.timestamp_seconds("ts_sec"))).collect()}
    assert got == {0: (1, 1), 2: (2, 1)}


def test_sums_agree(entries, log):
    minutes = minute_rollup(entries).toPandas()
    assert minutes["total"].sum() == len(log) == minutes[["trace", "debug", "info", "warn", "error", "critical", "unknown"]].sum().sum()
    assert source_stats(entries).toPandas()["total"].sum() == len(log)


def test_rules(entries, log):
    rules = RuleSet()
    assert [r.id for r in rules.ordered()] == ["critical_keyword", "error_keyword"] and len(DEFAULT_RULES) == 2
    settings = read_settings("# x\nrule.a = first KEYWORD Login\nrule.a.severity = 7\nrule.b = second LEVEL 4\nrule.b.enabled=false\nk = 1\nk = 2")
    assert Settings(settings).integer("k") == 2 and Settings(settings).boolean("rule.b.enabled") is False
    assert rules.load(settings, merge=False) == 2 and rules.rules["a"].severity == 1.0
    assert rules.matches(entries).count() == len(log)
    assert rules.enable("b") and rules.statistics(entries).filter("rule_id = 'b'").first()["matches"] == sum(x[2] == 4 for x in log)
    busy = RuleSet([Rule("t", "t", "THRESHOLD", frequency=3, seconds=10)])
    held, want = deque(), set()
    for seq, at, *_ in log:
        held.append(at)
        while at - held[0] > 10:
            held.popleft()
        if len(held) >= 3:
            want.add(seq)
    assert {r["seq"] for r in busy.matches(entries).collect()} == want
    custom = RuleSet([Rule("c", "c", "CUSTOM")])
    from pyspark.sql import functions as F

    custom.register("even", lambda rule: F.col("seq") % 2 == 0)
    assert custom.matches(entries).count() == len(log) // 2
