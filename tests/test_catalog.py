import duckdb
import pytest

from timberline.plans import catalog

DATA = "/root/testdata/sf0.001"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(str(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    query, sql = catalog.QUERIES[name]
    got = query(spark, DATA)
    rows = _rows(got.columns, got.collect())
    if sql is None:
        return
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows == _rows(want.columns, want.fetchall())


def test_ngrams_of_the_whole_window(spark):
    from collections import Counter

    from timberline.functions.text import pattern_token
    from timberline.sources.logs import log_entries

    rows = log_entries(spark.read.parquet(f"{DATA}/events.parquet")).orderBy("seq")
    tokens = [r[0] for r in rows.select(pattern_token(rows["source"], rows["level"], rows["message"])).collect()]
    want, held = Counter(), []
    for token in tokens:
        held = [*held, token][-10:]
        want.update((n, "->".join(held[i : i + n])) for n in range(2, len(held) + 1) for i in range(len(held) - n + 1))
    got = catalog.QUERIES["ngrams_whole_window"][0](spark, DATA).collect()
    assert {(r["length"], r["pattern"]): r["freq"] for r in got} == want and {r["length"] for r in got} == set(range(2, 11))


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
