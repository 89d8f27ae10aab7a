"""Queries with SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", ["op8_hosts", "op9_chats", "op10_decontaminate", "op11_spelling", "op12_filters"])
def test_query_equals_its_sql(spark, data, name):
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = entry.queries()[name](spark, data)
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, res.fetchall()))
