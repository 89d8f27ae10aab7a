"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from pledgetrace.plans import catalog
from pledgetrace.plans.views import BASE

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
#: with --slow only
SLOW = {"ST2_evidence_runs", "R14_find_evidence", "J7_search_hits", "U7_search_or_registry", "S8_discover_documents", "W3_drop_copies",
        "ST3_artifact_states", "F5_extract", "M8_places", "L7_agreement", "M3_accept_candidates"}
NAMES = [pytest.param(n, marks=pytest.mark.slow) if n in SLOW else n for n in sorted(catalog.ORACLES)]


def shown(v):
    """Null and not-a-number are one: engines differ in which of them an average of nothing is."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(map(shown, r)) for r in res.fetchall())
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    assert got == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
