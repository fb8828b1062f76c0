"""Every registered query against its DuckDB oracle on the smallest test data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents", "benchmark", "labels"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=_key)
    assert got == want


def test_every_query_has_an_oracle():
    from ledgerflow.plans.catalog import QUERIES
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_legacy_clean_rules(spark):
    r = entry.queries()["legacy_clean"](spark, SF_SMALL)
    assert r.columns[:3] == ["department_code", "department", "owner"]
    bad = r.where("txn_date IS NULL").count()
    assert bad > 0  # no row is rejected by the legacy cleaner
    assert "sign_label" not in r.columns and r.columns[-2:] == ["counterparty", "project"]
