"""Cleaning rules: required columns, dedup order, validity, quality counters."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import clean as C
from ledgerflow.schemas import LEDGER_RAW, REQUIRED_COLUMNS
from ledgerflow.sources.ledger_csv import repair_mojibake


def raw_df(spark, rows):
    return spark.createDataFrame(rows, LEDGER_RAW)


BASE = ("2024-01-05", "DEPT001", "Ventes", "Revenu", None, "100", "Ann", "Client A", "P1")


def test_missing_columns_bank_export(spark):
    header = ["TransactionID", "ClientID", "Date", "Montant", "Type", "Catégorie", "Solde"]
    df = spark.createDataFrame([tuple("1" for _ in header)], ", ".join(f"`{h}` string" for h in header))
    with pytest.raises(C.MissingColumnsError) as e:
        C.upload_to_ledger(df)
    assert e.value.missing == ["DepartementID", "Département", "TypeTransaction", "TypeDépense", "Responsable",
                               "Client_Fournisseur", "Projet"]


def test_missing_columns_user_export(spark):
    header = ["id", "firstname", "lastname", "email", "role", "login_type", "created_at"]
    df = spark.createDataFrame([tuple("1" for _ in header)], ", ".join(f"{h} string" for h in header))
    with pytest.raises(C.MissingColumnsError) as e:
        C.upload_to_ledger(df)
    assert e.value.missing == REQUIRED_COLUMNS


def test_header_trim_and_extra_columns_pass(spark):
    cols = [f" {c} " for c in REQUIRED_COLUMNS] + ["Extra"]
    df = spark.createDataFrame([tuple("x" for _ in cols)], ", ".join(f"`{c}` string" for c in cols))
    out = C.upload_to_ledger(df)
    assert "Extra" in out.columns and "department" in out.columns


def test_validity_rules(spark):
    only_code_null = list(BASE)
    only_code_null[1] = None
    blank_project = list(BASE)
    blank_project[8] = "   "
    cleaned = C.clean_ledger(raw_df(spark, [tuple(only_code_null), tuple(blank_project)]))
    valid, rejected = C.split_valid(cleaned)
    assert valid.count() == 1
    assert [r.reasons for r in rejected.collect()] == [["project"]]


def test_dedup_happens_before_normalising(spark):
    a = list(BASE)
    b = list(BASE)
    b[8] = "P1 "
    df = raw_df(spark, [tuple(a), tuple(a), tuple(b)])
    valid = C.clean_valid(df)
    assert valid.count() == 2  # exact copies go; a trailing-space variant survives


def test_expense_type_default_and_sign(spark):
    r = C.clean_valid(raw_df(spark, [BASE])).first()
    assert r.expense_type == "N/A" and float(r.signed_amount) == 100.0 and r.year_month == "2024-01"


def test_quality_counters_balance(spark):
    rows = [BASE, BASE, tuple(list(BASE[:5]) + ["n/d"] + list(BASE[6:]))]
    cleaned = C.clean_ledger(raw_df(spark, rows), with_copies=True)
    q = C.quality_counters(cleaned).first()
    assert (q.n_read, q.n_duplicates, q.n_rejected, q.n_valid) == (3, 1, 1, 1)
    assert q.n_read == q.n_duplicates + q.n_rejected + q.n_valid


def test_cleaning_is_idempotent(spark):
    from ledgerflow.sources import binding as B
    from tests.conftest import SF_SMALL
    once = C.clean_valid(B.ledger_raw(spark, SF_SMALL))
    as_raw = once.select(
        F.date_format("txn_date", "yyyy-MM-dd").alias("date_raw"), "department_code", "department", "txn_type",
        "expense_type", F.col("amount").cast("string").alias("amount_raw"), "owner", "counterparty", "project")
    twice = C.clean_valid(as_raw)
    assert once.distinct().exceptAll(twice).count() == 0 and twice.exceptAll(once.distinct()).count() == 0


def test_mojibake_column_policy(spark):
    df = spark.createDataFrame([("DÃ©partement", "DÃ©partement"), ("abc", "€5")], "a string, b string")
    out = repair_mojibake(df).collect()
    assert [r.a for r in out] == ["Département", "abc"]
    assert [r.b for r in out] == ["DÃ©partement", "€5"]


def test_mojibake_repair_matches_sql_form(spark):
    """Spark's column-wise repair equals the SQL form used by the legacy oracle."""
    import duckdb

    from ledgerflow.plans.oracle_sql import _UTF8_AS_LATIN1, _repaired
    rows = [("DÃ©partement", "abc", "x"), ("CafÃ©", "Dépense", None), ("plain", "€5", "Ã§a")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = [tuple(r) for r in repair_mojibake(df).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, a VARCHAR, b VARCHAR, c VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    pol = ", ".join(f"coalesce(bool_and(coalesce(regexp_full_match({c}, '{_UTF8_AS_LATIN1}'), true)), true) AS p_{c}"
                    for c in "abc")
    fix = ", ".join(f"CASE WHEN p.p_{c} THEN {_repaired('t.' + c)} ELSE t.{c} END" for c in "abc")
    want = con.execute(f"WITH p AS (SELECT {pol} FROM t) SELECT {fix} FROM t, p ORDER BY t.i").fetchall()
    assert got == want
    assert got[0] == ("Département", "abc", "x") and got[2][1] == "€5"
