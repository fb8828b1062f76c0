"""Golden micro-cases for the column functions (FIXTURES.md §4)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.functions import (
    calendar_columns, counterparty_kind, department_id, display_name, expense_category, import_status,
    normalize_text, null_token, parse_amount, parse_date, sign_label, signed_amount,
)


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_parse_amount(spark):
    got = one_col(spark, ["€ 1 234,50", "1,234.56", "(100)", "-12,5 $", "n/d", "", "5-", "--5", None, "1.", ".5"],
                  parse_amount)
    assert got == [Decimal("1234.500"), None, Decimal("100.000"), Decimal("-12.500"), None, None, None, None,
                   None, Decimal("1.000"), Decimal("0.500")]


def test_normalize_text(spark):
    got = one_col(spark, ["  a b\t", "   ", "x  y", "\x1cz\x1f", None], normalize_text)
    assert got == ["a b", None, "x y", "z", None]


def test_null_tokens(spark):
    got = one_col(spark, ["NA", "N/A", "null", "None", "nan", "", "ok", "n/d"], null_token)
    assert got == [None, None, None, None, None, None, "ok", "n/d"]


def test_signed_amount_rules(spark):
    df = spark.createDataFrame(
        [("Dépense", "10"), ("DEPENSE", "-10"), ("Revenu", "-10"), ("Autre", "10"), ("revenu", "10"), ("Revenu", None)],
        "t string, a string").withColumn("a", F.col("a").cast("decimal(18,3)"))
    out = df.select(signed_amount("a", "t").alias("s"), signed_amount("a", "t", rule="legacy").alias("l"),
                    sign_label("t").alias("lab")).collect()
    assert [r.s for r in out] == [Decimal("-10"), Decimal("-10"), Decimal("10"), Decimal("10"), Decimal("10"), None]
    assert [r.l for r in out][2:5] == [Decimal("-10"), Decimal("-10"), Decimal("-10")]
    assert [r.lab for r in out] == ["Négatif", "Négatif", "Positif", "Négatif", "Négatif", "Positif"]


def test_calendar_iso_week(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date")
    r = df.select(*[v.alias(k) for k, v in calendar_columns("d").items()]).first()
    assert (r.iso_week, r.day_name, r.day_of_year, r.quarter, r.year_month, r.fiscal_year) == \
        (1, "Monday", 365, 4, "2024-12", 2024)


def test_parse_date(spark):
    got = one_col(spark, ["2024-01-05", "2024-01-05 10:00:00", "2024-01-05T10:00:00", "pas une date", "2024/2/3",
                          "12/31/2023", "31.12.2023", None, "2024-13-01"], parse_date)
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 1, 5), None, dt.date(2024, 2, 3),
                   dt.date(2023, 12, 31), dt.date(2023, 12, 31), None, None]


def test_department_id(spark):
    assert one_col(spark, ["DEPT001", "X", "D12a3", None], department_id) == [1, None, 12, None]


def test_expense_category_first_rule_wins(spark):
    got = one_col(spark, ["Achat logiciel", "Capital", "Voyage", "Salaire", "Loyer bureau", "Publicité web",
                          "Vente directe"], expense_category)
    assert got == ["Achats & Approvisionnement", "IT & Technologie", "Autres", "Ressources Humaines",
                   "Infrastructure", "Marketing", "Revenus"]


def test_counterparty_kind(spark):
    assert one_col(spark, [" revenu ", "Revenu", "Dépense", None], counterparty_kind) == \
        ["Client", "Client", "Fournisseur", "Fournisseur"]
    assert one_col(spark, [" revenu ", "Revenu"], lambda c: counterparty_kind(c, exact=True)) == \
        ["Fournisseur", "Client"]


def test_display_name_fallbacks(spark):
    df = spark.createDataFrame(
        [("Ann", "Lee", "a@x", None, 1), (None, None, "b@x", None, 2), (None, "", "", "imp", 3),
         (None, None, None, None, 4)], "f string, l string, e string, i string, u long")
    got = [r[0] for r in df.select(display_name("f", "l", "e", "i", "u")).collect()]
    assert got == ["Ann Lee", "b@x", "imp", "User 4"]


def test_import_status(spark):
    df = spark.createDataFrame([(0, False), (3, False), (0, True)], "n long, f boolean")
    assert [r[0] for r in df.select(import_status("n", "f")).collect()] == ["succes", "partiel", "echec"]
