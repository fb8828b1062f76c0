"""Round 3's findings on time: what the ledger queries share is written once, narrow, and in code that the JVM compiles."""

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.functions import calendar as D
from ledgerflow.functions import money as M
from ledgerflow.operators import clean as C
from ledgerflow.plans import catalog as Q
from tests.conftest import SF_SMALL


def test_the_ledger_is_read_from_the_cleaned_rows(spark):
    """No second copy of the valid rows; the rejected ones lie in a folder of their own, which the ledger never reads."""
    cleaned, ledger = Q.cleaned(spark, SF_SMALL), Q.ledger_ordered(spark, SF_SMALL)
    files = set(ledger.inputFiles())
    assert files and files <= set(cleaned.inputFiles())
    assert ledger.columns == [*C.CLEAN_COLUMNS, C.ORDINAL] and "ledger_year" not in cleaned.columns
    valid, rejected = C.split_valid(cleaned)
    assert ledger.exceptAll(valid.select(*ledger.columns)).count() == 0
    assert ledger.count() == valid.count() == cleaned.count() - rejected.count() and rejected.count() > 0
    assert ledger.where(~F.col("year").eqNullSafe(F.year("txn_date"))).count() == 0


def _largest_method(spark, df) -> int:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")  # noqa: SLF001
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


def test_the_cleaners_methods_are_small_enough_to_be_compiled(spark):
    """The JVM only interprets a method of more than 8,000 bytes."""
    row = {c: "x" for c in ("date_raw", "department_code", "department", "txn_type", "expense_type", "amount_raw", "owner",
                            "counterparty", "project")}
    raw = spark.createDataFrame([row], ", ".join(f"{c} string" for c in row)).withColumn("ordinal", F.lit(1).cast("long"))
    assert _largest_method(spark, C.clean_ledger(raw, day_first=False, with_copies=True)) < 5000
    assert _largest_method(spark, C.clean_uploads(raw.withColumn("upload", F.col("ordinal").cast("int")))) < 5000


def test_the_load_carries_no_calendar(spark):
    assert not {"year_month", "day_name", "iso_week"} & set(Q.load2(spark, SF_SMALL).resolved.columns)


def test_calendar_without_a_formatter(spark):
    days = [dt.date(1, 1, 1), dt.date(999, 12, 31), dt.date(1000, 1, 1), dt.date(2024, 2, 29), dt.date(9999, 12, 31), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    cal = D.calendar_columns("d")
    got = df.select(cal["day_name"], cal["year_month"]).collect()
    assert [tuple(r) for r in got] == [(d.strftime("%A"), f"{d.year:04d}-{d.month:02d}") if d else (None, None) for d in days]
    plan = df.select(cal["day_name"])._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "date_format" not in plan


def test_dates_of_all_shapes_in_one_pattern(spark):
    texts = {"2024-01-05": "2024-01-05", "2024-01-5T": None, "2024": None, "2024-13-01": None, "20240105 10:00": "2024-01-05",
             "5/3/69": "1969-03-05", "5/3/68": "2068-03-05", "5.3.24": "2024-03-05", "5-March-2024": "2024-03-05", "Mar 5, 2024": "2024-03-05",
             "5 foo 2024": None, "2024-01-05\n": "2024-01-05", "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for parsed in (D.parse_date("t", D.date_formats(True)), D.parse_date_by("t", F.lit(True))):
        assert [r[0] for r in df.select(parsed.cast("string")).collect()] == list(texts.values())


def test_expense_spellings_and_long_decimals(spark):
    kinds = ["Dépense", "depense", " DÉPENSE ", "Depense", "Revenu", None]
    df = spark.createDataFrame([(k, "1.23456789") for k in kinds], "k string, a string").withColumn("a", M.parse_amount("a"))
    assert [r[0] for r in df.select(M.signed_amount("a", "k")).collect()] == [Decimal("-1.234567")] * 4 + [Decimal("1.234567")] * 2
