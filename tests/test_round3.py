"""Regression tests of the third round of findings."""

import os

from pyspark.sql import functions as F

from ledgerflow.functions import calendar as D
from ledgerflow.functions import money as M
from ledgerflow.functions import text as T
from ledgerflow.operators import clean as C
from ledgerflow.schemas import UPLOAD_TO_LEDGER
from ledgerflow.sources.ledger_csv import read_uploads


def test_date_order_tries_its_patterns_once_for_each_beginning(spark):
    texts = [" 13/02/2024", "13-02-24 10:00", "02/13/2024", "13/02/20245", "2024-02-13", None, "x", "1/13/2024", "13.02.2024", "31/31/2024"]
    df = spark.createDataFrame([(u, t) for u in (0, 1) for t in texts] + [(1, "25/12/2023"), (2, "x"), (3, None)], "u int, date_raw string")
    assert dict(D.day_first_by(df, "u").collect()) == {0: False, 1: True, 2: False, 3: False}
    lines = D.day_first_by(df, "u")._jdf.queryExecution().executedPlan().toString().splitlines()  # noqa: SLF001
    counted = next(i for i, line in enumerate(lines) if "partial_count(1)" in line)
    assert any("regexp_extract" in line for line in lines[:counted])
    assert not any("regexp_extract" in line for line in lines[counted:])


ROW = ["2024-02-{day:02d}", "DEPT001", "Sales", "Revenu", "x", "10.00", "Ann", "Bob", "P1"]


def _write(path, days, header):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(header) + "\n")
        for d in days:
            f.write(",".join(v.format(day=d) for v in ROW[:len(header)]) + "\n")


def test_an_upload_may_come_as_a_folder_of_parts(spark, tmpdir_path):
    names = {own: name for name, own in UPLOAD_TO_LEDGER.items()}
    header = [names[c] for c in ("date_raw", "department_code", "department", "txn_type", "expense_type", "amount_raw", "owner", "counterparty", "project")]
    top = f"{tmpdir_path}/parts"
    _write(f"{top}/big/part-0.csv", [1, 2, 2], header)
    _write(f"{top}/big/part-1.csv", [2, 3], header)
    _write(f"{top}/one.csv", [2], header)
    _write(f"{top}/bad/part-0.csv", [4], header)
    _write(f"{top}/bad/part-1.csv", [5], header[:-1])
    found = read_uploads(spark, [f"{top}/big", f"{top}/one.csv", f"{top}/bad/"])
    rows = [(r["upload"], r["ordinal"], r["date_raw"][-2:]) for r in found.rows.orderBy("ordinal").collect()]
    assert rows == [(0, 1, "01"), (0, 2, "02"), (0, 3, "02"), (0, 4, "02"), (0, 5, "03"), (1, 6, "02")]
    assert list(found.failed) == [2] and names["project"] in found.failed[2]
    cleaned = sorted((r["upload"], r["txn_date"].day, r[C.COPIES]) for r in C.clean_uploads(found.rows).collect())
    assert cleaned == [(0, 1, 1), (0, 2, 3), (0, 3, 1), (1, 2, 1)]  # copies in different parts are one file's copies


ODD_TEXTS = ["a b", " a", "a ", "a  b", "a\tb", "a\n", "a\x1cb", "a\x85b", "a\xa0b", "a b", "a b", "a　", "Dépense x", "中  b", "\U0001f600 c",
             "a\xadb", "a\x7fb", "\x00a b", "a​b", "", " ", "\t", None, "-", "a b c d"]


def test_tidy_texts_are_not_rewritten_and_others_are(spark):
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string")
    got = [r[0] for r in df.select(T.normalize_text("t")).collect()]
    assert got == [t and " ".join(t.split()) or None for t in ODD_TEXTS]
    tidy = [r[0] for r in df.select(F.col("t").rlike(T._TIDY)).collect()]  # noqa: SLF001
    assert tidy == [None if t is None else t in ("a b", "Dépense x", "a\xadb", "-", "a b c d") for t in ODD_TEXTS]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()  # noqa: SLF001


def test_dates_are_cast_without_a_formatter(spark):
    texts = ["2024-2-5", "2024/02/29 10:00", "2023-02-29", "20240205", "2024-13-01", "0000-01-01", "9999-12-31", "2024-00-10", "5/2/69", "5/2/68",
             "31.12.99", "5 Feb 2024", "february 30, 2024", "feb 5, 2024", "5-foo-2024", "2024-2-5x", " 2024-2-5 ", "2024-2", None, "12345-01-01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(D.parse_date("t").cast("string")).collect()]
    assert got == ["2024-02-05", "2024-02-29", None, "2024-02-05", None, "0000-01-01", "9999-12-31", None, "1969-05-02", "2068-05-02",
                   "1999-12-31", "2024-02-05", None, "2024-02-05", None, None, "2024-02-05", None, None, None]
    assert "gettimestamp" not in _plan(df.select(D.parse_date("t")))
    old = F.to_date(F.try_to_timestamp("t", F.lit("yyyy-M-d")))
    assert df.where(~D.iso_date(F.col("t")).eqNullSafe(old)).count() == 0


def test_amounts_need_no_pattern_of_their_own_for_signs_and_blanks(spark):
    texts = ["€ 1,5", "1 234.50 $", "1,234.56", "5-", "-5", "n/d", " 12 ", "0.1234567", "1.1234567.2", "1234567", ".5", "", None, "1.123456789-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r[0] is None else format(r[0].normalize(), "f") for r in df.select(M.parse_amount("t")).collect()]
    assert got == ["1.5", "1234.5", None, None, "-5", None, "12", "0.123456", None, "1234567", "0.5", None, None, None]
    assert _plan(df.select(M.parse_amount("t").alias("a"))).count("regexp_replace") == 2


def test_one_byte_text_is_left_alone_by_the_repair(spark):
    texts = ["abc", "D\xc3\xa9p", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [tuple(r) for r in df.select(T.repairable_mojibake("t"), T.repair_mojibake_value("t")).collect()] == [
        (True, "abc"), (True, "Dép"), (True, ""), (None, None)]
    assert "octet_length" in _plan(df.select(T.repair_mojibake_value("t")))
