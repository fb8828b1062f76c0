"""Property tests: column functions against small Python models of their rules."""

import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerflow.functions import normalize_text, parse_amount

_ALPHABET = "0123456789" * 3 + ".,-€$£  \tabc()%+"
_NUMBER = re.compile(r"^-?(\d+\.?\d*|\.\d+)$")


def model_amount(text):
    """The amount rule stated directly: drop currency signs and whitespace, comma to
    dot, keep digits/dot/minus, then a plain decimal number rounded half-up to 6."""
    if text is None:
        return None
    s = re.sub(r"[€$£\s]", "", text).replace(",", ".")
    s = re.sub(r"[^0-9.\-]", "", s)
    if not _NUMBER.match(s):
        return None
    try:
        d = Decimal(s).quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)
    except InvalidOperation:
        return None
    return d if abs(d) < Decimal(10) ** 22 else None


def model_text(text):
    if text is None:
        return None
    out = " ".join(text.split())
    return out or None


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=_ALPHABET, max_size=14)), min_size=1, max_size=40))
def test_parse_amount_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(parse_amount(F.col("v"))).collect()]
    assert got == [model_amount(v) for v in values]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n  　\x1c", max_size=12)),
                min_size=1, max_size=40))
def test_normalize_text_matches_python_split(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(normalize_text(F.col("v"))).collect()]
    assert got == [model_text(v) for v in values]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.dates(min_value=__import__("datetime").date(1900, 1, 1),
                         max_value=__import__("datetime").date(2100, 12, 31)), min_size=1, max_size=60))
def test_calendar_matches_python(spark, days):
    from ledgerflow.functions import calendar_columns
    df = spark.createDataFrame([(d,) for d in days], "d date")
    cal = calendar_columns("d")
    got = [tuple(r) for r in df.select(*[cal[k] for k in ["year", "month", "quarter", "iso_week", "day_name",
                                                          "day_of_year", "year_month"]]).collect()]
    want = [(d.year, d.month, (d.month - 1) // 3 + 1, d.isocalendar()[1], d.strftime("%A"),
             d.timetuple().tm_yday, d.strftime("%Y-%m")) for d in days]
    assert got == want


def model_category(text):
    from ledgerflow.schemas import EXPENSE_CATEGORY_DEFAULT, EXPENSE_CATEGORY_RULES
    t = ("none" if text is None else text).lower()
    for words, label in EXPENSE_CATEGORY_RULES:
        if any(w in t for w in words):
            return label
    return EXPENSE_CATEGORY_DEFAULT


def model_department_id(code):
    if code is None:
        return None
    m = re.search(r"\d+", code)
    if not m:
        return None
    v = int(m.group(0))
    return v if v <= 2**31 - 1 else None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="achtsirlomkvpéèAITHR ", max_size=16)),
                min_size=1, max_size=40))
def test_expense_category_matches_model(spark, values):
    from ledgerflow.functions import expense_category
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(expense_category(F.col("v"))).collect()]
    assert got == [model_category(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="DEPT0123456789-x", max_size=14)), min_size=1, max_size=40))
def test_department_id_matches_model(spark, values):
    from ledgerflow.functions import department_id
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(department_id(F.col("v"))).collect()]
    assert got == [model_department_id(v) for v in values]
