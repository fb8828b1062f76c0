"""Date parsing and calendar attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (shape, order) pairs: text of a shape is rewritten to year-month-day by the order of its groups, then parsed once. A time behind
# the date may lack seconds, carry fractions and end in Z or an offset; it is ignored.
_TIME = r"(?:[ t]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:z| ?[+-]\d{2}(?::?\d{2})?)?)?$"
_YEAR = r"(\d{4}|\d{2})"
_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"

YEAR_FIRST = ((r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})", "$1-$3-$4"), (r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3"))
DAY_FIRST = ((rf"(\d{{1,2}})([-/])(\d{{1,2}})\2{_YEAR}", "$4-$3-$1"),)
MONTH_FIRST = ((rf"(\d{{1,2}})([-/])(\d{{1,2}})\2{_YEAR}", "$4-$1-$3"),)
# Written with dots the day always stands first; a month's English name needs no order.
DOTTED = ((rf"(\d{{1,2}})\.(\d{{1,2}})\.{_YEAR}", "$3-$2-$1"),)
NAMED = ((r"(\d{1,2})([ -])([a-z]{3,9})\2(\d{4})", "$4-$3-$1"), (r"([a-z]{3,9}) (\d{1,2}),? (\d{4})", "$3-$1-$2"))
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def date_formats(day_first: bool) -> tuple[tuple[str, str], ...]:
    """The formats of an upload whose ``13/02/2024`` or ``02/13/2024`` are dates."""
    return YEAR_FIRST + (DAY_FIRST if day_first else MONTH_FIRST) + DOTTED + NAMED


DEFAULT_DATE_FORMATS = date_formats(day_first=False)


def detect_day_first(df: DataFrame, col: str = "date_raw") -> bool:
    """Whether an upload writes the day before the month, from one aggregate over its dates.

    A first number above 12 can only be a day, a second one above 12 only a month-first date. The
    more frequent kind decides for the whole upload, never value by value; without either, month first.
    """
    row = _order_votes(df, [], col).first()
    return row["day"] > row["month"]


def day_first_by(df: DataFrame, by: str, col: str = "date_raw") -> DataFrame:
    """:func:`detect_day_first` for each value of ``by`` (an upload's file): ``by`` and ``_day_first``."""
    return _order_votes(df, [by], col).select(by, (F.col("day") > F.col("month")).alias("_day_first"))


def _order_votes(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """How many dates can only be day first (``day``), and month first (``month``).

    Equal beginnings are counted first, so that the patterns are tried once for each of them and not for each row; eleven
    characters hold all that a pattern looks at. Texts without a separator in second or third place have no vote: one group.
    """
    text = F.trim(F.col(col).cast("string"))
    marks = ("-", "/")
    start = F.when(F.substring(text, 2, 1).isin(*marks) | F.substring(text, 3, 1).isin(*marks), F.substring(text, 1, 11))
    starts = df.select(*by, start.alias("_start")).groupBy(*by, "_start").agg(F.count(F.lit(1)).alias("_n"))
    first, second = (F.regexp_extract("_start", r"^(\d{1,2})[/-](\d{1,2})[/-](?:\d{4}|\d{2})(?!\d)", i).try_cast("int") for i in (1, 2))
    votes = [F.coalesce(F.sum(F.when(big & small, F.col("_n"))), F.lit(0)).alias(name)
             for name, big, small in (("day", first > 12, second <= 12), ("month", second > 12, first <= 12))]
    return starts.groupBy(*by).agg(*votes)


def parse_date(col, formats=DEFAULT_DATE_FORMATS) -> Column:
    """Text -> DATE; an unparseable value gives null (never an error). A time behind the date is ignored."""
    pattern, order = _one_pattern(formats)
    return _parse(col, pattern, F.lit(order))


def parse_date_by(col, day_first: Column) -> Column:
    """:func:`parse_date` where a column says whether the day stands before the month."""
    (pattern, by_day), (_, by_month) = (_one_pattern(date_formats(first)) for first in (True, False))
    return _parse(col, pattern, F.when(day_first, F.lit(by_day)).otherwise(F.lit(by_month)))


def _one_pattern(formats) -> tuple[str, str]:
    """All shapes as one pattern, the first that a text has decides, and one order: the groups of the shapes it has not are empty."""
    shapes, parts, before = [], ["", "", ""], 0
    for shape, order in formats:
        shapes.append(re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + before}", shape))
        groups = [int(n) + before for n in re.findall(r"\$(\d)", order)]
        parts = [f"{p}${n}" for p, n in zip(parts, groups)]
        before += re.compile(shape).groups
    return f"^(?:{'|'.join(shapes)}){_TIME}", "-".join(parts)


def _parse(col, pattern: str, order: Column) -> Column:
    text = F.trim(_c(col).cast("string"))
    s = F.lower(text)
    day = F.when(s.rlike(pattern), F.regexp_replace(s, F.lit(pattern), order))
    # A year of two digits lies between 1969 and 2068.
    day = F.regexp_replace(F.regexp_replace(day, "^(69|[7-9][0-9])-", "19$1-"), "^([0-9]{2})-", "20$1-")
    names = F.create_map(*(F.lit(x) for i, name in enumerate(MONTHS) for n in {name, name[:3]} for x in (n, str(i + 1))))
    # Applied to each part, this function over an array also keeps the projection out of whole-stage code: a cleaner's columns together
    # make a method of more than 8,000 bytes there, which the JVM only interprets; a projection by itself is split into small ones.
    number = F.transform(F.split(day, "-"), lambda part: F.when(part.rlike("^[0-9]"), part).otherwise(F.try_element_at(names, part)))
    # The shapes leave four digits, then one or two and one or two: a cast reads them without a formatter for each row. So it
    # does a plain 2024-01-05.
    return F.when(text.rlike(_PLAIN), text).otherwise(F.array_join(number, "-", "?")).try_cast("date")


def iso_date(col) -> Column:
    """Text of the form ``2024-2-5``, whole or null. The formatter is left with what does not look like it."""
    s = _c(col)
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), s.try_cast("date")).otherwise(
        F.to_date(F.try_to_timestamp(s, F.lit("yyyy-M-d"))))


def calendar_columns(date_col) -> dict[str, Column]:
    """The eight calendar attributes of a date (ISO week, English day name). The formatter is left with years of other than four digits."""
    d = _c(date_col)
    year_month = F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(F.month(d).cast("string"), 2, "0"))
    return {
        "year": F.year(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "iso_week": F.weekofyear(d),
        "day_name": F.get(F.array(*map(F.lit, DAYS)), F.weekday(d)),
        "day_of_year": F.dayofyear(d),
        "year_month": F.when(F.year(d).between(1000, 9999), year_month).otherwise(F.date_format(d, "yyyy-MM")),
        "fiscal_year": F.year(d),
    }


def with_calendar(df: DataFrame, date_col: str = "txn_date") -> DataFrame:
    return df.withColumns(calendar_columns(date_col))


def ts_label(col) -> Column:
    """Minute label ``yyyy-MM-dd HH:mm``."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm")


def ntz_literal(value) -> Column:
    """A wall-clock TIMESTAMP_NTZ literal, independent of the session time zone."""
    return F.to_timestamp_ntz(F.lit(value.strftime("%Y-%m-%d %H:%M:%S")))
