"""Ledger cleaning: column check, exact dedup, parsing, normalising, validation.

The whole cleaner is one lazy projection after one aggregation (the exact-duplicate
drop), so it runs as a single shuffle with a map-side partial aggregate: a row
repeated a billion times collapses on the map side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.calendar import DEFAULT_DATE_FORMATS, calendar_columns, date_formats, day_first_by, detect_day_first, iso_date, parse_date, parse_date_by
from ledgerflow.functions.money import parse_amount, signed_amount
from ledgerflow.functions.text import collapse_whitespace, normalize_text, null_tokens
from ledgerflow.operators.joins import dimension_size
from ledgerflow.schemas import (
    EXPENSE_TYPE_DEFAULT, LEDGER_CLEAN, MISSING_COLUMNS_MESSAGE, OPTIONAL_UPLOAD_TO_LEDGER, REQUIRED_COLUMNS,
    UPLOAD_TO_LEDGER,
)
from ledgerflow.session import is_stored, materialize

# Text columns normalised by the cleaner, and the columns a valid row must have.
NORMALISED = ["department_code", "department", "txn_type", "expense_type", "owner",
              "counterparty", "project"]
REQUIRED_VALUES = ["txn_date", "amount", "department", "txn_type", "owner", "counterparty", "project"]
CLEAN_COLUMNS = [f.name for f in LEDGER_CLEAN.fields]
COPIES = "n_copies"
# Bound on the hashes of repeated rows that are sent to every task (measured before).
REPEATED_MAX_ROWS = 3_000_000
# Place of a row in its upload, where the reader was asked for it.
ORDINAL = "ordinal"


class MissingColumnsError(ValueError):
    def __init__(self, missing: list[str]):
        self.missing = missing
        super().__init__(MISSING_COLUMNS_MESSAGE + ", ".join(missing))


def missing_columns(names: list[str], required: list[str] = REQUIRED_COLUMNS) -> list[str]:
    """The required columns that a header lacks, in the declared order."""
    own = {str(n).strip() for n in names}
    return [c for c in required if c not in own]


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[str(c).strip() for c in df.columns])


def require_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Trim header names and fail (before any job runs) when required columns are missing.

    The error lists the missing names in the declared order.
    """
    df = trim_headers(df)
    missing = missing_columns(df.columns, required)
    if missing:
        raise MissingColumnsError(missing)
    return df


def upload_to_ledger(df: DataFrame) -> DataFrame:
    """Check an upload's columns and rename them to ours; extra columns pass through."""
    df = require_columns(df)
    return df.withColumnsRenamed(UPLOAD_TO_LEDGER | OPTIONAL_UPLOAD_TO_LEDGER)


def drop_exact_duplicates(df: DataFrame, count_col: str | None = None) -> DataFrame:
    """Drop rows equal on every column, on the raw values (before normalising).

    With ``count_col`` the surviving row carries how many copies it stood for, so
    quality counters need no second pass over the input. An upload's ``ordinal`` is not a
    value: the survivor has the smallest of its copies.
    """
    values = [c for c in df.columns if c != ORDINAL]
    first = [F.min(ORDINAL).alias(ORDINAL)] if ORDINAL in df.columns else []
    if count_col is None:
        return df.groupBy(*values).agg(*first) if first else df.dropDuplicates()
    return df.groupBy(*values).agg(F.count(F.lit(1)).alias(count_col), *first)


def drop_stored_duplicates(df: DataFrame, count_col: str) -> DataFrame:
    """:func:`drop_exact_duplicates` of rows that can be read again, shuffling only those that may have a copy.

    A first pass shuffles one hash of each row and keeps those found twice; rows of any other hash are certainly without
    a copy and go on where they lie. Rows of a kept hash are compared whole, so the result is exact. If there
    are too many kept hashes to send to every task, all rows are compared whole. A hash has ten bits more than the number of rows
    asks for, so about one row in a thousand is compared without need.
    """
    values = [c for c in df.columns if c != ORDINAL]
    hashed = F.shiftrightunsigned(F.xxhash64(*values), max(0, 64 - 10 - df.count().bit_length()))
    repeated = materialize(df.groupBy(hashed.alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"))
    if dimension_size(repeated)[0] > REPEATED_MAX_ROWS:
        return drop_exact_duplicates(df, count_col)
    kept, same = F.broadcast(repeated), hashed == F.col("_hash")  # at most REPEATED_MAX_ROWS numbers
    alone = df.join(kept, same, "left_anti").withColumn(count_col, F.lit(1).cast("long"))
    return alone.unionByName(drop_exact_duplicates(df.join(kept, same, "left_semi"), count_col))


def has_required():
    """Whether a parsed row has all values that a valid row must have."""
    valid = F.lit(True)
    for c in REQUIRED_VALUES:
        valid = valid & F.col(c).isNotNull()
    return valid


def _reasons():
    """Missing required values, in declared order; empty for a valid row.

    Built from null tests, ``concat_ws`` and ``split`` (no higher-order function such
    as ``array_compact``), so the filter on it stays inside whole-stage codegen.
    """
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_VALUES])
    return F.when(has_required(), F.array().cast("array<string>")).otherwise(F.split(missing, ","))


def derived_columns() -> dict:
    """Columns of a cleaned row that follow from its other parsed values: signed amount, calendar and reasons. A table of cleaned rows need
    not hold them; a reader computes those that it asks for."""
    return {"signed_amount": signed_amount("amount", "txn_type"), **calendar_columns("txn_date"), "reasons": _reasons()}


def parse_and_normalise(df: DataFrame, formats=DEFAULT_DATE_FORMATS, date=None) -> DataFrame:
    """Typed, normalised ledger columns plus the calendar and a ``reasons`` array.

    ``reasons`` is empty for a valid row and lists the missing required values
    otherwise. ``date_raw`` and ``amount_raw`` are kept for the rejected rows. ``date`` replaces the
    parsing of ``date_raw`` by ``formats``.
    """
    out = df.withColumns({
        "txn_date": parse_date("date_raw", formats) if date is None else date,
        "amount": parse_amount("amount_raw"),
        **{c: normalize_text(c) for c in NORMALISED},
    })
    out = out.withColumn("expense_type", F.coalesce("expense_type", F.lit(EXPENSE_TYPE_DEFAULT)))
    out = out.withColumns(derived_columns())
    extras = [c for c in df.columns if c not in CLEAN_COLUMNS and c not in ("date_raw", "amount_raw")]
    return out.select(*CLEAN_COLUMNS, *extras, "date_raw", "amount_raw", "reasons")


def clean_ledger(raw: DataFrame, day_first: bool | None = None, with_copies: bool = False) -> DataFrame:
    """Raw ledger (our column names, strings) -> all deduplicated rows, parsed.

    Steps: missing tokens to null, exact dedup on raw values, parse and normalise.
    Use :func:`split_valid` afterwards. ``day_first`` says how the upload writes
    ``05/03/2024``; None finds out with one aggregate over its date column.

    The dedup always counts copies, and ``reasons`` is tied to that count. This
    keeps the validity filter above the dedup aggregate: every column of the
    test is a function of the grouping keys, so without the tie Catalyst pushes
    the filter (with all parse expressions inlined) below the aggregate and into
    the upstream join, where it runs un-deduplicated and is recomputed after.
    """
    formats = date_formats(detect_day_first(raw) if day_first is None else day_first)
    df = null_tokens(raw)
    df = drop_stored_duplicates(df, COPIES) if is_stored(raw) else drop_exact_duplicates(df, COPIES)
    out = parse_and_normalise(df, formats)
    out = out.withColumn("reasons", F.when(F.col(COPIES) > 0, F.col("reasons")))
    return out if with_copies else out.drop(COPIES)


def clean_uploads(raw: DataFrame, upload: str = "upload") -> DataFrame:
    """Several uploads at once, each cleaned by itself: ``upload`` names the file of a row.

    The order of day and month is decided for each file by one aggregate over the dates (one row per file), and rows are
    duplicates only within their file. Copies are counted, as ``with_copies`` does.
    """
    orders = day_first_by(raw, upload)
    df = drop_stored_duplicates(null_tokens(raw), COPIES) if is_stored(raw) else drop_exact_duplicates(null_tokens(raw), COPIES)
    df = df.join(F.broadcast(orders), upload)  # one row per file of a batch
    out = parse_and_normalise(df, date=parse_date_by("date_raw", F.col("_day_first"))).drop("_day_first")
    return out.withColumn("reasons", F.when(F.col(COPIES) > 0, F.col("reasons")))


def split_valid(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows in the clean schema, rejected rows with their reasons)."""
    ok = F.size("reasons") == 0
    keep = [c for c in cleaned.columns if c not in ("date_raw", "amount_raw", "reasons", COPIES)]
    return cleaned.filter(ok).select(*keep), cleaned.filter(~ok)


def clean_valid(raw: DataFrame, day_first: bool | None = None) -> DataFrame:
    """Convenience: the valid cleaned rows only (``LEDGER_CLEAN`` columns)."""
    valid, _ = split_valid(clean_ledger(raw, day_first))
    return valid.select(*CLEAN_COLUMNS)


def select_ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """Keep the listed columns that exist, in that order."""
    return df.select(*[c for c in order if c in df.columns])


def quality_counters(cleaned_with_copies: DataFrame, resolved_col: str | None = None, loaded: DataFrame | None = None,
                     by: tuple[str, ...] = ()) -> DataFrame:
    """Load-quality report in a single aggregate: one row, or one for each value of ``by`` (an upload's file).

    Input: :func:`clean_ledger` with ``with_copies=True``, optionally with a boolean
    ``resolved_col`` saying whether a valid row found all its dimension keys; or ``loaded``, the valid rows
    as they were loaded, with that flag as ``resolved``: then they are counted beside the cleaned rows, without a join of rows.
    ``read = duplicates + rejected + skipped + inserted`` holds by construction.
    """
    valid, none = F.size("reasons") == 0, F.lit(None).cast("boolean")
    rows = cleaned_with_copies.select(*by, F.col(COPIES).cast("long").alias("_copies"), valid.alias("_valid"),
                                      (F.when(valid, F.col(resolved_col)) if resolved_col else none).alias("_resolved"))
    if loaded is not None:  # rows of no copies: they count under "resolved" only
        rows = rows.unionByName(loaded.select(*by, F.lit(0).cast("long").alias("_copies"), none.alias("_valid"),
                                              F.col("resolved").alias("_resolved")))
    counted = F.col("_valid").isNotNull()
    aggs = [F.coalesce(F.sum("_copies"), F.lit(0)).cast("long").alias("n_read") if by else F.sum("_copies").cast("long").alias("n_read"),
            F.sum(F.when(counted, F.col("_copies") - 1)).cast("long").alias("n_duplicates"),
            F.count_if(~F.col("_valid")).alias("n_rejected"),
            F.count_if(F.col("_valid")).alias("n_valid")]
    if resolved_col or loaded is not None:
        aggs += [F.count_if(~F.col("_resolved")).alias("n_skipped"), F.count_if(F.col("_resolved")).alias("n_inserted")]
    out = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    # changed_rows of the original load report: min(rows before, rows after).
    return out.withColumn("n_changed", F.least("n_read", "n_valid"))


def reject_reasons(cleaned: DataFrame) -> DataFrame:
    """Count of rejected rows per missing value (a row may count under several)."""
    return (cleaned.select(F.explode("reasons").alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows")))


def load_stats(valid: DataFrame) -> DataFrame:
    """Rows, columns, total, balance, revenue and (negative) expense of a cleaned load."""
    s = F.col("signed_amount")
    return valid.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(valid.columns)).alias("n_columns"),
        F.round(F.coalesce(F.sum("amount"), F.lit(0)), 2).cast("double").alias("total"),
        F.round(F.coalesce(F.sum(s), F.lit(0)), 2).cast("double").alias("balance"),
        F.round(F.coalesce(F.sum(F.when(s > 0, s)), F.lit(0)), 2).cast("double").alias("revenue"),
        F.round(F.coalesce(F.sum(F.when(s < 0, s)), F.lit(0)), 2).cast("double").alias("expenses_signed"),
    )


# Column order of the first-generation cleaner's output (our names); columns that
# are absent are skipped.
LEGACY_ORDER = ["company", "department_code", "department", "owner", "txn_date", "year", "month", "quarter",
                "iso_week", "day_name", "day_of_year", "year_month", "fiscal_year", "txn_type", "expense_type",
                "amount", "signed_amount", "counterparty", "project"]


def legacy_clean(raw: DataFrame) -> DataFrame:
    """The first-generation cleaner, kept for its different rules.

    Encoding repair per column (all or nothing), ISO date only, default expense
    type, exact dedup (on parsed dates, after the default is filled), whitespace collapse that keeps
    blanks as empty text, legacy sign rule, fixed column order. No row is
    rejected.
    """
    from ledgerflow.sources.ledger_csv import repair_mojibake

    df = null_tokens(raw)
    df = repair_mojibake(df)
    df = df.withColumn("txn_date", iso_date(F.trim("date_raw")))
    df = df.withColumn("expense_type", F.coalesce("expense_type", F.lit(EXPENSE_TYPE_DEFAULT)))
    df = df.drop("date_raw").dropDuplicates()
    text_cols = [c for c in NORMALISED if c in df.columns]
    df = df.withColumns({c: collapse_whitespace(c) for c in text_cols})
    df = df.withColumn("amount", parse_amount("amount_raw"))
    df = df.withColumn("signed_amount", signed_amount("amount", "txn_type", rule="legacy"))
    df = df.withColumns(calendar_columns("txn_date"))
    return select_ordered(df, LEGACY_ORDER)
