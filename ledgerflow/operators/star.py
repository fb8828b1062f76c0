"""Star schema: dimension builds and upserts, fact key resolution, flattening.

Dimensions come from ``select distinct`` / ``groupBy`` over the cleaned ledger
(partial aggregation first, so hot members are reduced map-side) and are numbered
with the distributed :func:`ids.assign_ids`, which stores what it numbers. Ids are
BIGINT. Every dimension has one row per natural key and unique ids, so a join of facts to it
never multiplies them. Joins of facts to dimensions go through :func:`dim_join`, which
leaves the choice of a broadcast to checked sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.calendar import calendar_columns
from ledgerflow.functions.labels import counterparty_kind, department_id, expense_category
from ledgerflow.operators.ids import assign_ids, first_per_key, next_id
from ledgerflow.operators.joins import dim_join
from ledgerflow.operators.places import places
from ledgerflow.schemas import MONEY
from ledgerflow.session import mark_stored, materialize

# Total order of ledger rows used for fact numbering, and for "first row seen" without an upload's own order:
# rows tied on all of it are identical, so which one gets which id is irrelevant.
LEDGER_ORDER = ["txn_date", "department", "txn_type", "expense_type", "owner", "counterparty",
                "project", "amount", "signed_amount", "department_code"]


def with_first_seen(ledger: DataFrame, name: str = "_ord") -> DataFrame:
    """``ledger`` with what "first seen" is decided by: the row's place in its upload where it is known
    (``ordinal``), else the ledger order as a struct (the nullable code is made non-null)."""
    if "ordinal" in ledger.columns:
        return ledger.withColumn(name, F.col("ordinal"))
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c == "department_code" else F.col(c) for c in LEDGER_ORDER]
    return ledger.withColumn(name, F.struct(*cols))


# --------------------------------------------------------------------------- full builds

def build_dim_date(ledger: DataFrame, start=1) -> DataFrame:
    dates = ledger.select(F.col("txn_date").alias("date")).where(F.col("date").isNotNull()).distinct()
    dim = assign_ids(dates, ["date"], "date_id", start)
    cal = calendar_columns("date")
    return dim.select("date_id", "date",
                      *[cal[c].alias(c) for c in ["year", "month", "quarter", "fiscal_year", "day_name",
                                                   "iso_week", "day_of_year", "year_month"]])


def build_dim_department(ledger: DataFrame) -> DataFrame:
    """One row per department name; the id is the number inside its code.

    A name with several codes takes the one with the largest number (a code without
    a number, or none, only if it has no other; then the id is null). Of several names with one
    number the first in name order keeps it, the others get the numbers after the largest.
    """
    coded = ledger.where(F.col("department").isNotNull()).select(
        "department", F.struct(department_id("department_code").alias("department_id"), "department_code").alias("c"))
    named = coded.groupBy("department").agg(F.max("c").alias("c")).select("c.department_id", "department", "c.department_code")
    named = materialize(named)  # one row per name, read four times below
    owners = named.where(F.col("department_id").isNotNull()).groupBy("department_id").agg(F.min("department").alias("_owner"))
    ranked = named.join(owners, "department_id", "left")
    first = F.col("department_id").isNull() | (F.col("department") == F.col("_owner"))
    clashing = ranked.where(~first).select("department", "department_code")
    renumbered = assign_ids(clashing, ["department"], "department_id", next_id(named, "department_id"))
    columns = ["department_id", "department", "department_code"]
    return ranked.where(first).select(*columns).unionByName(renumbered.select(*columns))


def build_dim_simple(ledger: DataFrame, col: str, id_col: str, start=1) -> DataFrame:
    d = ledger.select(col).where(F.col(col).isNotNull()).distinct()
    return assign_ids(d, [col], id_col, start).select(id_col, col)


def build_dim_txn_type(ledger: DataFrame) -> DataFrame:
    return build_dim_simple(ledger, "txn_type", "txn_type_id")


def build_dim_expense_type(ledger: DataFrame) -> DataFrame:
    d = build_dim_simple(ledger, "expense_type", "expense_type_id")
    return d.withColumn("category", expense_category("expense_type"))


def build_dim_owner(ledger: DataFrame) -> DataFrame:
    """Full rebuild: one row per owner name, department from the first row seen."""
    first = first_per_key(with_first_seen(ledger.where(F.col("owner").isNotNull())),
                          ["owner"], "_ord", ["department"])
    d = assign_ids(first, ["owner"], "owner_id")
    return d.select("owner_id", "owner", "department")


def build_dim_counterparty(ledger: DataFrame) -> DataFrame:
    """Full rebuild: kind from the first row seen, exact ``Revenu`` test."""
    first = first_per_key(with_first_seen(ledger.where(F.col("counterparty").isNotNull())),
                          ["counterparty"], "_ord", ["txn_type"])
    d = assign_ids(first, ["counterparty"], "counterparty_id")
    return d.select("counterparty_id", "counterparty",
                    counterparty_kind("txn_type", exact=True).alias("kind"))


def project_span(ledger: DataFrame) -> DataFrame:
    """First and last transaction date per project."""
    return (ledger.where(F.col("project").isNotNull()).groupBy("project")
            .agg(F.min("txn_date").alias("start_date"), F.max("txn_date").alias("end_date")))


def build_dim_project(ledger: DataFrame) -> DataFrame:
    d = assign_ids(project_span(ledger), ["project"], "project_id")
    return d.select("project_id", "project", "start_date", "end_date")


def build_dimensions(ledger: DataFrame) -> dict:
    """Builders of the seven dimensions (call each to get its frame)."""
    return {
        "dim_date": lambda: build_dim_date(ledger),
        "dim_department": lambda: build_dim_department(ledger),
        "dim_owner": lambda: build_dim_owner(ledger),
        "dim_txn_type": lambda: build_dim_txn_type(ledger),
        "dim_expense_type": lambda: build_dim_expense_type(ledger),
        "dim_counterparty": lambda: build_dim_counterparty(ledger),
        "dim_project": lambda: build_dim_project(ledger),
    }


# --------------------------------------------------------------------------- incremental upserts

UPLOAD = "upload"  # place of a row's file among the files of one batch, where the batch has several


def _new_members(existing: DataFrame, members: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """Members whose key is not in ``existing``, with ids max+1...: by the file that brings them first, then by key, so that
    several files of one batch give the ids that they give one after another."""
    fresh = members.join(existing.select(*key), on=key, how="left_anti")
    order = [UPLOAD, *key] if UPLOAD in members.columns else key
    kept = [c for c in existing.columns if c != id_col]
    return assign_ids(fresh, order, id_col, next_id(existing, id_col), stored=kept).select(*existing.columns)


def _members(ledger: DataFrame, key: list[str], by_first_file: list | None = None) -> DataFrame:
    """One row per key; with several files, the first one that has it (and aggregates over that file's rows only)."""
    rows = ledger.dropna(subset=key)
    if UPLOAD not in ledger.columns:
        return rows.groupBy(*key).agg(*by_first_file) if by_first_file else rows.select(*key).distinct()
    if not by_first_file:
        return rows.groupBy(*key).agg(F.min(UPLOAD).alias(UPLOAD))
    per_file = rows.groupBy(*key, UPLOAD).agg(*by_first_file)
    values = [c for c in per_file.columns if c not in (*key, UPLOAD)]
    first = per_file.groupBy(*key).agg(F.min(F.struct(UPLOAD, *values)).alias("_first"))
    return first.select(*key, f"_first.{UPLOAD}", *(f"_first.{c}" for c in values))


def new_dates(dim: DataFrame, ledger: DataFrame) -> DataFrame:
    cal = calendar_columns("date")
    members = _members(ledger.withColumnRenamed("txn_date", "date"), ["date"])
    return _new_members(dim, members.withColumns({c: cal[c] for c in dim.columns if c in cal}), ["date"], "date_id")


def new_owners(dim: DataFrame, ledger: DataFrame, owner_key: tuple[str, ...] = ("owner", "department")) -> DataFrame:
    """Owners keyed by (name, department) by default, as the incremental loader does."""
    key = list(owner_key)
    if key == ["owner"]:
        seen = _first_seen_values(ledger.where(F.col("owner").isNotNull()), ["owner"], ["department"])
        return _new_members(dim, seen, key, "owner_id")
    return _new_members(dim, _members(ledger, ["owner", "department"]), key, "owner_id")


def new_counterparties(dim: DataFrame, ledger: DataFrame) -> DataFrame:
    """New counterparties; kind from the first row seen (trimmed, case-insensitive test)."""
    rows = ledger.where(F.col("counterparty").isNotNull() & F.col("txn_type").isNotNull())
    seen = _first_seen_values(rows, ["counterparty"], ["txn_type"])
    return _new_members(dim, seen.withColumn("kind", counterparty_kind("txn_type")).drop("txn_type"), ["counterparty"], "counterparty_id")


def new_projects(dim: DataFrame, ledger: DataFrame) -> DataFrame:
    """New projects with their span in the file that brings them; existing spans are never widened."""
    span = [F.min("txn_date").alias("start_date"), F.max("txn_date").alias("end_date")]
    return _new_members(dim, _members(ledger, ["project"], span), ["project"], "project_id")


def _first_seen_values(rows: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """``cols`` of the first row seen of each key; an upload's ordinal follows the order of its files."""
    first = first_per_key(with_first_seen(rows), key, "_ord", cols)
    if UPLOAD not in rows.columns:
        return first
    return first.join(rows.groupBy(*key).agg(F.min(UPLOAD).alias(UPLOAD)), key)


def _upsert(new):
    """The whole dimension after an insert-only extension: existing rows never change."""
    def upsert(dim: DataFrame, ledger: DataFrame, *options) -> DataFrame:
        return dim.unionByName(new(dim, ledger, *options))
    upsert.__doc__ = new.__doc__
    return upsert


upsert_date, upsert_owner, upsert_counterparty, upsert_project = map(_upsert, (new_dates, new_owners, new_counterparties, new_projects))


# --------------------------------------------------------------------------- facts

FACT_IDS = ["date_id", "department_id", "txn_type_id", "expense_type_id", "owner_id", "counterparty_id",
            "project_id"]


def attach_keys(ledger: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Left-join the cleaned rows to the seven dimensions on their natural keys."""
    df = ledger
    df = dim_join(df, dims["dim_date"].select(F.col("date").alias("txn_date"), "date_id"), "txn_date")
    df = dim_join(df, dims["dim_department"].select("department", "department_id"), "department")
    df = dim_join(df, dims["dim_txn_type"].select("txn_type", "txn_type_id"), "txn_type")
    df = dim_join(df, dims["dim_expense_type"].select("expense_type", "expense_type_id"), "expense_type")
    owner_cols = ["owner", "department"] if "department" in dims["dim_owner"].columns else ["owner"]
    df = dim_join(df, dims["dim_owner"].select(*owner_cols, "owner_id"), owner_cols)
    df = dim_join(df, dims["dim_counterparty"].select("counterparty", "counterparty_id"), "counterparty")
    df = dim_join(df, dims["dim_project"].select("project", "project_id"), "project")
    return df


def resolve_keys(ledger: DataFrame, dims: dict[str, DataFrame], strict: bool = True,
                 owner_by_name: bool = False) -> DataFrame:
    """Rows with their seven dimension ids and a ``resolved`` flag.

    ``strict``: resolved means every id was found (the incremental loader skips the
    rest). Lenient (full rebuild): only a missing date id drops the row.
    """
    if owner_by_name:
        dims = dict(dims)
        dims["dim_owner"] = dims["dim_owner"].select("owner", "owner_id")
    df = attach_keys(ledger, dims)
    if strict:
        ok = F.lit(True)
        for c in FACT_IDS:
            ok = ok & F.col(c).isNotNull()
    else:
        ok = F.col("date_id").isNotNull()
    return df.withColumn("resolved", ok)


FACT_COLUMNS = [*FACT_IDS, "amount", "signed_amount"]  # as stored; the fact's own id is its place


def facts_from_resolved(resolved: DataFrame, start=1, ordered: bool = True, folders: tuple[str, str] | None = None) -> DataFrame:
    """Resolved rows -> fact rows numbered from ``start``.

    ``ordered`` numbers in ledger order (one range shuffle of the facts, ids
    reproducible row by row); ``ordered=False`` numbers in partition order of the
    materialized input (no shuffle), for loads where only gap-free ids matter. ``folders``: where the facts
    and their files' offsets are stored for good. Rows of :func:`places.place_rows` are dealt as they are, narrow.
    """
    how = places(resolved)
    if how is not None:
        rows = resolved.where("resolved").drop(UPLOAD, "resolved")
        kept = [*(F.col(c).cast("long").alias(c) for c in FACT_IDS), F.round("amount", 2).cast(MONEY).alias("amount"), how.signed().alias("signed_amount")]
        numbered = assign_ids(rows, how.order() if ordered else None, "transaction_id", start, stored=kept, folders=folders, dealt=how.with_ids)
        return mark_stored(numbered.select("transaction_id", *FACT_COLUMNS))
    first = [UPLOAD] if UPLOAD in resolved.columns else []  # several files are numbered one after another
    rows = resolved.where(F.col("resolved")).select(
        *first, *LEDGER_ORDER[:-3], "department_code", *[F.col(c).cast("long").alias(c) for c in FACT_IDS],
        F.col("amount").alias("_exact"), F.round("amount", 2).cast(MONEY).alias("amount"),
        F.col("signed_amount").cast(MONEY).alias("signed_amount"))
    order = [*first, *LEDGER_ORDER[:-3], "_exact", "signed_amount", "department_code"]
    numbered = assign_ids(rows, order if ordered else None, "transaction_id", start, stored=FACT_COLUMNS, folders=folders)
    return mark_stored(numbered.select("transaction_id", *FACT_COLUMNS))


def load_facts(existing: DataFrame | None, resolved: DataFrame, replace: bool = True,
               ordered: bool = True) -> DataFrame:
    """Replace: new facts numbered from 1. Append: existing + new numbered from max+1."""
    if replace or existing is None:
        return facts_from_resolved(resolved, 1, ordered)
    new = facts_from_resolved(resolved, next_id(existing, "transaction_id"), ordered)
    return mark_stored(existing.unionByName(new.select(*existing.columns)))


def facts_with_year(facts: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Facts with the year of their date, for a table partitioned by it."""
    return dim_join(facts, dim_date.select("date_id", "year"), "date_id")


# --------------------------------------------------------------------------- flatten

def flatten_star(facts: DataFrame, dims: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """All facts with their seven dimensions (left joins), newest first.

    ``limit`` makes it the newest-N report (``FLATTEN_LIMIT`` rows in the application). Then
    a per-date count (one row per date) gives the oldest date that can still be in
    the newest N, and facts older than that are filtered out, so the top-N operator
    only sees about N rows instead of the whole table.
    """
    d = dims["dim_date"].select("date_id", "date", "year", "month", "quarter", "year_month")
    f = facts
    if limit is not None:
        f = _newest_candidates(facts, d, limit)
    df = dim_join(f, d, "date_id")
    df = dim_join(df, dims["dim_department"].select("department_id", "department"), "department_id")
    df = dim_join(df, dims["dim_txn_type"], "txn_type_id")
    df = dim_join(df, dims["dim_expense_type"].select("expense_type_id", "expense_type"), "expense_type_id")
    df = dim_join(df, dims["dim_owner"].select("owner_id", "owner"), "owner_id")
    df = dim_join(df, dims["dim_counterparty"].select("counterparty_id", "counterparty",
                                                      F.col("kind").alias("counterparty_kind")), "counterparty_id")
    df = dim_join(df, dims["dim_project"].select("project_id", "project"), "project_id")
    out = df.select(
        "transaction_id", F.col("amount").cast("double").alias("amount"),
        F.col("signed_amount").cast("double").alias("signed_amount"),
        "date", "year", "month", "quarter", "year_month", "department", "txn_type", "expense_type",
        "owner", "counterparty", "counterparty_kind", "project")
    order = [F.desc_nulls_last("date"), F.asc("transaction_id")]
    return out.orderBy(*order).limit(limit) if limit is not None else out.orderBy(*order)


def _newest_candidates(facts: DataFrame, dim_date: DataFrame, limit: int) -> DataFrame:
    """Facts whose date is among the dates that can hold the newest ``limit`` rows."""
    from pyspark.sql import Window
    per_date = facts.groupBy("date_id").agg(F.count(F.lit(1)).alias("_n"))
    per_date = dim_join(per_date, dim_date.select("date_id", "date"), "date_id")
    # One row per date: the window is bounded by the number of calendar days.
    w = Window.orderBy(F.desc_nulls_last("date"), F.asc("date_id")).rowsBetween(Window.unboundedPreceding, -1)
    before = per_date.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    keep = before.where(F.col("_before") < F.lit(limit)).select(F.col("date_id").alias("_kd"))
    # Null-safe: facts without a date (ordered last) stay when the newest N reach them.
    return facts.join(F.broadcast(keep), facts["date_id"].eqNullSafe(keep["_kd"]), "left_semi")


def kpi_base(facts: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Facts with date, department, transaction type and expense type (for the KPI refresh)."""
    df = dim_join(facts, dims["dim_date"].select("date_id", "year", "quarter", "year_month"), "date_id")
    df = dim_join(df, dims["dim_department"].select("department_id", "department"), "department_id")
    df = dim_join(df, dims["dim_txn_type"], "txn_type_id")
    df = dim_join(df, dims["dim_expense_type"].select("expense_type_id", "expense_type"), "expense_type_id")
    return df.select("amount", "signed_amount", "year", "quarter", "year_month", "department",
                     "department_id", "txn_type", "expense_type")
