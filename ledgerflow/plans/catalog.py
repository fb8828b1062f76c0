"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the test-data tables through ``sources.binding`` and runs the
library's operators over the whole tables. The star-schema queries share one load
scenario, as the application is used:

1. the standalone rebuild builds the star from a first upload (the ledger rows
   dated before 1997);
2. the upload path then loads the whole ledger into it (dimensions extended
   insert-only, facts replaced), and the KPI refresh of each state is merged
   into the KPI store.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions import jsonval as J
from ledgerflow.functions import labels as L
from ledgerflow.functions import money as M
from ledgerflow.functions import text as T
from ledgerflow.operators import assistant as A
from ledgerflow.operators import clean as C
from ledgerflow.operators import history as H
from ledgerflow.operators import kpi as K
from ledgerflow.operators import refresh as R
from ledgerflow.operators import sketches as Sk
from ledgerflow.operators import star as St
from ledgerflow.operators import store as S
from ledgerflow.operators import users as U
from ledgerflow.operators.ids import first_per_key
from ledgerflow.operators.pages import paged
from ledgerflow.operators.temporal import as_of_join, overlap_join
from ledgerflow.plans import etl_load as E
from ledgerflow.schemas import FLATTEN_LIMIT, UPLOAD_TO_LEDGER
from ledgerflow.session import mark_stored, materialize
from ledgerflow.sources import binding as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Scenario parameters.
FIRST_UPLOAD_END = _dt.date(1997, 1, 1)
STORE_T0 = _dt.datetime(2024, 1, 1, 0, 0, 0)
STORE_T1 = _dt.datetime(2024, 6, 1, 0, 0, 0)
STATS_NOW = _dt.datetime(2024, 1, 2, 18, 0, 0)
REPORT_MONTH = "1996-03"
REPORT_DEPARTMENT = 5
SEARCH_TEXT = "nom1"
SEARCH_PAGE = 2
SCOPE_USER = 7
FORECAST_DEPARTMENT = 3
KPI_LOOKUP_NAME = "CA_Mensuel"
KEYWORD = "revenu"
AUDIT_AT = _dt.datetime(2024, 3, 1, 9, 30, 0)


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


_MEMO: dict[tuple, object] = {}


def _memo(spark: SparkSession, sf_dir: str, key: str, build):
    """Reuse a built piece (whose ids are checkpointed) across queries of one session."""
    k = (spark.sparkContext.applicationId, sf_dir, key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def clear_memo() -> None:
    _MEMO.clear()


def raw(spark, sf_dir) -> DataFrame:
    """The uploaded ledger file: the binding written once per session (an upload is
    a stored file, not a join recomputed by every job that reads it)."""
    return raw_ordered(spark, sf_dir).drop("ordinal")


def raw_ordered(spark, sf_dir) -> DataFrame:
    """The upload with the place of every row in it."""
    return _memo(spark, sf_dir, "raw", lambda: materialize(B.ledger_raw(spark, sf_dir, ordinal=True)))


LEDGER_YEAR = "year_folder"  # folders of the cleaned rows: the year of a valid row, one more folder for the rejected ones


def _cleaned_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned rows as they are stored, one folder a year. What follows from a row's other values (its calendar, the sign of its amount, its
    reasons) is not written but computed when read, by the cleaner's own rules; most readers take few of these columns."""
    def build():
        rows = C.clean_ledger(raw_ordered(spark, sf_dir), with_copies=True)
        stored = rows.drop(*C.derived_columns()).withColumn(LEDGER_YEAR, F.when(C.has_required(), F.year("txn_date")))
        return mark_stored(materialize(stored, partition_by=[LEDGER_YEAR]).withColumns(C.derived_columns()).select(*rows.columns, LEDGER_YEAR))
    return _memo(spark, sf_dir, "cleaned", build)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning job's output: every deduplicated upload row, parsed, with its
    copy count and rejection reasons. Written once per session; the valid ledger,
    the rejected rows and the quality counters all read it."""
    return mark_stored(_cleaned_by_year(spark, sf_dir).drop(LEDGER_YEAR))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cleaned ledger: valid rows of the test-data upload.

    The cleaning job writes it once per session to the checkpoint folder, valid rows by their year and apart from the
    rejected ones; reports and loads read it, as the application's reports read the
    stored transactions rather than re-cleaning the upload.
    """
    return ledger_ordered(spark, sf_dir).select(*C.CLEAN_COLUMNS)


def ledger_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cleaned ledger with each row's place in the upload ("first seen" is decided by it). Its folders are those
    of the valid rows, so that the year of a row is the name of its folder, no second copy of the rows is written, and a reader takes no
    column to know that a row is valid."""
    valid = _cleaned_by_year(spark, sf_dir).where(F.col(LEDGER_YEAR).isNotNull()).withColumn("year", F.col(LEDGER_YEAR))
    return mark_stored(valid.select(*C.CLEAN_COLUMNS, C.ORDINAL))


def first_upload(spark, sf_dir) -> DataFrame:
    return mark_stored(ledger_ordered(spark, sf_dir).where(F.col("txn_date") < F.lit(FIRST_UPLOAD_END)))


def star1(spark, sf_dir) -> E.Star:
    return _memo(spark, sf_dir, "star1", lambda: E.rebuild_star(first_upload(spark, sf_dir)))


def load2(spark, sf_dir) -> E.LoadResult:
    return _memo(spark, sf_dir, "load2", lambda: E.load_upload(star1(spark, sf_dir), ledger_ordered(spark, sf_dir), True))


def store1(spark, sf_dir) -> DataFrame:
    return _memo(spark, sf_dir, "store1",
                 lambda: S.initial_store(E.refresh_from_star(star1(spark, sf_dir)), STORE_T0))


def merged(spark, sf_dir):
    return _memo(spark, sf_dir, "merged",
                 lambda: E.refresh_and_merge(store1(spark, sf_dir), load2(spark, sf_dir).star, STORE_T1))


def kpi_base2(spark, sf_dir) -> DataFrame:
    def build():
        st = load2(spark, sf_dir).star
        return St.kpi_base(st.facts, st.dims)
    return _memo(spark, sf_dir, "kpi_base2", build)


def shared_folder(spark: SparkSession, *parts: str) -> str:
    """A path under the session's reliable checkpoint folder (shared storage)."""
    import os
    from ledgerflow.session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def _sf_name(sf_dir: str) -> str:
    import os
    return os.path.basename(os.path.normpath(sf_dir))


# ------------------------------------------------------------------ A. sources

@query("ledger_csv_roundtrip")
def q_ledger_csv_roundtrip(spark, sf_dir):
    """The upload written as CSV files and read back through the encoding-aware reader."""
    from ledgerflow.sources.ledger_csv import read_ledger_csv, write_ledger_csv

    def build():
        path = shared_folder(spark, "uploads", _sf_name(sf_dir), "ledger_csv")
        write_ledger_csv(raw(spark, sf_dir), path)
        return path
    path = _memo(spark, sf_dir, "ledger_csv", build)
    return T.null_tokens(read_ledger_csv(spark, path + "/*.csv"))


@query("ledger_csv_mixed")
def q_ledger_csv_mixed(spark, sf_dir):
    """One upload in three files: UTF-8, Latin-1 with another column order, and quoted values with line ends."""
    from ledgerflow.sources.ledger_csv import read_ledger_csv, write_ledger_csv

    def build():
        r, path = raw(spark, sf_dir), shared_folder(spark, "uploads", _sf_name(sf_dir), "ledger_mixed")
        kind = F.right(F.col("project"), F.lit(1)).cast("int")
        write_ledger_csv(r.where(kind <= 2), path + "/a")
        plain = r.where(kind.between(3, 4)).withColumn("amount_raw", F.replace("amount_raw", F.lit("€ "), F.lit("")))
        write_ledger_csv(plain.select(*reversed(r.columns)), path + "/b", encoding="ISO-8859-1")
        quoted = F.concat(F.col("owner"), F.lit(' "q"\n'), F.col("project"))
        write_ledger_csv(r.where(kind >= 5).withColumn("owner", quoted), path + "/c")
        return path
    path = _memo(spark, sf_dir, "ledger_mixed", build)
    return T.null_tokens(read_ledger_csv(spark, path + "/*/*.csv")).select(*raw(spark, sf_dir).columns)


# The files of one batch: which rows (by the last digit of their project) and how each writes its dates.
BATCH_FILES = [("0_iso", (0, 3), "yyyy-MM-dd"), ("1_day_first", (2, 6), "dd/MM/yyyy"), ("2_month_first", (5, 9), "MM/dd/yyyy"),
               ("3_lacking", (0, 9), "yyyy-MM-dd")]


def batch_files(spark, sf_dir) -> list[str]:
    """The upload dealt into files that share rows, write their dates in different orders, and one that lacks a required column.
    Each is a folder of compressed parts, so that many tasks write and read it."""
    from ledgerflow.sources.ledger_csv import write_ledger_csv

    def build():
        r, out = raw(spark, sf_dir), []
        digit, day = F.right(F.trim("project"), F.lit(1)).try_cast("int"), F.to_date(F.try_to_timestamp(F.trim("date_raw"), F.lit("yyyy-MM-dd")))
        names = {own: name for name, own in UPLOAD_TO_LEDGER.items()}
        for name, (low, high), fmt in BATCH_FILES:
            path = shared_folder(spark, "uploads", _sf_name(sf_dir), "batch", name)
            text = F.coalesce(F.date_format(day, fmt), F.col("date_raw"))
            rows = r.where(F.coalesce(digit, F.lit(0)).between(low, high)).withColumn("date_raw", text)
            kept = [c for c in r.columns if name != "3_lacking" or c != "project"]
            write_ledger_csv(rows.select(*(F.col(c).alias(names[c]) for c in kept)), path, compression="gzip")
            out.append(path)
        return out
    return _memo(spark, sf_dir, "batch_files", build)


@query("uploads_by_file")
def q_uploads_by_file(spark, sf_dir):
    """The valid rows of several files read as one batch, each cleaned as an upload of its own: the file, the typed values, the copies."""
    from ledgerflow.sources.ledger_csv import read_uploads

    cleaned = C.clean_uploads(read_uploads(spark, batch_files(spark, sf_dir)).rows)
    return cleaned.where(F.size("reasons") == 0).select("upload", "txn_date", "department", "txn_type", "owner", "counterparty", "project",
                                                        "amount", C.COPIES)


@query("star_appended")
def q_star_appended(spark, sf_dir):
    """Facts read from the append log after two batches of files: the first file builds the star, the others extend it."""
    from ledgerflow.streaming.uploads import load_batch, read_star

    def build():
        base, paths = shared_folder(spark, "star-log", _sf_name(sf_dir)), batch_files(spark, sf_dir)
        for number, files in enumerate((paths[:2], paths[2:])):
            load_batch(spark.createDataFrame([(k, f) for k, f in enumerate(files)], "modificationTime int, path string"), number,
                       f"{base}/star", f"{base}/history")
        return base
    base = _memo(spark, sf_dir, "star_appended", build)
    star = read_star(spark, f"{base}/star")
    days = star.facts.join(star.dims["dim_date"].select("date_id", "date"), "date_id")
    return days.select("transaction_id", "date", "amount", "signed_amount")


@query("upload_columns")
def q_upload_columns(spark, sf_dir):
    """An upload with the application's column names, blanks around them, checked and renamed."""
    r = raw(spark, sf_dir)
    return C.upload_to_ledger(r.select(*(F.col(own).alias(f" {name} ") for name, own in UPLOAD_TO_LEDGER.items())))


@query("upload_preview")
def q_upload_preview(spark, sf_dir):
    from ledgerflow.sources.ledger_csv import preview
    columns, n, first = preview(raw(spark, sf_dir), 5)
    return first.agg(F.lit(",".join(columns)).alias("columns"), F.lit(n).cast("long").alias("n_rows"),
                     F.count(F.lit(1)).alias("n_shown"))


@query("upload_stage")
def q_upload_stage(spark, sf_dir):
    from ledgerflow.sources.ledger_csv import stage
    both = [stage(raw(spark, sf_dir), ledger(spark, sf_dir), w).agg(
        F.lit(w).alias("stage"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("project").alias("n_projects"))
        for w in ("before", "after")]
    return both[0].unionByName(both[1])


@query("star_written")
def q_star_written(spark, sf_dir):
    """The star written (facts by year) and its facts read back."""
    from ledgerflow.sources.tables import read_table, write_star

    def build():
        path, star = shared_folder(spark, "tables", _sf_name(sf_dir), "star"), load2(spark, sf_dir).star
        write_star({**star.tables(), "fact_transactions": St.facts_with_year(star.facts, star.dims["dim_date"])}, path)
        return path
    path = _memo(spark, sf_dir, "star_written", build)
    return read_table(spark, path, "fact_transactions")


@query("dates_parsed")
def q_dates_parsed(spark, sf_dir):
    """The upload's dates written day first, some with times and fractions, parsed as the whole upload is found to be."""
    from ledgerflow.functions import calendar as D
    day = F.try_to_timestamp("date_raw", F.lit("yyyy-MM-dd"))
    text = (F.when(F.dayofmonth(day) % 4 == 0, F.date_format(day, "yyyy-MM-dd'T'10:00:00.123"))
            .when(F.dayofmonth(day) % 4 == 1, F.date_format(day, "dd.MM.yyyy"))
            .when(F.dayofmonth(day) % 4 == 2, F.date_format(day, "d/M/yyyy 8:05"))
            .when(day.isNotNull(), F.date_format(day, "dd/MM/yyyy")).otherwise(F.col("date_raw")))
    r = raw(spark, sf_dir).select(text.alias("date_raw"))
    return r.select("date_raw", D.parse_date("date_raw", D.date_formats(D.detect_day_first(r))).alias("txn_date"))


@query("amounts_wide")
def q_amounts_wide(spark, sf_dir):
    """Amounts of four decimals and of more than 10^15, parsed and rounded once."""
    text = F.concat(F.when(F.col("department_code") == "DEPT003", F.lit("9999999999")).otherwise(F.lit("")),
                    F.regexp_replace("amount_raw", "[.,]", ".00"))
    amount = M.parse_amount(text)
    return raw(spark, sf_dir).select(text.alias("amount_raw"), amount.alias("amount"),
                                     F.round(amount, 2).cast("decimal(28,6)").alias("stored"))


@query("kpi_batch_saved")
def q_kpi_batch_saved(spark, sf_dir):
    """A caller's plain batch (name, period, value) saved over the store."""
    batch = K.kpi_monthly(ledger(spark, sf_dir)).select(
        F.lit(KPI_LOOKUP_NAME).alias("kpi_name"), F.col("month").alias("period"), F.col("revenue").cast("double").alias("value"))
    store, _ = S.merge_kpis(merged(spark, sf_dir)[0], batch, True, STORE_T1, source="saved")
    return store.where(F.col("kpi_name") == KPI_LOOKUP_NAME).select("kpi_name", "period", "value", "source")


@query("kpi_report_filtered")
def q_kpi_report_filtered(spark, sf_dir):
    """The six parts of the report under a period and a department, one line per value."""
    rep = K.kpi_report(ledger(spark, sf_dir), REPORT_MONTH, REPORT_DEPARTMENT)

    def part(name, key, value):
        return rep[name].select(F.lit(name).alias("part"), F.col(key).cast("string").alias("key") if key else
                                F.lit("").alias("key"), F.col(value).cast("double").alias("value"))
    parts = [part("kpis", None, "net_balance"), part("by_department", "department_id", "balance"),
             part("monthly", "month", "running_balance"), part("top_expense_types", "expense_type", "total_amount"),
             part("top_projects", "project", "total_amount"), part("top_counterparties", "counterparty", "total_amount")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("period_filter_stored")
def q_period_filter_stored(spark, sf_dir):
    """The period report over the stored clean table (Parquet, partitioned by year):
    the date range prunes partitions and reaches the scan as pushed filters."""
    from ledgerflow.sources.tables import read_clean, write_clean

    def build():
        path = shared_folder(spark, "tables", _sf_name(sf_dir), "ledger_clean")
        write_clean(ledger(spark, sf_dir), path)
        return path
    path = _memo(spark, sf_dir, "ledger_clean_table", build)
    return K.kpi_global(K.in_period(read_clean(spark, path), REPORT_MONTH))


@query("null_tokens")
def q_null_tokens(spark, sf_dir):
    return T.null_tokens(raw(spark, sf_dir))


# ------------------------------------------------------------------ B. scalar functions

@query("amount_parse")
def q_amount_parse(spark, sf_dir):
    r = T.null_tokens(raw(spark, sf_dir))
    return r.select("amount_raw", M.parse_amount("amount_raw").alias("amount"))


@query("text_normalize")
def q_text_normalize(spark, sf_dir):
    r = raw(spark, sf_dir)
    return r.select(F.col("department").alias("text_raw"), T.normalize_text("department").alias("text"),
                    F.col("owner").alias("owner_raw"), T.normalize_text("owner").alias("owner"))


@query("signed_amount")
def q_signed_amount(spark, sf_dir):
    return ledger(spark, sf_dir).select("txn_type", "amount", "signed_amount")


@query("signed_amount_legacy")
def q_signed_amount_legacy(spark, sf_dir):
    led = ledger(spark, sf_dir)
    legacy = M.signed_amount("amount", "txn_type", rule="legacy")
    return led.select("txn_type", "amount", legacy.alias("signed_legacy"),
                      M.sign_label("txn_type").alias("sign_label"))


@query("calendar_attributes")
def q_calendar(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return led.select("txn_date", "year", "month", "quarter", "iso_week", "day_name", "day_of_year",
                      "year_month", "fiscal_year")


@query("department_id")
def q_department_id(spark, sf_dir):
    r = raw(spark, sf_dir)
    return r.select("department_code", L.department_id("department_code").alias("department_id"))


@query("expense_category")
def q_expense_category(spark, sf_dir):
    return St.build_dim_expense_type(ledger(spark, sf_dir)).select("expense_type", "category")


@query("display_name")
def q_display_name(spark, sf_dir):
    u = B.users(spark, sf_dir)
    return u.select("id", L.display_name("firstname", "lastname", "email").alias("display_name"))


@query("json_payload")
def q_json_payload(spark, sf_dir):
    f = S.forecast_values(B.forecasts(spark, sf_dir))
    return f.select("id", F.try_variant_get("results_json", "$.k", "int").alias("k"),
                    F.col("results_json").isNotNull().alias("is_json"))


@query("json_safe")
def q_json_safe(spark, sf_dir):
    rep = K.kpi_by_department(ledger(spark, sf_dir))
    ratio = F.try_divide(F.col("revenue"), F.col("expenses"))
    return J.to_json_record(rep.select("department_id", "n_transactions", ratio.alias("ratio")), "json")


# ------------------------------------------------------------------ C. filters

@query("reject_invalid")
def q_reject_invalid(spark, sf_dir):
    _, rejected = C.split_valid(cleaned(spark, sf_dir))
    return rejected.select("date_raw", "amount_raw", "department", "txn_type", "owner", "counterparty",
                           "project", "reasons")


@query("dedup_exact")
def q_dedup_exact(spark, sf_dir):
    return C.drop_exact_duplicates(T.null_tokens(raw(spark, sf_dir)))


@query("period_filter")
def q_period_filter(spark, sf_dir):
    return K.kpi_global(K.in_period(ledger(spark, sf_dir), REPORT_MONTH))


@query("department_filter")
def q_department_filter(spark, sf_dir):
    return K.kpi_global(K.in_department(ledger(spark, sf_dir), REPORT_DEPARTMENT))


@query("kpi_lookup")
def q_kpi_lookup(spark, sf_dir):
    store, _ = merged(spark, sf_dir)
    return S.kpi_lookup(store, KPI_LOOKUP_NAME)


@query("forecast_read")
def q_forecast_read(spark, sf_dir):
    f = S.read_forecasts(B.forecasts(spark, sf_dir), FORECAST_DEPARTMENT)
    return f.select("id", "type", "start_date", "end_date", "department_id", "created_by", "created_at")


@query("history_scope_admin")
def q_history_scope_admin(spark, sf_dir):
    h = H.history_with_users(B.import_history(spark, sf_dir), B.users(spark, sf_dir))
    return H.scope_history(h, SCOPE_USER, "admin").select("id", "user_id", "user_name", "imported_at")


@query("history_scope_user")
def q_history_scope_user(spark, sf_dir):
    h = H.history_with_users(B.import_history(spark, sf_dir), B.users(spark, sf_dir))
    return H.scope_history(h, SCOPE_USER, "user").select("id", "user_id", "user_name", "imported_at")


# ------------------------------------------------------------------ D. joins / star

def _dim_query(name: str, dim_key: str, source):
    @query(name)
    def q(spark, sf_dir):
        return source(spark, sf_dir)[dim_key]
    return q


_dim_query("dim_upsert_date", "dim_date", lambda s, d: load2(s, d).star.dims)
_dim_query("dim_upsert_owner", "dim_owner", lambda s, d: load2(s, d).star.dims)
_dim_query("dim_upsert_counterparty", "dim_counterparty", lambda s, d: load2(s, d).star.dims)
_dim_query("dim_upsert_project", "dim_project", lambda s, d: load2(s, d).star.dims)


def _full_dim(name: str, builder):
    @query(name)
    def q(spark, sf_dir):
        return builder(ledger_ordered(spark, sf_dir))
    return q


_full_dim("dim_date", St.build_dim_date)
_full_dim("dim_owner", St.build_dim_owner)
_full_dim("dim_counterparty", St.build_dim_counterparty)
_full_dim("dim_project", St.build_dim_project)


@query("dim_department")
def q_dim_department(spark, sf_dir):
    return St.build_dim_department(ledger(spark, sf_dir))


@query("dim_txn_type")
def q_dim_txn_type(spark, sf_dir):
    return St.build_dim_txn_type(ledger(spark, sf_dir))


@query("dim_expense_type")
def q_dim_expense_type(spark, sf_dir):
    return St.build_dim_expense_type(ledger(spark, sf_dir))


@query("fact_load")
def q_fact_load(spark, sf_dir):
    return load2(spark, sf_dir).star.facts


@query("fact_load_lenient")
def q_fact_load_lenient(spark, sf_dir):
    return E.rebuild_star(ledger_ordered(spark, sf_dir)).facts


@query("fact_append")
def q_fact_append(spark, sf_dir):
    return St.load_facts(star1(spark, sf_dir).facts, load2(spark, sf_dir).resolved, replace=False)


@query("star_flatten")
def q_star_flatten(spark, sf_dir):
    st = load2(spark, sf_dir).star
    return St.flatten_star(st.facts, st.dims)


@query("star_flatten_newest")
def q_star_flatten_newest(spark, sf_dir):
    """The application's report: the newest rows only."""
    st = load2(spark, sf_dir).star
    return St.flatten_star(st.facts, st.dims, FLATTEN_LIMIT)


def recoded(spark, sf_dir) -> DataFrame:
    """The ledger with blank and second department codes, and two names that share a number."""
    led, day = ledger(spark, sf_dir), F.col("day_of_year")
    code = (F.when(day % 5 == 0, F.lit(None)).when(day % 7 == 0, F.concat("department_code", F.lit("0")))
            .when(F.col("department").isin("NATION 3", "NATION 9"), F.lit("DEPT777")).otherwise(F.col("department_code")))
    return led.withColumn("department_code", code)


@query("dim_department_recoded")
def q_dim_department_recoded(spark, sf_dir):
    return St.build_dim_department(recoded(spark, sf_dir))


@query("facts_recoded")
def q_facts_recoded(spark, sf_dir):
    """Facts of the recoded ledger per department id: as many as there are valid rows."""
    led = recoded(spark, sf_dir)
    star = E.rebuild_star(led)
    return star.facts.groupBy("department_id").agg(
        F.count(F.lit(1)).alias("n_facts"), F.sum("amount").cast("double").alias("amount"))


@query("kpi_base")
def q_kpi_base(spark, sf_dir):
    return kpi_base2(spark, sf_dir)


@query("history_users")
def q_history_users(spark, sf_dir):
    h = H.history_with_users(B.import_history(spark, sf_dir), B.users(spark, sf_dir))
    return h.select("id", "user_id", "firstname", "lastname", "email", "user_name")


# ------------------------------------------------------------------ E. aggregations

@query("kpi_global")
def q_kpi_global(spark, sf_dir):
    return K.kpi_global(ledger(spark, sf_dir))


@query("kpi_by_department")
def q_kpi_by_department(spark, sf_dir):
    return K.kpi_by_department(ledger(spark, sf_dir))


@query("kpi_monthly")
def q_kpi_monthly(spark, sf_dir):
    return K.kpi_monthly_balance(ledger(spark, sf_dir))


@query("top_expense_types")
def q_top_expense_types(spark, sf_dir):
    return K.top_expense_types(ledger(spark, sf_dir))


@query("top_projects")
def q_top_projects(spark, sf_dir):
    return K.top_projects(ledger(spark, sf_dir))


@query("top_counterparties")
def q_top_counterparties(spark, sf_dir):
    return K.top_counterparties(ledger(spark, sf_dir))


@query("load_stats")
def q_load_stats(spark, sf_dir):
    return C.load_stats(ledger(spark, sf_dir))


@query("legacy_clean")
def q_legacy_clean(spark, sf_dir):
    return C.legacy_clean(raw(spark, sf_dir))


@query("email_user")
def q_email_user(spark, sf_dir):
    u = B.users(spark, sf_dir)
    return u.select("id", T.normalize_email("email").alias("email"), T.email_user(T.normalize_email("email")).alias("user"))


@query("import_audit")
def q_import_audit(spark, sf_dir):
    counters = E.quality_report(cleaned(spark, sf_dir), resolved=load2(spark, sf_dir).resolved)
    return H.audit_row(counters, 1, "ledger.csv", AUDIT_AT, "Finance", "importer1").drop("id", "details", "data")


@query("audit_detail")
def q_audit_detail(spark, sf_dir):
    """An audit row with messages and stored rows, written, and its detail read back."""
    def build():
        counters = E.quality_report(cleaned(spark, sf_dir), resolved=load2(spark, sf_dir).resolved)
        rows = ledger(spark, sf_dir).select("txn_date", "department", "amount", "department_code", "owner", "counterparty")
        row = H.audit_row(counters, 1, "ledger.csv", AUDIT_AT, "Finance", "importer1", details=["version 1", "5 rows kept"],
                          data=H.audit_data(rows, rows.columns), row_id=12)
        return materialize(row)
    audit = _memo(spark, sf_dir, "audit", build)
    return H.history_detail(audit).join(audit.select("id", F.array_join("details", "; ").alias("details")), "id").select(
        "id", "n_rows", "n_errors", "status", "details", F.array_join("columns", ",").alias("columns"), "rows_count", "preview")


@query("quality_counters")
def q_quality_counters(spark, sf_dir):
    return E.quality_report(cleaned(spark, sf_dir), load2(spark, sf_dir).star)


@query("reject_reasons")
def q_reject_reasons(spark, sf_dir):
    return C.reject_reasons(cleaned(spark, sf_dir))


def _refresh_query(name: str, fn):
    @query(name)
    def q(spark, sf_dir):
        return fn(kpi_base2(spark, sf_dir)).drop("part", "position")
    return q


_refresh_query("refresh_global", R.refresh_global)
_refresh_query("refresh_quarter", R.refresh_quarter)
_refresh_query("refresh_department", R.refresh_department)
_refresh_query("refresh_txn_type", R.refresh_txn_type)
_refresh_query("refresh_expense_type", R.refresh_expense_type)
_refresh_query("monthly_evolution", R.monthly_evolution)


@query("project_span")
def q_project_span(spark, sf_dir):
    return St.project_span(ledger(spark, sf_dir))


@query("user_stats")
def q_user_stats(spark, sf_dir):
    return U.user_stats(B.users(spark, sf_dir), STATS_NOW)


@query("registrations_daily")
def q_registrations_daily(spark, sf_dir):
    return U.registrations_daily(B.users(spark, sf_dir))


@query("login_split")
def q_login_split(spark, sf_dir):
    return U.login_split(B.users(spark, sf_dir))


@query("activity_weekly")
def q_activity_weekly(spark, sf_dir):
    return U.activity_weekly(B.activity(spark, sf_dir))


@query("activity_weekly_sketched")
def q_activity_weekly_sketched(spark, sf_dir):
    """Weekly active users from stored daily sketches."""
    day = {"day": F.to_date("ts")}
    daily = _memo(spark, sf_dir, "user_sketches", lambda: materialize(Sk.distinct_sketches(B.activity(spark, sf_dir), day, "user_id")))
    return Sk.distinct_counts(daily, {"week_start": F.to_date(F.date_trunc("week", "day"))}).withColumnRenamed("n_distinct", "active_users")


@query("amount_medians")
def q_amount_medians(spark, sf_dir):
    """Quartiles of the amounts per department and month, from stored weekly sketches."""
    week = {"department": F.col("department"), "year_month": F.col("year_month"), "iso_week": F.col("iso_week")}
    weekly = _memo(spark, sf_dir, "amount_sketches", lambda: materialize(Sk.quantile_sketches(ledger(spark, sf_dir), week, F.col("amount"))))
    out = Sk.quantiles(weekly, {k: F.col(k) for k in ("department", "year_month")}, [0.25, 0.5, 0.75])
    return out.select("department", "year_month", "n", *(F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(("low", "median", "high"))))


@query("kpi_keyword_total")
def q_kpi_keyword_total(spark, sf_dir):
    store, _ = merged(spark, sf_dir)
    return A.kpi_keyword_total(store, KEYWORD)


@query("history_groups")
def q_history_groups(spark, sf_dir):
    h = H.history_with_users(B.import_history(spark, sf_dir), B.users(spark, sf_dir))
    return H.history_groups(h).select("user_name", "item_no", "id", "imported_at_label", "status", "data")


# ------------------------------------------------------------------ F. windows

@query("first_per_key")
def q_first_per_key(spark, sf_dir):
    return first_per_key(ledger_ordered(spark, sf_dir), ["owner"], C.ORDINAL, ["department", "txn_date"])


# ------------------------------------------------------------------ G. top-k / paging

@query("latest_n")
def q_latest_n(spark, sf_dir):
    return H.latest_history(B.import_history(spark, sf_dir)).select("id", "user_id", "imported_at", "status")


@query("users_page")
def q_users_page(spark, sf_dir):
    return U.search_users(B.users(spark, sf_dir), SEARCH_TEXT, SEARCH_PAGE)


@query("users_page_stored")
def q_users_page_stored(spark, sf_dir):
    """A later page of the matching users from their stored pages."""
    pages = _memo(spark, sf_dir, "user_pages", lambda: U.search_pages(B.users(spark, sf_dir), SEARCH_TEXT))
    return pages.page(SEARCH_PAGE + 1, 10)


@query("ledger_page_deep")
def q_ledger_page_deep(spark, sf_dir):
    """A page far down the ledger, newest rows first."""
    rows = ledger_ordered(spark, sf_dir).select(C.ORDINAL, "txn_date", "department", "project", "amount")
    pages = _memo(spark, sf_dir, "ledger_pages", lambda: paged(rows, [F.desc("txn_date"), F.asc(C.ORDINAL)]))
    return pages.page(400, 50)


@query("owner_as_of")
def q_owner_as_of(spark, sf_dir):
    """Every transaction with the owner and code of its department valid at its date. A change of a quarter is that of its first
    row and takes effect ten days later."""
    led = ledger_ordered(spark, sf_dir)
    first = led.groupBy("department", "year", "quarter").agg(F.min(F.struct("txn_date", C.ORDINAL, "owner", "department_code")).alias("f"))
    changes = first.select("department", F.date_add("f.txn_date", 10).alias("since"), F.col("f.owner").alias("owner_then"),
                           F.col("f.department_code").alias("code_then"))
    rows = led.select(C.ORDINAL, "department", "txn_date")
    return as_of_join(rows, changes, ["department"], "txn_date", "since", ["owner_then", "code_then"])


@query("forecast_facts")
def q_forecast_facts(spark, sf_dir):
    """Per forecast, moved into the ledger's years, the transactions of its department inside its period."""
    days = ledger(spark, sf_dir).groupBy(L.department_id("department_code").alias("department_id"), "txn_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    periods = B.forecasts(spark, sf_dir).select(F.col("department_id").cast("long").alias("department_id"), "id", *(
        F.add_months(c, -12 * 27).alias(c) for c in ("start_date", "end_date")))
    pairs = overlap_join(days, periods, ["department_id"], ("txn_date", "txn_date"), ("start_date", "end_date"))
    return pairs.groupBy(F.col("right.id").alias("id")).agg(F.sum("left.n").alias("n_facts"), F.sum("left.amount").cast("double").alias("amount"))


@query("project_overlaps")
def q_project_overlaps(spark, sf_dir):
    """For each project and year, how many other projects' spans of that department overlap its own, and for how many days in all."""
    led = ledger(spark, sf_dir)
    spans = led.groupBy("department", "project", "year").agg(F.min("txn_date").alias("start_date"), F.max("txn_date").alias("end_date"))
    ends = ("start_date", "end_date")
    pairs = overlap_join(spans, spans, ["department"], ends, ends, bin_days=366).where("left.project != right.project")
    shared = F.datediff(F.least("left.end_date", "right.end_date"), F.greatest("left.start_date", "right.start_date")) + 1
    return pairs.groupBy("left.department", "left.project", "left.year").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(shared).cast("long").alias("n_days"))


@query("users_search_total")
def q_users_search_total(spark, sf_dir):
    return U.search_total(B.users(spark, sf_dir), SEARCH_TEXT)


@query("users_list")
def q_users_list(spark, sf_dir):
    return U.list_users(B.users(spark, sf_dir))


@query("users_export")
def q_users_export(spark, sf_dir):
    return U.export_lines(B.users(spark, sf_dir))


# ------------------------------------------------------------------ H / I. set ops, maintenance

@query("kpi_refresh_all")
def q_kpi_refresh_all(spark, sf_dir):
    return R.refresh_kpis(kpi_base2(spark, sf_dir))


@query("kpi_merge")
def q_kpi_merge(spark, sf_dir):
    store, _ = merged(spark, sf_dir)
    return store


@query("kpi_merge_counts")
def q_kpi_merge_counts(spark, sf_dir):
    _, counts = merged(spark, sf_dir)
    return counts


@query("kpi_refresh_incremental")
def q_kpi_refresh_incremental(spark, sf_dir):
    """The refresh after facts were appended, from the stored partial sums of the old and of the new facts alone."""
    first, second = star1(spark, sf_dir), load2(spark, sf_dir).star

    def build():
        return [materialize(R.refresh_partials(St.kpi_base(st.facts, st.dims))) for st in (first, second)]
    old, new = _memo(spark, sf_dir, "partials", build)
    return R.kpis_from_partials(old.unionByName(new))


@query("audit_status")
def q_audit_status(spark, sf_dir):
    return H.audit_status(B.import_history(spark, sf_dir).drop("status")).select("id", "n_errors", "status")


@query("history_detail")
def q_history_detail(spark, sf_dir):
    d = H.history_detail(B.import_history(spark, sf_dir))
    return d.select("id", "columns", "rows_count", "preview")


# ------------------------------------------------------------------ J. messages

@query("message_intent")
def q_message_intent(spark, sf_dir):
    store, _ = merged(spark, sf_dir)
    return A.answer_messages(B.messages(spark, sf_dir), store, B.users(spark, sf_dir)) \
        .select("conv_id", "turn", "intent", "answer")


__all__ = ["QUERIES", "clear_memo"]
