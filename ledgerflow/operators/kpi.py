"""Computed KPI report over a cleaned ledger: filters, global, per department,
monthly with running balance, top-k lists.

Money stays DECIMAL through every aggregate, so sums are exact and do not
depend on partitioning or task order; values turn into DOUBLE only at the output.
Every aggregate here has a map-side partial step, so a hot
group (one department holding a third of all rows) is pre-aggregated on the map
side and never gathered into one task. The only windows run over already
aggregated rows (one per month), never over raw rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.labels import department_id
from ledgerflow.functions.money import expense_part, revenue_part
from ledgerflow.schemas import LABEL_DASH, LABEL_UNCLASSIFIED, MONEY, QUOTIENT, TOP_K


def _s() -> Column:
    return F.col("signed_amount")


def div_round2(num: Column, den: Column) -> Column:
    """round(num / den, 2) as DOUBLE, in exact decimal arithmetic (half-up)."""
    return F.round(num.cast(QUOTIENT) / den, 2).cast("double")


def pct_round2(num: Column, den: Column) -> Column:
    """round(num / den * 100, 2) as DOUBLE, in exact decimal arithmetic."""
    return F.round((num.cast(QUOTIENT) / den.cast(QUOTIENT)) * F.lit(100), 2).cast("double")


def dec0(col: Column) -> Column:
    """Null-safe decimal sum result (0 when the group has no rows)."""
    return F.coalesce(col, F.lit(0).cast(MONEY))


# --------------------------------------------------------------------------- filters

def period_bounds(period: str) -> tuple[_dt.date, _dt.date]:
    """``YYYY-MM`` -> that month; anything else is read as a year ``YYYY``."""
    period = period.strip()
    if len(period) == 7:
        y, m = int(period[:4]), int(period[5:7])
        start = _dt.date(y, m, 1)
        end = _dt.date(y + (m == 12), 1 if m == 12 else m + 1, 1)
    else:
        y = int(period)
        start, end = _dt.date(y, 1, 1), _dt.date(y + 1, 1, 1)
    return start, end


def in_period(df: DataFrame, period: str | None, date_col: str = "txn_date") -> DataFrame:
    """Rows of one month or one year, as a half-open date range.

    A range on the raw date column (not ``date_format(...) = ...``) so that Parquet
    min/max statistics and year partitions prune the scan.
    """
    if not period:
        return df
    start, end = period_bounds(period)
    d = F.col(date_col)
    if "year" in df.columns and date_col == "txn_date":  # the year of that date: stored tables are partitioned by it
        df = df.filter(F.col("year") == F.lit(start.year))
    return df.filter((d >= F.lit(start)) & (d < F.lit(end)))


def with_department_id(df: DataFrame) -> DataFrame:
    if "department_id" in df.columns:
        return df
    return df.withColumn("department_id", department_id("department_code"))


def in_department(df: DataFrame, dept_id: int | None) -> DataFrame:
    if dept_id is None:
        return df
    return with_department_id(df).filter(F.col("department_id") == F.lit(int(dept_id)))


def report_base(df: DataFrame, period: str | None = None, dept_id: int | None = None) -> DataFrame:
    return in_department(in_period(df, period), dept_id)


# --------------------------------------------------------------------------- aggregates

def kpi_global(df: DataFrame) -> DataFrame:
    """One row: revenue, expenses, balance, net margin %, count, mean absolute amount."""
    S = _s()
    agg = df.agg(
        F.count(F.lit(1)).alias("n_transactions"),
        dec0(F.sum(revenue_part(S))).alias("_rev"),
        dec0(F.sum(expense_part(S))).alias("_dep"),
        dec0(F.sum(S)).alias("_net"),
        F.sum(F.abs(S)).alias("_abs"),
        F.count(S).alias("_n"),
    )
    return agg.select(
        F.round("_rev", 2).cast("double").alias("total_revenue"),
        F.round("_dep", 2).cast("double").alias("total_expenses"),
        F.round("_net", 2).cast("double").alias("net_balance"),
        F.when(F.col("_rev") > 0, pct_round2(F.col("_net"), F.col("_rev"))).otherwise(F.lit(0.0)).alias("net_margin"),
        F.col("n_transactions"),
        F.coalesce(div_round2(F.col("_abs"), F.col("_n")), F.lit(0.0)).alias("mean_transaction"),
    )


def kpi_by_department(df: DataFrame) -> DataFrame:
    """Per department id: count, revenue, expenses, balance (largest expenses first)."""
    S = _s()
    return (with_department_id(df).groupBy("department_id").agg(
        F.count(F.lit(1)).alias("n_transactions"),
        dec0(F.sum(revenue_part(S))).cast("double").alias("revenue"),
        dec0(F.sum(expense_part(S))).cast("double").alias("expenses"),
        dec0(F.sum(S)).cast("double").alias("balance"),
    ).orderBy(F.desc("expenses"), F.asc_nulls_first("department_id")))


def kpi_monthly(df: DataFrame) -> DataFrame:
    """Per ``yyyy-MM``: revenue and expenses (positive), oldest month first."""
    S = _s()
    return (df.groupBy(F.date_format("txn_date", "yyyy-MM").alias("month"))
            .agg(dec0(F.sum(revenue_part(S))).alias("revenue"),
                 dec0(F.sum(expense_part(S))).alias("expenses")))


def running_balance(monthly: DataFrame) -> DataFrame:
    """Cumulative revenue - expenses over months, rounded only at the output.

    The window has no partition key on purpose: it runs after the group-by, on
    one row per month (a few hundred rows for decades of data), not on raw rows.
    """
    w = Window.orderBy(F.asc_nulls_first("month")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.select(
        "month",
        F.col("revenue").cast("double").alias("revenue"),
        F.col("expenses").cast("double").alias("expenses"),
        F.round(F.sum(F.col("revenue") - F.col("expenses")).over(w), 2).cast("double").alias("running_balance"),
    ).orderBy(F.asc_nulls_first("month"))


def kpi_monthly_balance(df: DataFrame) -> DataFrame:
    return running_balance(kpi_monthly(df))


def top_expense_types(df: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k expense types by total expense (negative signed amounts only).

    Grouped on the raw value; the label for null is applied only in the output,
    so null and a literal ``Non classé`` stay two rows.
    """
    S = _s()
    g = (df.filter(S < 0).groupBy("expense_type")
         .agg(F.count(F.lit(1)).alias("n_transactions"),
              F.sum(-S).alias("_tot"), F.count(S).alias("_n")))
    return (g.select(
        F.coalesce("expense_type", F.lit(LABEL_UNCLASSIFIED)).alias("expense_type"),
        "n_transactions",
        F.col("_tot").cast("double").alias("total_amount"),
        div_round2(F.col("_tot"), F.col("_n")).alias("mean_amount"),
        F.col("expense_type").alias("_key"))
        .orderBy(F.desc("total_amount"), F.asc_nulls_first("_key")).limit(k).drop("_key"))


def top_projects(df: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k projects by absolute volume, with revenue and expenses."""
    S = _s()
    g = (df.groupBy("project")
         .agg(F.count(F.lit(1)).alias("n_transactions"),
              F.sum(F.abs(S)).alias("_tot"), F.count(S).alias("_n"),
              F.sum(revenue_part(S)).alias("_rev"), F.sum(expense_part(S)).alias("_dep")))
    return (g.select(
        F.coalesce("project", F.lit(LABEL_DASH)).alias("project"),
        "n_transactions",
        F.col("_tot").cast("double").alias("total_amount"),
        div_round2(F.col("_tot"), F.col("_n")).alias("mean_amount"),
        F.col("_rev").cast("double").alias("revenue"),
        F.col("_dep").cast("double").alias("expenses"),
        F.col("project").alias("_key"))
        .orderBy(F.desc("total_amount"), F.asc_nulls_first("_key")).limit(k).drop("_key"))


def top_counterparties(df: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k counterparties by absolute volume."""
    S = _s()
    g = (df.groupBy("counterparty")
         .agg(F.count(F.lit(1)).alias("n_transactions"), F.sum(F.abs(S)).alias("_tot")))
    return (g.select(
        F.coalesce("counterparty", F.lit(LABEL_DASH)).alias("counterparty"),
        "n_transactions",
        F.col("_tot").cast("double").alias("total_amount"),
        F.col("counterparty").alias("_key"))
        .orderBy(F.desc("total_amount"), F.asc_nulls_first("_key")).limit(k).drop("_key"))


def kpi_report(df: DataFrame, period: str | None = None, dept_id: int | None = None) -> dict[str, DataFrame]:
    """The six lazy results of the computed report over one filtered base."""
    base = report_base(df, period, dept_id)
    return {
        "kpis": kpi_global(base),
        "by_department": kpi_by_department(base),
        "monthly": kpi_monthly_balance(base),
        "top_expense_types": top_expense_types(base),
        "top_projects": top_projects(base),
        "top_counterparties": top_counterparties(base),
    }
