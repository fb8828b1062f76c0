"""KPI refresh: the stored KPI rows computed from the star (global, per quarter,
department, transaction type, expense type, and monthly with evolution).

All parts come from one grouping-sets aggregate over the flattened facts and are
emitted as one long frame with an emission ordinal ``(part, position)`` that
decides which row wins when two rows share (name, period) in a replace-merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.schemas import (
    KPI_GLOBAL_NAMES, KPI_MONTHLY_NAME, KPI_PREFIX_AMOUNT, KPI_PREFIX_EXPENSE, KPI_PREFIX_VOLUME,
    KPI_SOURCE_REFRESH, MONEY, QUOTIENT, LABEL_NO_MONTH, LABEL_OTHER, LABEL_UNKNOWN_DEPARTMENT, QUARTER_KEY_PREFIX,
)

KPI_COLUMNS = ["kpi_name", "period", "value", "evolution", "department_id", "stat_type", "source",
               "part", "position"]


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _label(col: str, default: str) -> Column:
    """Null or empty -> default (the application's ``value or default``)."""
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(default))


# Grouping sets of the refresh, with the grouping id Spark gives each
# (bit set = column not grouped, first column is the highest bit).
_KEYS = ["qkey", "dep", "tt", "td", "ym"]
_PARTS = {31: 0, 15: 1, 23: 2, 27: 3, 29: 4, 30: 5}  # gid -> part
ALL_PARTS = (0, 1, 2, 3, 4, 5)


def _labelled(base: DataFrame) -> DataFrame:
    return base.select(
        "amount", "signed_amount", "department_id",
        F.concat(F.lit(QUARTER_KEY_PREFIX), F.coalesce(F.col("quarter"), F.lit(0)).cast("string"), F.lit("_"),
                 F.coalesce(F.col("year"), F.lit(0)).cast("string")).alias("qkey"),
        _label("department", LABEL_UNKNOWN_DEPARTMENT).alias("dep"),
        _label("txn_type", LABEL_OTHER).alias("tt"),
        _label("expense_type", LABEL_OTHER).alias("td"),
        _label("year_month", LABEL_NO_MONTH).alias("ym"))


_SUM = "decimal(38,6)"  # what Spark sums money to
SUMS = ["tot", "net", "rev", "neg", "n"]


def refresh_partials(base: DataFrame, parts: tuple[int, ...] = ALL_PARTS) -> DataFrame:
    """The sums of ``parts`` in ONE aggregate over grouping sets (global, quarter,
    department, transaction type, expense type, month): one scan of the facts and
    one shuffle of map-side partial sums, instead of one scan per KPI family.

    The rows (a few per key) can be stored and added up: sums, a count and a maximum, so partials of old and of
    new facts together are those of all facts.
    """
    b = _labelled(base)
    a, s = F.coalesce(F.col("amount"), _zero()), F.coalesce(F.col("signed_amount"), _zero())
    sets = [[], *([k] for k in _KEYS)]
    agg = b.groupingSets([sets[p] for p in parts], *_KEYS).agg(
        F.sum(a).alias("tot"), F.sum(s).alias("net"), F.sum(F.when(s > 0, s)).alias("rev"), F.sum(F.when(s < 0, s)).alias("neg"),
        F.count(F.lit(1)).alias("n"), F.max("department_id").alias("dept_id"), F.grouping_id().alias("gid"))
    return agg.select("gid", *_KEYS, *(F.col(c).cast(_SUM if c != "n" else "long").alias(c) for c in SUMS), "dept_id")


def add_partials(partials: DataFrame) -> DataFrame:
    """Partial sums of several loads added up: one row per grouping set and key."""
    return partials.groupBy("gid", *_KEYS).agg(*(F.sum(c).cast(_SUM if c != "n" else "long").alias(c) for c in SUMS),
                                                F.max("dept_id").alias("dept_id"))


def _finished(partials: DataFrame) -> DataFrame:
    part = F.lit(None).cast("int")
    for gid, p in _PARTS.items():
        part = F.when(F.col("gid") == gid, F.lit(p)).otherwise(part)
    filled = {c: F.coalesce(c, _zero()) for c in ("tot", "net", "rev")}
    return partials.withColumns({**filled, "dep_abs": F.abs(F.coalesce("neg", _zero())), "part": part})


def refresh_aggregate(base: DataFrame, parts: tuple[int, ...] = ALL_PARTS) -> DataFrame:
    """The refresh sums of ``parts`` with their part number."""
    return _finished(refresh_partials(base, parts))


def _kpi_struct(name, period, value, evolution, dept, stat, part, position) -> Column:
    return F.struct(name.cast("string").alias("kpi_name"), period.cast("string").alias("period"),
                    value.cast("double").alias("value"), evolution.cast("double").alias("evolution"),
                    dept.cast("long").alias("department_id"), F.lit(stat).alias("stat_type"),
                    F.lit(KPI_SOURCE_REFRESH).alias("source"), F.lit(part).alias("part"),
                    position.cast("string").alias("position"))


def refresh_kpis(base: DataFrame, parts: tuple[int, ...] = ALL_PARTS) -> DataFrame:
    """The refresh rows of ``parts`` (all by default), emitted from the one grouping-sets aggregate."""
    return _kpi_rows(refresh_aggregate(base, parts))


def kpis_from_partials(partials: DataFrame) -> DataFrame:
    """The refresh rows from stored partial sums of any number of loads: equal to the refresh over all their facts,
    without reading one."""
    return _kpi_rows(_finished(add_partials(partials)))


def _kpi_rows(agg: DataFrame) -> DataFrame:
    """Every aggregate row becomes its KPI row(s) in one projection (``inline``); the
    month-over-month lag is a window over the month rows only (one per month).
    """
    val = F.round("tot", 2)
    # Only the month rows need to stand together; the other rows are spread by their key.
    spread = F.when(F.col("part") == 5, F.lit(0)).otherwise(F.xxhash64("qkey", "dep", "tt", "td"))
    w = Window.partitionBy("part", spread).orderBy("ym")
    prev = F.coalesce(F.lag(val).over(w), val)
    agg = agg.withColumns({"val": val, "evo": F.when(prev != 0, F.round(((val - prev).cast(QUOTIENT) / prev.cast(QUOTIENT)) * F.lit(100), 2))
                                                  .otherwise(_zero())})
    null_int = F.lit(None).cast("long")
    zero = F.lit(0.0)
    # Values of the global KPIs, in the order of KPI_GLOBAL_NAMES: total, net,
    # revenue, expenses, count, mean, expense/revenue ratio.
    values = [
        F.round("tot", 2), F.round("net", 2), F.round("rev", 2), F.round("dep_abs", 2),
        F.col("n").cast("decimal(20,0)"),
        F.when(F.col("n") > 0, F.round(F.col("tot").cast(QUOTIENT) / F.col("n"), 2)).otherwise(_zero()),
        F.when(F.col("rev") != 0, F.round((F.col("dep_abs").cast(QUOTIENT) / F.col("rev").cast(QUOTIENT)) * F.lit(100), 2)).otherwise(_zero()),
    ]
    global_rows = F.array(*[_kpi_struct(F.lit(name), F.lit("global"), value, zero, null_int, stat, 0,
                                        F.lpad(F.lit(str(i)), 2, "0"))
                            for i, ((name, stat), value) in enumerate(zip(KPI_GLOBAL_NAMES, values))])
    q_name = F.concat(F.lit(KPI_PREFIX_AMOUNT), F.col("qkey"))
    d_name = F.concat(F.lit(KPI_PREFIX_AMOUNT), F.col("dep"))
    t_name = F.concat(F.lit(KPI_PREFIX_VOLUME), F.col("tt"))
    e_name = F.concat(F.lit(KPI_PREFIX_EXPENSE), F.col("td"))
    p = F.col("part")
    rows = (F.when(p == 0, global_rows)
            .when(p == 1, F.array(_kpi_struct(q_name, F.col("qkey"), F.col("val"), zero, null_int, "sum", 1, q_name)))
            .when(p == 2, F.array(_kpi_struct(d_name, F.lit("global"), F.col("val"), zero, F.col("dept_id"), "sum", 2,
                                              d_name)))
            .when(p == 3, F.array(_kpi_struct(t_name, F.lit("global"), F.col("val"), zero, null_int, "sum", 3, t_name)))
            .when(p == 4, F.array(_kpi_struct(e_name, F.lit("global"), F.col("val"), zero, null_int, "sum", 4, e_name)))
            .otherwise(F.array(_kpi_struct(F.lit(KPI_MONTHLY_NAME), F.col("ym"), F.col("val"), F.col("evo"),
                                           null_int, "sum", 5, F.col("ym")))))
    return agg.select(F.inline(rows)).select(*KPI_COLUMNS)


def _part(base: DataFrame, part: int) -> DataFrame:
    return refresh_kpis(base, (part,))


def refresh_global(base: DataFrame) -> DataFrame:
    """The seven global KPIs (sum, count, mean, ratio)."""
    return _part(base, 0)


def refresh_quarter(base: DataFrame) -> DataFrame:
    """``CA_Q<t>_<y>`` per quarter (null quarter or year -> 0)."""
    return _part(base, 1)


def refresh_department(base: DataFrame) -> DataFrame:
    """``CA_<department>`` (null or empty -> ``Inconnu``) with the department id."""
    return _part(base, 2)


def refresh_txn_type(base: DataFrame) -> DataFrame:
    """``Vol_<type>`` per transaction type (null or empty -> ``Autre``)."""
    return _part(base, 3)


def refresh_expense_type(base: DataFrame) -> DataFrame:
    """``Dep_<type>`` per expense type (null or empty -> ``Autre``)."""
    return _part(base, 4)


def monthly_evolution(base: DataFrame) -> DataFrame:
    """``CA_Mensuel`` per month with % change against the previous present month.

    The lag runs on the grouped rows (one per month), values rounded to 2 first;
    the first month and a zero previous month give 0.
    """
    return _part(base, 5)
