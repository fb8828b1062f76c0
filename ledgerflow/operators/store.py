"""KPI store and forecast store: merge, newest-N reads, JSON payloads.

The store is a plain Parquet table; a merge never overwrites what it reads: it
writes the merged result as a new version folder (see ``write_version``).
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.calendar import ntz_literal
from ledgerflow.operators.ids import assign_ids
from ledgerflow.operators.joins import dim_join
from ledgerflow.schemas import (
    FORECAST_READ_LIMIT, KPI_DEFAULT_PERIOD, KPI_DEFAULT_SOURCE, KPI_DEFAULT_STAT, KPI_READ_LIMIT,
    KPI_VALUES,
)
from ledgerflow.session import materialize

KEY = ["kpi_name", "period"]


def _scan_place():
    """The place of a row in its scan as text that sorts like the number."""
    return F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")


def normalise_batch(batch: DataFrame, source: str | None = None) -> DataFrame:
    """Trim names, apply defaults, drop blank names. Keeps the ``part``/``position`` ordinal; a caller's plain
    batch (name, period, value) has none and is taken in the order its rows are read."""
    name = F.trim(F.coalesce(F.col("kpi_name").cast("string"), F.lit("")))
    cols = batch.columns

    def opt(c, default):
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(default))) if c in cols else F.lit(default)

    out = batch.select(
        name.alias("kpi_name"),
        opt("period", KPI_DEFAULT_PERIOD).alias("period"),
        F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value") if "value" in cols else F.lit(0.0).alias("value"),
        (F.coalesce(F.col("evolution").cast("double"), F.lit(0.0)) if "evolution" in cols else F.lit(0.0)).alias("evolution"),
        (F.col("department_id").cast("long") if "department_id" in cols else F.lit(None).cast("long")).alias("department_id"),
        (F.lit(source) if source is not None else opt("source", KPI_DEFAULT_SOURCE)).alias("source"),
        opt("stat_type", KPI_DEFAULT_STAT).alias("stat_type"),
        (F.col("part").cast("int") if "part" in cols else F.lit(0)).alias("part"),
        (F.col("position").cast("string") if "position" in cols else _scan_place()).alias("position"),
    )
    return out.where(F.col("kpi_name") != "")


def stamp(batch: DataFrame, created_at: _dt.datetime, start_id=None) -> DataFrame:
    """Number a batch in emission order and stamp it.

    ``id`` = stored max id + rank (``start_id`` is a scalar-subquery column, or
    None for ids 1..n); creation time = ``created_at`` + (rank - 1) seconds. The
    rank comes from the distributed numbering, so no one-partition window.
    """
    ranked = assign_ids(batch, ["part", "position"], "_rank")
    ts = ntz_literal(created_at) + F.make_dt_interval(secs=(F.col("_rank") - 1).cast("decimal(18,6)"))
    base = start_id if start_id is not None else F.lit(0)
    return ranked.withColumns({"id": (base + F.col("_rank")).cast("long"), "created_at": ts,
                               "updated_at": ts}).drop("_rank")


def merge_kpis(existing: DataFrame, batch: DataFrame, replace: bool, created_at: _dt.datetime,
               source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new store, one-row counts ``inserted``/``replaced``).

    Replace: a stored row goes when the batch has its (name, period); inside the
    batch only the last row per (name, period) in emission order survives.
    ``replaced`` counts every removed row, stored or from the batch; ``inserted``
    counts every non-blank batch row.
    """
    b = materialize(normalise_batch(batch, source))  # read by the numbering, the survivors and the counts
    if replace:
        latest = F.max_by(F.struct(*[c for c in b.columns if c not in KEY]), F.struct("part", "position"))
        kept = b.groupBy(*KEY).agg(latest.alias("_r")).select(*KEY, "_r.*")
        hits = kept.select(*KEY, F.lit(True).alias("_hit"))
        marked = dim_join(existing, hits, KEY)
        survivors = marked.where(F.col("_hit").isNull()).drop("_hit")
    else:
        kept = b
        marked = existing.withColumn("_hit", F.lit(None).cast("boolean"))
        survivors = existing
    max_id = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    new_rows = stamp(kept, created_at, max_id)
    store = survivors.unionByName(new_rows.select(*[f.name for f in KPI_VALUES.fields]))

    counts = (marked.select(F.col("_hit").isNotNull().cast("long").alias("replaced"), F.lit(0).cast("long").alias("inserted"))
              .unionByName(b.select(F.lit(1).cast("long").alias("replaced"), F.lit(1).cast("long").alias("inserted")))
              .unionByName(kept.select(F.lit(-1).cast("long").alias("replaced"), F.lit(0).cast("long").alias("inserted")))
              .agg(F.coalesce(F.sum("inserted"), F.lit(0)).cast("long").alias("inserted"),
                   F.coalesce(F.sum("replaced"), F.lit(0)).cast("long").alias("replaced")))
    if not replace:
        counts = counts.withColumn("replaced", F.lit(0).cast("long"))
    return materialize(store.select(*[f.name for f in KPI_VALUES.fields])), counts


def initial_store(batch: DataFrame, created_at: _dt.datetime) -> DataFrame:
    """A stored table holding one batch (ids 1.., stamped in emission order)."""
    return materialize(stamp(normalise_batch(batch), created_at).select(*[f.name for f in KPI_VALUES.fields]))


def latest(df: DataFrame, n: int | None, ts: str = "created_at", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows, with an id tie-break (a top-k, not a full sort); all rows in that order for None."""
    out = df.orderBy(F.desc_nulls_last(ts), F.desc_nulls_last(tie))
    return out if n is None else out.limit(n)


def kpi_lookup(store: DataFrame, name: str | None = None, period: str | None = None,
               limit: int | None = KPI_READ_LIMIT) -> DataFrame:
    df = store
    if name:
        df = df.where(F.col("kpi_name") == name)
    if period:
        df = df.where(F.col("period") == period)
    return latest(df, limit)


def forecast_values(df: DataFrame, col: str = "results") -> DataFrame:
    """Decode stored JSON results to VARIANT; text that is not JSON stays as text."""
    return df.withColumns({"results_json": F.try_parse_json(col),
                           "results_text": F.when(F.try_parse_json(col).isNull(), F.col(col))})


def read_forecasts(df: DataFrame, department_id: int | None = None, ftype: str | None = None,
                   limit: int | None = FORECAST_READ_LIMIT) -> DataFrame:
    if department_id is not None:
        df = df.where(F.col("department_id") == int(department_id))
    if ftype:
        df = df.where(F.col("type") == ftype)
    return latest(df, limit)


def write_version(df: DataFrame, base: str) -> str:
    """Write ``df`` as the next version folder under ``base`` and return its path.

    Readers keep using the previous version until they list the folder again, so
    a merge that reads the current version can never clobber it.
    """
    spark: SparkSession = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(base)  # noqa: SLF001
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    versions = []
    if fs.exists(jvm_path):
        for st in fs.listStatus(jvm_path):
            nm = st.getPath().getName()
            if nm.startswith("v") and nm[1:].isdigit():
                versions.append(int(nm[1:]))
    target = os.path.join(base, f"v{(max(versions) + 1) if versions else 1:06d}")
    df.write.mode("error").parquet(target)
    return target


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """Read the newest complete version folder under ``base`` (a failed write has no ``_SUCCESS``)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(base)  # noqa: SLF001
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    names = sorted(st.getPath().getName() for st in fs.listStatus(jvm_path)
                   if st.getPath().getName().startswith("v")
                   and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))  # noqa: SLF001
    if not names:
        raise FileNotFoundError(f"no complete version under {base}")
    return spark.read.parquet(os.path.join(base, names[-1]))
