"""Table scans and sinks (Parquet first; CSV for ledger files and exports)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(base: str, name: str) -> str:
    """``base/name.parquet`` when such a file or folder exists, else ``base/name``."""
    p = os.path.join(base, f"{name}.parquet")
    if "://" in base or os.path.exists(p):
        return p
    return os.path.join(base, name)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan a stored table. Column pruning and filters reach the Parquet reader."""
    return spark.read.parquet(table_path(base, name))


def read_clean(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read a cleaned ledger back (Parquet, or header CSV with an explicit schema)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    from ledgerflow.schemas import LEDGER_CLEAN
    return (spark.read.option("header", True).option("encoding", "UTF-8")
            .schema(schema or LEDGER_CLEAN).csv(path))


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a cleaned ledger; Parquet is partitioned by year so period reads prune."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.partitionBy("year").parquet(path)
    else:
        w.option("header", True).csv(path)


def write_star(tables: dict[str, DataFrame], base: str, mode: str = "overwrite") -> None:
    """Write dimensions and facts; facts are partitioned by year for pruning."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        if name.startswith("fact") and "year" in df.columns:
            w = w.partitionBy("year")
        w.parquet(os.path.join(base, name))


def write_lines(df: DataFrame, path: str, column: str = "line", header: str | None = None) -> None:
    """Write one text column as lines (CSV export without quoting).

    The header, when given, is a one-row frame unioned in front: it lands in the
    first part file, so no row moves through one task to prepend it.
    """
    body = df.select(F.col(column).alias("value"))
    if header is not None:
        hdr = df.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
        body = hdr.unionByName(body)
    body.write.mode("overwrite").text(path)
