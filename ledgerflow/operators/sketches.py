"""Mergeable sketches: distinct counts and quantiles of any range from small stored summaries.

A sketch is taken once per group (a day, a month and department) where the rows are, and stored as a few KB; reports over longer
ranges merge stored sketches and read no row again. New rows add sketches of their own, as in an append log.

Distinct counts use theta sketches: exact while a group has fewer distinct values than ``2**lg_entries``, and
within about ``1 / sqrt(2**lg_entries)`` (one standard error) beyond. Quantiles use KLL sketches: the rank of a returned value is
off by about ``1.33 / k`` of the rows at 99 % confidence with the default ``k``, whatever was merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_ENTRIES, K = 14, 400


def distinct_sketches(df: DataFrame, by: dict[str, Column], value: str, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """One sketch of the distinct non-null ``value`` per group (``by``: name -> column)."""
    return df.groupBy(*(c.alias(n) for n, c in by.items())).agg(F.theta_sketch_agg(F.col(value), lg_entries).alias("sketch"))


def distinct_counts(sketches: DataFrame, by: dict[str, Column], lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Distinct values per coarser group, from stored sketches alone (``n_distinct``)."""
    merged = sketches.groupBy(*(c.alias(n) for n, c in by.items())).agg(F.theta_union_agg("sketch", lg_entries).alias("sketch"))
    return merged.select(*by, F.theta_sketch_estimate("sketch").alias("n_distinct"))


def quantile_sketches(df: DataFrame, by: dict[str, Column], value: Column, k: int = K) -> DataFrame:
    """One quantile sketch of the non-null ``value`` per group."""
    return df.where(value.isNotNull()).groupBy(*(c.alias(n) for n, c in by.items())).agg(
        F.kll_sketch_agg_double(value.cast("double"), k).alias("sketch"))


def quantiles(sketches: DataFrame, by: dict[str, Column], ranks: list[float], k: int = K) -> DataFrame:
    """Per coarser group the number of values (``n``, exact) and ``quantiles``, the values at ``ranks``, from stored sketches alone."""
    merged = sketches.groupBy(*(c.alias(n) for n, c in by.items())).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), F.array(
        *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in ranks)).alias("quantiles"))
