"""Joins in time: the value valid at a date, and spans that overlap.

Neither needs a sorted pass over a whole key or a nested loop. Both deal rows into bins of time, so a key that holds a third of
all rows is spread over as many tasks as it has bins, and what crosses from bin to bin is aggregated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_DAYS = 32


def _bin(day: Column, days: int) -> Column:
    """The number of the bin of a date or timestamp; bins are days since the epoch cut at equal steps."""
    return F.floor(F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")) / F.lit(days)).cast("long")


def as_of_join(rows: DataFrame, changes: DataFrame, on: list[str], at: str, since: str, values: list[str], bin_days: int = BIN_DAYS) -> DataFrame:
    """Each row with the ``values`` of the last change of its key at or before ``at`` (nulls if there is none).

    Rows and changes of a key meet in bins of time, in one union: inside a bin a running last value gives the answer, before
    the first change of a bin it is the last one of the bins before. Those are one row per key and bin, carried over the
    bins by a window on them alone. Several changes at one moment: the greatest values count. A row with a null key or
    date gets nulls; a change with a null key or date is none. Rows keep their number and columns; the values' names must be new.
    """
    held = F.struct(*(F.col(c) for c in rows.columns))
    none_row, none_change = F.lit(None), F.lit(None)
    value = F.struct(*(F.col(c) for c in values))
    left = rows.select(*on, F.col(at).alias("_at"), _bin(F.col(at), bin_days).alias("_bin"), F.lit(1).alias("_kind"), held.alias("_row"))
    right = (changes.dropna(subset=[*on, since]).groupBy(*on, F.col(since).alias("_at")).agg(F.max(value).alias("_value"))
             .withColumn("_bin", _bin(F.col("_at"), bin_days)))
    types = {f.name: f.dataType for f in left.schema.fields} | {f.name: f.dataType for f in right.schema.fields}
    both = left.withColumn("_value", none_change.cast(types["_value"])).unionByName(
        right.withColumns({"_kind": F.lit(0), "_row": none_row.cast(types["_row"])}).select(*on, "_at", "_bin", "_kind", "_row", "_value"))
    in_bin = Window.partitionBy(*on, "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(in_bin)).where("_kind = 1")
    # One row per key and bin: the last change inside it, and by a window over a key's bins alone the one before it.
    lasts = right.groupBy(*on, "_bin").agg(F.max(F.struct("_at", "_value")).alias("_last"))
    bins = left.select(*on, "_bin").distinct().withColumn("_last", F.lit(None).cast(lasts.schema["_last"].dataType)).unionByName(lasts)
    bins = bins.groupBy(*on, "_bin").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*on).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    known = bins.select(*on, "_bin", F.last("_last", ignorenulls=True).over(earlier)["_value"].alias("_carried")).where(F.col("_carried").isNotNull())
    out = seen.join(known, [*on, "_bin"], "left").withColumn("_value", F.coalesce("_seen", "_carried"))
    return out.select("_row.*", *(F.col(f"_value.{c}").alias(c) for c in values))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
                 bin_days: int = BIN_DAYS) -> DataFrame:
    """All pairs of rows of one key whose spans share a day, as structs ``left`` and ``right``. Spans are closed; a moment is a span
    that ends where it begins (name its column twice).

    Each span is dealt into the bins that it touches and rows meet by key and bin, which is an equi-join. Two spans that share
    several bins are paired in one of them only: that of the later of their two beginnings. A span with a null end or key, or that
    ends before it begins, has no pair. A span takes one row per bin, so ``bin_days`` should be near the usual length of spans.
    """
    def dealt(df: DataFrame, side: str, span: tuple[str, str]) -> DataFrame:
        first, last = (F.col(c).cast("date") for c in span)
        rows = df.select(*on, F.struct(*(F.col(c) for c in df.columns)).alias(side), first.alias(f"_{side}_first"), last.alias(f"_{side}_last"))
        rows = rows.dropna(subset=[*on, f"_{side}_first", f"_{side}_last"]).where(F.col(f"_{side}_first") <= F.col(f"_{side}_last"))
        return rows.withColumn("_bin", F.explode(F.sequence(_bin(F.col(f"_{side}_first"), bin_days), _bin(F.col(f"_{side}_last"), bin_days))))

    pairs = dealt(left, "left", left_span).join(dealt(right, "right", right_span), [*on, "_bin"])
    later = F.greatest("_left_first", "_right_first")
    return pairs.where((later <= F.least("_left_last", "_right_last")) & (_bin(later, bin_days) == F.col("_bin"))).select("left", "right")
