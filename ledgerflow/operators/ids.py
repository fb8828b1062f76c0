"""Gap-free surrogate keys without a one-partition sort, and first-row-per-key.

``assign_ids`` numbers rows 1..n (or start..start+n-1) in a total order:

1. range-partition on the order key and sort within partitions (a distributed
   sort: the range partitioner splits even one hot leading value across tasks
   when the order key has further columns);
2. store the rows once, as Parquet in the shared folder, without an id. The files are what every later
   reading and every repeated task sees; an unstored range shuffle draws new bounds at each reading;
3. count the rows of each file, which the reader takes from the footers alone. The sums of the counts
   before each file are stored too: one row per file, so that broadcasting them is safe;
4. id = start + rows in earlier files + the row's place in its file, both known to the reader
   (``_metadata.row_index``), so ids are resolved when rows are read and the table is never copied for them.

Nothing is collected to the driver and no task sees more than its partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.session import mark_stored, materialize


def _order_cols(order: list) -> list[Column]:
    return [F.asc_nulls_first(c) if isinstance(c, str) else c for c in order]


def assign_ids(df: DataFrame, order: list, id_col: str, start=1, num_partitions: int | None = None,
               stored: list | None = None, folders: tuple[str, str] | None = None,
               dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``id_col`` = start, start+1, ... following ``order`` (ascending, nulls first).

    ``order=None`` numbers rows in their current partition order: still gap-free and
    stable (the rows are stored), but without the range shuffle. That
    is the cheap choice for a huge fact table whose ids need no particular order.

    ``start`` is an int or a one-row, one-column DataFrame (e.g. ``max(id) + 1`` of
    an existing table) so appends stay lazy and nothing goes through the driver.
    Rows equal on the whole order key get consecutive ids in an arbitrary order;
    pass a total order when ids must be reproducible row by row. ``stored`` names the columns to keep: others
    only take part in the order. ``folders`` says where rows and offsets are stored for good; :func:`read_numbered` reads
    them again. ``dealt`` is applied to the rows after they are dealt to their ranges and before they are sorted: columns that it
    adds are not shuffled. It must keep each row in its task (broadcast joins, projections).
    """
    rows, offsets = ordered_table(df, order, start, num_partitions, stored, folders, dealt)
    return read_numbered(rows, offsets, id_col)


def ordered_table(df: DataFrame, order: list, start=1, num_partitions: int | None = None, stored: list | None = None,
                  folders: tuple[str, str] | None = None, dealt: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows stored in ``order``, and the offsets of their files: what :func:`read_numbered` resolves ids from."""
    if order:
        # Without an explicit count AQE may coalesce adjacent ranges towards the
        # advisory partition size; coalescing keeps the order, so ids stay exact.
        cols = _order_cols(order)
        ranged = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
        ordered = (dealt(ranged) if dealt else ranged).sortWithinPartitions(*cols)
    else:
        # No order: number rows as they lie in their files (no shuffle at all, and no copy of a stored table).
        ordered = dealt(df) if dealt else df
    rows = materialize(ordered.select(*stored) if stored else ordered, folder=folders and folders[0])
    return rows, materialize(_offsets(rows, start), folder=folders and folders[1])


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("_metadata.file_path").alias("__lf_file"), F.col("_metadata.row_index").alias("__lf_row"))


def _offsets(rows: DataFrame, start) -> DataFrame:
    """For each file of a stored table the id before its first row (``__lf_file``, ``__lf_off``)."""
    counts = _placed(rows).groupBy("__lf_file").agg(F.count(F.lit(1)).alias("__lf_cnt"))
    # The task's number is the place of its range; written out in full, since file names pad it to five digits only.
    task = F.coalesce(F.regexp_extract("__lf_file", r"part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(0))
    counts = counts.select("__lf_file", "__lf_cnt", task.alias("__lf_task"))
    # The ids before the first one go in as a file of its own holding start-1
    # rows, so a lazily computed start (max + 1 of a stored table) needs no join.
    if isinstance(start, DataFrame):
        before = start.select((F.col(start.columns[0]).cast("long") - 1).alias("__lf_cnt"))
    else:
        before = rows.sparkSession.range(1).select(F.lit(int(start) - 1).cast("long").alias("__lf_cnt"))
    counts = counts.unionByName(before.select(F.lit("").alias("__lf_file"), "__lf_cnt", F.lit(-1).cast("long").alias("__lf_task")))
    # One row per file: the offset window is bounded by their number.
    w = Window.orderBy("__lf_task", "__lf_file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("__lf_file", F.coalesce(F.sum("__lf_cnt").over(w), F.lit(0)).alias("__lf_off"))


def number_as_read(df: DataFrame, block: list[str], id_col: str, stored: list[str]) -> DataFrame:
    """Number rows by the ``block`` that they were read from, then by their place in it, without a shuffle: for rows that lie as they were read,
    so that a block (not null) is a stretch of one task's rows. They are stored once, and a block's rows are numbered from the rows in earlier
    blocks on; one row for each block is sent to every task."""
    rows = _placed(materialize(df.select(*stored, *(c for c in block if c not in stored))))
    at = [*block, "__lf_file"]
    blocks = rows.groupBy(*at).agg(F.min("__lf_row").alias("__lf_first"), F.max("__lf_row").alias("__lf_last"), F.count(F.lit(1)).alias("__lf_cnt"))
    before = F.coalesce(F.sum("__lf_cnt").over(Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per block
    whole = F.col("__lf_last") - F.col("__lf_first") + 1 == F.col("__lf_cnt")
    offset = F.when(whole, before - F.col("__lf_first")).otherwise(F.raise_error(F.lit("the rows of a block do not lie together")).cast("long"))
    offsets = materialize(blocks.select(*at, offset.alias("__lf_off")))
    out = rows.join(F.broadcast(offsets), at).withColumn(id_col, (F.lit(1) + F.col("__lf_off") + F.col("__lf_row")).cast("long"))
    return mark_stored(out.select(*stored, id_col))


def read_numbered(rows: DataFrame, offsets: DataFrame, id_col: str) -> DataFrame:
    """Stored rows with their ids: the file's offset plus the place in the file. Both frames may be the union
    of several stored tables."""
    out = _placed(rows).join(F.broadcast(offsets), "__lf_file")  # one row per file
    out = out.withColumn(id_col, (F.lit(1) + F.col("__lf_off") + F.col("__lf_row")).cast("long"))
    return mark_stored(out.drop("__lf_file", "__lf_row", "__lf_off"))


def next_id(existing: DataFrame, id_col: str) -> DataFrame:
    """One-row frame ``max(id) + 1`` (1 for an empty table)."""
    return existing.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).cast("long").alias("_next"))


def first_per_key(df: DataFrame, key: list[str], ordinal: str, cols: list[str]) -> DataFrame:
    """For each key, the values of ``cols`` from the row with the smallest ``ordinal``.

    With a BIGINT ordinal (a place in an upload) each combination of key and values is reduced to its smallest ordinal by a hash
    aggregate, inside the tasks first, so that what is shuffled is combinations and not rows; the first one of each key is
    then taken from these. Of values that share a key's smallest place the smallest counts; rows without an ordinal never do. Any other ordinal goes
    through ``min_by``, which sorts within tasks. Both have a partial map-side step, so a key holding a third
    of all rows is reduced before the shuffle; unlike ``first()`` neither depends on row order.
    """
    if dict(df.dtypes)[ordinal] == "bigint":
        known = df.dropna(subset=[*key, ordinal])
        least = known.groupBy(*dict.fromkeys([*key, *cols])).agg(F.min(ordinal).alias("_least"))
        first = least.groupBy(*key).agg(F.min(F.struct("_least", *[F.col(c) for c in cols])).alias("_first"))
        return first.select(*key, *[F.col(f"_first.{c}").alias(c) for c in cols])
    picked = F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(ordinal)).alias("_first")
    return df.groupBy(*key).agg(picked).select(*key, *[F.col(f"_first.{c}").alias(c) for c in cols])
