"""Contiguous shards of near equal size in bytes, by global prefix sums.

The documents are put in order of their id over all tasks (range partitions, sorted inside), and each task
adds running sums of bytes and rows inside its partition while the rows are stored once. The totals of the partitions,
one row each, give every partition its offset; with it each row knows the bytes and rows before it in
the whole table. The total is cut at equal targets: a document belongs to the shard in which its middle byte
lies, so a shard differs from the target by at most the size of one document at either end. A place in the
shard (``slot``) is the row's place in the table less that of the shard's first row.

No key decides a partition alone: rows with one id, or equal in all, are told apart by the further columns of
the order (the place in the input last) and may sit in any number of tasks. What reaches all tasks is one row for each partition and each shard.

Cases: a null text has no bytes but the fixed overhead; null ids come first; rows with one id are ordered by the checksum,
then the size of their text, then their place in the input. Shards may be empty if there are fewer documents than
shards, or one document is larger than a target. An empty table gives an empty table. Further columns
travel as one struct and cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerflow.llm.common import prepare, whole_row
from ledgerflow.session import materialize

OVERHEAD = 16  # bytes that every document takes beside its text


def _running(batches):
    """Adds the bytes and rows before each row of this partition; the rows of a partition come in order."""
    seen_bytes = seen_rows = 0
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        before = seen_bytes + ends - sizes
        places = np.arange(seen_rows, seen_rows + len(sizes), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(places, pa.int64())],
                                         names=[*batch.schema.names, "before", "place"])
        seen_rows += len(sizes)
        if len(sizes):
            seen_bytes += int(ends[-1])


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD,
                  carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size (bytes of the text plus ``overhead``), text_crc32, shard, slot.

    With ``carry`` the whole row comes along as the struct ``row``.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    prepare(df.sparkSession)
    raw = F.col(text_col).cast("binary")
    sized = df.select(F.col(id_col).cast("long").alias("doc_id"),
                      (F.coalesce(F.octet_length(raw), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
                      F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"), *([whole_row(df).alias("row")] if carry else []))
    # The place in the input comes last, so that even rows equal in all else may sit in several ranges.
    order = [F.asc_nulls_first("doc_id"), F.col("text_crc32"), F.col("size"), F.col("tie")]
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = StructType([*ranged.schema.fields, StructField("before", LongType()), StructField("place", LongType())])
    stored = materialize(ranged.mapInArrow(_running, schema), compression=None)
    totals = stored.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    everything = Window.partitionBy()
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
                            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
                            F.sum("bytes").over(everything).alias("total"))
    placed = stored.join(F.broadcast(offsets), "part")
    # floor((2 * bytes before + size) * shards / (2 * total)), exactly: products pass 64 bits on very large tables
    wide = "decimal(24,0)"
    shard = F.expr(f"cast((cast((bytes_before + before) * 2 + size as {wide}) * cast({int(shards)} as decimal(10,0))) "
                   f"div cast(total * 2 as {wide}) as int)")
    placed = placed.select("*", F.least(shard, F.lit(shards - 1)).alias("shard"), (F.col("rows_before") + F.col("place")).alias("position"))
    firsts = placed.groupBy("shard").agg(F.min("position").alias("first"))  # at most one row per shard
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"),
                      *(["row"] if carry else []))


def write_shards(df: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text",
                 overhead: int = OVERHEAD) -> None:
    """The documents as Parquet, one folder ``shard=k`` each: ``slot`` and the whole ``row``, in the order of ``slot`` inside each file.

    Every task holds a stretch of the order, so a shard takes as many files as stretches that it crosses; a
    failed task is written anew by Spark's committer.
    """
    placed = assign_shards(df, shards, id_col, text_col, overhead, carry=True)
    (placed.select("shard", "slot", "row").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
