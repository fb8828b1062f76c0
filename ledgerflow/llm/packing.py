"""Packing by cutting-stock column generation (operator 6).

A document's ids, with the end id behind them, are cut into pieces of the full sequence length
and one shorter rest. Rests are grouped into length classes of ``grain`` tokens, rounded
up; only the histogram of the classes reaches the driver (``seq_len / grain`` rows whatever
the input). There ``cutting_stock.plan`` solves the linear program over
patterns, rounds it, and gives every pattern its number of sequences. Back on the
cluster the pieces of a class are ranked, and a rank says which pattern, sequence and slot
a piece takes.

Ranks are counted in (class, salt) cells: a class that holds a third of all pieces is spread over as
many tasks as there are salts, and the cells' counts give each cell its first rank.

Padding: a sequence is padded to ``seq_len`` unless its length is a power of two.

Defined cases: a null text is empty and is packed as its end id alone; a null id is packed like
any other; repeated rows are packed once each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm import cutting_stock
from ledgerflow.llm.common import documents, keep, prepare
from ledgerflow.llm.encoding import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
ROWS_A_CELL = 20_000


def cut_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int, end_id: int,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document (``PIECES``). A narrow step; ids are not kept, only their checksums."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for k in range(0, len(texts), 512):
                for doc_id, ids in zip(doc_ids[k:k + 512], own.encode(texts[k:k + 512])):
                    data = memoryview(ids + end)
                    total = len(data) // 4
                    for start in range(0, total, seq_len):
                        part = data[4 * start:4 * (start + seq_len)]
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return documents(docs, id_col, text_col).mapInArrow(run, PIECES)


def slots(planned: list[tuple[cutting_stock.Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, rank after the last, pieces a sequence, first sequence, first slot) of every pattern and class."""
    out, next_rank, sequence = [], {}, 0
    for pattern, times in planned:
        slot = 0
        for c, k in pattern:
            first = next_rank.get(c, 0)
            next_rank[c] = first + k * times
            out.append((c, first, first + k * times, k, sequence, slot))
            slot += k
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, grain: int = 8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``PIECES`` with ``sequence_id`` and ``offset`` of every piece."""
    spark = docs.sparkSession
    pieces = keep(cut_pieces(docs, tokenizer_path, seq_len, end_id, id_col, text_col)
                  .withColumn("_class", F.ceil(F.col("length") / grain).cast("int")))
    counts = {r["_class"]: r["count"] for r in pieces.groupBy("_class").count().collect()}
    table = spark.createDataFrame(
        slots(cutting_stock.plan(counts, seq_len // grain)) or [(0, 0, 0, 1, 0, 0)],
        "_class int, _first long, _last long, _each long, _sequence long, _slot long")

    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // ROWS_A_CELL)
    # Pieces are dealt into cells by what they are, so that the result does not depend on how the input is split. Equal pieces
    # beyond a cell's rows are spread by their place in the stored pieces too; they are told from one another by nothing else.
    keyed = pieces.withColumn("_key", F.xxhash64("doc_id", "start", "ids_crc32"))
    heavy = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > ROWS_A_CELL)
    placed = keyed.withColumn("_place", F.monotonically_increasing_id()).join(heavy, "_key", "left")
    spread = F.when(F.col("_copies").isNotNull(), F.col("_place")).otherwise(F.lit(0))
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64("_key", spread), F.lit(salts)).cast("int")).drop("_key", "_copies", "_place")
    cells = salted.groupBy("_class", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("_class", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_class", "_salt").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    ranked = (salted.withColumn("_row", F.row_number().over(inside) - 1)
              .join(firsts, ["_class", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row")))

    # ``table`` has a few rows per class, bounded by the number of classes: broadcast.
    hit = (F.col("p._class") == F.col("t._class")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    placed = ranked.alias("p").join(F.broadcast(table).alias("t"), hit).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor((F.col("_rank") - F.col("_first")) / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_slot") + (F.col("_rank") - F.col("_first")) % F.col("_each")).alias("_slot"))
    so_far = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0)).cast("long")).drop("_slot")


def padding(packed: DataFrame, seq_len: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and padded tokens by the rule above."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.expr("bit_count(n) = 1")
    return per.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"),
                   F.sum(F.when(power, 0).otherwise(F.lit(seq_len) - F.col("n"))).alias("padded"))
