r"""Token ids in length-delimited binary records (operator 7).

A data file is a row of frames, one frame a document, documents in ascending id order
within a file and from file to file:

    length of the payload      8 bytes, little endian
    masked checksum of those   4 bytes
    payload
    masked checksum of it      4 bytes
    line feed                  1 byte, the text writer's separator

The checksum is CRC-32, masked by a rotation and a constant so that a checksum over
data that holds checksums stays useful. A payload is the document id (8 bytes), a flag byte (bit 0: the id
is null), the bytes of an id (2 while the vocabulary fits, else 4), the number of ids (8 bytes), and the ids.

Files are written by Spark's own text writer (a frame is handed over as a string of raw
bytes), so they go to any store Spark can write, through its commit protocol: an executor that is
lost leaves no partial file. The offset index is a separate Parquet table, made from the
finished files: file, place in the file, document id, offset and length of every frame. A reader may take
frames in any order with it (``read_shuffled``).

Defined cases: a null or empty text is its end id alone; a null id sorts first; repeated rows are
written once each; an empty table gives no frames and an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import documents, prepare
from ledgerflow.llm.encoding import encoder

MASK_DELTA = 0xA282EAD8  # fixed value of the usual checksum mask
HEAD, SUM, META = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBBQ")
INDEX = "file int, place long, doc_id long, offset long, length long"
ROWS = "file int, place long, doc_id long, before long, n_tokens long, ids_crc32 long"
SHARD_BYTES = 64 << 20


def masked(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """The frame of one document without the line feed. ``ids``: little-endian unsigned 32-bit integers."""
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = META.pack(doc_id or 0, doc_id is None, width, len(ids) // 4) + body
    head = HEAD.pack(len(payload))
    return b"".join((head, SUM.pack(masked(head)), payload, SUM.pack(masked(payload))))


def frames(data: memoryview) -> Iterator[tuple[int, int]]:
    """(offset, length) of every frame, lengths checked."""
    at = 0
    while at < len(data):
        head = data[at:at + 8]
        if masked(head) != SUM.unpack_from(data, at + 8)[0]:
            raise ValueError(f"damaged length at byte {at}")
        size = 8 + 4 + HEAD.unpack(head)[0] + 4 + 1
        yield at, size
        at += size


def meta(data, at: int) -> tuple[int, int, int, int]:
    """Id, null flag, bytes of an id and number of ids of the frame at ``at``."""
    return META.unpack_from(data, at + 12)


def read_frame(data: memoryview) -> tuple[int | None, np.ndarray]:
    """Document id and ids (unsigned 32-bit) of one frame, its payload checked."""
    payload = data[12:12 + HEAD.unpack_from(data)[0]]
    if masked(payload) != SUM.unpack_from(data, 12 + len(payload))[0]:
        raise ValueError("damaged payload")
    doc_id, null, width, n = META.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if width == 4 else "<u2", n, META.size).astype("<u4")
    return (None if null else doc_id), ids


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_bytes: int = SHARD_BYTES,
                  id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the documents and write the data files below ``path``/data and the index to ``path``/index.

    One shuffle deals the texts out by id range; every task sorts its range and writes one file. The number
    of files follows the measured bytes of text, so a file stays near ``shard_bytes``. Rows that repeat
    one id are dealt out further by a hash of their text, and equal rows by their place in the input.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = documents(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // shard_bytes + 1)
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("_place")]
    dealt = (rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(files, *order)
             .sortWithinPartitions(*order).drop("_place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        width = 2 if own.vocabulary <= 1 << 16 and end_id < 1 << 16 else 4
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for k in range(0, len(texts), 512):
                done = [frame(d, ids + end, width) for d, ids in zip(doc_ids[k:k + 512], own.encode(texts[k:k + 512]))]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], ["frame"])

    (dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.mode("error").option("lineSep", "\n").text(f"{path}/data"))
    _index(spark, path).write.mode("error").parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
            .select(number.alias("file"), "content"))


def _index(spark: SparkSession, path: str) -> DataFrame:
    """The index, read off the finished files: one whole file of bounded size a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                data = memoryview(content.as_buffer())
                found = list(frames(data))
                ids = [meta(data, at) for at, _ in found]
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int64()),
                    pa.array([None if null else d for d, null, _, _ in ids], pa.int64()),
                    pa.array([at for at, _ in found], pa.int64()), pa.array([s for _, s in found], pa.int64())],
                    ["file", "place", "doc_id", "offset", "length"])

    return _files(spark, path).mapInArrow(run, INDEX)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold (``ROWS``), every checksum tested: per document its file, its place there, the ids before
    it in the file, their number and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                data = memoryview(content.as_buffer())
                rows, before = [], 0
                for place, (at, size) in enumerate(frames(data)):
                    doc_id, ids = read_frame(data[at:at + size])
                    rows.append((number, place, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                cols = list(zip(*rows)) if rows else [[]] * 6
                names = [c.split()[0] for c in ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    return _files(spark, path).mapInArrow(run, ROWS)


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in a random order that ``seed`` fixes: columns ``turn`` (sort by it), ``doc_id``, ``ids``.

    Index rows are drawn into a random order and meet their file by number; a task takes its frames by offset.
    """
    prepare(spark)
    turn = F.xxhash64(F.lit(seed), "file", "place")
    index = spark.read.parquet(f"{path}/index").select("file", F.struct(turn.alias("turn"), "offset", "length").alias("at"))
    wanted = index.groupBy("file").agg(F.array_sort(F.collect_list("at")).alias("wanted"))  # a file's frames are bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column("content"), batch.column("wanted").to_pylist()):
                data = memoryview(content.as_buffer())
                got = [(w["turn"], *read_frame(data[w["offset"]:w["offset"] + w["length"]])) for w in wanted]
                yield pa.RecordBatch.from_arrays([
                    pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                    pa.array([g[2].tolist() for g in got], pa.list_(pa.int64()))], ["turn", "doc_id", "ids"])

    joined = _files(spark, path).join(wanted, "file").select("content", "wanted")
    return joined.mapInArrow(run, "turn long, doc_id long, ids array<long>")


def global_starts(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read_records`` with ``start``: the ids of all documents before, over all files.

    Only one row a file goes through the running sum.
    """
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(firsts, "file").withColumn("start", F.col("_first") + F.col("before")).drop("_first")
