r"""SimHash near-duplicates by bit-sliced comparison (operator 3).

Fingerprint: A-Z become lower case, the words ``[^\x20\x09-\x0D]+`` form shingles
(repeats included, words joined by one blank; with fewer words than a shingle the whole
sequence is one), each hashed with XXH64, seed 42. A bit of the fingerprint is 1 if it is 1 in
more than half of the hashes; without words the fingerprint is 0.

Links: fingerprints that differ in at most ``radius`` bits. The 64 bits are dealt
into ``blocks`` > ``radius`` blocks; two such fingerprints agree in at least
``blocks - radius`` whole blocks, so they meet in a bucket of one of the
C(blocks, radius) tables keyed by that many blocks. Any number of blocks finds every
link; more of them make smaller buckets and more tables, and ``table_blocks`` takes the
number with the least work for the number of fingerprints.

Buckets are compared bit-sliced: the fingerprints of a tile are stored as 64 bit planes, 64
candidates to a machine word. A query's bits are run over the planes, and carry-save
counters in three bit planes and one for overflow add up 64 distances at once. Words in which all
candidates are beyond the radius are abandoned at checkpoints on the way. A tile links its
members by union-find and passes on at most one link per member, never all pairs.

A bucket above ``tile`` fingerprints is cut into parts, and each pair of parts is a tile of
its own, so that a hot bucket spreads over tasks and no pair is lost.

Equal fingerprints are one node (the smallest id of its rows); ``components`` joins nodes.

Defined cases: a null or empty text has fingerprint 0 and links like any other; rows with
a null id have a fingerprint and a component, but null is no id a component could be
named after, so theirs is null only if no member has an id; repeated rows keep
their number; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import documents, keep, prepare, whole_row
from ledgerflow.llm.components import components

TILE = 2048
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
# Planes after which finished words are dropped: of random pairs, hardly a word is left after 24.
_CHECKS = (20, 24, 28, 32, 40, 48, 56)


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of one text as an unsigned 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    first, last = starts[:n].tolist(), ends[shingle - 1:].tolist()
    for k in range(0, n, 65536):  # bits of a bounded number of hashes at once
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[k:k + 65536], last[k:k + 65536])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's 64 bits as a long) and ``text_hash``. A narrow step."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("text_hash")],
                                             ["doc_id", "fp", "text_hash"])

    rows = documents(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of ``fps``, 64 candidates to a word: shape (64, words). Padding candidates are 0."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def close_pairs(queries: np.ndarray, sliced: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, candidate) of all pairs within ``radius`` (at most 7) bits; ``sliced`` are the
    planes of ``n`` candidates."""
    words = sliced.shape[1]
    q = np.repeat(np.arange(len(queries)), words)
    w = np.tile(np.arange(words), len(queries))
    c0 = np.zeros(len(q), np.uint64)
    c1, c2, over = c0.copy(), c0.copy(), c0.copy()

    def beyond() -> np.ndarray:
        """Candidates whose count is above the radius: the comparison of three bits with a constant, by logic."""
        above, equal = np.zeros_like(c0), np.full_like(c0, _ONES)
        for plane, bit in ((c2, radius >> 2 & 1), (c1, radius >> 1 & 1), (c0, radius & 1)):
            if bit:
                equal = equal & plane
            else:
                above = above | (equal & plane)
                equal = equal & ~plane
        return over | above

    for b in range(64):
        flip = np.where((queries[q] >> np.uint64(b)) & np.uint64(1), _ONES, np.uint64(0))
        carry = sliced[b][w] ^ flip
        c0, carry = c0 ^ carry, c0 & carry
        c1, carry = c1 ^ carry, c1 & carry
        c2, carry = c2 ^ carry, c2 & carry
        over = over | carry
        if b + 1 in _CHECKS:
            alive = beyond() != _ONES
            q, w, c0, c1, c2, over = q[alive], w[alive], c0[alive], c1[alive], c2[alive], over[alive]
            if not len(q):
                break
    hits = ~beyond()
    some = hits != 0
    q, w, hits = q[some], w[some], hits[some]
    bits = np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    candidate = w[row] * 64 + lane
    real = candidate < n
    return q[row][real], candidate[real]


def tile_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links among ``fps`` (distinct): at most one per member."""
    n = len(fps)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sliced, links = planes(fps), []
    step = max(1, (1 << 18) // sliced.shape[1])  # queries at once: the counters stay within a few MB
    for k in range(0, n, step):
        for i, j in zip(*(x.tolist() for x in close_pairs(fps[k:k + step], sliced, n, radius))):
            a, b = find(i + k), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i + k, j))
    return links


def table_blocks(n: int, radius: int) -> int:
    """The number of blocks with the least work for ``n`` fingerprints: rows of the tables against pairs
    compared, a row costing about as much as a thousand bit-sliced pairs."""
    def work(blocks: int) -> float:
        tables = comb(blocks, radius)
        bits = 64 * (blocks - radius) // blocks
        return tables * (n * 1000 + n * n / 2 ** bits / 2)

    return min(range(radius + 1, radius + 5), key=work)


def links(fps: DataFrame, radius: int = 4, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    prepare(fps.sparkSession)
    blocks = blocks or table_blocks(fps.count(), radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("part", "key"))
    sizes = keyed.groupBy("part", "key").count().where("count > 1")
    # Members of a bucket of one have nobody to be compared with.
    cut = F.ceil(F.col("count") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), cut).cast("int")
    tiles = (keyed.join(sizes, ["part", "key"])
             .select("fp", "part", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), cut - 1)).alias("other"))
             .select("fp", "part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    dealt = tiles.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small buckets share a tile: a pair of two buckets within the radius is a link as well.
        kept, ends = np.zeros(0, np.int64), None
        for batch in batches:
            fp = np.concatenate([kept, batch.column("fp").to_numpy()])
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "key", "i", "j")], axis=1)
            if ends is not None:
                marks = np.concatenate([ends, marks])
            starts = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(axis=1)]))
            at = 0
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):  # the last group may go on in the next batch
                if b - at >= 256:
                    yield linked(fp[at:b], radius)
                    at = b
            kept, ends = fp[at:], marks[at:]
        if len(kept):
            yield linked(kept, radius)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def linked(fp: np.ndarray, radius: int) -> pa.RecordBatch:
    """The links of one tile as a batch."""
    own = np.unique(fp)
    found = tile_links(own.view(np.uint64), radius)
    return pa.RecordBatch.from_arrays([pa.array(own[[i for i, _ in found]].astype(np.int64)),
                                       pa.array(own[[j for _, j in found]].astype(np.int64))], ["u", "v"])


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, tile: int = TILE, blocks: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``root`` (a fingerprint that names the component) and ``component_id`` (the smallest id
    in it) for every row of ``docs``."""
    return group(keep(fingerprints(docs, shingle, id_col, text_col)), radius, tile, blocks)


def group(rows: DataFrame, radius: int = 4, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """``rows`` (with ``doc_id`` and ``fp``) and the ``root`` and ``component_id`` of every row."""
    nodes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fp"), radius, tile, blocks))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written down, so that the join below is an ordinary one whose hot root Spark can split.
    named = keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id")
    return rows.join(by_fp, "fp")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """One document of every component, the one with the smallest id (rows without an id only where no
    member has one); all columns of ``docs`` stay. Rows that repeat id and text count as one document."""
    rows = near_duplicates(docs, shingle, radius, tile, blocks)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    chosen = keep(rows.groupBy("root").agg(first.alias("first")).select("first.doc_id", "first.text_hash"))
    mine = docs.select(whole_row(docs).alias("row"))
    same = (F.col("row.doc_id").cast("long").eqNullSafe(chosen["doc_id"])
            & F.xxhash64("row.text").eqNullSafe(chosen["text_hash"]))
    kept = mine.join(chosen, same, "left_semi")
    # Repeated rows are rare, so they are looked for before all texts are shuffled once more.
    repeated = (rows.join(chosen.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash"),
                          F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_hash").eqNullSafe(F.col("hash")), "left_semi")
                .groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count())
    if repeated:
        marked = kept.withColumn("id", F.col("row.doc_id")).withColumn("hash", F.xxhash64("row.text"))
        kept = marked.dropDuplicates(["id", "hash"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
