r"""Collocations of two to four words, from a weighted de Bruijn graph of the corpus.

A text is lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and the pieces into words. Every word of a
piece starts one edge of the graph: the node of three words there, and the word after them; behind a
piece's last word stands an end mark, as often as needed. Only these longest grams are aggregated:

1. Every task builds the graph of some megabytes of text: equal edges become one with a weight. Unary paths (each inner
   node has one way in and one way out, so all edges weigh the same) are compacted to one string of words with
   one weight. A path is cut only where its nodes belong to different buckets.
2. A node's bucket is that of the smaller hash among those of its first two words that are not heavy, the hash of
   the whole node if both are. Heavy are the words with a share of all words of one in ``buckets`` or more, at most
   ``buckets`` of them by definition; only their hashes are sent to the tasks. So neighbouring nodes often share a
   bucket, and no bucket grows with one frequent word. Equal paths of many copies are one row a task.
3. A bucket holds every edge of its nodes. The count of four words is an edge's weight, of three the flow out of
   their node, the edges into the end mark (piece-end corrections) included; the flows of nodes by their first two
   words and first word give the counts of two and one. Two words of which one is not heavy have all their nodes in one
   bucket; the others' counts, and those of single words, are partial sums that Spark adds up. A bucket is
   worked off in slices, so a task holds its packed paths and one slice of the graph.

A candidate has ``a = f(phrase) >= min_count``; each cut gives ``floor(scale * a / (l + r))``, the
lowest cut counts (ties: the first), and a candidate inside a longer one with ``100 f(longer) >= 80 a`` is
dropped. All of that is exact decimal arithmetic over the frequent phrases alone, and the list of a language is cut to
``top`` rows inside the tasks before they meet.

Cases: a null text counts as empty, a null language as ``und``; texts without words add nothing; repeated rows count as
often as they stand there. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import UPPER, LOWER, prepare
from ledgerflow.session import materialize

GRAPH_BYTES = 8 << 20  # text of one task's graph; longer graphs only compact better
SLICE_BYTES = 8 << 20  # paths that a bucket works off at once, as far as 256 slices go
END = b"."  # no word holds a full stop
SPLITTERS = b".,;:!?\n\x0b\x0c\r"  # fixed: the ends of a piece
NO_ROUTE = np.uint64(0xFFFFFFFFFFFFFFFF)
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # any odd numbers
_WORDS = bytes.maketrans(UPPER.encode() + SPLITTERS, LOWER.encode() + b" " * len(SPLITTERS))
_TABLE = bytes.maketrans(UPPER.encode() + SPLITTERS, LOWER.encode() + b"\n" * len(SPLITTERS))


def _tokens(text: bytes) -> list[bytes]:
    """The words of a text, an end mark behind every piece that has any."""
    pieces = text.translate(_TABLE).split(b"\n")
    return b" . ".join([*(p for p in pieces if p and not p.isspace()), b""]).split()


def _coded(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers for the tokens (the end mark is 0) and the token of each number."""
    coded = pa.array([END, *tokens], pa.binary()).dictionary_encode()
    return coded.indices.to_numpy()[1:].astype(np.int64), coded.dictionary.to_pylist()


def _hashes(names: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(w, 12) for w in names), np.uint64, len(names))


def _classes(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """A number for each pair (a, b), b below ``size``: equal for equal pairs."""
    return pd.factorize(a * np.int64(size) + b)[0].astype(np.int64)


def _texts(batches):
    """(language, text) chunks of about GRAPH_BYTES; very long texts are cut behind a piece."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if not text:
                continue
            at = 0
            while len(text) - at > 2 * GRAPH_BYTES:
                cut = max(text.rfind(bytes([c]), at, at + GRAPH_BYTES) for c in SPLITTERS) + 1
                if cut <= at:  # one piece longer than a chunk: whole
                    ends = [k for k in (text.find(bytes([c]), at) for c in SPLITTERS) if k >= 0]
                    cut = min(ends) + 1 if ends else len(text)
                yield lang, text[at:cut]
                at = cut
            held.setdefault(lang, []).append(text[at:])
            size[lang] = size.get(lang, 0) + len(text) - at
            if size[lang] >= GRAPH_BYTES:
                yield lang, b"\n".join(held.pop(lang))
                size[lang] = 0
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def heavy_words(texts: DataFrame, buckets: int) -> np.ndarray:
    """Sorted hashes of the words with a share of about one in ``buckets`` or more: never more than ``buckets``.

    A task leaves out words below that share of its own text, so a word below twice the share may be missing.
    They only steer which rows meet where.
    """
    def count(batches):
        for _, text in _texts(batches):
            n = Counter(text.translate(_WORDS).split())
            total = sum(n.values())
            some = {w: k for w, k in n.items() if k * buckets >= total}
            kept = _hashes(list(some)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array([*kept.tolist(), None], pa.int64()),
                                              "n": pa.array([*some.values(), total], pa.int64())})

    counts = materialize(texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), compression=None)
    total = counts.where(F.col("word").isNull()).select("n").scalar()
    rows = counts.where(F.col("word").isNotNull() & (F.col("n") * F.lit(buckets) >= total)).select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).astype(np.uint64))


def _is_heavy(names: list[bytes], heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, heavy or not) of each token; the end mark counts as heavy."""
    hashes = _hashes(names)
    found = np.isin(hashes, heavy)
    found[0] = True
    return hashes, found


def _routes(a: np.ndarray, b: np.ndarray, c: np.ndarray, names: list[bytes], heavy: np.ndarray) -> np.ndarray:
    """The route of nodes (a, b, c): equal for the nodes of two words of which one is not heavy."""
    hashes, is_heavy = _is_heavy(names, heavy)
    ranks = np.where(is_heavy, NO_ROUTE, hashes)
    least = np.minimum(ranks[a], ranks[b])
    whole = hashes[a] * MIXERS[0] + hashes[b] * MIXERS[1] + hashes[c] * MIXERS[2]
    mixed = np.where(least == NO_ROUTE, whole, least)
    return (mixed ^ (mixed >> np.uint64(29))) * MIXERS[0]


def bucket_and_slice(routes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((routes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32), (routes >> np.uint64(56)).astype(np.uint8).view(np.int8)


def local_paths(text: bytes, heavy: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The compacted paths of a text's graph: (words, weight, route). A path of k edges has k + 3 tokens."""
    tokens = _tokens(text)
    codes, names = _coded(tokens)
    codes = codes.astype(np.int32)  # the arrays of a graph are what a task holds: narrow, and freed when they are used up
    tokens = list(map(names.__getitem__, codes.tolist()))  # one object for equal words
    size, n = len(names), len(codes)
    places = np.flatnonzero(codes)
    if not places.size:
        return [], np.empty(0, np.int64), np.empty(0, np.uint64)
    padded = np.r_[codes, 0, 0, 0]  # the grams of four tokens, end marks from the piece's end on
    c0, c1 = codes[places], padded[places + 1]
    c2 = np.where(c1 == 0, 0, padded[places + 2])
    c3 = np.where(c2 == 0, 0, padded[places + 3])
    del padded
    route = np.zeros(n, np.uint64)
    route[places] = _routes(c0, c1, c2, names, heavy)
    node, edge = np.full(n + 1, -1, np.int32), np.full(n, -1, np.int32)
    pair = _classes(c0, c1, size)
    del c0, c1
    node[places] = _classes(pair, c2, size)
    del pair, c2
    edge[places] = _classes(node[places], c3, size)
    del c3
    n_edges, n_nodes = int(edge.max()) + 1, int(node.max()) + 1
    weight = np.bincount(edge[places], minlength=n_edges)
    first = np.empty(n_edges, np.int32)
    first[edge[places][::-1]] = places[::-1]
    ways_out = np.bincount(node[first], minlength=n_nodes)
    after = node[first + 1]  # -1 behind a piece
    ways_in = np.bincount(after[after >= 0], minlength=n_nodes)
    begins = places[np.r_[True, codes[places[1:] - 1] == 0]]
    ways_in[np.unique(node[begins])] += 1
    del after, places
    firsts = np.sort(first)
    linked = np.r_[False, firsts[1:] == firsts[:-1] + 1]
    linked &= (ways_in[node[firsts]] == 1) & (ways_out[node[firsts]] == 1)
    linked &= route[firsts] == route[np.maximum(firsts - 1, 0)]
    heads = np.flatnonzero(~linked)
    del node, first, ways_out, ways_in, linked
    start = firsts[heads]
    stop = firsts[np.r_[heads[1:] - 1, len(firsts) - 1]] + 4
    weight, route = weight[edge[start]], route[start]
    marks = np.flatnonzero(codes == 0)
    del firsts, edge, codes
    piece_end = marks[np.searchsorted(marks, start)]  # every piece has its mark
    marked = [b"", b" .", b" . .", b" . . ."]
    paths = [b" ".join(tokens[i:j]) + marked[k] for i, j, k in zip(
        start.tolist(), np.minimum(stop, piece_end).tolist(), np.maximum(stop - piece_end, 0).tolist())]
    return paths, weight, route


def flows(paths: pa.Array, weights: np.ndarray, min_count: int, heavy: np.ndarray) -> list[tuple[int, list[bytes], list[bytes], np.ndarray]]:
    """Counts from paths that hold all edges of their nodes: (words, languages, phrases, counts); a path's first token is its language.

    Four and three words, and two that are not both heavy, are complete and at least ``min_count``; the others and
    none (all words) are partial sums."""
    sizes = (pc.count_substring(paths, " ").to_numpy(zero_copy_only=False) + 1).astype(np.int64)
    codes, names = _coded(b" ".join(paths.cast(pa.binary()).to_pylist()).split())
    size = len(names)
    ends = np.cumsum(sizes)
    edge_at = np.ones(len(codes), bool)
    edge_at[ends - sizes] = False
    for back in (1, 2, 3):
        edge_at[ends - back] = False
    at = np.flatnonzero(edge_at)
    lang = np.repeat(codes[ends - sizes], sizes - 4)
    w = np.repeat(weights, sizes - 4)
    c = [codes[at + k] for k in range(4)]
    is_heavy = _is_heavy(names, heavy)[1]
    cls, out = pd.factorize(lang)[0].astype(np.int64), []
    for k in range(5):
        if k:
            cls = _classes(cls, c[k - 1], size)
        count = np.zeros(int(cls.max()) + 1, np.int64)
        np.add.at(count, cls, w)
        sample = np.zeros(len(count), np.int64)  # a place of each class
        sample[cls] = np.arange(len(cls))
        good = np.ones(len(count), bool) if k < 2 else count >= min_count
        if k == 2:
            good |= is_heavy[c[0][sample]] & is_heavy[c[1][sample]]
        if k:
            good &= c[k - 1][sample] > 0  # no end mark inside
        chosen = sample[np.flatnonzero(good)]
        columns = [[names[i] for i in c[j][chosen].tolist()] for j in range(k)]
        phrases = list(map(b" ".join, zip(*columns))) if k else [b""] * len(chosen)
        out.append((k, [names[i] for i in lang[chosen].tolist()], phrases, count[good]))
    return out


def phrase_counts(df: DataFrame, min_count: int, lang_col: str = "lang", text_col: str = "text",
                  buckets: int | None = None) -> DataFrame:
    """lang, words (0 to 4), phrase, n: all phrases of one to four words that occur ``min_count`` times or more, and in the row of no
    words the number of words of the language. A stored table of frequent phrases only."""
    spark = df.sparkSession
    prepare(spark)
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    heavy = spark.sparkContext.broadcast(heavy_words(texts, buckets))  # at most 8 bytes a bucket

    def packed(parts):
        """One row for each bucket: its paths, led by their language, with weight and slice."""
        if not parts:
            return
        paths = [p for tag, own, _, _ in parts for p in map(tag.__add__, own)]
        weights, routes = (np.concatenate([x[k] for x in parts]) for k in (2, 3))
        bucket, piece = bucket_and_slice(routes, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        offsets = pa.array(np.r_[starts, len(paths)], pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(bucket[starts], pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array([paths[i] for i in order.tolist()], pa.binary()).cast(pa.string())),
            pa.ListArray.from_arrays(offsets, pa.array(weights[order], pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array(piece[order], pa.int8()))], names=["bucket", "paths", "weights", "slices"])

    def build(batches):
        held, size = [], 0
        for lang, text in _texts(batches):
            paths, weights, routes = local_paths(text, heavy.value)
            if paths:  # any language as one token
                held.append((b"=" + quote(lang, safe="").encode() + b" ", paths, weights, routes))
                size += len(text)
            if size >= GRAPH_BYTES:
                yield from packed(held)
                held, size = [], 0
        yield from packed(held)

    def counted(rows):
        paths = pa.concat_arrays([r.column(1).flatten() for r in rows])
        weights, slices = (np.concatenate([r.column(k).flatten().to_numpy(zero_copy_only=False) for r in rows]) for k in (2, 3))
        parts = min(256, 1 + paths.nbytes // SLICE_BYTES)
        piece = slices.view(np.uint8).astype(np.int64) * parts // 256
        for k in range(parts):
            chosen = np.flatnonzero(piece == k)
            if not chosen.size:
                continue
            for words, langs, phrases, n in flows(paths.take(pa.array(chosen)), weights[chosen], min_count, heavy.value):
                yield pa.RecordBatch.from_arrays([
                    pa.array([unquote(x[1:].decode()) for x in langs], pa.string()), pa.array(np.full(len(n), words), pa.int32()),
                    pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "words", "phrase", "n"])

    def add_up(batches):
        at, rows = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if rows and keys[i] != at:
                    yield from counted(rows)
                    rows = []
                at = keys[i]
                rows.append(batch.slice(i, j - i))
        if rows:
            yield from counted(rows)

    routed = (texts.mapInArrow(build, "bucket int, paths array<string>, weights array<long>, slices array<byte>")
              .repartition("bucket").sortWithinPartitions("bucket"))
    counts = (routed.mapInArrow(add_up, "lang string, words int, phrase string, n long")
              .groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")))
    return materialize(counts.where((F.col("words") == 0) | (F.col("n") >= min_count)), compression=None)


def _part(phrase, start, n):
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def collocations(df: DataFrame, min_count: int = 30, top: int = 2000, scale: int = 2_000_000, inside: int = 80,
                 lang_col: str = "lang", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    if min_count < 1:
        raise ValueError("min_count is at least 1")
    counts = phrase_counts(df, min_count, lang_col, text_col, buckets)
    words = F.col("words")
    found = counts.where(words > 1).select("lang", "words", "phrase", F.col("n").alias("a"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), words - 1)))
    cuts = cuts.select("*", _part("phrase", F.lit(1), F.col("k")).alias("head"),
                       _part("phrase", F.col("k") + 1, words - F.col("k")).alias("tail"))
    parts = counts.where(words.between(1, 3))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    exact = "decimal(20,0)"
    score = F.expr(f"cast(cast({int(scale)} as {exact}) * cast(a as decimal(18,0)) div (cast(l as {exact}) + cast(r as {exact})) as long)")
    best = (cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r"))
            .groupBy("lang", "words", "phrase", "a").agg(F.min("cut").alias("cut")))
    within = found.where(words > 2).select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(2), words - 1)).alias("m"))
    within = within.select("lang", "phrase", "a", "m", F.explode(F.sequence(F.lit(1), words - F.col("m") + 1)).alias("start"))
    around = (within.select("lang", _part("phrase", F.col("start"), F.col("m")).alias("phrase"), F.col("a").alias("longer"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = best.join(around, ["lang", "phrase"], "left").where(
        F.expr(f"longer IS NULL OR cast(100 as {exact}) * cast(longer as decimal(18,0)) < cast({int(inside)} as {exact}) * cast(a as decimal(18,0))"))
    totals = counts.where(words == 0).groupBy("lang").agg(F.max("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = (kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(top)))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
