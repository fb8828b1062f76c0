r"""Benchmark decontamination by an FM-index per training shard (operator 5).

A-Z become lower case; words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A phrase is a window
of 10 consecutive words of an item, or a whole shorter item that has words. Each task
cuts its documents into shards of bounded size and maps words to symbols of the phrases'
vocabulary; a word outside it is a separator, which no phrase can cross. Runs between separators
shorter than the shortest phrase cannot hold one and are left out of the index. The shard's FM-index
then finds all phrases at once by backward search over wavelet ranks and locates every
occurrence from sampled suffix positions; occurrences merge into removal spans.

The phrases are broadcast in blocks: the items are counted first, and when they hold more
than ``block_words`` words they are dealt by a hash into as many blocks as it takes, each broadcast by
itself and run over all documents in turn (one pass per block, no shuffle).

Defined cases: a null text, of a document or an item, has no words; an item without an id is searched for, hit and
removed like any other, and only missing from the ids; item rows that repeat an id count as one item; a null document id stays a row; repeated
rows each get a result; empty tables give an empty result or nothing found; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import prepare, whole_row
from ledgerflow.llm.fm_index import FMIndex
from ledgerflow.llm.quality_rules import with_text

WINDOW = 10
BLOCK_WORDS = 500_000
SHARD_WORDS = 2_000_000
# Bytes of a word: digits, letters (A-Z as a-z) and all of non-ASCII; any other byte ends it.
_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND_TYPES = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
               ("items", pa.list_(pa.string()))]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


@dataclass
class Phrases:
    """The phrases of one block: symbols of the words, and by length the phrases with their items."""

    symbols: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, list[list[str]]]]

    @property
    def longest(self) -> int:
        return max(self.by_length, default=1)


def phrases(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases:
    """The phrases of (item id, text) pairs; equal phrases of several items are one."""
    symbols: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        own = [symbols.setdefault(w, len(symbols) + 1) for w in words(text)]
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            owners.setdefault(tuple(own[i:i + size]), set()).update([item] if item is not None else [])
    lengths: dict[int, list] = {}
    for phrase, who in owners.items():
        lengths.setdefault(len(phrase), []).append((phrase, sorted(who)))
    return Phrases(symbols, {n: (np.array([p for p, _ in found], np.int64), [w for _, w in found])
                             for n, found in lengths.items()})


def _segments(text: str | None, known: dict[bytes, int], overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first word, symbols) of consecutive parts of a text that overlap by ``overlap`` words; 0: no phrase has the word."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)
    at, done, tail = 0, 0, np.zeros(0, np.int32)
    while at < len(raw) or not at:
        end = at + 6 * SHARD_WORDS
        end = raw.find(b" ", end) if end < len(raw) else len(raw)
        end = len(raw) if end < 0 else end
        own = raw[at:end].split()
        part = np.concatenate([tail, np.fromiter(map(known.get, own, repeat(0)), np.int32, len(own))])
        yield done - len(tail), part
        done += len(own)
        tail = part[len(part) - min(overlap, len(part)):]
        at = max(end, 1)


def find(texts: list[str | None], table: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For every text: number of words, merged (first, last) word spans of all occurrences, items found."""
    counts = [0] * len(texts)
    hits: list[tuple[np.ndarray, ...]] = []
    shard: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        for first, part in _segments(text, table.symbols, table.longest - 1):
            counts[i] = first + len(part)
            if len(part) and part.any():
                shard.append((i, first, part))
                size += len(part)
            if size >= SHARD_WORDS:
                hits += _search(shard, table)
                shard, size = [], 0
    hits += _search(shard, table)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for doc, first, length, who in hits:
        for d, a, k in zip(doc.tolist(), first.tolist(), who.tolist()):
            spans.setdefault(d, []).append((a, a + length - 1))
            items.setdefault(d, set()).update(table.by_length[length][1][k])
    return [(n, merge(spans.get(i, [])), sorted(items.get(i, ()))) for i, n in enumerate(counts)]


def _search(shard: list[tuple[int, int, np.ndarray]], table: Phrases) -> list[tuple]:
    """(documents, first words, phrase length, phrase numbers) of all occurrences in a shard, by phrase length."""
    if not shard or not table.by_length:
        return []
    shortest = min(table.by_length)
    text = np.concatenate([np.concatenate([p, [0]]) for _, _, p in shard]).astype(np.int64)
    lengths = np.array([len(p) + 1 for _, _, p in shard])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    # Runs of known words that are long enough, each followed by one separator.
    edge = np.diff(np.concatenate([[0], (text != 0).astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stops - starts >= shortest
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return []
    size = stops - starts + 1  # with the separator behind the run
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    places = np.arange(int(size.sum())) - np.repeat(offset, size) + np.repeat(starts, size)
    index = FMIndex(text[places], len(table.symbols) + 1)
    out = []
    for length, (rows, _) in sorted(table.by_length.items()):
        low, high = index.search(rows)
        times = high - low
        if not times.any():
            continue
        which = np.repeat(np.arange(len(rows)), times)
        row = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        at = places[index.locate(row)]
        part = np.searchsorted(begins, at, side="right") - 1
        docs = np.array([d for d, _, _ in shard])[part]
        firsts = np.array([f for _, f, _ in shard])[part] + at - begins[part]
        out.append((docs, firsts, length, which))
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    out, at, wanted = [], 0, iter(spans)
    span = next(wanted, None)
    for i, m in enumerate(_WORD.finditer(text)):
        if span is None:
            break
        if i == span[0]:
            out.append(text[at:m.start()])
        if i == span[1]:
            at = m.end()
            span = next(wanted, None)
    return "".join(out) + text[at:]


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
           item_col: str = "item_id", item_text: str = "text", text_col: str = "text", cut: bool = False) -> DataFrame:
    """Columns ``row`` (all of ``docs`` as a struct), ``text`` (with ``cut``, without the spans' words) and ``n_words``, ``spans`` and ``items``: words, merged word spans and the ids of
    the items found, sorted as strings. Narrow over the documents, one pass for each block of items."""
    spark = docs.sparkSession
    prepare(spark)
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    # A word has at least one byte and a separator, so half the bytes bound the words.
    total = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    blocks = total // block_words + 1
    packed = docs.select(whole_row(docs).alias("row"), F.col(text_col).alias("text"))
    out = packed.select("row", "text", F.lit(0).cast("long").alias("n_words"),
                        F.expr("cast(array() as array<struct<first:long,last:long>>)").alias("spans"),
                        F.expr("cast(array() as array<string>)").alias("items"))
    schema = out.schema
    for block in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        table = spark.sparkContext.broadcast(phrases([(r["item"], r["text"]) for r in mine.collect()], window))

        def run(batches: Iterator[pa.RecordBatch], table=table, last=cut and block == blocks - 1) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                found = find(texts, table.value)
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                cols = [[], [], []]
                for (n, spans, ids), (s, i) in zip(found, before):
                    whole = merge(spans + [(x["first"], x["last"]) for x in s])
                    if last and whole:
                        place = len(cols[0])
                        texts[place] = without(texts[place], whole)
                    cols[0].append(n)
                    cols[1].append([{"first": a, "last": b} for a, b in whole])
                    cols[2].append(sorted({*ids, *i}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(texts, pa.string()), *(pa.array(c, k) for c, (_, k) in zip(cols, FOUND_TYPES))],
                    ["row", "text", *(n for n, _ in FOUND_TYPES)])

        out = out.mapInArrow(run, schema)
    return out


def hit_words(spans):
    """Words covered by the merged spans, as a Column."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)


def remove_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
                   item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All documents with the removal spans cut out of their text; all columns of ``docs`` stay."""
    found = search(docs, items, window, block_words, item_col, item_text, cut=True)
    return with_text(found, docs.columns, F.col("text"))
