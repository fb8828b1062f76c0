r"""Maximal periodic runs of words in a document, and the text without their repetitions.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(min_length, power * q)`` that no neighbouring word extends with the same period. Runs come from maximal
pairs: two places i < j whose following words agree for exactly ``depth`` words and whose left words
differ. With d = j - i, words i .. j+depth-1 then have period d and no neighbour keeps it, so a pair with
``d <= depth / (power - 1)`` is a run as it stands, without extension; multiples of a period give the same stretch, and
the least distance of a stretch is its smallest period.

The pairs are listed bottom-up over the tree of LCP intervals of a suffix array over the words (prefix doubling,
then the LCPs of neighbours). Each interval keeps its places in order with the class of their left word.
When two children meet, the places of the smaller one look into the list of the larger one. Places of one
interval within a third of its depth lie at equal steps, so all but the first of them have the same left word: the
first place within reach decides on the left, the next one on the right, and classes that match are skipped
whole. The work is that of merging small lists into large ones plus the pairs found, whose number is linear.

Documents are independent and each is handled whole by one task, several of a batch in one array (words of
different documents never compare equal). No shuffle; memory is that of one Arrow batch or of one long
document.

Cases: a null or empty text, or one of white space only, has no words, no runs and an empty ``collapsed`` text. Rows
with equal or null ids stay rows of their own. An empty table gives an empty table. Columns beside id and text are not
read and cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerflow.llm.common import documents, prepare

MIN_LENGTH, POWER = 6, 4
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS), ("collapsed", pa.string())])


def least_depth(min_length: int, power: int) -> int:
    """The smallest depth at which a maximal pair can be a run."""
    depth = power - 1
    while depth + depth // (power - 1) < min_length:
        depth += 1
    return depth


def repeated(codes: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from a place on occur at another place too (exact: classes, no hashes)."""
    n = len(codes)
    out = np.zeros(n, bool)
    if n <= k:
        return out
    cls = codes
    for step in range(1, k):
        cls = pd.factorize(cls[:-1] * np.int64(n) + codes[step:])[0].astype(np.int64)
    out[:len(cls)] = np.bincount(cls)[cls] > 1
    return out


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each place) by prefix doubling; only places that still tie are sorted again."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    active = order[np.repeat(sizes, sizes) > 1]
    step = 1
    while active.size:
        after = active + step
        key = rank[active] * np.int64(n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        active, key = active[by_key], key[by_key]
        old = key // (n + 1)
        new_old = np.r_[True, old[1:] != old[:-1]]
        slot = old + np.arange(len(old)) - np.maximum.accumulate(np.where(new_old, np.arange(len(old)), 0))
        order[slot] = active
        new = np.r_[True, key[1:] != key[:-1]]
        start = slot[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        rank[active] = start
        sizes = np.diff(np.r_[np.flatnonzero(new), len(key)])
        active = active[np.repeat(sizes, sizes) > 1]
        step *= 2
    return order, rank


def neighbour_lcps(codes: list[int], order: np.ndarray, rank: np.ndarray, active: np.ndarray) -> dict[int, int]:
    """Slot -> words that the suffix there shares with the one before it; places in text order, so each word is
    compared once. Only places whose first words repeat are asked."""
    n, h, before, out = len(codes), 0, -2, {}
    places = np.flatnonzero(active)
    slots = rank[places]
    others = order[np.maximum(slots - 1, 0)]
    for p, s, q in zip(places.tolist(), slots.tolist(), others.tolist()):
        h = h - 1 if p == before + 1 and h else 0
        before = p
        if s == 0:
            h = 0
            continue
        while p + h < n and q + h < n and codes[p + h] == codes[q + h]:
            h += 1
        out[s] = h
    return out


def maximal_pairs(order: np.ndarray, lcp: dict[int, int], left: list[int], depth: int, power: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, depth) of maximal pairs with j - i <= depth / (power - 1), bottom-up over the LCP intervals of at least ``depth``."""
    def meet(a: list[int], b: list[int], at: int):
        big, small = (a, b) if len(a) >= len(b) else (b, a)
        reach = at // (power - 1)
        for p in small:
            k = bisect_left(big, p)
            if k < len(big) and big[k] - p <= reach and left[big[k]] != left[p]:
                for j in range(k, len(big)):
                    if big[j] - p > reach:
                        break
                    yield p, big[j], at
            if k and p - big[k - 1] <= reach:
                i = big[bisect_left(big, p - reach, 0, k)]
                if left[i] != left[p]:
                    yield i, p, at

    def joined(a: list[int], b: list[int]) -> list[int]:
        big, small = (a, b) if len(a) >= len(b) else (b, a)
        if len(small) * 8 > len(big):
            big += small
            big.sort()
        else:
            for p in small:
                insort(big, p)
        return big

    slots = sorted(s for s, h in lcp.items() if h >= depth)
    stack: list[tuple[int, list[int]]] = []
    for x, s in enumerate(slots):
        if not stack:
            leaf = [int(order[s - 1])]
            stack.append((lcp[s], leaf))
        # the stack's top ends at slot s - 1 with depth lcp[s], or is shallower; the leaf of slot s comes next
        node = [int(order[s])]
        follows = lcp.get(s + 1, 0) if x + 1 < len(slots) and slots[x + 1] == s + 1 else 0
        here = lcp[s]
        if here > follows:
            at, held = stack.pop()
            yield from meet(held, node, at)
            node = joined(held, node)
            while stack and stack[-1][0] > follows:
                at, held = stack.pop()
                yield from meet(held, node, at)
                node = joined(held, node)
            if stack and stack[-1][0] == follows:
                at, held = stack.pop()
                yield from meet(held, node, at)
                stack.append((at, joined(held, node)))
            elif follows >= depth:
                stack.append((follows, node))
        elif here == follows:
            at, held = stack.pop()
            yield from meet(held, node, at)
            stack.append((at, joined(held, node)))
        else:
            stack.append((follows, node))


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document's words, by start, then period."""
    depth = least_depth(min_length, power)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return out
    seen: dict[bytes, int] = {}
    words = np.fromiter((seen.setdefault(w, len(seen)) for t in texts for w in t), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(texts)), lengths)
    codes = pd.factorize(doc * np.int64(len(seen)) + words)[0].astype(np.int64)
    # Documents in which no stretch of ``depth`` words repeats have no interval that deep.
    some = np.zeros(len(texts), bool)
    again = repeated(codes, depth)
    some[doc[again]] = True
    chosen = some[doc]
    codes, again, doc = codes[chosen], again[chosen], doc[chosen]
    if not len(codes):
        return out
    order, rank = suffix_array(codes)
    starts = np.r_[True, doc[1:] != doc[:-1]]
    left = np.where(starts, -1, np.r_[-1, codes[:-1]]).tolist()
    found: dict[tuple[int, int], int] = {}
    for i, j, at in maximal_pairs(order, neighbour_lcps(codes.tolist(), order, rank, again), left, depth, power):
        d = j - i
        if d + at >= min_length:
            key = (i, d + at)
            if d < found.get(key, d + 1):
                found[key] = d
    first = dict(zip(doc[starts].tolist(), np.flatnonzero(starts).tolist()))
    for (i, length), period in sorted((k, p) for k, p in found.items()):
        d = int(doc[i])
        out[d].append((i - first[d], length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              power: int = POWER) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    ``power`` is the least number of periods in a run, at least 3; ``min_length`` its least number of words.
    """
    if power < 3 or min_length < 1:
        raise ValueError("a run has at least 3 periods and one word")
    prepare(df.sparkSession)

    def scan(batches):
        for batch in batches:
            # bytes.split() cuts at the six characters of ASCII white space and nowhere else
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            runs = runs_of(texts, min_length, power)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], RUNS),
                pa.array([collapse(t, r) for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())], schema=OUT)

    return documents(df, id_col, text_col).mapInArrow(
        scan, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
