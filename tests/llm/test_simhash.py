import re

import numpy as np
import pytest
import xxhash

from ledgerflow.llm import simhash as sh
from ledgerflow.llm.components import components
from tests.llm.helpers import WORD, awkward, documents, empty, prose


def fingerprint(text, shingle=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def neighbours(fps, radius):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= radius]


def noisy(n, seed, spread=9):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 2**63, n)]
    for f in list(out[: n // 2]):
        for _ in range(3):
            for b in rng.choice(64, rng.integers(0, spread), replace=False):
                f ^= 1 << int(b)
            out.append(f)
    return sorted(set(out))


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    fps = np.array(noisy(150, radius), dtype=np.uint64)
    q, c = sh.close_pairs(fps, sh.planes(fps), len(fps), radius)
    exact = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    assert set(zip(q.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(exact))))


@pytest.mark.parametrize("blocks, tile", [(5, 2048), (6, 16), (7, 2048), (8, 8)])
def test_links_connect_what_brute_force_connects(spark, blocks, tile):
    fps = noisy(120, 5)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = sh.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 4, tile, blocks).collect()
    back = dict(zip(signed, fps))
    pairs = [(back[r["u"]], back[r["v"]]) for r in found]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    assert groups(fps, pairs) == groups(fps, neighbours(fps, 4))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(500, 560)] + [(9, 9), (3, 2), (2, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(500, 560)} | {3: 2}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents_against_brute_force(spark):
    text = prose(9, 300)
    rows = awkward() + [(50 + i, text.replace("ta", "ta", 1) + " tail" * i) for i in range(4)] + [(60, text.upper())]
    out = sh.near_duplicates(documents(spark, rows)).collect()
    prints = [(i, fingerprint(t)) for i, t in rows]
    assert sorted((r["doc_id"] or 0, r["fp"] & (1 << 64) - 1) for r in out) == sorted((i or 0, f) for i, f in prints)
    named = groups({f for _, f in prints}, neighbours(sorted({f for _, f in prints}), 4))
    least = {}
    for i, f in prints:
        if i is not None:
            least[named[f]] = min(i, least.get(named[f], i))
    assert all(r["component_id"] == least.get(named[r["fp"] & (1 << 64) - 1]) for r in out)


def test_keep_one(spark):
    rows = awkward()
    out = sh.keep_one(documents(spark, rows)).collect()
    named = sh.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == len({r["root"] for r in named})
    assert {r["doc_id"] for r in out if r["doc_id"] is not None} == {r["component_id"] for r in named if r["component_id"] is not None}
    assert all(r["fp"] == "own fp" for r in out)
    assert sh.keep_one(empty(spark)).count() == 0 and sh.near_duplicates(empty(spark)).count() == 0
