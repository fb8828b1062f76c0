import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import periodic_runs, phrases, queries, sharding
from tests.llm.helpers import WORD, awkward, by_id, documents, empty, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_runs(w, min_length=6, power=4):
    found, n = {}, len(w)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(min_length, power * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("min_length,power", [(6, 4), (3, 3), (10, 5)])
def test_runs_of_random_words(min_length, power):
    r = random.Random(min_length)
    for _ in range(300):
        docs = []
        for _ in range(r.randint(1, 5)):
            n, k = r.choice([0, 1, 5, 6, 30, 120]), r.randint(1, 3)
            w = [bytes([97 + r.randrange(k)]) for _ in range(n)]
            if n and r.random() < 0.7:
                a, p = r.randrange(n), 1 + r.randrange(8)
                w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < n else w[i] for i in range(n)]
            docs.append(w)
        assert periodic_runs.runs_of(docs, min_length, power) == [brute_runs(d, min_length, power) for d in docs]


def test_runs_of_long_periodic_texts():
    a, ab = [b"a"], [b"a", b"b"]
    while len(ab) < 20_000:
        a, ab = ab, ab + a
    assert periodic_runs.runs_of([[b"x"] * 50_000, ab]) == [[(0, 50_000, 1)], []]  # a Fibonacci word has no fourth power


def brute_op11(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], *sha)


def run_rows():
    r = random.Random(9)
    return [x for x in awkward() if x[0] != 7] + [(i, prose(i, r.choice([3, 40, 200]))) for i in range(200, 320)] + [
        (400, "a b c " * 5 + "z " + "q " * 9), (401, "one\ttwo\n" * 4), (402, "l1\n" * 7)]


def test_op11_against_brute_force(spark, tmp_path):
    documents(spark, run_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    expected = [brute_op11(i, t) for i, t in run_rows()]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))
    assert sum(e[1] > 0 for e in expected) > 8


def test_runs_of_nothing(spark):
    assert periodic_runs.find_runs(empty(spark)).count() == 0
    row = periodic_runs.find_runs(documents(spark, [(1, None)])).first()
    assert (row["n_words"], row["runs"], row["collapsed"]) == (0, [], "")


def brute_phrases(rows, min_count, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    around = {}
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for s in range(len(w) - m + 1):
                around[lang, w[s:s + m]] = max(around.get((lang, w[s:s + m]), 0), a)
    out = []
    for (lang, w), a in found.items():
        if 100 * around.get((lang, w), -1) >= 80 * a:
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        best = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(best)]
    return sorted(ranked)


def phrase_rows():
    r = random.Random(3)
    words = ["a", "b", "c", "D", *"uvwxyz", "e.", "f,", "\n", "é", "\x1c", "x\x00", "g!h"]
    return [(r.choice([None, "en", "fr", "zh Hant.", ""]), " ".join(r.choice(words) for _ in range(r.randrange(60)))) for _ in range(300)] + [
        ("en", None), ("de", ""), ("x", " . \n"), ("en", "the same line\nthe same line\n" * 200)] + [("fr", "copies of one text here")] * 50


@pytest.mark.parametrize("buckets,graph_bytes", [(None, 8 << 20), (3, 700)])
def test_phrases_against_brute_force(spark, monkeypatch, buckets, graph_bytes):
    monkeypatch.setattr(phrases, "GRAPH_BYTES", graph_bytes)
    df = spark.createDataFrame([(*r, "own", "own") for r in phrase_rows()], "lang string, text string, phrase string, n string")
    if graph_bytes < 1000:  # the tasks' workers read the module anew: chunks are tried here
        import pyarrow as pa
        batch = pa.RecordBatch.from_pydict({"lang": ["und" if r[0] is None else r[0] for r in phrase_rows()], "text": [r[1] for r in phrase_rows()]})
        chunks = spark.createDataFrame([(a, b.decode()) for a, b in phrases._texts([batch])], "lang string, text string")
        assert chunks.count() > 20
        df = chunks
    got = sorted(tuple(r) for r in phrases.collocations(df.repartition(4), 4, 50, buckets=buckets).collect())
    assert got == brute_phrases(phrase_rows() if graph_bytes > 1000 else [(r[0], r[1]) for r in chunks.collect()], 4, 50)
    assert len(got) > 80
    if graph_bytes < 1000:  # cutting long texts behind pieces changes no count
        assert got == brute_phrases([r for r in phrase_rows()], 4, 50)


def test_paths_are_compacted():
    paths, weights, _ = phrases.local_paths(b"one two three four five six seven.\n" * 9 + b"one two three four nine",
                                            np.sort(phrases._hashes([b"nine"])))
    assert (b"one two three four", 10) in zip(paths, weights.tolist())
    assert sum(len(p.split()) - 3 for p in paths) == 7 + 4  # every distinct edge once
    assert len(paths) < 9
    all_heavy = np.sort(phrases._hashes(phrases._coded(phrases._tokens(b"one two three four five six seven nine"))[1]))
    assert len(phrases.local_paths(b"one two three four five six seven.\n" * 9, all_heavy)[0]) == 7  # every node has its own bucket


def test_phrases_of_nothing(spark):
    assert phrases.collocations(empty(spark)).count() == 0
    assert phrases.collocations(documents(spark, [(1, None), (2, " "), (3, "a b")])).count() == 0


def check_shards(rows, got, shards):
    size = {}
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    by_place = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    for r in by_place:
        slots = size.setdefault(r["shard"], [])
        assert r["slot"] == len(slots)
        slots.append(r["size"])
    order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in by_place]
    assert order == sorted(order)  # contiguous in the order of ids
    total, before = sum(map(sum, size.values())), 0
    for r in by_place:  # the shard of the middle byte
        assert r["shard"] == (2 * before + r["size"]) * shards // (2 * total)
        before += r["size"]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_against_brute_force(spark, shards):
    rows = awkward() + [(i % 90, prose(i, i % 50)) for i in range(300)] + [(17, "same")] * 200 + [(None, "")] * 3
    got = sharding.assign_shards(documents(spark, rows).repartition(5), shards).collect()
    check_shards(rows, got, shards)


def test_shards_of_few_rows(spark):
    assert sharding.assign_shards(empty(spark), 40).count() == 0
    got = sharding.assign_shards(documents(spark, [(1, "a"), (2, None)]), 40).collect()
    check_shards([(1, "a"), (2, None)], got, 40)


def test_shard_files(spark, tmp_path):
    rows = [(i, prose(i, 20)) for i in range(100, 160)] + [(1, None), (None, "")]
    docs = documents(spark, rows).withColumn("shard", F.lit("own")).withColumn("slot", F.lit("own"))
    sharding.write_shards(docs, f"{tmp_path}/out", 8)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select("row.*").collect())) == sorted(map(str, docs.collect()))
    assert back.select("shard").distinct().count() == 8


def test_op13_columns(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_sharding(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                                "slot": "bigint", "grown_shard": "int"}
    check_shards(awkward(), out.collect(), 40)
    assert {r["law"] for r in out.collect()} == {"bytes"} and out.where(F.col("grown_shard").isNotNull()).count() == 0
    assert by_id(out)


def test_phrase_graph_holds_little_memory():
    """The arrays of a text's graph are freed on the way: a task's memory stays a small multiple of its text."""
    import tracemalloc
    pick = random.Random(5)
    text = " ".join(f"word{int(pick.paretovariate(0.7)) % 20000}" + "." * (pick.random() < 0.1) for _ in range(200_000)).encode()
    phrases.local_paths(text[:1000], np.array([], np.uint64))  # imports
    tracemalloc.start()
    paths, weights, routes = phrases.local_paths(text, np.array([], np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(paths) == len(weights) == len(routes)
    assert peak < 22 * len(text), peak / len(text)
