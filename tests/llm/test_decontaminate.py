import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import decontaminate as dc
from ledgerflow.llm.fm_index import FMIndex
from tests.llm.helpers import awkward, documents, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        wanted = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i:i + n]) in wanted:
                hit |= set(range(i, i + n))
                found |= {str(item)} - {"None"}
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_and_locates_all(seed):
    rng = np.random.default_rng(seed)
    kinds = int(rng.integers(2, 6))
    text = rng.integers(0, kinds, int(rng.integers(0, 500)))
    index = FMIndex(text, kinds, rate=int(rng.integers(1, 20)))
    for size in (1, 2, 4):
        phrases = rng.integers(1, kinds, (15, size))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            expected = [i for i in range(len(text) - size + 1) if (text[i:i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def case():
    items = [(1, prose(20, 40)), (2, prose(21, 10)), (3, "Short item"), (4, None), (5, "..."), (None, prose(22, 30)),
             (1, prose(23, 30)), (10, prose(20, 40)), (7, "aa " * 25)]
    body = prose(30, 200)
    rows = awkward() + [(100, body + " " + re.sub("[a-z]", lambda m: m.group().upper(), prose(20, 40)) + " " + body), (101, prose(21, 10)), (102, "a short ITEM!"),
                        (103, " ".join(prose(20, 40).split()[3:12])), (104, prose(22, 30)), (105, prose(23, 30) * 3),
                        (106, "aa " * 60), (107, prose(20, 40).replace(" ", "\n- "))]
    return rows, items


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_documents_against_brute_force(spark, block_words):
    rows, items = case()
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("x"))
    out = dc.search(documents(spark, rows), table, block_words=block_words).select(
        "row.doc_id", "n_words", dc.hit_words("spans").alias("n_hit"), F.array_join("items", ",").alias("ids")).collect()
    expected = sorted(((i or 0), *brute(t, items)) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["ids"]) for r in out) == expected


def test_small_shards_find_the_same(monkeypatch):
    rows, items = case()
    table = dc.phrases([(i and str(i), t) for i, t in items])
    whole = dc.find([t for _, t in rows], table)
    monkeypatch.setattr(dc, "SHARD_WORDS", 25)
    assert dc.find([t for _, t in rows], table) == whole


def test_removal_cuts_the_passage_only(spark):
    rows, items = case()
    out = {r["doc_id"]: r for r in dc.remove_phrases(
        documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    body = prose(30, 200)
    assert words(out[100]["text"]) == words(body) * 2 and out[100]["n_chars"] == len(out[100]["text"])
    assert out[7]["text"] == prose(1, 30_000) and out[1]["text"] is None and words(out[104]["text"]) == []
    assert out[7]["spans"] == "own spans" and len(out) == len({i for i, _ in rows})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.search(empty(spark), none).count() == 0
    assert dc.search(documents(spark), none).where(F.size("items") > 0).count() == 0
    assert dc.remove_phrases(documents(spark), none).count() == len(awkward())


def test_many_equal_items(spark):
    rows, items = case()
    table = spark.createDataFrame(items, "item_id long, text string")
    many = table.crossJoin(spark.range(500)).drop("id")
    wanted = dc.search(documents(spark, rows), table).select("row.doc_id", "spans", "items").collect()
    assert sorted(map(str, dc.search(documents(spark, rows), many).select("row.doc_id", "spans", "items").collect())) == sorted(map(str, wanted))
