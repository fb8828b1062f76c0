import importlib
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerflow.llm import packing, quality_rules, simhash
from ledgerflow.llm.queries import QUERIES, tokenizer_path
from tests.llm.helpers import awkward, documents, prose

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_take_effect(spark, tmpdir_path):
    items = [(1, prose(700, 40))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    good = prose(800, 120)
    rows = awkward() + [(20, good), (21, good), (22, prose(801, 80) + " " + prose(700, 40)),
                        (23, prose(802, 90) + " mail a@b.example.com now."), (24, "A | B | C | D\n" * 30)]
    docs = documents(spark, rows, extra=False)
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        done = stage(spark, docs, tmpdir_path)
        assert done.columns == COLUMNS and done.dtypes == docs.dtypes, name
        done.write.parquet(f"{tmpdir_path}/{k}")
        docs = spark.read.parquet(f"{tmpdir_path}/{k}")
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert 24 not in kept[0] and 1 not in kept[0] and {20, 21, 22, 23} <= set(kept[0])
    assert 20 in kept[1] and 21 not in kept[1]
    assert prose(700, 40)[:60] in kept[1][22] and prose(700, 40)[:60] not in kept[2][22]
    assert "[EMAIL]" in kept[3][23] and kept[3][20] == good
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tmpdir_path)
    assert packed.select("doc_id").distinct().count() == len(kept[3])


def test_run_gives_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
    expected = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_filters_of_the_first_two_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = quality_rules.clean_lines(docs).where("kept").select("doc_id")
    kept = quality_rules.keep_good(docs).persist()
    assert {r[0] for r in verdict.collect()} == {r[0] for r in kept.select("doc_id").collect()}
    roots = simhash.near_duplicates(kept).where("doc_id = component_id").select("doc_id")
    assert {r[0] for r in roots.collect()} == {r[0] for r in simhash.keep_one(kept).select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_test_tables(spark, name):
    out = QUERIES[name](spark, SF)
    if "phrases" in name:  # rows are phrases of a language
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.where("a < 30").count() == 0
        return
    table = "conversations" if "chat" in name else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    key = "conv_id" if "chat" in name else "doc_id"
    ids = {r[0] for r in rows.select(key).distinct().collect()} | ({-7} if "chat" in name else set())
    assert {r[0] for r in out.select(F.col(key)).distinct().collect()} == ids


def test_entry_works_without_the_subpackage(monkeypatch):
    assert {"pipeline", *QUERIES} <= set(__spark_entry__.queries())
    for gone in ("corpus_pipeline", "ledgerflow.llm"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, gone, None)
            if gone == "ledgerflow.llm":
                m.setitem(sys.modules, "ledgerflow.llm.queries", None)
            entry = importlib.reload(__spark_entry__)
            assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries()) and len(entry.queries()) >= 75
    importlib.reload(__spark_entry__)
