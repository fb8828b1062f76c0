"""The operators bound to the test tables: one query for each, and the pipeline.

Where a contract fixes the columns of a result, the query derives them from the
operator's own output.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import (chat, decontaminate, licenses, packing, periodic_runs, phrases, pii, quality_classifier, quality_rules,
                            records, sharding, simhash, token_counts)
from ledgerflow.llm.common import keep, shared_folder, table
from ledgerflow.llm.oracle_sql import ORACLE  # noqa: F401


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; TOKENIZER_DIR overrides the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held_out(doc_id):
        return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"),
                                         labels.select("doc_id", F.col("quality").alias("label")), threshold=0.3)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words("spans")
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-records")
    records.write_records(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    rows = keep(records.read_records(spark, path))  # both the sums by file and the rows read it
    return records.global_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    done = chat.format_chats(chat.records_from_rows(rows.unionByName(extra)))
    back = done.select("conv_id", "layout", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.all_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS), F.size("_term").cast("long").alias("n_term"),
        F.sha2(pii.written(pii.KINDS), 256).alias("base_sha256"), pii.written((*pii.KINDS, "term")).alias("spans"))


def tiled(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``documents``; where crc32(doc_id) ends in 0 the words from place a on repeat with period p, a and p
    taken from the checksum, as the contract of operator 11 says. Other texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(
        h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    period = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    length = F.col("n") - F.col("a")
    copies = F.flatten(F.array_repeat(period, F.ceil(length / F.col("p")).cast("int")))
    words = F.concat(F.slice("w", 1, F.col("a").cast("int")), F.slice(copies, 1, length.cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(tiled(table(spark, sf_dir, "documents")), min_length=6, power=4)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("*", best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"),
                      period.alias("period"), F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=30, top=2000, scale=2_000_000, inside=80)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_license_scan": op4_license_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_packing": op6_packing,
    "op7_token_records": op7_token_records,
    "op8_token_counts": op8_token_counts,
    "op9_chat_format": op9_chat_format,
    "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrases": op12_phrases,
    "op13_sharding": op13_sharding,
}

