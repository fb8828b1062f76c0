"""The corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; between
stages the documents are written as Parquet into the shared folder and read again, so a lost executor costs
a task of one stage. All stages but the last return the columns of ``documents``.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows, no rows at all, and further
columns of any name, as its docstring says. The near-duplicate stage takes shingle length and bit distance from the contract
of its operator, and checks no word similarity beside the distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import decontaminate, packing, pii, quality_rules, simhash
from ledgerflow.llm.common import shared_folder, table
from ledgerflow.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines leave their document, rejected documents leave the corpus.

    A null text has no words and is rejected, as are texts of fewer than ten words; a null id stays a row; repeated rows are judged
    one by one; all columns stay, ``n_chars`` follows the text."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash group stays, the one with the smallest id.

    Texts without a word have the fingerprint zero and are linked like any other; a document without an id is linked too and stays only
    where no member of its group has one; rows that repeat id and text count as one document; nothing is removed from an empty table."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out.

    Items without an id count like others, items without a text or a word not at all; a null text stays null; a document may become empty, and
    stays; without items nothing is cut."""
    return decontaminate.remove_phrases(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it become labels.

    A null text stays null, a text without personal data stays as it is; spans that overlap become one label; counts are over all
    documents that the stage before kept."""
    return pii.sanitize(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences.

    A null or empty text is one piece, its end id; very long texts are cut into as many pieces as it takes; repeated rows are packed each;
    an empty table gives no piece."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("packing", pack),
]

# Fingerprints, tokenizers and the column generation are not SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the last one."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            done.write.parquet(f"{folder}/{k}")
            done = spark.read.parquet(f"{folder}/{k}")
        docs = done
    return docs
