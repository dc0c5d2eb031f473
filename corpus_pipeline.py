"""A training-data pipeline over ``documents``: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs; all but the last return the columns of ``documents``.

In every stage an empty table gives an empty table, null and empty texts are texts without words, very long ones are read whole, rows with a null id or a repeated
one are rows of their own unless a stage says otherwise, and further columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxolink.llm.common import staged, table
from taxolink.llm.op1_mixing import mix
from taxolink.llm.op2_near_duplicates import keep_one
from taxolink.llm.op3_token_files import read_documents, tokenizer_path, write_tokens
from taxolink.llm.op7_decontamination import decontaminate
from taxolink.llm.op9_quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Rows with equal texts get equal scores; without labels of both kinds all stay."""
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity of 0.8): that with the smallest id, of several that with the least text hash.

    Texts without words are no group, but of rows that share id and text one stays; rows with a null id all stay.
    """
    return keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row is decided by its own text."""
    return decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources weigh 1, 2, 3, repeating; a null source is a source.  Rows that repeat id and text draw apart."""
    return mix(spark, docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in byte-plane shuffled blocks, read back as one row per document, copies included; ties of ids go by text."""
    return read_documents(write_tokens(spark, docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: A learned classifier, sketches and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
