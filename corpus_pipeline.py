"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.llm import jaccard, language, mixing, packing, pii
from demandgrid.llm.common import bounded_batches, stored
from demandgrid.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; texts without a letter go, as do those no language fits."""
    bounded_batches(spark)
    return language.keep_identified(docs).select(*COLUMNS)


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    bounded_batches(spark)
    return jaccard.first_of_classes(docs).select(*COLUMNS)


def private_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    bounded_batches(spark)
    return pii.replace_in(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to their target weights."""
    bounded_batches(spark)
    return mixing.draw_documents(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row per piece."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identified),
    ("n-gram Jaccard join", near_copies_removed),
    ("PII", private_data_replaced),
    ("mixing", mixed),
    ("packing", packed),
]

# Fitted models, keyed hashes and tokenizers have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage{number + 1}")
    return docs
