"""A training-data pipeline over ``documents``: quality rules, near copies, repeated passages, personal data, packing.

Each stage takes what its predecessor kept, is stored as Parquet and read again. All but the last return the columns of
``documents``; the last returns the packed pieces. SQL has no suffix sorting, sketches or tokeniser, so there is no ORACLE_SQL; the
tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.llm import packing, pii, quality, simhash, suffixes
from reclink.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    return quality.quality(docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id.

    Rows without an id count as the last. Rows that share an id but not the text are different documents, of a repeated row one stays.
    """
    return simhash.first_of_each(docs, width=5, least=0.8).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, span: int = 100) -> DataFrame:
    """Documents without what earlier ones hold already; cut characters are mended and documents with nothing left go."""
    left = suffixes.remove_repeats(docs, span=span, keep_text=True, others=COLUMNS[2:])
    cut = left.withColumn("text", F.col("kept_text")).where("n_removed = 0 OR length(trim(text)) > 0")
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by tags."""
    found = pii.find_pii(docs, keep_text=True, others=COLUMNS[2:])
    changed = F.length("spans") > 0
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one stored before the next reads it."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
