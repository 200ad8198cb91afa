"""From raw documents to packed training sequences, as stages of whole tables.

Each stage gets all documents that the one before it left, reread from Parquet, and
returns the columns of ``documents``, further ones with their values; the last returns the
pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm.mixing import mix
from stockyard.llm.neardup import near_duplicates
from stockyard.llm.packing import pack
from stockyard.llm.quality import with_quality
from stockyard.llm.substrings import drop_repeated_windows
from stockyard.staging import stage

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# Sketches, draws and sums of repeated pieces have no SQL form; tests/llm has brute force.
ORACLE_SQL = None


# Columns of ``documents``. Others may be called as they like, and keep their values.
_DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_own_columns(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply`` to documents whose further columns have other names in the meantime, so that
    what an operator adds takes the place of none."""
    aside = {c: f"own_{i}_" for i, c in enumerate(docs.columns) if c not in _DOCUMENTS}
    made = apply(docs.toDF(*[aside.get(c, c) for c in docs.columns]))
    return made.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return _with_own_columns(docs, lambda d: with_quality(d).where("kept"))


def near_duplicate_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return _with_own_columns(docs, lambda d: near_duplicates(d).where("kept"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words that repeated passages cover; others keep their text.

    A document that is covered whole stays, with an empty text.
    """
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    new = {"text": text, "n_chars": length}
    return _with_own_columns(docs, lambda d: drop_repeated_windows(d).withColumns(new))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; one without a word adds nothing and goes."""
    copy = F.explode(F.sequence(F.lit(1), "copies"))
    return _with_own_columns(docs, lambda d: mix(d).where("taken > 0").withColumn("copy", copy))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence."""
    return pack(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_classes),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
