"""The registered queries of this subpackage and the SQL of those that have it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import audit, linedup, quality, search, substrings
from stockyard.llm.fingerprints import edit_report
from stockyard.llm.html import with_main_text
from stockyard.llm.language import remainder, train, with_language
from stockyard.llm.lm import with_lm_scores
from stockyard.llm.mixing import mix
from stockyard.llm.neardup import near_duplicates
from stockyard.llm.packing import pack
from stockyard.llm.shards import round_trip

# The byte-level vocabulary; it is installed beside the library on every executor.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality.with_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"),
    )


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return with_main_text(pages).select("page_id", "url", "text", "n_chars")


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document by a model of four fifths of them."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    marked = docs.withColumn("held_out", remainder("doc_id", 5) == 1)
    return with_lm_scores(marked, ~F.col("held_out"), VOCABULARY)


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words outside repeated 35-word windows, as a digest per document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    cut = substrings.drop_repeated_windows(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document's ids lie in the shards written of all, and their checksum."""
    return round_trip(_table(spark, folder, "documents").select("doc_id", "text"), VOCABULARY)


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    mixed = mix(_table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, by a model of three quarters of them."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = train(docs, ~held_out)
    told = with_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return told.select("doc_id", "held_out", "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near duplicates of every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 ids."""
    return pack(_table(spark, folder, "documents").select("doc_id", "text"), VOCABULARY)


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edit_report(_table(spark, folder, "documents").select("doc_id", "text"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that larger documents repeat, as a digest."""
    cut = linedup.drop_repeated_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes in each of their 120 orders, per language."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    return audit.filter_audit(docs, _table(spark, folder, "labels"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return search.search(docs, _table(spark, folder, "benchmark"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_text": op2_html_text,
    "op3_lm_score": op3_lm_score,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_shards": op5_token_shards,
    "op6_source_mix": op6_source_mix,
    "op7_language_id": op7_language_id,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op1_quality_rules": quality.SQL,
    "op4_substring_dedup": substrings.SQL,
    "op11_line_dedup": linedup.SQL,
    "op12_filter_audit": audit.SQL,
    "op13_lexical_search": search.SQL,
}
