"""Every operator over nulls, empty and very long texts, repeated rows, clashing names, no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockyard.llm.fingerprints import edit_report, fingerprint
from stockyard.llm.html import with_main_text
from stockyard.llm.linedup import drop_repeated_lines
from stockyard.llm.language import train, with_language
from stockyard.llm.lm import with_lm_scores
from stockyard.llm.mixing import mix
from stockyard.llm.neardup import near_duplicates
from stockyard.llm.packing import pack
from stockyard.llm.quality import with_quality
from stockyard.llm.queries import VOCABULARY
from stockyard.llm.shards import round_trip
from stockyard.llm.substrings import drop_repeated_windows

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [
    (1, "the quick brown fox and the lazy dog went to the river by the old mill", "en", "a"),
    (1, "the quick brown fox and the lazy dog went to the river by the old mill", "en", "a"),
    (None, "la casa de la playa y el mar que no se ve", "es", None),
    (None, None, None, None),
    (4, None, "en", "b"),
    (5, "", "de", "b"),
    (6, " \n\t ", None, "a"),
    (7, LONG, "en", "a"),
    (8, LONG + " end", "en", "b"),
    (9, "\x00 ퟿ 中文 <|endoftext|>  x", "zh", "é"),
]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, chunk int, "
    "Kept string, N_WORDS int, verdict string, draw int, learn int, ids int, size string"
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, len(t[1] or ""), "r", 1, "k", 2, "v", 3, 4, 5, "s") for t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


OPERATORS = {
    "quality": with_quality,
    "html": lambda df: with_main_text(df.withColumnRenamed("text", "html")),
    "lm": lambda df: with_lm_scores(df, F.col("doc_id") % 2 == 1, VOCABULARY),
    "substrings": drop_repeated_windows,
    "lines": drop_repeated_lines,
    "shards": lambda df: round_trip(df, VOCABULARY),
    "mix": mix,
    "language": lambda df: with_language(df, train(df, F.lit(True))),
    "near": near_duplicates,
    "fingerprint": fingerprint,
    "edited": edit_report,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_a_result(docs, name):
    found = OPERATORS[name](docs)
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    assert found.count() == len(TEXTS)
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_packing_covers_every_id(docs):
    pieces = pack(docs, VOCABULARY)
    assert pieces.agg(F.sum("length")).first()[0] == round_trip(docs, VOCABULARY).agg(F.sum("n_tokens")).first()[0]
    assert pack(docs.limit(0), VOCABULARY).collect() == []


def test_defined_results(docs):
    quality = {r.doc_id: r for r in with_quality(docs).where("doc_id >= 4").collect()}
    assert (quality[4].n_words, quality[6].n_words, quality[4].kept) == (0, 0, False)
    cut = {r.doc_id: r for r in drop_repeated_windows(docs).where("doc_id >= 4").collect()}
    assert (cut[4].kept_text, cut[5].kept_text, cut[6].kept_text) == ("", "", "")
    assert cut[7].n_removed == 60_000 and cut[8].kept_text == "end"
    language = {r.doc_id: r.lang_pred for r in OPERATORS["language"](docs).where("doc_id >= 4").collect()}
    assert language[4] == language[5] == language[6] == "und"
    near = near_duplicates(docs).collect()
    sizes = sorted(r.class_size for r in near)
    # Two nulls alone, two texts without words, two equal texts, the two long ones, two more.
    assert sizes == [1, 1, 1, 1, 2, 2, 2, 2, 2, 2]
    assert sum(r.kept for r in near) == 7
    mixed = mix(docs).collect()
    assert all(r.taken == 0 for r in mixed if not (r.text or "").strip())
    assert all(r.taken <= 2 * r["size"] for r in mixed)


NAMED = ("kept", "size", "copies", "taken", "n_words", "n_removed", "class_id", "target", "copy", "own_5_", "_copy", "row")


@pytest.mark.parametrize("place", range(4))
def test_stages_leave_columns_of_any_name(spark, place):
    words = "the old man and the sea is a book that he wrote by the shore of it all"
    rows = [(i, f"{words} {'x' * i} {i}", "en", "a", 80, *[f"mine {i} {n}" for n in NAMED]) for i in range(0, 40, 9)]
    names = ", ".join(f"`{n}` string" for n in NAMED)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    found = corpus_pipeline.STAGES[place][1](spark, docs, "")
    assert found.columns == docs.columns
    kept = found.collect()
    assert kept and all(r[n] == f"mine {r.doc_id} {n}" for r in kept for n in NAMED)


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_the_columns(spark, docs, place):
    name, apply = corpus_pipeline.STAGES[place]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (plain, plain.limit(0)):
        found = apply(spark, table, "")
        if place < 4:
            assert found.columns == plain.columns
        found.count()
