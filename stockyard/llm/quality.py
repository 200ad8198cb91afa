"""Quality rules: a table of thresholds, compiled into one projection of native functions.

A rule bounds a ratio of two counts of a text, in percent, from a number of words on.
Ratios are compared by multiplying integers, so there is no rounding.

All counts and the verdict are one expression that binds each step to a name (a lambda
over an array of one), so a filter on the verdict, which the optimizer moves below the
projection, costs no more than the projection did.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.frames import quoted, unused, without

WINDOW = 5
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que pour est dans qui par sur pas au avec "
    "el y los se las del por con no una su para al es lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """``least`` <= 100 * part / whole <= ``most``, for texts of ``from_words`` words or more."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    from_words: int = 0


RULES = (
    Rule("few_words", "n_words", "one", least=1000),
    Rule("word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("exclamations", "n_exclamations", "n_words", most=25),
    Rule("stop_words", "n_stop_words", "n_words", least=5, from_words=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=30, from_words=20),
)

COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_exclamations n_lines".split()


def _matches(text: Column, pattern: str) -> Column:
    """How often a pattern occurs: splitting makes one piece more."""
    return F.size(F.split(text, pattern)) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(places: Column) -> Column:
    """Words covered by windows that start at these places, in order."""
    steps = F.transform(
        places, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - at, F.lit(WINDOW)))
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _repeated_places(hashes: Column) -> Column:
    """Where windows stand whose hash occurs again, in order."""
    placed = F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("i")))
    return _let(
        F.sort_array(placed),
        lambda ranked: F.sort_array(
            F.transform(
                F.filter(
                    ranked,
                    lambda x, k: (x["h"] == F.get(ranked, k + 1)["h"])
                    | (F.when(k > 0, x["h"] == F.get(ranked, k - 1)["h"]).otherwise(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )


def _repeat_words(words: Column) -> Column:
    """Words in windows that are found twice or more.

    Windows are told apart by a 64-bit hash; only a text with equal ones sorts them.
    """
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    covered = _let(
        hashed,
        lambda hashes: F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), _let(_repeated_places(hashes), _covered)
        ).otherwise(0),
    )
    return F.when(F.size(words) > WINDOW, covered).otherwise(0)


def _failures(counts: Column, rules: Sequence[Rule]) -> Column:
    """Names of the rules that these counts break, in the order of the table."""
    broken = []
    for rule in rules:
        part = 100 * counts[rule.part]
        whole = F.lit(1) if rule.whole == "one" else counts[rule.whole]
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (part < rule.least * whole)
        if rule.most is not None:
            bad = bad | (part > rule.most * whole)
        broken.append(F.when(bad & (counts["n_words"] >= rule.from_words), F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def verdict(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """A struct of the counts of a text, as bigint, and what the rules make of them.

    A null text has none of anything. Stop words count where they stand in lower case and
    alone, as most of them do.
    """

    def counts(whole: Column) -> Column:
        split = F.array_remove(F.split(whole, SPACES), "")
        filled = F.filter(F.split(whole, "\n"), lambda line: F.rlike(line, F.lit("[^\\x20\\x09-\\x0D]")))
        return _let(F.struct(split.alias("words"), filled.alias("lines")), lambda s: of_parts(whole, s))

    def of_parts(whole: Column, parts: Column) -> Column:
        words, lines = parts["words"], parts["lines"]
        made = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": _matches(whole, SYMBOLS),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
            "n_exclamations": _matches(whole, "!"),
            "n_lines": F.size(lines),
        }
        return F.struct(*[made[name].cast("bigint").alias(name) for name in COUNTS])

    def judged(c: Column) -> Column:
        base = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return _let(
            F.struct(base.alias("base"), _failures(c, rules).alias("failed")),
            lambda j: F.struct(
                *[c[name].alias(name) for name in COUNTS],
                j["base"].alias("base_failed"),
                j["failed"].alias("failed_rules"),
                (~j["base"] & (F.size(j["failed"]) == 0)).alias("kept"),
            ),
        )

    return _let(F.coalesce(text, F.lit("")), lambda whole: _let(counts(whole), judged))


def with_quality(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds the counts, ``base_failed``, ``failed_rules`` (names) and ``kept``.

    A null, empty or blank text has no words and is not kept. Columns with a name of an
    added one are replaced; repeated rows get the same verdict.
    """
    made = [*COUNTS, "base_failed", "failed_rules", "kept"]
    found = unused([*df.columns, *made], "verdict")
    judged = without(df, *[m for m in made if m != text.lower()]).withColumn(found, verdict(F.col(quoted(text)), rules))
    return judged.select(*[F.col(quoted(c)) for c in judged.columns if c != found], f"{found}.*")


def _rule_sql(rule: Rule) -> str:
    whole = "1" if rule.whole == "one" else rule.whole
    sides = []
    if rule.least is not None:
        sides.append(f"100 * {rule.part} < {rule.least} * {whole}")
    if rule.most is not None:
        sides.append(f"100 * {rule.part} > {rule.most} * {whole}")
    return f"CASE WHEN ({' OR '.join(sides)}) AND n_words >= {rule.from_words} THEN '{rule.name}' END"


SQL = f"""
WITH texts AS (
  SELECT ROW_NUMBER() OVER () AS r, doc_id, COALESCE(text, '') AS t,
    REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    LIST_FILTER(STRING_SPLIT(COALESCE(text, ''), CHR(10)),
                LAMBDA l: REGEXP_MATCHES(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, LIST_SLICE(w, i, i + {WINDOW - 1}) AS words
  FROM (SELECT r, w, UNNEST(RANGE(1, LEN(w) - {WINDOW - 2})) AS i FROM texts)
), repeated AS (
  SELECT r, i FROM windows
  QUALIFY COUNT(*) OVER (PARTITION BY r, words) > 1
), covered AS (
  SELECT r, COUNT(DISTINCT i + k) AS n FROM repeated, RANGE({WINDOW}) AS steps(k) GROUP BY r
), counts AS (
  SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words,
    CAST(LENGTH(REGEXP_REPLACE(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(LENGTH(t) - LENGTH(REGEXP_REPLACE(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(LEN(lines) - LEN(LIST_DISTINCT(lines)) AS BIGINT) AS n_dup_lines,
    CAST(COALESCE(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(LEN(LIST_FILTER(w, LAMBDA x: LIST_CONTAINS([{", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}], x))) AS BIGINT) AS n_stop_words,
    CAST(LENGTH(t) - LENGTH(REPLACE(t, '!', '')) AS BIGINT) AS n_exclamations,
    CAST(LEN(lines) AS BIGINT) AS n_lines
  FROM texts LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CONCAT_WS(',', {", ".join(map(_rule_sql, RULES))}) AS failed_rules
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM judged
"""
