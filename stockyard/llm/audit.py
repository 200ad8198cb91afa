"""What each filter of a chain removes, in every order that the chain can have.

A document is reduced to the set of filters that it fails, a bit mask, and documents are
counted per part and mask. In an order of the filters a document goes at the first one of
its mask. Orders are numbered by their Lehmer rank, which is their place in lexicographic
order, so the orders that begin alike are an interval of ranks: filters outside the mask,
then one of it, say at which step the document goes, for a whole interval at once. Counts
are added where an interval begins and taken off where it ends; prefix sums over the ranks
then give what every step of every order removes. No document is looked at per order.

Whether a text is a copy of one with a smaller id is told by counts per text, part and id,
combined before each shuffle, so no group of copies meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockyard.llm.frames import quoted
from stockyard.staging import stage

SPACES = "[\\x20\\x09-\\x0D]+"
# The filter of copies, beside those that look at one text.
COPIES = "E"
COUNTS = ("n", "good", "toxic")
# Orders and intervals are tables of k! rows and more.
MOST_FILTERS = 7


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that is not null, by name."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.size(F.split(text, "[A-Z]")) - 1
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def intervals(count: int) -> Iterator[tuple[int, int, int, int]]:
    """``mask``, ``step``, ``low`` and ``high``: documents of the mask go at this step in
    the orders whose rank is at least ``low`` and below ``high``.

    Filters are numbered; bit i of a mask is filter i.
    """

    def low_rank(chosen: tuple[int, ...]) -> int:
        left, rank = list(range(count)), 0
        for at, one in enumerate(chosen):
            rank += left.index(one) * factorial(count - 1 - at)
            left.remove(one)
        return rank

    for mask in range(1, 1 << count):
        outside = [i for i in range(count) if not mask >> i & 1]
        for before in range(len(outside) + 1):
            for passed in permutations(outside, before):
                for stop in (i for i in range(count) if mask >> i & 1):
                    low = low_rank((*passed, stop))
                    yield mask, before + 1, low, low + factorial(count - before - 1)


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column],
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good`` and ``toxic``: documents per set of failed filters.

    ``filters`` are conditions on a column ``body``, the text; the filter of copies is
    added as the last bit. A condition that is null does not fail.
    """
    bits = [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(filters.values())]
    whole = docs.select(
        F.col(quoted(key)).cast("bigint").alias("id"),
        F.coalesce(F.col(quoted(part)).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("body"),
    )
    judged = whole.select(
        "id", "part", sum(bits, F.lit(0)).alias("bits"),
        F.xxhash64("body").alias("t1"), F.xxhash64(F.lit("second"), F.col("body")).alias("t2"),
    )
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("at")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    # Rows without an id are spread by their text; no label has the mark that they get.
    judged = judged.withColumns({"at": F.coalesce("id", "t1"), "has": F.col("id").isNotNull()})
    marked = judged.join(marks.withColumn("has", F.lit(True)), ["has", "at"], "left")
    text_key, sums = ["t1", "t2"], [F.sum(c).alias(c) for c in COUNTS]
    by_id = marked.groupBy(*text_key, "bits", "part", "id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    )
    # A missing id is the smallest. All rows of the smallest id of a text are its originals.
    by_part = by_id.groupBy(*text_key, "bits", "part").agg(*sums, F.min(F.struct("id", *COUNTS)).alias("first"))
    parts = F.collect_list(F.struct("part", *COUNTS, "first"))
    texts = by_part.groupBy(*text_key, "bits").agg(F.min("first.id").alias("least"),
                                                   F.max(F.col("first.id").isNull()).alias("none"),
                                                   parts.alias("parts"))
    each = texts.select("bits", "none", "least", F.inline("parts"))
    original = F.when(F.col("none"), F.col("first.id").isNull()).otherwise(F.col("first.id") == F.col("least"))

    def kept(name: str) -> Column:
        return F.when(original, F.col(f"first.{name}")).otherwise(0)

    copy = 1 << len(filters)
    split = F.array(
        F.struct(F.col("bits").alias("mask"), *[kept(c).alias(c) for c in COUNTS]),
        F.struct((F.col("bits") + copy).alias("mask"), *[(F.col(c) - kept(c)).alias(c) for c in COUNTS]),
    )
    masks = each.select("part", F.inline(split))
    return masks.groupBy("part", "mask").agg(*sums).where("n > 0")


def audit(masks: DataFrame, names: str) -> DataFrame:
    """What every step of every order removes, from the counts of :func:`mask_counts`.

    ``names`` has a letter per bit, in ascending order. A row per part, order and step,
    zeros included: ``kept`` and ``removed`` documents, ``redundant`` ones (failing the
    step's filter but gone before), ``unique_fails`` (failing this filter alone),
    ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``, what the filter
    removes over all orders. No part, no row.
    """
    spark, count = masks.sparkSession, len(names)
    if count > MOST_FILTERS or list(names) != sorted(set(names)):
        raise ValueError(f"names must be up to {MOST_FILTERS} different letters in ascending order")
    orders = factorial(count)
    spans = spark.createDataFrame(list(intervals(count)), "mask int, step int, low int, high int")
    masks = masks.withColumn("mask", F.col("mask").cast("int"))
    ends = F.array(
        F.struct(F.col("low").alias("rank"), *[F.col(c).alias(c) for c in COUNTS]),
        F.struct(F.col("high").alias("rank"), *[(-F.col(c)).alias(c) for c in COUNTS]),
    )
    steps = masks.join(F.broadcast(spans), "mask").select("part", "step", F.inline(ends)).where(F.col("rank") < orders)
    parts = masks.groupBy("part").agg(F.sum("n").alias("total"), *_fails(names), *_alone(names))
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(orders * count - 1))).alias("at")).select(
        "part", (F.col("at") % count + 1).alias("step"), F.expr(f"CAST(at DIV {count} AS INT)").alias("rank"),
        *[F.lit(0).cast("bigint").alias(c) for c in COUNTS],
    )
    differences = steps.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = differences.select("part", "step", "rank", *[F.sum(c).over(upto).alias(c) for c in COUNTS])
    named = sums.join(F.broadcast(_order_table(spark, names)), ["rank", "step"]).join(parts, "part")
    done = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    letter = F.col("letter")

    def pick(prefix: str) -> Column:
        return F.coalesce(*[F.when(letter == x, F.col(f"{prefix}_{x}")) for x in names])

    return named.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(done)).alias("kept"),
        F.col("n").alias("removed"),
        (pick("fails") - F.col("n")).alias("_late"),
        pick("alone").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    ).withColumnRenamed("_late", "redundant")


def _fails(names: str) -> list[Column]:
    return [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)).alias(f"fails_{x}")
            for i, x in enumerate(names)]


def _alone(names: str) -> list[Column]:
    return [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"alone_{x}")
            for i, x in enumerate(names)]


def _order_table(spark: SparkSession, names: str) -> DataFrame:
    """The letter of every step of every order, by rank."""
    rows = [(rank, step, "".join(order), x) for rank, order in enumerate(permutations(names))
            for step, x in enumerate(order, 1)]
    return spark.createDataFrame(rows, "rank int, step int, filter_order string, letter string")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents, per language.

    A null text counts as empty, a null language as the part ``''``. Copies are told over
    the whole table, other parts included; rows of one id are no copies of each other, and
    a missing id is smaller than all others. A document with several labels is good or
    toxic if one of them says so; columns beside id, text and language are not read.
    """
    filters = text_filters(F.col("body"))
    masks = stage(mask_counts(docs, labels, filters), "masks")
    return audit(masks, "".join(filters) + COPIES)


SQL = """
WITH texts AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t,
    REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), marks AS (
  SELECT doc_id, MAX(CAST(quality = 1 AS INT)) AS good, MAX(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic,
    [LEN(w) < 200, 100 * LEN(LIST_DISTINCT(w)) < 50 * LEN(w),
     100 * LEN(REGEXP_REPLACE(t, '[^A-Z]', '', 'g')) > 3 * LENGTH(t),
     REGEXP_MATCHES(t, '[#$%&*|]'), texts.doc_id > MIN(texts.doc_id) OVER (PARTITION BY t)] AS f
  FROM texts LEFT JOIN marks USING (doc_id)
), masks AS (
  SELECT part, f, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM failing GROUP BY part, f
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS v(x, i)
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE LEN(LIST_DISTINCT([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT part, filter_order, o, step, n, good, toxic, f[o[step]] AS fails,
    LIST_BOOL_OR(LIST_TRANSFORM(o[1:step - 1], LAMBDA i: f[i])) AS before,
    LEN(LIST_FILTER(f, LAMBDA b: b)) = 1 AS one
  FROM masks, orders, RANGE(1, 6) AS s(step)
), counted AS (
  SELECT part, filter_order, CAST(step AS INT) AS step,
    SUM(n) FILTER (NOT fails AND NOT COALESCE(before, FALSE)) AS kept,
    SUM(n) FILTER (fails AND NOT COALESCE(before, FALSE)) AS removed,
    SUM(n) FILTER (fails AND COALESCE(before, FALSE)) AS redundant,
    SUM(n) FILTER (fails AND one) AS unique_fails,
    SUM(good) FILTER (fails AND NOT COALESCE(before, FALSE)) AS good_lost,
    SUM(toxic) FILTER (fails AND NOT COALESCE(before, FALSE)) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(COALESCE(kept, 0) AS BIGINT) AS kept,
  CAST(COALESCE(removed, 0) AS BIGINT) AS removed, CAST(COALESCE(redundant, 0) AS BIGINT) AS redundant,
  CAST(COALESCE(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(COALESCE(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(COALESCE(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(COALESCE(SUM(removed) OVER (PARTITION BY part, SUBSTR(filter_order, step, 1)), 0) AS BIGINT) AS shapley
FROM counted
"""
