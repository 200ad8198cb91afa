"""Removal of lines that many documents hold, by levelled sorted runs of line hashes.

The key of a line is the line without the white space around it, A-Z in lower case. A key
long enough that enough documents hold loses all its lines but those of the largest
document id.

Documents come in batches, the largest ids first. A batch counts its documents per key
and merge-anti-joins the runs: a key that a run already settles, held by enough documents
and by one with an id as large, adds nothing. The rest is the batch's own run, a table
bucketed and sorted by the 128-bit hash of the key, so a join shuffles the batch alone and
merges. ``fanout`` runs of a level are compacted into one of the next, where counts add up.
What the runs say in the end is joined with the lines again, and texts lose their places.

Everything is DataFrame work. A key that a third of all documents hold is combined before
it is shuffled, and spread by adaptive execution where its lines meet the verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm.frames import quoted, unused, without
from stockyard.staging import new_folder, stage

LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 6
FANOUT = 3

# The white space that is stripped, and the letters that change case.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_KEY = ("h1", "h2")
_ENTRY = "h1 bigint, h2 bigint, n bigint, last bigint"
_ROW = ("doc", "t1", "t2")
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """A line without the white space around it, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _hashes(value: Column) -> list[Column]:
    """Two 64-bit hashes; equal values have equal ones, others practically never both."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


class LineRuns:
    """Sorted runs of line hashes in levels, each run a table bucketed by hash.

    An entry is a hash, the number of documents counted for it and the largest of their
    ids. Entries of one hash in several runs add up. Documents of one id have to come in
    one batch; batches may come in any order of ids.
    """

    def __init__(
        self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT, buckets: int | None = None
    ):
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def add(self, lines: DataFrame) -> None:
        """Counts one batch, columns ``doc``, ``h1`` and ``h2``, and compacts full levels."""
        entries = lines.select(*_KEY, "doc").distinct().groupBy(*_KEY)
        entries = entries.agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
        for run in self._runs():
            settled = run.where(F.col("n") >= self.least_docs).select(
                *[F.col(k).alias(f"_{k}") for k in _KEY], F.col("last").alias("_last")
            )
            same = reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in _KEY])
            entries = entries.join(settled.hint("merge"), same & (F.col("last") <= F.col("_last")), "left_anti")
        self._write(entries, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._write(self._merged(self.levels[level]), level + 1)
            self.levels[level] = []
            level += 1

    def repeated(self) -> DataFrame:
        """``h1``, ``h2`` and ``last`` of every key that enough documents hold, staged."""
        found = self._merged([t for level in self.levels for t in level]).where(F.col("n") >= self.least_docs)
        return stage(found.select(*_KEY, "last"), "repeated-lines")

    def close(self) -> None:
        """Takes the tables out of the session's catalogue; their files stay."""
        for table in self._paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, entries: DataFrame, level: int) -> None:
        table = f"stockyard_line_run_{uuid4().hex}"
        writer = entries.write.format("parquet").bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
        path = new_folder(self.spark, "line-run")
        writer.option("path", path).saveAsTable(table)
        self._paths[table] = path
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def _merged(self, tables: Sequence[str]) -> DataFrame:
        """One entry per hash of several runs.

        Runs are read as files: this Spark sums a union of bucketed tables bucket by bucket
        without bringing equal buckets together, and gets several entries per hash.
        """
        runs = self.spark.read.schema(_ENTRY).parquet(*[self._paths[t] for t in tables])
        return runs.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def drop_repeated_lines(
    df: DataFrame,
    key: str = "doc_id",
    column: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Adds ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped`` to every row.

    Lines are what stands between line feeds, so a null or empty text has one empty line
    and an empty ``kept_text``, and a text whose lines all go has an empty one as well.
    Rows that share an id are one document: they count once, and lose or keep a line
    together. Rows without an id are one document too, smaller than all others. A line that
    stands several times in one document counts once there; all its copies go or stay.
    Columns that have one of the three names are replaced, the others are left alone.
    """
    df = without(df, "kept_text", "n_lines", "n_dropped")
    names = {n: unused(df, n) for n in _ROW}
    gone, body = unused(df, "gone"), unused(df, "body")
    text = F.coalesce(F.col(quoted(column)), F.lit(""))
    marked = df.withColumns(
        dict(zip(names.values(), [F.coalesce(F.col(quoted(key)).cast("bigint"), F.lit(_NO_ID)), *_hashes(text)]))
    )
    places = _dropped_places(marked.select(*[F.col(names[n]).alias(n) for n in _ROW], text.alias("text")),
                             least_chars, least_docs, batches, fanout)
    places = places.select(*[F.col(n).alias(names[n]) for n in _ROW], F.col("gone").alias(gone))

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        rest = F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n")
        return F.struct(
            F.when(F.col(gone).isNull(), text).otherwise(rest).alias("kept_text"),
            F.size(lines).cast("bigint").alias("n_lines"),
            F.coalesce(F.array_size(F.col(gone)), F.lit(0)).cast("bigint").alias("n_dropped"),
        )

    # One name for the lines of a text, which are used several times.
    made = F.get(F.transform(F.array(F.split(text, "\n")), kept), 0)
    joined = marked.join(places, list(names.values()), "left").withColumn(body, made)
    return joined.select(*[F.col(quoted(c)) for c in df.columns], f"{body}.*")


def _dropped_places(texts: DataFrame, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """``gone``, the places of the lines to drop, of each row that has any."""
    spark = texts.sparkSession
    shares = [i / batches for i in range(1, batches)]
    ends = texts.agg(F.percentile_approx("doc", shares, 10_000)).first()[0] if shares else None
    above = [F.when(F.col("doc") <= F.lit(e), 1).otherwise(0) for e in sorted(set(ends or []))]
    lines = texts.select(*_ROW, F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.select(*_ROW, "place", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= least_chars).select(
        reduce(Column.__add__, above, F.lit(0)).alias("batch"),
        *_ROW, "place", *[h.alias(k) for h, k in zip(_hashes(F.col("key")), _KEY)],
    )
    lines = stage(lines, "lines", by=["batch"])
    runs = LineRuns(spark, least_docs, fanout)
    for batch in range(len(above) + 1):
        runs.add(lines.where(F.col("batch") == batch))
    repeated = runs.repeated()
    runs.close()
    # Both sides are plain shuffles, so that a key of many lines is split at run time.
    late = lines.join(repeated, list(_KEY)).where("doc < last")
    return late.groupBy(*_ROW).agg(F.collect_set("place").alias("gone"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line,
    TRANSLATE(TRIM(line, CHR(32) || CHR(9) || CHR(10) || CHR(11) || CHR(12) || CHR(13)),
              '{UPPER}', '{UPPER.lower()}') AS key
  FROM (SELECT doc_id, UNNEST(s) AS line, UNNEST(RANGE(1, LEN(s) + 1)) AS i
        FROM (SELECT doc_id, STRING_SPLIT(COALESCE(text, ''), CHR(10)) AS s FROM documents))
), repeated AS (
  SELECT key, MAX(doc_id) AS last FROM lines WHERE LENGTH(key) >= {LEAST_CHARS}
  GROUP BY key HAVING COUNT(DISTINCT doc_id) >= {LEAST_DOCS}
), judged AS (
  SELECT doc_id, i, line, last IS NOT NULL AND doc_id < last AS gone FROM lines LEFT JOIN repeated USING (key)
)
SELECT doc_id, COUNT(*) AS n_lines, CAST(COUNT(*) FILTER (gone) AS BIGINT) AS n_dropped,
  SHA256(COALESCE(STRING_AGG(line, CHR(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
