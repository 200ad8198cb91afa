"""A stored table in hash buckets of its key, updated by rewriting the buckets that change.

Each bucket has versions of its own: an attempt writes new files of some buckets, and the
manifest says which attempt holds which bucket. An update reads and writes the buckets that
it touches; the files of the others stay as they are. Two updates that touch the same bucket
at once do not overwrite each other: the one that commits later fails and can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.sources.manifest import BUCKET, Manifest, NotStoredError, whole_schema

BUCKETS = 256
_LAYOUT = "layout"
_BUCKET, _ATTEMPT = "_bucket", "_attempt"


class ConflictError(RuntimeError):
    """Another update has rewritten a bucket in the meantime."""


def is_bucketed(spark: SparkSession, root: str) -> bool:
    """Whether a table was written by :func:`write_buckets`."""
    return not Manifest(spark, root).lines().where(F.col("kind") == _LAYOUT).isEmpty()


def write_buckets(df: DataFrame, root: str, version: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes a whole table in buckets of ``key`` and returns it as read back.

    A table that is there already is replaced, whatever its buckets were.
    """
    spark, manifest = df.sparkSession, Manifest(df.sparkSession, root)
    attempt = uuid4().hex
    filled = _write(df, root, attempt, key, buckets)
    layout = {"kind": _LAYOUT, "table": key, "run": version, "attempt": attempt, "bucket": buckets}
    manifest.commit([layout, *_lines(version, attempt, range(buckets), filled, df.schema)])
    return read_buckets(spark, root)


def read_buckets(spark: SparkSession, root: str, columns: Sequence[str] = ()) -> DataFrame:
    """The table as the last versions of its buckets have it, or some of its columns."""
    _, state = _state(Manifest(spark, root))
    rows = _read(spark, root, state).drop(_BUCKET)
    return rows.select(*columns) if columns else rows


def update_buckets(
    spark: SparkSession,
    root: str,
    version: str,
    asked: DataFrame,
    on: str,
    update: Callable[[DataFrame], DataFrame],
) -> list[int]:
    """Rewrites the buckets that hold a row whose ``on`` is among those of ``asked``.

    ``update`` gets the rows of these buckets and returns what takes their place, under the
    same keys; columns that it adds are null in the other buckets. Returns the buckets.
    A missing value of ``on`` is no match. Where nothing matches, nothing is written.
    """
    manifest = Manifest(spark, root)
    seen = manifest.numbers()
    layout, state = _state(manifest, seen)
    keys = asked.select(on).dropna().distinct()
    near = state
    if on == layout.table:
        own = {r[0] for r in keys.select(_bucket_of(F.col(on), layout.bucket)).distinct().collect()}
        near = [r for r in state if r.bucket in own]
    # No more buckets than the table has.
    hit = _read(spark, root, near).select(on, _BUCKET).join(keys, on, "left_semi").select(_BUCKET).distinct()
    touched = sorted(r[0] for r in hit.collect())
    if not touched:
        return []
    rows = _read(spark, root, [r for r in state if r.bucket in touched]).drop(_BUCKET)
    changed, attempt = update(rows), uuid4().hex
    filled = _write(changed, root, attempt, layout.table, layout.bucket)
    if not filled <= set(touched):
        raise ValueError(f"an update must leave {layout.table} as it is")
    lines = _lines(version, attempt, touched, filled, changed.schema)

    def choose(numbers: list[int]) -> list[dict]:
        since = [n for n in numbers if n not in set(seen)]
        late = manifest.lines(since).where((F.col("kind") == _LAYOUT) | F.col("bucket").isin(touched))
        if since and not late.isEmpty():
            raise ConflictError(f"{root} was updated by another at the same time")
        return lines

    manifest.decide(choose)
    return touched


def _bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _write(df: DataFrame, root: str, attempt: str, key: str, buckets: int) -> set[int]:
    """Writes files per bucket; a bucket that is too large for a task is split at run time."""
    placed = df.withColumn(_BUCKET, _bucket_of(F.col(key), buckets)).hint("rebalance", _BUCKET)
    path = f"{root.rstrip('/')}/{_ATTEMPT}={attempt}"
    placed.write.partitionBy(_BUCKET).parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
    return {r[0] for r in df.sparkSession.read.schema(schema).parquet(path).select(_BUCKET).distinct().collect()}


def _lines(version: str, attempt: str, buckets, filled: set[int], schema: T.StructType) -> list[dict]:
    line = {"kind": BUCKET, "table": "", "run": version, "schema": schema.json()}
    return [{**line, "bucket": b, "attempt": attempt if b in filled else None} for b in buckets]


def _state(manifest: Manifest, numbers: list[int] | None = None):
    """The layout, and a row per bucket with the attempt that holds it."""
    lines = manifest.lines(numbers)
    layout = lines.where(F.col("kind") == _LAYOUT).orderBy(F.desc("number")).first()
    if layout is None:
        raise NotStoredError(f"{manifest.root} has no buckets")
    own = lines.where((F.col("kind") == BUCKET) & (F.col("number") >= layout.number))
    last = F.max_by(F.struct("attempt", "schema", "number"), "number").alias("_last")
    return layout, own.groupBy("bucket").agg(last).select("bucket", "_last.*").orderBy("number").collect()


def _read(spark: SparkSession, root: str, state) -> DataFrame:
    root = root.rstrip("/")
    fields = whole_schema([r.schema for r in state])
    paths = [f"{root}/{_ATTEMPT}={r.attempt}/{_BUCKET}={r.bucket}" for r in state if r.attempt]
    marks = [T.StructField(_ATTEMPT, T.StringType()), T.StructField(_BUCKET, T.IntegerType())]
    schema = T.StructType([*fields, *marks])
    if not paths:
        return spark.createDataFrame([], schema).drop(_ATTEMPT)
    return spark.read.schema(schema).option("basePath", root).parquet(*paths).drop(_ATTEMPT)

