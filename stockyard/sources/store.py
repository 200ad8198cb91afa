"""Stored tables: lookups, posted runs, catalogue snapshots and report files.

Every write of a run or a version goes to a folder of its own, named by the attempt, and
counts once the manifest has a line for it. A run that fails half way, or one that is being
repeated, is therefore never read, and a repeat cannot empty what it reads itself. Each
table is resolved by itself: a repeat of a run that writes some of its tables again takes
the place of these and leaves the others. Run ids, versions and attempts are text, whatever
they look like.

The manifest keeps the schema of every attempt. Readers get the columns of all runs, null
where a run was written before a column came up.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.sources.buckets import is_bucketed, read_buckets
from stockyard.sources.manifest import TABLE, Manifest, NotStoredError, id_range, whole_schema
from stockyard.staging import shuffles_let_go

_PARTITIONS = ("run_id", "version", "drop_id", "attempt")
STEP_LOG = "step_log"
_STEP = "step string, started_at timestamp, ended_at timestamp, rows bigint"


# Posting order: headers before the rows that refer to them.
POSTING_ORDER = (
    "products",
    "suppliers",
    "categories",
    "purchases",
    "purchase_orders",
    "transfers",
    "purchase_items",
    "transfer_items",
    "inventory_movements",
    "quarantine",
    "run_log",
)


def scan_store(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """A stored table, only the columns asked for."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def append_run(
    tables: dict[str, DataFrame], root: str, run_id: str, ids: Mapping[str, int] | None = None
) -> None:
    """Write the tables of one run, each into its own partition of the stored table.

    All of them count from one moment on, when all are written. A run that is repeated
    takes the place of its earlier attempt in the tables that it writes again, so nothing
    is posted twice. ``ids`` has the first id that the run was given in some tables; what
    it did not use of them is given back.

    Rows are counted while they are written. The ``step_log`` of the run has a row per
    table with its rows and the times at which writing it began and ended.
    """
    unknown = set(tables) - set(POSTING_ORDER)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    attempt, lines, steps = uuid4().hex, [], []

    def write(name: str, df: DataFrame) -> None:
        with shuffles_let_go(spark):
            df.write.option("compression", "zstd").parquet(f"{root}/{name}/run_id={run_id}/attempt={attempt}")
        lines.append({"kind": TABLE, "table": name, "run": run_id, "attempt": attempt, "schema": df.schema.json()})

    for name in POSTING_ORDER:
        if name in tables:
            counted, began = Observation(), time.time()
            write(name, tables[name].observe(counted, F.count(F.lit(1)).alias("rows")))
            steps.append((name, _moment(began), _moment(time.time()), counted.get["rows"]))
    for name, first in (ids or {}).items():
        if name in tables:
            written = spark.read.schema("id bigint").parquet(f"{root}/{name}/run_id={run_id}/attempt={attempt}")
            last = written.agg(F.max("id")).first()[0]
            lines.append(id_range(run_id, name, first, first - 1 if last is None else last))
    manifest = Manifest(spark, root)
    earlier = _steps_of(manifest, run_id, [s[0] for s in steps])
    log = spark.createDataFrame(steps, _STEP)
    write(STEP_LOG, (log if earlier is None else earlier.unionByName(log)).coalesce(1))
    manifest.commit(lines)


def repeat_run(
    tables: dict[str, DataFrame], root: str, run_id: str, ids: Mapping[str, int] | None = None
) -> None:
    """Write a whole run again, as :func:`append_run` does.

    A table that the store holds of the run and that is not among ``tables`` is an error, so
    nothing of the run is left as an earlier attempt wrote it.
    """
    lines = Manifest(next(iter(tables.values())).sparkSession, root).lines()
    held = lines.where((F.col("kind") == TABLE) & (F.col("run") == run_id)).select("table").distinct()
    missing = {r.table for r in held.collect()} - {*tables, STEP_LOG}
    if missing:
        raise ValueError(f"run {run_id} also has {sorted(missing)}")
    append_run(tables, root, run_id, ids)


def _moment(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def _steps_of(manifest: Manifest, run_id: str, again: Sequence[str]) -> DataFrame | None:
    """The steps logged before for tables of a run that are not written again."""
    try:
        log = read_runs(manifest.spark, manifest.root, STEP_LOG)
    except NotStoredError:
        return None
    return log.where((F.col("run_id") == run_id) & ~F.col("step").isin(list(again))).drop("run_id")


def read_runs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All committed runs of a stored table, with the run id as text.

    The attempts that count are named to the reader, one path per run, so nothing else
    is listed or scanned.
    """
    found = Manifest(spark, root).attempts(name).orderBy("number").collect()
    if not found:
        raise NotStoredError(f"no run of {root}/{name} has been committed")
    partitions = [T.StructField(c, T.StringType()) for c in ("run_id", "attempt")]
    schema = T.StructType([*whole_schema([r.schema for r in found]), *partitions])
    paths = [f"{root}/{name}/run_id={r.run}/attempt={r.attempt}" for r in found]
    reader = spark.read.schema(schema).option("basePath", f"{root}/{name}")
    return reader.parquet(*paths).drop("attempt")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, a bucketed table, the latest version of a snapshot, or the committed
    runs of a store.

    ``path`` may also be one run of a stored table.
    """
    root, _, name = path.rstrip("/").rpartition("/")
    if Manifest(spark, path).numbers():
        return read_latest(spark, path)
    if name.startswith("run_id=") and root:
        store, _, table = root.rpartition("/")
        if Manifest(spark, store).numbers():
            return read_runs(spark, store, table).where(F.col("run_id") == name.removeprefix("run_id=")).drop("run_id")
    if root and Manifest(spark, root).numbers():
        try:
            return read_runs(spark, root, name)
        except NotStoredError:
            pass
    table = read_partitioned(spark, path)
    if "attempt" in table.columns:
        raise NotStoredError(f"no run of {path} has been committed")
    return table


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table whose run ids and versions stay text, such as ``007``."""
    found = spark.read.parquet(path).schema
    text = [T.StructField(f.name, T.StringType()) if f.name in _PARTITIONS else f for f in found]
    return spark.read.schema(T.StructType(text)).parquet(path)


def rewrite_snapshot(df: DataFrame, root: str, version: str) -> DataFrame:
    """Write an updated table as a version and return it as read back.

    What was read is never overwritten: a repeat of a version takes the place of the
    earlier attempt when it is complete.
    """
    attempt = uuid4().hex
    path = f"{root.rstrip('/')}/version={version}/attempt={attempt}"
    with shuffles_let_go(df.sparkSession):
        df.write.parquet(path)
    line = {"kind": TABLE, "table": "", "run": version, "attempt": attempt, "schema": df.schema.json()}
    Manifest(df.sparkSession, root).commit([line])
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The version of a snapshot that was committed last, or a bucketed table as it stands."""
    if is_bucketed(spark, root):
        return read_buckets(spark, root)
    last = Manifest(spark, root).attempts("").orderBy(F.desc("number")).first()
    if last is None:
        raise NotStoredError(f"no version of {root} has been committed")
    schema = T.StructType.fromJson(json.loads(last.schema))
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/version={last.run}/attempt={last.attempt}")


def write_report(report: DataFrame, path: str, file_format: str = "csv") -> None:
    """A report as CSV with a header, or as parquet."""
    writer = report.write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"no such report format: {file_format}")
