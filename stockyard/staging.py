"""Tables written once and read by many outputs.

Staged tables go to the shared folder that the cluster names in
``spark.checkpoint.dir``, so they outlive the executors that wrote them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The folder of the work that is being done, if its staged tables go with it.
_WORK: ContextVar[str | None] = ContextVar("work", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="stockyard-")
    spark.conf.set(_SETTING, folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has written to yet."""
    return f"{_WORK.get() or f'{shared_folder(spark)}/stockyard'}/{name}-{uuid4().hex}"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write in here are deleted once it is done.

    What it wrote is read from there; otherwise they would stay until the driver collects its
    garbage, beside those of everything written since.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and read it back from the shared folder.

    ``by`` names columns of few values; filters on them read only what they ask for.
    """
    return _staged(df, new_folder(df.sparkSession, name), by)


def stage_bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Write ``df`` once, in as many buckets of ``keys`` as the session shuffles to.

    Joins and groups by all of the keys read it without a shuffle of its rows. Meant for
    keys of few rows each: a join does not split a bucket. Rows that are not dealt out by
    the keys yet are best repartitioned by them first, or every task writes to every bucket.
    """
    return _bucketed(df, new_folder(df.sparkSession, name), keys)


def _bucketed(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    spark, table = df.sparkSession, f"stockyard_{uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys)
    with shuffles_let_go(spark):
        writer.option("path", path).saveAsTable(table)
    found = spark.table(table)
    # The frame knows its files and buckets; the session's catalogue need not.
    spark.sql(f"DROP TABLE {table}")
    return found


def _staged(df: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    with shuffles_let_go(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables that one piece of work needs until its own result is staged."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_folder(spark, name)

    def stage(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        """As :func:`stage`, in the folder of this work."""
        return _staged(df, self._path(name), by)

    def stage_bucketed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """As :func:`stage_bucketed`, in the folder of this work."""
        return _bucketed(df, self._path(name), keys)

    def release(self) -> None:
        """Deletes the folder, when nothing that is still to run reads from it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid4().hex}"


@contextmanager
def inside(scratch: Scratch | None) -> Iterator[None]:
    """Whatever is staged in here, however deep, goes to the folder of ``scratch``.

    With None it goes to the shared folder itself, for tables that outlast the work.
    """
    before = _WORK.set(scratch and scratch.folder)
    try:
        yield
    finally:
        _WORK.reset(before)
