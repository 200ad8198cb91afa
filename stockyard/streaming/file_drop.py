"""Feeds of CSV files and workbooks dropped into a folder, imported by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from stockyard.sources import feeds
from stockyard.sources.store import append_run
from stockyard.staging import Scratch, inside, shuffles_let_go

Post = Callable[[DataFrame], DataFrame]
PostRun = Callable[[DataFrame, str], tuple[dict[str, DataFrame], Mapping[str, int]]]


def watch_folder(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the ``path`` of new files, whose content is not read here."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema)
    return reader.option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path")


def import_drops(
    spark: SparkSession,
    folder: str,
    layout: tuple[str, ...],
    post: Post,
    target: str,
    checkpoint: str,
    files_per_trigger: int = 1000,
) -> None:
    """Post every file not seen before, then stop.

    ``post`` gets rows with ``source_file`` and ``ord``, which starts at 0 in each file.
    Each trigger writes its own partition of ``target``; a trigger that is repeated
    after a failure replaces what it wrote.
    """

    def land(files: DataFrame, trigger: int) -> None:
        numbered = feeds.read_positional(spark, _paths(files), layout, per_file=True)
        posted = post(numbered)
        with shuffles_let_go(spark):
            posted.write.mode("overwrite").parquet(f"{target}/drop_id={trigger}")

    _take(watch_folder(spark, folder, files_per_trigger), land, checkpoint)


def import_runs(
    spark: SparkSession,
    folder: str,
    layout: tuple[str, ...],
    post: PostRun,
    root: str,
    checkpoint: str,
    files_per_trigger: int = 1000,
    job: str = "drop",
    multiline: bool = False,
) -> None:
    """Import every file not seen before as a whole flow, then stop.

    Each trigger is a run of the store under ``root``, named ``<job>-<trigger>``, so jobs
    that share a store, each with a checkpoint and triggers of its own, need names of their
    own. ``post`` gets its rows, with ``ord`` over all its files, and the name, and returns
    the tables of the run and the ids it was given, which count once all are written; a
    trigger that is repeated after a failure takes the place of its earlier attempt. What a
    trigger stages goes when its run is stored, so none of its tables is to be read later but
    from the store.
    """

    def land(files: DataFrame, trigger: int) -> None:
        run_id, scratch = f"{job}-{trigger}", Scratch(spark, "trigger")
        try:
            with inside(scratch):
                rows = feeds.read_positional(spark, _paths(files), layout, multiline=multiline)
                posted, ids = post(rows, run_id)
                append_run(posted, root, run_id, ids)
        finally:
            scratch.release()

    _take(watch_folder(spark, folder, files_per_trigger), land, checkpoint)


def _paths(files: DataFrame) -> list[str]:
    """The new files of a trigger, as many as it takes at most."""
    return sorted(r.path for r in files.collect())


def _take(stream: DataFrame, land: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
