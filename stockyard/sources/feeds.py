"""Feeds of many files, CSV and workbooks mixed, as one numbered input.

A file is a workbook if its name says so, and CSV otherwise. Names of columns are looked
up in every file by itself, so files may hold them in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockyard.operators.ordinals import file_marks, with_file_ordinal
from stockyard.sources import layouts, workbooks
from stockyard.sources.delimited import MissingColumnsError, scan_positional
from stockyard.staging import stage

_WORKBOOKS = (".xlsx", ".xlsm")


def input_files(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """CSV files and workbooks under a path, in order. Names only are read."""
    found = spark.read.format("binaryFile").load(path).select("path").collect()
    names = sorted(r.path for r in found)
    books = [n for n in names if n.lower().endswith(_WORKBOOKS)]
    return [n for n in names if not n.lower().endswith(_WORKBOOKS)], books


def with_input_ordinal(rows: DataFrame) -> DataFrame:
    """``ord`` within each file becomes the position in the whole input, files by path.

    Rows stay where they are; only their number per file is summed up, one row per file.
    """
    placed = stage(rows.withColumnRenamed("ord", "_at"), "cells")
    sizes = placed.groupBy("source_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    located = placed.join(stage(starts, "file-starts"), "source_file")
    return located.withColumn("ord", F.col("_start") + F.col("_at")).drop("_start", "_at")


def read_positional(
    spark: SparkSession,
    path: str | list[str],
    layout: tuple[str, ...],
    per_file: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """Files of one layout as text cells with ``source_file`` and ``ord``, staged.

    With ``per_file``, ``ord`` starts at 0 in each file. ``multiline`` takes quoted cells
    with line breaks in CSV files, at the price of one task per file; cells of workbooks
    keep theirs in any case.
    """
    csv, books = input_files(spark, path)
    parts = []
    if csv:
        rows = scan_positional(spark, csv, layout, multiline=multiline).select("*", *file_marks())
        if not books:
            return with_file_ordinal(rows, per_file=per_file)
        parts.append(with_file_ordinal(rows, per_file=True))
    if books:
        parts.append(workbooks.by_position(workbooks.read_workbooks(spark, books), layout))
    columns = [*layout, "source_file", "ord"]
    whole = parts[0].select(columns)
    for part in parts[1:]:
        whole = whole.unionByName(part.select(columns))
    return stage(whole, "cells") if per_file else with_input_ordinal(whole)


def read_named(
    spark: SparkSession, path: str | list[str], required: Sequence[str] = layouts.IMAGE
) -> DataFrame:
    """Named columns of all files, with ``source_file`` and ``ord``; a file that lacks one fails."""
    csv, books = input_files(spark, path)
    parts = [_named_csv(spark, group, names, required) for names, group in _by_header(spark, csv)]
    if books:
        parts.append(_named_books(spark, books, required))
    columns = [*required, "source_file", "ord"]
    whole = parts[0].select(columns)
    for part in parts[1:]:
        whole = whole.unionByName(part.select(columns))
    return with_input_ordinal(whole)


def _by_header(spark: SparkSession, files: list[str]) -> list[tuple[list[str], list[str]]]:
    """Files by their header line: one group for each order of columns."""
    if not files:
        return []
    lines = spark.read.text(files).select("value", *file_marks(), F.monotonically_increasing_id().alias("_seq"))
    first = lines.where("_block = 0").groupBy("source_file").agg(F.min_by("value", "_seq").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("source_file").collect():
        groups.setdefault(row.header, []).append(row.source_file)
    return [([n.strip().strip('"') for n in header.split(",")], group) for header, group in groups.items()]


def _named_csv(spark: SparkSession, files: list[str], names: list[str], required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in names]
    if missing:
        raise MissingColumnsError(f"{files[0]} needs columns {missing}, found {names}")
    layout = tuple(n if n in required and names.index(n) == i else f"_c{i}" for i, n in enumerate(names))
    rows = scan_positional(spark, files, layout)
    return with_file_ordinal(rows.select(*required, *file_marks()), per_file=True)


def _named_books(spark: SparkSession, files: list[str], required: Sequence[str]) -> DataFrame:
    rows = stage(workbooks.readable(workbooks.read_workbooks(spark, files)), "cells")
    names = F.transform("cells", lambda c: F.trim(c))
    headers = rows.where("ord = 0").select("source_file", names.alias("_names"))
    placed = rows.where("ord > 0").join(headers, "source_file")

    def cell(name: str):
        at = F.array_position("_names", name)
        complaint = F.concat(F.col("source_file"), F.lit(f" needs column {name}"))
        found = F.when(at > 0, at).otherwise(F.raise_error(complaint).cast("bigint"))
        return F.get("cells", (found - 1).cast("int")).alias(name)

    return placed.select(*[cell(n) for n in required], "source_file", (F.col("ord") - 1).alias("ord"))
