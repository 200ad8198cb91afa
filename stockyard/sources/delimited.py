"""CSV feeds, read by position or by checked name. Every cell arrives as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.operators.ordinals import file_marks, with_file_ordinal
from stockyard.sources import layouts
from stockyard.sources.workbooks import read_workbooks, workbook_columns


class MissingColumnsError(ValueError):
    """A file lacks columns that its import needs."""


# A first line is dropped whatever it says; names come from the layout.
POSITIONAL_OPTIONS = {"header": "true", "enforceSchema": "true", "escape": '"'}


def scan_positional(
    spark: SparkSession,
    path: str | list[str],
    layout: tuple[str, ...],
    ordinal: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """Files of one layout: header text is ignored, names go by position.

    ``ordinal`` adds ``source_file`` and ``ord``, the position of each row in the whole
    input, and stages the rows. ``multiline`` takes cells with line breaks, at the price
    of one task per file.
    """
    reader = spark.read.schema(layouts.text_schema(layout)).options(**POSITIONAL_OPTIONS)
    rows = reader.option("multiLine", multiline).csv(path)
    return with_file_ordinal(rows.select("*", *file_marks())) if ordinal else rows


def scan_promoted_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Discount files, whose real header is the first data row."""
    rows = scan_positional(spark, path, layouts.DISCOUNT)
    return drop_promoted_header(rows)


def drop_promoted_header(rows: DataFrame) -> DataFrame:
    """Rows without the header that was read as data."""
    return rows.filter(~F.col("item_no").eqNullSafe(F.lit(layouts.DISCOUNT_HEADER)))


def scan_named_checked(
    spark: SparkSession,
    path: str,
    required: Sequence[str] = layouts.IMAGE,
    ordinal: bool = False,
) -> DataFrame:
    """Named columns of a CSV or workbook, the extension deciding which is tried first.

    A file whose content belies its extension is read in the other format. Missing
    columns are an error; columns that are not asked for are left out. Only the
    header is looked at before the job runs. ``ordinal`` adds the row position.
    """
    readers = [_named_csv, _named_workbook]
    if not _first_name(spark, path).lower().endswith(".csv"):
        readers.reverse()
    found: set[str] = set()
    for read in readers:
        names, rows = read(spark, path, required, ordinal)
        if rows is not None:
            return rows
        found.update(names)
    raise MissingColumnsError(f"{path} needs columns {list(required)}, found {sorted(found)}")


def _first_name(spark: SparkSession, path: str) -> str:
    """The path itself, or for a folder the name of a file in it; no content is read."""
    files = spark.read.format("binaryFile").load(path).select("path").head()
    return path if files is None else files.path


def _named_csv(spark: SparkSession, path: str, required: Sequence[str], ordinal: bool):
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    if not set(required) <= set(rows.columns):
        return rows.columns, None
    if ordinal:
        marked = rows.select(*required, *file_marks())
        return rows.columns, with_file_ordinal(marked).select(*required, "ord")
    return rows.columns, rows.select(*required)


def _named_workbook(spark: SparkSession, path: str, required: Sequence[str], ordinal: bool):
    rows = read_workbooks(spark, path)
    names = workbook_columns(rows)
    if not set(required) <= set(names):
        return names, None
    cells = [F.get("cells", F.lit(names.index(name))).alias(name) for name in required]
    position = [(F.col("ord") - 1).alias("ord")] if ordinal else []
    return names, rows.filter("ord > 0").select(*cells, *position)
