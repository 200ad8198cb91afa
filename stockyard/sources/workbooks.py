"""Many workbooks at once: one task opens each file and streams its first sheet.

An ``.xlsx`` file is a zip of XML parts and cannot be split. Its format ends at
1,048,576 rows, which bounds the work of one task; rows leave the task in chunks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import cache
from itertools import chain
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_SCHEMA = "source_file string, ord bigint, cells array<string>, problem string"
_CHUNK = 20_000

# Number format ids that show a date, as the file format defines them.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_DIGITS = "0123456789"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_workbooks(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Rows of the first sheet of every workbook under a path.

    A file that is no workbook gives one row that names the problem.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return decode_workbooks(files.select("path", "content"))


def decode_workbooks(files: DataFrame) -> DataFrame:
    """Rows of workbooks given as (path, content); row 0 of each is its header."""
    return files.mapInArrow(_decode, ROWS_SCHEMA)


def by_position(rows: DataFrame, layout: tuple[str, ...]) -> DataFrame:
    """Data rows under the names of a layout, with file and position from 0.

    A file that could not be opened fails the job.
    """
    cells = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(layout)]
    data = readable(rows).filter("ord > 0")
    return data.select("source_file", (F.col("ord") - 1).alias("ord"), *cells)


def readable(rows: DataFrame) -> DataFrame:
    """Rows as they are; a file that could not be read, or not to its end, fails the job."""
    refused = F.raise_error(F.concat_ws(": ", "source_file", "problem"))
    return rows.filter(
        F.when(F.col("problem").isNotNull(), refused.cast("boolean")).otherwise(F.lit(True))
    )


def workbook_columns(rows: DataFrame) -> list[str]:
    """Header names of one workbook, none where there is no header to be read."""
    header = rows.filter("ord = 0 AND problem IS NULL").select("cells").head()
    return [] if header is None else [str(c).strip() for c in header.cells]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            path = path.as_py()
            try:
                for first, chunk in _chunks(sheet_rows(content.as_py())):
                    yield _frame(path, first, chunk)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as problem:
                yield _frame(path, 0, [[]], f"{type(problem).__name__}: {problem}")


def _frame(path: str, first: int, chunk: list, problem: str | None = None) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, chunk), np.int32, len(chunk))
    cells = pa.array(list(chain.from_iterable(chunk)), pa.string())
    columns = [
        pa.repeat(pa.scalar(path, pa.string()), len(chunk)),
        pa.array(np.arange(first, first + len(chunk), dtype=np.int64)),
        pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), sizes.cumsum(dtype=np.int32))), cells),
        pa.repeat(pa.scalar(problem, pa.string()), len(chunk)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["source_file", "ord", "cells", "problem"])


def _chunks(rows: Iterator[list]) -> Iterator[tuple[int, list]]:
    first, chunk = 0, []
    for row in rows:
        chunk.append(row)
        if len(chunk) == _CHUNK:
            yield first, chunk
            first, chunk = first + _CHUNK, []
    if chunk:
        yield first, chunk


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t) == "t")


def _tree(book: zipfile.ZipFile, part: str):
    return ElementTree.fromstring(book.read(part)) if part in book.namelist() else None


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """Part name of the first sheet, and whether dates count from 1904."""
    workbook = _tree(book, "xl/workbook.xml")
    if workbook is None:
        raise KeyError("xl/workbook.xml")
    flags = [e.get("date1904") for e in workbook.iter() if _local(e) == "workbookPr"]
    sheets = [e for e in workbook.iter() if _local(e) == "sheet"]
    links = _tree(book, "xl/_rels/workbook.xml.rels")
    targets = {e.get("Id"): e.get("Target") for e in links} if links is not None else {}
    target = targets[sheets[0].get(_RELATION)] if sheets else None
    if target is None:
        raise KeyError("first sheet")
    part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return part, any(f in ("1", "true") for f in flags)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date."""
    styles = _tree(book, "xl/styles.xml")
    if styles is None:
        return set()
    dated = set(_DATE_FORMATS)
    for e in styles.iter():
        if _local(e) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode") or "")
            if re.search(r"[ymdhs]", code.lower()) and "general" not in code.lower():
                dated.add(int(e.get("numFmtId")))
    formats = next((e for e in styles if _local(e) == "cellXfs"), ())
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId") or 0) in dated}


@cache
def _column(letters: str) -> int:
    """Position from 0 of a column such as AB."""
    position = 0
    for letter in letters:
        position = position * 26 + ord(letter.upper()) - ord("A") + 1
    return position - 1


def _number(text: str) -> str:
    return text if re.fullmatch(r"-?\d+", text) else repr(float(text))


def _cell(cell, text: str, found: str, shared: list[str], dated: set[int], epoch: datetime) -> str | None:
    """The text of a cell; ``text`` and ``found`` are the names of the elements that hold it."""
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join([t.text or "" for t in cell.iter(text)]) or None
    value = cell.findtext(found)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)] or None
    if kind in ("str", "b", "d"):
        return value or None
    if int(cell.get("s") or 0) in dated:
        moment = epoch + timedelta(days=float(value))
        return moment.strftime("%Y-%m-%d %H:%M:%S")
    return _number(value)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text cells; rows left out of the file come as empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part, from_1904 = _first_sheet(book)
        epoch = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
        strings = _tree(book, "xl/sharedStrings.xml")
        shared = [] if strings is None else [_texts(e) for e in strings]
        dated = _date_styles(book)
        done = 0
        with book.open(part) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if not element.tag.endswith("}row"):
                    continue
                text, found = f"{element.tag[:-3]}t", f"{element.tag[:-3]}v"
                number = int(element.get("r") or done + 1)
                for _ in range(done + 1, number):
                    yield []
                done = number
                cells: list[str | None] = []
                for cell in element:
                    place = cell.get("r")
                    at = _column(place.rstrip(_DIGITS)) if place else len(cells)
                    if at > len(cells):
                        cells.extend([None] * (at - len(cells)))
                    cells.append(_cell(cell, text, found, shared, dated, epoch))
                yield cells
                element.clear()
