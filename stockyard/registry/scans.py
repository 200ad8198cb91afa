"""Scans and sources. Files are derived from the feed by Spark, then read back whole."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.registry.core import KEYS, Tables, amounts, query
from stockyard.sources import layouts
from stockyard.sources.delimited import scan_named_checked, scan_positional, scan_promoted_header
from stockyard.sources.store import scan_store
from stockyard.sources.workbooks import by_position, decode_workbooks
from stockyard.staging import new_folder, shuffles_let_go

_SUPPLIER_SQL = f"""
  item_code, item_name, item_batch_number, item_expiry_date, supplier_id, supplier_name,
  {amounts("item_quantity", "item_purchase_price", "vat_value", "item_cost_price",
           "item_sale_price")}"""


def as_text(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, name: str, **options) -> str:
    """CSV files with a header line each, blanks kept; returns their folder.

    Files that one task reads whole in any case may as well be written with a ``compression``.
    """
    path = new_folder(df.sparkSession, name)
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    with shuffles_let_go(df.sparkSession):
        df.write.options(header=True, escape='"', **keep, **options).csv(path)
    return path


@query("scan_positional", f"SELECT ord, {_SUPPLIER_SQL} FROM ordered")
def positional(t: Tables) -> DataFrame:
    """CSV files in feed order; the position found in the files is that of the feed."""
    folder = write_csv(as_text(t.laid_out(lambda rows: rows.orderBy("ord")), layouts.SUPPLIER), "positional")
    rows = scan_positional(t.spark, folder, layouts.SUPPLIER, ordinal=True)
    return layouts.typed(rows.drop("source_file"))


@query(
    "scan_promoted_header",
    "SELECT item_no, credit_dis, credit_dis2, credit_dis3, cash_dis, cash_dis2, cash_dis3"
    " FROM discount_sheet",
)
def promoted_header(t: Tables) -> DataFrame:
    sheet = t.view("discount_sheet").drop("ord").select(*layouts.DISCOUNT)
    titles = ["ITEM_NO", "Dis1", "Dis2", "Dis3", "Dis1", "Dis2", "Dis3"]
    header = t.spark.createDataFrame([titles], sheet.schema)
    return scan_promoted_header(t.spark, write_csv(header.unionByName(sheet), "discounts"))


@query("scan_named_checked", "SELECT product_code, image_url FROM image_sheet")
def named_checked(t: Tables) -> DataFrame:
    sheet = t.view("image_sheet").select("image_url", "ord", "product_code")
    return scan_named_checked(t.spark, write_csv(sheet, "images"))


def _lines(rows: pa.RecordBatch) -> pa.Array:
    """Each row as the text of a sheet's row; a missing cell is an empty one."""
    parts = []
    for cells in rows.columns:
        for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
            cells = pc.replace_substring(cells, mark, reference)
        filled = pc.binary_join_element_wise('<c t="str"><v>', cells, "</v></c>", "")
        parts.append(pc.fill_null(filled, "<c/>"))
    return pc.binary_join_element_wise("<row>", *parts, "</row>", "")


def _workbook(rows: list[tuple]) -> bytes:
    """A minimal workbook with one sheet of text cells."""
    width = range(max(map(len, rows)))
    cells = [[None if i >= len(r) or r[i] is None else str(r[i]) for r in rows] for i in width]
    columns = [pa.array(c, pa.string()) for c in cells]
    return _packed(_lines(pa.RecordBatch.from_arrays(columns, [str(i) for i in width])))


def _packed(*lines: pa.Array) -> bytes:
    """A workbook whose only sheet has these rows."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    body = "".join(chain.from_iterable(part.to_pylist() for part in lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>'
            '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{package}"><Relationship Id="rId1" '
            f'Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
        )
    return out.getvalue()


def _to_workbooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for number, rows in enumerate(batches):
        names = pa.RecordBatch.from_pydict({n: pa.array([n]) for n in rows.schema.names})
        content = _packed(_lines(names), _lines(rows))
        yield pa.RecordBatch.from_pydict({"path": [f"feed-{part}-{number}.xlsx"], "content": [content]})


@query("scan_workbooks", f"SELECT {_SUPPLIER_SQL} FROM feed")
def workbooks(t: Tables) -> DataFrame:
    """The feed as workbooks, one per Arrow batch of rows, spread out and opened again."""
    files = as_text(t.feed, layouts.SUPPLIER).mapInArrow(
        _to_workbooks, "path string, content binary"
    )
    spread = files.repartition(t.spark.sparkContext.defaultParallelism, "path")
    rows = by_position(decode_workbooks(spread), layouts.SUPPLIER)
    return layouts.typed(rows.drop("source_file", "ord"))


@query("scan_store", "SELECT p_partkey, p_name, p_type FROM part")
def store(t: Tables) -> DataFrame:
    return scan_store(t.spark, t.path("part"), ["p_partkey", "p_name", "p_type"])


@query(
    "head_preview",
    f"SELECT k1, k2, k3, k4, item_code, item_name FROM feed ORDER BY {', '.join(KEYS)} LIMIT 5",
)
def head_preview(t: Tables) -> DataFrame:
    return t.feed.orderBy(*KEYS).limit(5).select("k1", "k2", "k3", "k4", "item_code", "item_name")
