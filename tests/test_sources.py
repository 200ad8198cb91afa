"""Readers and writers on real files."""

from __future__ import annotations

import io
import zipfile

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from stockyard.registry.scans import _workbook
from stockyard.sources import feeds, layouts, store, workbooks
from stockyard.sources.delimited import (
    MissingColumnsError,
    scan_named_checked,
    scan_positional,
    scan_promoted_header,
)

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def styled_workbook() -> bytes:
    """Shared strings, a date style, numbers, a formula text, an error and a skipped row."""
    sheet = (
        f'<worksheet xmlns="{MAIN}"><sheetData>'
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2"><v>100</v></c><c r="B2" s="1"><v>46447</v></c>'
        '<c r="D2"><v>0.10000000000000001</v></c></row>'
        '<row r="4"><c r="A4" t="str"><v>text</v></c><c r="C4" t="e"><v>#N/A</v></c>'
        '<c r="AA4" t="s"><v>2</v></c></row>'
        "</sheetData></worksheet>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>'
            '<sheet name="S" sheetId="4" r:id="rId9"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId9" Target="/xl/worksheets/other.xml"/></Relationships>',
        )
        book.writestr(
            "xl/sharedStrings.xml",
            f'<sst xmlns="{MAIN}"><si><t>code</t></si><si><t>expiry</t></si>'
            "<si><r><t>rich </t></r><r><t>text</t></r></si></sst>",
        )
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/>'
            '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        )
        book.writestr("xl/worksheets/other.xml", sheet)
    return out.getvalue()


def test_workbook_cells():
    rows = list(workbooks.sheet_rows(styled_workbook()))
    assert rows[0] == ["code", "expiry"]
    assert rows[1] == ["100", "2027-03-01 00:00:00", None, "0.1"]
    assert rows[2] == []
    assert rows[3][:3] == ["text", None, None]
    assert rows[3][26] == "rich text" and len(rows[3]) == 27


def test_many_workbooks_by_position(spark, tmp_path):
    for n in range(3):
        lines = [layouts.IMAGE, *[(f"c{n}-{i}", "" if i == 1 else f"<u&{i}>") for i in range(4)]]
        (tmp_path / f"f{n}.xlsx").write_bytes(_workbook(lines))
    rows = workbooks.by_position(workbooks.read_workbooks(spark, str(tmp_path)), layouts.IMAGE)
    assert rows.select("source_file").distinct().count() == 3
    expected = [
        (f"c{n}-{i}", i, None if i == 1 else f"<u&{i}>") for n in range(3) for i in range(4)
    ]
    assert rows_of(rows, "product_code", "ord", "image_url") == expected


def test_broken_workbook_fails_with_its_name(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    rows = workbooks.by_position(workbooks.read_workbooks(spark, str(tmp_path)), layouts.IMAGE)
    with pytest.raises(Exception, match="bad.xlsx"):
        rows.collect()


def test_positional_ignores_header_text(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Any,Thing\n"1,2",http://a\n,"x ""y"""\n')
    rows = scan_positional(spark, str(tmp_path / "f.csv"), layouts.IMAGE)
    assert rows_of(rows) == [("1,2", "http://a"), (None, 'x "y"')]


@pytest.mark.parametrize(
    "layout, width",
    [("STANDARD", 15), ("SUPPLIER", 11), ("CATEGORY", 19), ("BARCODE", 18), ("DISCOUNT", 7)],
)
def test_layout_widths(layout, width):
    assert len(set(getattr(layouts, layout))) == width


def test_promoted_header(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        ",CREDIT,,,CASH,,\nITEM_NO,Dis1,Dis2,Dis3,Dis1,Dis2,Dis3\n7,1,2,3,4,5,6\n,1,1,1,1,1,1\n"
    )
    rows = scan_promoted_header(spark, str(tmp_path / "d.csv"))
    assert rows.columns == list(layouts.DISCOUNT)
    assert rows_of(rows) == [("7", "1", "2", "3", "4", "5", "6"), (None, *["1"] * 6)]


def test_named_columns_are_checked(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("image_url,extra,product_code\nu,e,1\n")
    bad.write_text("image,code\nu,1\n")
    assert rows_of(scan_named_checked(spark, str(good))) == [("1", "u")]
    assert rows_of(scan_named_checked(spark, str(good), ordinal=True)) == [("1", "u", 0)]
    with pytest.raises(MissingColumnsError, match="product_code"):
        scan_named_checked(spark, str(bad))


def test_named_file_with_the_wrong_extension(spark, tmp_path):
    book, text = tmp_path / "book.csv", tmp_path / "text.xlsx"
    book.write_bytes(_workbook([("image_url", "product_code"), ("u", "1"), ("v", "2")]))
    text.write_text("product_code,image_url\n1,u\n2,v\n")
    for path in (book, text):
        rows = scan_named_checked(spark, str(path), ordinal=True)
        assert rows_of(rows, "product_code", "image_url", "ord") == [("1", "u", 0), ("2", "v", 1)]


def test_a_repeated_run_replaces_its_own_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    for run_id, count in (("a", 5), ("b", 3), ("a", 4)):
        store.append_run({"purchases": spark.range(count)}, root, run_id)
    stored = store.read_runs(spark, root, "purchases").groupBy("run_id").count()
    assert rows_of(stored) == [("a", 4), ("b", 3)]
    with pytest.raises(ValueError, match="unknown tables"):
        store.append_run({"purchase": spark.range(1)}, root, "c")


def test_a_run_that_broke_off_is_not_read(spark, tmp_path):
    root = str(tmp_path / "store")
    store.append_run({"purchases": spark.range(2)}, root, "007")
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.append_run({"purchases": spark.range(9), "purchase_items": broken}, root, "007")
    with pytest.raises(Exception, match="lost"):
        store.append_run({"purchases": spark.range(9), "purchase_items": broken}, root, "2024-01-01")
    assert rows_of(store.read_runs(spark, root, "purchases").groupBy("run_id").count()) == [("007", 2)]


def test_a_snapshot_never_overwrites_a_version(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    first = store.rewrite_snapshot(spark.range(3), root, "1")
    second = store.rewrite_snapshot(first.withColumn("id", F.col("id") + 1), root, "2")
    assert rows_of(second) == [(1,), (2,), (3,)]
    again = store.rewrite_snapshot(second.filter("id > 1"), root, "2")
    assert rows_of(again) == rows_of(store.read_latest(spark, root)) == [(2,), (3,)]
    assert rows_of(second) == [(1,), (2,), (3,)]


def test_folders_of_files_in_any_order_of_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("product_code,image_url\n1,u\n2,v\n")
    (tmp_path / "b.csv").write_text("image_url,other,product_code\nw,x,3\n")
    (tmp_path / "c.xlsx").write_bytes(_workbook([("image_url", "product_code"), ("y", "4")]))
    (tmp_path / "d.xlsx").write_bytes(_workbook([("product_code", "image_url"), ("5", "z")]))
    rows = feeds.read_named(spark, str(tmp_path))
    assert rows_of(rows, "ord", "product_code", "image_url") == [
        (0, "1", "u"), (1, "2", "v"), (2, "3", "w"), (3, "4", "y"), (4, "5", "z"),
    ]
    (tmp_path / "e.xlsx").write_bytes(b"PK no workbook")
    with pytest.raises(Exception, match="e.xlsx"):
        feeds.read_named(spark, str(tmp_path)).collect()
    with pytest.raises(MissingColumnsError):
        feeds.read_named(spark, str(tmp_path / "a.csv"), ["price"])


def test_a_mixed_folder_by_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,u\n2,v\n")
    (tmp_path / "b.xlsx").write_bytes(_workbook([("p", "q"), ("3", "w"), ("4", None)]))
    rows = feeds.read_positional(spark, str(tmp_path), ("code", "name"))
    assert rows_of(rows, "ord", "code", "name") == [
        (0, "1", "u"), (1, "2", "v"), (2, "3", "w"), (3, "4", None),
    ]


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_report_files(spark, tmp_path, file_format):
    path = str(tmp_path / file_format)
    store.write_report(spark.range(2).withColumn("x", F.lit("a,b")), path, file_format)
    read = spark.read.option("header", True).format(file_format).load(path)
    assert rows_of(read.select(F.col("id").cast("int"), "x")) == [(0, "a,b"), (1, "a,b")]


def test_cells_of_any_kind_are_read(spark):
    """Marks, gaps, rich text, errors; rows leave the task as Arrow columns."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = (
        f'<x:worksheet xmlns:x="{main}"><x:sheetData><x:row r="2">'
        '<x:c r="B2" t="inlineStr"><x:is><x:r><x:t>a &lt;b&gt;</x:t></x:r><x:r><x:t> &amp; <![CDATA[<c>]]></x:t></x:r></x:is></x:c>'
        '<x:c r="D2"><x:f>1+1</x:f><x:v>2.50</x:v></x:c><x:c t="e"><x:v>#N/A</x:v></x:c><x:c t="b"><x:v>1</x:v></x:c>'
        '</x:row><x:row r="4"><x:c r="A4" t="inlineStr"><x:is><x:t/></x:is></x:c></x:row></x:sheetData></x:worksheet>'
    )
    book = io.BytesIO(_workbook([("old",)]))
    made = io.BytesIO()
    with zipfile.ZipFile(book) as old, zipfile.ZipFile(made, "w") as new:
        for name in old.namelist():
            new.writestr(name, sheet if name.endswith("sheet1.xml") else old.read(name))
    read = workbooks.decode_workbooks(spark.createDataFrame([("a", made.getvalue())], "path string, content binary"))
    rows = [tuple(r) for r in read.orderBy("ord").collect()]
    cells = [[], [None, "a <b> & <c>", None, "2.5", None, "1"], [], [None]]
    assert rows == [("a", i, c, None) for i, c in enumerate(cells)]
    assert "MapInArrow" in read._jdf.queryExecution().executedPlan().toString()
