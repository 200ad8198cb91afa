"""The stream posts what the batch posts, once."""

from __future__ import annotations

import os

from conftest import rows_of
from test_imports import supplier_rows, write_csv

from stockyard import jobs
from stockyard.operators.ordinals import file_marks, with_file_ordinal
from stockyard.registry.control import post_supplier_drop
from stockyard.registry.scans import _workbook
from stockyard.sources import layouts, store
from stockyard.sources.delimited import scan_positional
from stockyard.streaming.file_drop import import_drops

COLUMNS = ["supplier_id", "supplier", "total", "total_sale", "grand_total", "items_read"]


def drop(spark, folder, tmp_path):
    import_drops(
        spark, str(folder), layouts.SUPPLIER, post_supplier_drop,
        str(tmp_path / "out"), str(tmp_path / "check"), files_per_trigger=2,
    )
    return spark.read.parquet(str(tmp_path / "out"))


def batch(spark, folder):
    rows = scan_positional(spark, str(folder), layouts.SUPPLIER).select("*", *file_marks())
    return post_supplier_drop(with_file_ordinal(rows, per_file=True))


def test_stream_equals_batch_and_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        write_csv(folder / f"f{n}.csv", supplier_rows(60, seed=n), layouts.SUPPLIER)
    found = rows_of(drop(spark, folder, tmp_path), *COLUMNS)
    assert found == rows_of(batch(spark, folder), *COLUMNS)
    assert rows_of(drop(spark, folder, tmp_path), *COLUMNS) == found

    write_csv(folder / "late.csv", supplier_rows(40, seed=8), layouts.SUPPLIER)
    assert rows_of(drop(spark, folder, tmp_path), *COLUMNS) == rows_of(batch(spark, folder), *COLUMNS)


def test_whole_imports_of_drops_go_on_where_the_last_left_off(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    words = ["watch-supplier", "--feed", str(folder), "--store", root, "--at", "2025-06-01T08:00:00"]
    priced = [{**r, "item_sale_price": "5.5"} for r in supplier_rows(80, seed=3)]
    posted = 0
    for n, rows in enumerate((priced[:50], priced[50:])):
        write_csv(folder / f"f{n}.csv", rows, layouts.SUPPLIER)
        jobs.run(spark, jobs.parsed(words))
        posted += sum(bool(r["item_code"] and r["supplier_id"]) for r in rows)
        assert store.read_runs(spark, root, "purchase_items").count() == posted
    ids = [r.id for r in store.read_runs(spark, root, "purchases").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    codes = [r.code for r in store.read_runs(spark, root, "products").collect()]
    assert len(codes) == len(set(codes)) > 0
    jobs.run(spark, jobs.parsed(words))
    assert store.read_runs(spark, root, "purchase_items").count() == posted


def test_dropped_workbooks_are_posted_as_in_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    priced = [{**r, "item_sale_price": "5.5"} for r in supplier_rows(60, seed=5)]
    write_csv(folder / "a.csv", priced[:30], layouts.SUPPLIER)
    lines = [layouts.SUPPLIER, *[[r[c] for c in layouts.SUPPLIER] for r in priced[30:]]]
    (folder / "b.xlsx").write_bytes(_workbook(lines))
    posted = []
    for job, more in (("watch-supplier", []), ("supplier", ["--run-id", "1"])):
        root = str(tmp_path / job)
        words = [job, "--feed", str(folder), "--store", root, "--at", "2025-06-01T08:00:00", *more]
        jobs.run(spark, jobs.parsed(words))
        posted.append([
            rows_of(table.drop("run_id"))
            for name in ("purchases", "purchase_items")
            for table in [store.read_runs(spark, root, name)]
        ])
    assert posted[0] == posted[1]
    assert len(posted[0][1]) == sum(bool(r["item_code"] and r["supplier_id"]) for r in priced)


def test_what_a_trigger_stages_goes_when_its_run_is_stored(spark, tmp_path):
    from stockyard.staging import shared_folder, stage
    from stockyard.streaming.file_drop import import_runs

    folder, root, staged = tmp_path / "in", str(tmp_path / "store"), []
    folder.mkdir()
    write_csv(folder / "a.csv", supplier_rows(20, seed=3), layouts.SUPPLIER)

    def post(rows, run_id):
        staged.append(stage(rows.select("ord"), "posted"))
        return {"purchases": staged[0]}, {}

    import_runs(spark, str(folder), layouts.SUPPLIER, post, root, str(tmp_path / "stream"))
    assert store.read_runs(spark, root, "purchases").count() == 20
    assert not [x for x in os.listdir(f"{shared_folder(spark)}/stockyard") if x.startswith("trigger-")]
    assert all(".zstd." in f for f in store.read_runs(spark, root, "purchases").inputFiles())
