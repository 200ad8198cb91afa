"""The manifest of a store: tables by themselves, ids, schemas, steps and buckets."""

from __future__ import annotations

import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_imports import standard_rows, supplier_rows, write_csv

from stockyard import jobs
from stockyard.operators import lookups, updates
from stockyard.sources import buckets, keyed, layouts, store
from stockyard.sources.manifest import Manifest, NotStoredError, reserve_ids

AT = "2025-06-01T08:00:00"


def test_a_partial_repeat_leaves_the_other_tables(spark, tmp_path):
    root = str(tmp_path / "store")
    store.append_run({"products": spark.range(3), "purchases": spark.range(2)}, root, "1")
    store.append_run({"products": spark.range(5)}, root, "1")
    assert store.read_runs(spark, root, "products").count() == 5
    assert store.read_runs(spark, root, "purchases").count() == 2
    store.append_run({"suppliers": spark.range(4)}, root, "1")
    assert [store.read_runs(spark, root, n).count() for n in ("products", "purchases", "suppliers")] == [5, 2, 4]
    with pytest.raises(NotStoredError):
        store.read_runs(spark, root, "transfers")


def test_of_two_writers_of_one_number_one_is_refused(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "store"))
    line = {"kind": "table", "table": "t", "run": "a", "attempt": "x", "schema": "{}"}
    assert manifest.commit([line]) == 1
    assert not manifest._create(1, [{**line, "attempt": "y"}])
    asked = []

    def late(seen):
        asked.append(list(seen))
        if len(asked) == 1:
            manifest.commit([{**line, "run": "b"}])
        return [{**line, "attempt": "z"}]

    assert manifest.decide(late) == 3
    assert asked == [[1], [1, 2]]
    assert rows_of(manifest.attempts("t"), "run", "attempt") == [("a", "z"), ("b", "x")]
    assert not [n for n in os.listdir(manifest.folder) if n.endswith(".tmp")]


def test_ids_of_runs_that_start_together_are_disjoint(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "store"))
    first = reserve_ids(manifest, "a", {"products": 10, "purchases": 4}, {"products": 7})
    second = reserve_ids(manifest, "b", {"products": 10}, {"products": 7})
    assert (first, second) == ({"products": 8, "purchases": 1}, {"products": 18})
    # A repeat keeps its ids as long as it needs no more of them.
    assert reserve_ids(manifest, "a", {"products": 10}, {"products": 7}) == {"products": 8}
    assert reserve_ids(manifest, "a", {"products": 11}, {"products": 7}) == {"products": 28}
    # What a run did not use goes back.
    given = spark.range(3).select((F.col("id") + 18).alias("id"))
    rest = reserve_ids(manifest, "c", {"suppliers": 100}, {})
    store.append_run({"suppliers": given}, manifest.root, "c", rest)
    assert reserve_ids(manifest, "d", {"suppliers": 5}, {}) == {"suppliers": 21}


def test_two_imports_from_one_state_post_under_their_own_ids(spark, tmp_path):
    root = str(tmp_path / "store")
    begun = []
    for n in range(2):
        path = tmp_path / f"f{n}.csv"
        write_csv(path, [{**r, "item_sale_price": "5.5"} for r in supplier_rows(60, seed=n)], layouts.SUPPLIER)
        args = jobs.parsed(["supplier", "--feed", str(path), "--store", root, "--run-id", str(n), "--at", AT])
        feed = jobs.read_feed(spark, str(path), layouts.SUPPLIER)
        none = jobs.read_catalogue(spark, [], str(n))
        begun.append(jobs.post_feed(spark, args, "supplier", str(n), feed, none))
    for n, (posted, ids) in enumerate(begun):
        tables = {k: v for k, v in posted.items() if k not in jobs.REPORTS}
        store.append_run(tables, root, str(n), ids)
    for name in ("products", "purchases", "purchase_orders"):
        found = [r.id for r in store.read_runs(spark, root, name).collect()]
        assert found and len(set(found)) == len(found), name
    items = store.read_runs(spark, root, "purchase_items")
    owned = items.join(store.read_runs(spark, root, "purchases"), F.col("purchase_id") == F.col("id"), "left_semi")
    assert owned.count() == items.count() > 0


def test_watch_jobs_that_share_a_store_keep_each_others_runs(spark, tmp_path):
    root = str(tmp_path / "store")
    good = [r for r in standard_rows(60) if r["item_total_sale_price"]]
    priced = [{**r, "item_sale_price": "5.5"} for r in supplier_rows(60)]
    for job, rows, layout in (("standard", good, layouts.STANDARD), ("supplier", priced, layouts.SUPPLIER)):
        folder = tmp_path / job
        folder.mkdir()
        write_csv(folder / "a.csv", rows, layout)
        jobs.run(spark, jobs.parsed([f"watch-{job}", "--feed", str(folder), "--store", root, "--at", AT]))
    runs = store.read_runs(spark, root, "purchases").groupBy("run_id").count()
    assert {r.run_id for r in runs.collect()} == {"standard-drop-0", "supplier-drop-0"}
    ids = [r.id for r in store.read_runs(spark, root, "purchases").collect()]
    assert len(ids) == len(set(ids))


def test_columns_of_all_runs(spark, tmp_path):
    root = str(tmp_path / "store")
    store.append_run({"products": spark.range(2).withColumn("name", F.lit("a"))}, root, "1")
    store.append_run({"products": spark.range(2, 3).withColumn("cost", F.lit(1.5))}, root, "2")
    found = store.read_runs(spark, root, "products")
    assert set(found.columns) == {"id", "name", "cost", "run_id"}
    assert rows_of(found, "id", "name", "cost", "run_id") == [
        (0, "a", None, "1"), (1, "a", None, "1"), (2, None, 1.5, "2"),
    ]


def test_a_step_is_logged_per_table(spark, tmp_path):
    root = str(tmp_path / "store")
    none = spark.createDataFrame([], "id long")
    store.append_run({"products": spark.range(3), "purchases": none}, root, "1")
    store.append_run({"products": spark.range(4)}, root, "1")
    log = store.read_runs(spark, root, store.STEP_LOG)
    assert rows_of(log, "run_id", "step", "rows") == [("1", "products", 4), ("1", "purchases", 0)]
    assert all(r.started_at <= r.ended_at for r in log.collect())


def catalogue(spark, rows=500):
    codes = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string"))
    return spark.range(rows).select("id", codes.alias("code"), F.lit("n").alias("name"))


def files_of(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_an_update_of_one_row_rewrites_one_bucket(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    whole = catalogue(spark)
    back = buckets.write_buckets(whole, root, "1", "code", 16)
    assert rows_of(back) == rows_of(whole)
    before = files_of(root)
    sheet = spark.createDataFrame([("7", "u", 0), ("none", "v", 1)], "product_code string, image_url string, ord long")
    codes = sheet.select(F.col("product_code").alias("code"))
    touched = buckets.update_buckets(spark, root, "2", codes, "code", lambda p: updates.update_images(p, sheet))
    new = files_of(root) - before
    assert len(touched) == 1 and before <= files_of(root)
    assert {f.split("_bucket=")[1].split("/")[0] for f in new} == {str(touched[0])}
    found = buckets.read_buckets(spark, root)
    assert rows_of(found.where("image_url_new IS NOT NULL"), "code", "image_url_new") == [("7", "u")]
    assert rows_of(found, "id", "code", "name") == rows_of(whole)
    # Another column, which is not what the buckets go by.
    ids = spark.createDataFrame([(0,), (None,)], "id long")
    touched = buckets.update_buckets(spark, root, "3", ids, "id", lambda p: p.withColumn("name", F.lit("m")))
    assert len(touched) == 1
    assert buckets.read_buckets(spark, root).where("name = 'm' AND id = 0").count() == 1
    assert buckets.update_buckets(spark, root, "4", ids.where("id > 9"), "id", lambda p: p) == []


def test_buckets_can_be_emptied_and_replaced(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    buckets.write_buckets(catalogue(spark, 40), root, "1", "code", 4)
    every = catalogue(spark, 40).select("code")
    buckets.update_buckets(spark, root, "2", every, "code", lambda p: p.where("code IS NULL"))
    assert buckets.read_buckets(spark, root).where("code IS NOT NULL").count() == 0
    assert buckets.write_buckets(catalogue(spark, 0), root, "3", "code", 2).count() == 0
    buckets.write_buckets(catalogue(spark, 9), root, "4", "code", 3)
    assert store.read_table(spark, root).count() == 9
    with pytest.raises(NotStoredError):
        buckets.read_buckets(spark, str(tmp_path / "nowhere"))


def test_two_updates_of_one_bucket_do_not_overwrite_each_other(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    buckets.write_buckets(catalogue(spark, 40), root, "1", "code", 1)
    seven = spark.createDataFrame([("7",)], "code string")

    def first(part):
        buckets.update_buckets(spark, root, "2", seven, "code", lambda p: p.withColumn("name", F.lit("first")))
        return part.withColumn("name", F.lit("late"))

    with pytest.raises(buckets.ConflictError):
        buckets.update_buckets(spark, root, "3", seven, "code", first)
    assert rows_of(buckets.read_buckets(spark, root), "name") == [("first",)] * 40


def test_the_store_catalogue_is_updated_in_its_buckets(spark, tmp_path):
    root, sheet = str(tmp_path / "store"), tmp_path / "images.csv"
    products = spark.range(200).select((F.col("id") + 1).alias("id"), F.col("id").cast("string").alias("code"))
    products.withColumn("cost", F.lit(None).cast("decimal(12,2)")).write.parquet(str(tmp_path / "products"))
    own = f"{root}/catalogue"
    for n, (catalogue_path, code) in enumerate(((str(tmp_path / "products"), "5"), (own, "9"))):
        sheet.write_text(f"product_code,image_url\n{code},http://{code}\n")
        words = ["images", "--feed", str(sheet), "--store", root, "--run-id", str(n), "--buckets", "32"]
        before = files_of(own) if n else set()
        jobs.run(spark, jobs.parsed([*words, "--catalogue", catalogue_path]))
    assert len({f.split("_bucket=")[1].split("/")[0] for f in files_of(own) - before}) == 1
    found = store.read_latest(spark, own).where("image_url_new IS NOT NULL")
    assert rows_of(found, "code", "image_url_new") == [("5", "http://5"), ("9", "http://9")]
    discounts = tmp_path / "discounts.csv"
    discounts.write_text(",CREDIT,,,CASH,,\nITEM_NO,Dis1,Dis2,Dis3,Dis1,Dis2,Dis3\n7,1,2,3,4,5,6\n")
    jobs.run(spark, jobs.parsed([
        "discounts", "--feed", str(discounts), "--store", root, "--run-id", "d", "--catalogue", own,
    ]))
    told = store.read_latest(spark, own).where("credit_discount IS NOT NULL")
    assert [(r.id, float(r.credit_discount), float(r.cash_dis3)) for r in told.collect()] == [(7, 1.0, 6.0)]
    assert store.read_latest(spark, own).count() == 200


def test_the_stored_side_of_a_lookup_is_not_shuffled(spark, tmp_path):
    root = str(tmp_path / "codes")
    products = catalogue(spark, 3000)
    back = keyed.write_keyed(products, root, "1", "code")
    assert rows_of(back) == rows_of(products.where("code IS NOT NULL"))
    feed = spark.range(9000).select((F.col("id") % 4000).cast("string").alias("code"), F.col("id").alias("ord"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Of 4,000 codes every third is not stored, nor are those from 3,000 on.
        for find, expected in ((lookups.existing_keys, 2000), (lookups.missing_keys, 2000)):
            found = find(feed, keyed.read_keyed(spark, root), ["code"])
            count = found.count()
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "SortMergeJoin" in plan and "Bucketed: true" in plan
            assert plan.count("Exchange hashpartitioning") == 1
            assert count == find(feed, products, ["code"]).count() == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    keyed.write_keyed(products.limit(0), root, "2", "code", 3)
    assert keyed.read_keyed(spark, root).count() == 0
    with pytest.raises(NotStoredError):
        keyed.read_keyed(spark, str(tmp_path / "nowhere"))


def test_every_table_of_the_run_is_written_twice(spark, folder, tmp_path, monkeypatch):
    from stockyard.registry import control
    from stockyard.registry.core import Tables

    root = str(tmp_path / "store")
    monkeypatch.setattr(control, "new_folder", lambda *_: root)
    stored = {r.table_name: r.stored_rows for r in control.append_tables(Tables(spark, folder)).collect()}
    for name, times in (("purchases", 3), ("purchase_items", 2), ("inventory_movements", 2)):
        attempts = os.listdir(f"{root}/{name}/run_id=r1")
        rows = [spark.read.parquet(f"{root}/{name}/run_id=r1/{a}").count() for a in attempts]
        assert rows == times * [stored[name]]


def test_a_whole_repeat_leaves_no_table_out(spark, tmp_path):
    root = str(tmp_path / "store")
    store.append_run({"products": spark.range(3), "purchases": spark.range(2)}, root, "1")
    with pytest.raises(ValueError, match="purchases"):
        store.repeat_run({"products": spark.range(5)}, root, "1")
    store.repeat_run({"products": spark.range(5), "purchases": spark.range(4)}, root, "1")
    assert [store.read_runs(spark, root, n).count() for n in ("products", "purchases")] == [5, 4]
