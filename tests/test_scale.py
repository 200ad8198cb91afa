"""Plans that hold at any size: no row-level single task, no cross join, pruned scans."""

from __future__ import annotations

import os
import re
import time

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

import __spark_entry__ as driver
from stockyard.functions.measures import with_line_totals
from stockyard.operators import cleaning, lookups, posting
from stockyard.registry.core import KEYS, RUN_TIME, Tables
from stockyard.settings import SUPPLIER

QUERIES = driver.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Windows over everything are allowed on the brand and type lists only.
SMALL_WINDOW = re.compile(r"p_type|p_brand")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_plan_has_a_row_level_bottleneck(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if "- Window [" in line and "windowspecdefinition(" in line:
            spec = line.split("windowspecdefinition(", 1)[1]
            partitioned = not re.match(r"[\w#]+L? (ASC|DESC)", spec)
            assert partitioned or SMALL_WINDOW.search(line), line


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(QUERIES["product_report"](spark, folder))
    lineitem = next(
        x for x in plan.splitlines() if "FileScan parquet" in x and "l_partkey" in x
    )
    assert "l_extendedprice" not in lineitem and "l_shipdate" not in lineitem
    assert "PushedFilters: [IsNotNull(l_partkey)" in lineitem


def test_supplier_sums_are_hash_aggregates_over_an_ordinal(spark, folder):
    rows = with_line_totals(cleaning.drop_null_key(Tables(spark, folder).ordered))
    plan = plan_of(posting.purchases_per_supplier(rows, SUPPLIER, RUN_TIME, ["ord"]))
    first = [x for x in plan.splitlines() if "Aggregate(" in x and "partial_min(ord" in x]
    assert len(first) == 1 and "HashAggregate(" in first[0]


@pytest.mark.parametrize("name", ["purchase_per_batch", "upsert_last_in_first_batch", "row_ordinal"])
def test_results_do_not_depend_on_the_number_of_partitions(spark, folder, name):
    from stockyard.registry.core import forget_staged

    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        forget_staged()
        results.append(rows_of(QUERIES[name](spark, folder)))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    forget_staged()
    assert results[0] == results[1]


def test_a_hot_supplier_and_equal_rows(spark, folder, tmp_path):
    """Two thirds of the feed are copies of one line; sums follow the copies."""
    source = Tables(spark, folder)
    lines = source.table("lineitem")
    one = lines.orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(1)
    count = lines.count()
    copies = one.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(2 * count)))).drop("_n")
    hot = str(tmp_path)
    lines.unionByName(copies).write.parquet(f"{hot}/lineitem.parquet")
    for name in ("part", "supplier"):
        source.table(name).write.parquet(f"{hot}/{name}.parquet")

    placed = Tables(spark, hot).ordered
    assert placed.agg(F.count_distinct("ord"), F.max("ord")).first() == (3 * count, 3 * count - 1)
    back = placed.groupBy(*KEYS).count()
    assert back.agg(F.sum("count"), F.max("count")).first()[0] == 3 * count

    key = one.first().l_suppkey
    before = {r.supplier_id: r for r in QUERIES["purchase_per_supplier"](spark, folder).collect()}
    after = {r.supplier_id: r for r in QUERIES["purchase_per_supplier"](spark, hot).collect()}
    assert set(after) >= set(before)
    for supplier_id, header in before.items():
        if supplier_id != key:
            assert after[supplier_id] == header


def test_numbering_windows_run_over_part_sizes_only(spark):
    """The staging jobs themselves: rows enter no window, and no exchange to one task."""
    from stockyard.operators import ordinals

    seen = []
    real = ordinals.stage

    def spy(df, name):
        seen.append((name, plan_of(df)))
        return real(df, name)

    ordinals.stage = spy
    try:
        ordinals.with_ordinal(spark.range(1000), ["id"], name="ord").collect()
    finally:
        ordinals.stage = real
    (_, rows), (_, starts) = seen
    assert "SinglePartition" not in rows and "Window" not in rows
    above = starts.split("SinglePartition")[0]
    assert "Window [sum(_rows" in above and "HashAggregate(keys=[_part" in starts


def test_hot_and_missing_keys_are_split_in_a_lookup_without_broadcast(spark):
    """A third of the rows share one code and a third have none."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
    }
    old = {k: spark.conf.get(k) for k in settings}
    row = F.col("id")
    code = F.when(row % 3 == 0, F.lit("hot")).when(row % 3 == 2, (row % 5000).cast("string"))
    feed = spark.range(600_000).select(
        row.alias("ord"), code.alias("item_code"), F.repeat(row.cast("string"), 4).alias("pad")
    )
    products = spark.range(5000).select(
        (row + 1).alias("id"), F.when(row == 3, "hot").otherwise(row.cast("string")).alias("code")
    )
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = lookups.with_product_id(feed, products, spread_by=["ord"])
        by_rest = found.groupBy(F.col("product_id") % 7).agg(F.count("*"), F.max("pad"))
        assert sum(r[1] for r in by_rest.collect()) == 600_000
        plan = plan_of(by_rest)
        counts = found.agg(F.count("*"), F.count("item_code"), F.count("product_id")).first()
        joined = [x for x in plan.splitlines() if "SortMergeJoin" in x]
        assert joined and all("[_key" in x for x in joined)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert "skew=true" in plan
    missing = sum(1 for i in range(2, 600_000, 3) if i % 5000 == 3)
    assert tuple(counts) == (600_000, 400_000, 400_000 - missing)


def test_a_hot_supplier_name_is_split_in_a_lookup_without_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
    }
    old = {k: spark.conf.get(k) for k in settings}
    row = F.col("id")
    name = F.when(row % 2 == 0, F.lit("hot")).otherwise((row % 3000).cast("string"))
    feed = spark.range(500_000).select(row.alias("ord"), name.alias("supplier_name"), F.repeat(row.cast("string"), 4).alias("pad"))
    suppliers = spark.range(3000).select((row + 1).alias("id"), F.when(row == 4, "hot").otherwise(row.cast("string")).alias("name"))
    suppliers = suppliers.unionByName(suppliers.withColumn("id", row + 90_000))
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = lookups.with_supplier_or_default(feed, suppliers, "supplier_name", 786, "none", ["ord"])
        by_rest = found.groupBy("supplier_known").agg(F.count("*").alias("n"), F.min("supplier_id"), F.max("pad"))
        counts = {r.supplier_known: r.n for r in by_rest.collect()}
        plan = plan_of(by_rest)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert "skew=true" in plan
    assert counts == {True: 500_000}


def test_a_cell_is_parsed_a_few_times_only(spark):
    from stockyard.functions import dates

    cells = spark.range(10).select(F.col("id").cast("string").alias("x"))
    for form in (dates.strict_expiry, dates.clamped_expiry):
        plan = cells.select(form(F.col("x")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"gettimestamp|try_to_date|as date\)|as timestamp_ntz", plan)) <= 4


def test_line_totals_put_nothing_in_order(spark, folder):
    from stockyard.registry import core

    core.forget_staged()
    assert QUERIES["line_totals"](spark, folder).count() > 0
    assert not core._STAGED


def test_the_first_row_of_a_key_is_found_without_sorting_the_feed(spark, folder):
    feed = Tables(spark, folder).ordered
    columns = ["item_name", "item_cost_price"]
    found = cleaning.keep_first(feed, "item_code", ["ord"], columns)
    first = [x for x in plan_of(found).splitlines() if "Aggregate(" in x][-1]
    assert "HashAggregate(" in first and "partial_min(ord" in first
    own = feed.groupBy("item_code").agg(F.min("ord").alias("ord")).join(feed.withColumnRenamed("item_code", "c"), "ord")
    assert rows_of(found) == rows_of(own, "item_code", *columns)


def test_what_only_sorts_the_feed_is_not_staged(spark, folder):
    from stockyard.operators.ordinals import with_ordinal

    rows = spark.range(50).selectExpr("id % 7 AS a", "id AS mark")
    placed = with_ordinal(rows, ["a", "mark"], only_sorted_by=["mark"])
    assert placed.columns == ["a", "ord"]
    assert rows_of(placed) == [(a, i) for i, a in enumerate(sorted(x % 7 for x in range(50)))]
    assert "source_path" not in plan_of(Tables(spark, folder).ordered)


def test_supplier_items_are_looked_up_by_the_columns_they_are_made_of(spark, folder, monkeypatch):
    from stockyard.plans import supplier

    seen, real = [], lookups.with_product_id
    monkeypatch.setattr(supplier.lookups, "with_product_id", lambda feed, *more: seen.append(feed.columns) or real(feed, *more))
    source = Tables(spark, folder)
    none = source.table("region").select(F.lit(0).cast("bigint").alias("id"))
    supplier.supplier_import(source.ordered, source.view("catalogue"), none, none, RUN_TIME, code_digits=12)
    assert not {*KEYS, "raw_code", "supplier_name", "total_sale", "item_total_cost_text"} & set(seen[0])


def test_category_rows_are_parsed_once(spark, folder, monkeypatch):
    from stockyard.plans import category
    from stockyard.registry.core import CATEGORIES
    from stockyard.registry.imports import _category_feed

    seen, real = [], category.stage
    monkeypatch.setattr(category, "stage", lambda df, name: seen.append((name, plan_of(df))) or real(df, name))
    source = Tables(spark, folder)
    none = source.table("region").select(F.lit(0).cast("bigint").alias("id"))
    category.category_import(
        _category_feed(source), source.view("catalogue"), source.view("known_suppliers"),
        source.view("known_groups"), none, none, RUN_TIME, rule=CATEGORIES,
    )
    assert [name for name, plan in seen if "not a number" in plan] == ["rows"]


def test_purchases_written_twice_are_totalled_once(spark, folder, monkeypatch):
    from stockyard.registry import control

    written, real = [], control.append_run
    monkeypatch.setattr(control, "append_run", lambda tables, *x: written.append(tables) or real(tables, *x))
    control.append_tables(Tables(spark, folder))
    assert [sorted(t) for t in written] == [["inventory_movements", "purchase_items", "purchases"], ["purchases"]]
    assert all("Aggregate" not in plan_of(t["purchases"]) for t in written)


def _shuffle_files(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(1 for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_"))


def test_a_staged_table_leaves_no_shuffle_files(spark):
    from stockyard.staging import stage

    before = _shuffle_files(spark)
    staged = stage(spark.range(1000).repartition(3, "id"), "numbers")
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    assert staged.count() == 1000


def test_supplier_items_are_not_moved_for_their_orders(spark, folder, monkeypatch):
    """Links whose size is known are sent to the items; the plan of an aggregate promises no size."""
    from stockyard.plans import supplier

    seen, real = {}, supplier.stage
    monkeypatch.setattr(supplier, "stage", lambda df, name: seen.setdefault(name, plan_of(df)) and real(df, name))
    source = Tables(spark, folder)
    none = source.table("region").select(F.lit(0).cast("bigint").alias("id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        supplier.supplier_import(source.ordered, source.view("catalogue"), none, none, RUN_TIME, code_digits=12)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = next(x for x in seen["posted"].splitlines() if "Join [supplier_id" in x and "Inner" in x)
    assert "BroadcastHashJoin" in join


def test_a_text_key_is_moved_once_in_a_lookup(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        feed = spark.createDataFrame([(0, "a"), (1, None), (2, ""), (3, "=b"), (4, "#c")], "ord long, code string")
        stored = spark.createDataFrame([("a", 1), ("", 2), ("=b", 3)], "code string, id int")
        for spread in ([], ["ord"]):
            found = lookups.look_up(feed, stored, "code", ["id"], spread)
            assert found.columns == ["ord", "code", "id"]
            assert rows_of(found) == [(0, "a", 1), (1, None, None), (2, "", 2), (3, "=b", 3), (4, "#c", None)]
        moved = found._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)[1].splitlines()[1]
        assert "_key" in moved and re.search(r"\bcode#\d+,", moved) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_category_rows_are_staged_without_what_follows_from_them(spark, folder, monkeypatch):
    from stockyard.plans import category
    from stockyard.registry.core import CATEGORIES
    from stockyard.registry.imports import _category_feed

    seen, real, order = {}, category.stage, []
    monkeypatch.setattr(category, "stage", lambda df, name: order.append(name) or seen.update({name: df.columns}) or real(df, name))
    source = Tables(spark, folder)
    none = source.table("region").select(F.lit(0).cast("bigint").alias("id"))
    tables = category.category_import(
        _category_feed(source), source.view("catalogue"), source.view("known_suppliers"),
        source.view("known_groups"), none, none, RUN_TIME, rule=CATEGORIES, parsed=lambda: order.append("parsed"),
    )
    derived = {"item_total_vat", "item_total_after_vat", "total_sale_vat", "total_sale", "batch_id"}
    assert not derived & {*seen["rows"], *seen["posted"]}
    assert order[:2] == ["rows", "parsed"]
    taxed = F.col("main_net") - F.col("subtotal") - F.col("item_tax")
    assert tables["purchase_items"].agg(F.max(F.abs(taxed)), F.max("item_tax") > 0).first() == (0, True)


def test_the_barcode_file_goes_once_it_is_parsed(spark, folder):
    from stockyard.staging import shared_folder

    rows = QUERIES["barcode_import"](spark, folder)
    assert rows.count() == QUERIES["category_import"](spark, folder).count()
    assert not [x for x in os.listdir(f"{shared_folder(spark)}/stockyard") if x.startswith("barcode-")]


def test_the_feed_is_moved_before_its_columns_are_derived(spark, folder):
    feed = Tables(spark, folder).laid_out(lambda rows: rows.orderBy("ord"))
    plan = plan_of(feed.select("item_batch_number", "item_total_cost_text"))
    assert "concat(B" in plan and "concat(B" not in plan.split("Exchange rangepartitioning")[1]
