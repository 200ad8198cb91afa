"""Operators on small tables against hand-made or brute-force results."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from stockyard.operators import (
    acceptance,
    cleaning,
    lookups,
    ordinals,
    registration,
    reporting,
    updates,
)
from stockyard.sources import layouts
from stockyard.sources.delimited import scan_positional


def test_drop_all_null_and_keys(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (3, None, "b")], "n int, x string, y string")
    assert rows_of(cleaning.drop_all_null(df, ["x", "y"]), "n") == [(2,), (3,)]
    assert rows_of(cleaning.drop_null_key(df, "x"), "n") == [(2,)]


def test_keep_first_and_last_take_null_as_one_key(spark):
    df = spark.createDataFrame(
        [("a", 2, None), ("a", 1, "x"), (None, 4, "p"), (None, 3, "q")], "k string, ord int, v string"
    )
    assert rows_of(cleaning.keep_first(df, "k", ["ord"])) == [("a", 1, "x"), (None, 3, "q")]
    assert rows_of(cleaning.keep_last(df, "k", ["ord"])) == [("a", 2, None), (None, 4, "p")]


def test_members_and_complement_split_the_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    table = spark.createDataFrame([("a",), ("z",)], "k string")
    for values in (["a", "z"], table):
        assert rows_of(cleaning.members(df, "k", values)) == [("a",)]
        assert rows_of(cleaning.non_members(df, "k", values)) == [("b",), (None,)]


def skewed(spark, rows=4000, seed=3):
    """A third of the rows share one key, a third of them are equal in every sort key."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        hot = rng.random() < 1 / 3
        data.append((0 if hot else rng.randrange(50), 0 if hot else rng.randrange(20), i))
    return data, spark.createDataFrame(data, "a int, b int, i int").repartition(5, "i")


@pytest.mark.parametrize("partitions", [1, 7])
def test_ordinal_is_the_sorted_position(spark, partitions):
    data, df = skewed(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = ordinals.with_ordinal(df, ["a", "b", "i"])
        placed = {r.ord: (r.a, r.b, r.i) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert placed == dict(enumerate(sorted(data)))


def test_any_number_of_sort_partitions_gives_the_same_positions(spark):
    data, df = skewed(spark)
    found = ordinals.with_ordinal(df, ["a", "b", "i"], partitions=23)
    assert {r.ord: (r.a, r.b, r.i) for r in found.collect()} == dict(enumerate(sorted(data)))


def test_ordinal_with_equal_keys_is_dense(spark):
    data, df = skewed(spark)
    found = ordinals.with_ordinal(df, ["a", "b"])
    rows = sorted((r.ord, r.a, r.b) for r in found.collect())
    assert [r[0] for r in rows] == list(range(len(data)))
    assert [r[1:] for r in rows] == sorted(d[:2] for d in data)


def test_file_ordinal_follows_files_and_splits(spark, tmp_path):
    files = {"b.csv": 300, "a.csv": 2000, "c.csv": 1}
    for name, count in files.items():
        lines = [f"{name}-{i},u" for i in range(count)]
        (tmp_path / name).write_text("\n".join(["code,url", *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        whole = scan_positional(spark, str(tmp_path), layouts.IMAGE, ordinal=True)
        found = {r.ord: r.product_code for r in whole.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = [f"{n}-{i}" for n in sorted(files) for i in range(files[n])]
    assert found == dict(enumerate(expected))


def test_batches_cover_the_rows(spark):
    df = ordinals.with_batch(spark.range(2501).withColumnRenamed("id", "ord"))
    assert rows_of(df.groupBy("batch_id").count()) == [(0, 1000), (1, 1000), (2, 501)]


def test_new_ids_follow_the_stored_ones(spark):
    names = spark.createDataFrame([("c",), ("a",), ("b",)], "name string")
    stored = spark.createDataFrame([(7,), (3,)], "id long")
    assert rows_of(ordinals.with_new_ids(names, stored, ["name"])) == [(8, "a"), (9, "b"), (10, "c")]
    empty = spark.createDataFrame([], "id long")
    assert rows_of(ordinals.with_new_ids(names, empty, ["name"]), "id") == [(1,), (2,), (3,)]


def test_item_codes_run_out_with_an_error(spark):
    rows = spark.range(90).withColumnRenamed("id", "ord")
    codes = [r.avz_item_code for r in ordinals.with_item_code(rows, digits=2).collect()]
    assert sorted(codes) == [str(n) for n in range(10, 100)]
    with pytest.raises(Exception, match="codes of 2 digits are used"):
        ordinals.with_item_code(rows, digits=2, used=1).collect()


def test_look_up_keeps_every_row(spark):
    feed = spark.createDataFrame(
        [(i, None if i % 3 == 0 else str(i % 5)) for i in range(300)], "ord int, code string"
    )
    stored = spark.createDataFrame([("1", 10), ("2", 20), (None, 99)], "code string, id int")
    spread = lookups.look_up(feed, stored, "code", ["id"], spread_by=["ord"])
    known = {"1": 10, "2": 20}
    expected = [
        (None if i % 3 == 0 else str(i % 5), i, None if i % 3 == 0 else known.get(str(i % 5)))
        for i in range(300)
    ]
    assert sorted(rows_of(spread, "code", "ord", "id"), key=lambda r: r[1]) == expected


def test_supplier_or_default(spark):
    feed = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "ord int, supplier string")
    stored = spark.createDataFrame([(5, "a"), (4, "a"), (9, "b")], "id long, name string")
    found = lookups.with_supplier_or_default(feed, stored, "supplier", 786, "Internal supplier")
    assert rows_of(found, "ord", "supplier_id", "supplier_name") == [
        (1, 4, "a"),
        (2, 786, "Internal supplier"),
        (3, 786, "Internal supplier"),
    ]


def upserts(rows, known):
    """Brute force of the standard flow: batches in order, one row after the other."""
    stored, table = set(known), {}
    for batch in sorted({r[0] for r in rows}):
        in_batch = [r for r in rows if r[0] == batch]
        unknown = [r for r in in_batch if r[2] is not None and r[2] not in stored]
        for _, _, code, name, cost in unknown:
            table[code] = (name, cost)
        stored |= {r[2] for r in unknown}
    return sorted((code, *values) for code, values in table.items())


def test_first_batch_decides_and_its_last_row_wins(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        code = None if rng.random() < 0.1 else ("hot" if rng.random() < 0.3 else str(rng.randrange(80)))
        rows.append((i // 50, i, code, f"n{i}", Decimal(i)))
    df = spark.createDataFrame(
        [(*r, None) for r in rows],
        "batch_id long, ord long, item_code string, item_name string,"
        " item_cost_price decimal(12,2), item_sale_price decimal(12,2)",
    )
    known = [str(n) for n in range(0, 80, 7)]
    products = spark.createDataFrame([(k,) for k in known], "code string")
    found = registration.products_last_in_first_batch(df, products)
    assert rows_of(found, "code", "name", "cost") == upserts(rows, known)


def test_registering_twice_adds_nothing(spark):
    feed = spark.createDataFrame(
        [(0, "7.0", "a"), (1, "7", "b"), (2, "8", "c"), (3, None, "d")],
        "ord long, item_code string, item_name string",
    ).withColumns(
        {
            "item_cost_price": F.lit(None).cast("decimal(12,2)"),
            "item_sale_price": F.lit(3).cast("decimal(12,2)"),
        }
    )
    none = spark.createDataFrame([], "code string")
    first = registration.products_priced(feed, none, ["ord"])
    assert rows_of(first, "code", "name", "cost", "tax_rate") == [("7", "a", 0, 5), ("8", "c", 0, 5)]
    again = registration.products_priced(feed, first.select("code"), ["ord"])
    assert again.count() == 0


def test_subcategories_are_matched_as_pairs(spark):
    feed = spark.createDataFrame(
        [("A", " g "), ("B", "g"), ("A", None), ("Z", "g"), (None, "g"), ("A", "h"), ("A", "g")],
        "category string, item_group string",
    )
    stored = spark.createDataFrame(
        [(1, "A", 0), (2, "B", 0), (3, "g", 2)], "id long, name string, parent_id long"
    )
    found = registration.new_subcategories(feed, stored)
    assert rows_of(found, "id", "name", "parent_id") == [(4, "g", 1), (5, "h", 1)]


def test_image_update_last_row_wins_and_every_row_counts(spark):
    products = spark.createDataFrame(
        [("1", "old1"), ("2", "old2"), (None, "old3")], "code string, image_url_new string"
    )
    sheet = spark.createDataFrame(
        [(0, " 1 ", "x"), (1, "1", " y "), (2, "9", "z"), (3, None, "w"), (4, "2", None)],
        "ord int, product_code string, image_url string",
    )
    updated = updates.update_images(products, sheet)
    assert rows_of(updated) == [("1", "y"), ("2", "old2"), (None, "old3")]
    assert rows_of(updates.image_counters(products, sheet)) == [(3, 2, 1)]


def test_discount_update_writes_null_over_old_values(spark):
    products = spark.createDataFrame(
        [(1, Decimal("5"), Decimal("6")), (2, Decimal("5"), Decimal("6"))],
        "id long, cash_discount decimal(10,4), credit_discount decimal(10,4)",
    )
    sheet = spark.createDataFrame(
        [
            (0, "1", "9", "1", "1", "1", "1", "1"),
            (1, "1.0", "x", None, "2.5", "3", "1", "1"),
            (2, "1", "1", "1", "1", "99999999", "1", "1"),
            (3, "TOTAL", "1", "1", "1", "1", "1", "1"),
            (4, "77", "1", "1", "1", "1", "1", "1"),
        ],
        "ord int, " + ", ".join(f"{c} string" for c in layouts.DISCOUNT),
    )
    updated = updates.update_discounts(products, sheet)
    assert updated.count() == products.count()
    row = updated.filter("id = 1").first()
    assert row.credit_discount is None and row.credit_dis2 is None
    assert (row.credit_dis3, row.cash_discount) == (Decimal("2.5"), 3)
    kept = updated.filter("id = 2").first()
    assert (kept.cash_discount, kept.credit_discount, kept.cash_dis2) == (5, 6, None)
    assert rows_of(updates.discount_counters(products, sheet)) == [(4, 2, 1, 1)]


def test_batches_are_all_or_nothing(spark):
    df = spark.createDataFrame(
        [(0, 0, 1), (0, 1, 1), (1, 2, None), (1, 3, 1), (1, 4, None)],
        "batch_id long, ord long, amount int",
    )
    verdicts = acceptance.batch_verdicts(df, ["amount"])
    assert rows_of(verdicts) == [(0, 2, 0, None, True), (1, 3, 2, "amount", False)]
    assert rows_of(acceptance.accepted_rows(df, verdicts), "ord") == [(0,), (1,)]
    assert rows_of(acceptance.quarantined_rows(df, verdicts), "ord") == [(2,), (3,), (4,)]
    log = acceptance.run_log(verdicts, "import")
    assert rows_of(log, "batch_id", "status", "rows_posted") == [(0, "completed", 2), (1, "failed", 0)]


def test_grand_total_takes_missing_amounts_as_zero(spark):
    report = spark.createDataFrame(
        [(1, 2, Decimal(3), None, Decimal(1), Decimal(4)), (2, 1, Decimal(1), None, None, Decimal(1))],
        "id long, total_items long, total_stock decimal(25,5), total decimal(25,5),"
        " total_tax decimal(25,5), grand_total decimal(25,5)",
    ).withColumn("date", F.current_date())
    rows = reporting.with_grand_total(report).collect()
    assert [r.id for r in rows] == [1, 2, None]
    last = rows[-1]
    assert (last.total_items, last.total_stock, last.total, last.total_tax) == (3, 4, 0, 1)
    assert rows[0].total is None and last.date is None
