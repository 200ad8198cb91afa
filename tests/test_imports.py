"""Whole imports against row-by-row brute force on a small dirty feed."""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import replace
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from stockyard import jobs, settings
from stockyard.plans import catalogue, category, standard, supplier
from stockyard.sources import layouts, store

AT = datetime(2025, 6, 1, 8, 0)
EXPIRIES = {
    None: None,
    "2027-03-01": date(2027, 3, 1),
    "2999-12-31": date(2999, 12, 31),
    "2028-01-02 00:00:00": date(2028, 1, 2),
    "n/a": "bad",
}


def five(value) -> Decimal:
    return Decimal(value).quantize(Decimal("0.00001"), ROUND_HALF_UP)


def standard_rows(count=230, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        code = "hot" if rng.random() < 1 / 3 else str(rng.randrange(40))
        quantity, sale, cost = rng.randrange(1, 9), rng.randrange(100, 999), rng.randrange(50, 99)
        vat = rng.choice([0, 5, 15])
        missing = 90 <= i < 100 and i % 4 == 0
        rows.append(
            {
                "item_code": code,
                "item_name": f"name {i}",
                "item_batch_number": f"B{i % 7}",
                "item_ascon_code": f"a{i}",
                "item_expiry_date": rng.choice(list(EXPIRIES)),
                "item_quantity": str(quantity),
                "item_sale_price": str(sale),
                "item_total_sale_price": None if missing else str(sale * quantity),
                "item_purchase_price": str(cost - 1),
                "item_total_purchase_price": str((cost - 1) * quantity),
                "item_cost_price": str(cost),
                "item_total_cost_price": str(cost * quantity),
                "vat_value": str(vat),
                "item_total_vat": str(Decimal(cost * quantity * vat) / 100),
                "item_total_after_vat": str(cost * quantity + Decimal(cost * quantity * vat) / 100),
            }
        )
    return rows


def text_frame(spark, rows, layout):
    schema = ", ".join(["ord long", *[f"`{c}` string" for c in layout]])
    data = [(i, *[r[c] for c in layout]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="module")
def posted(spark):
    rows = standard_rows()
    feed = layouts.typed(text_frame(spark, rows, layouts.STANDARD))
    products = spark.createDataFrame([(10 + n, str(n)) for n in range(0, 40, 3)], "id long, code string")
    empty = spark.createDataFrame([], "id long")
    last = spark.createDataFrame([(500,)], "id long")
    posting = replace(settings.STANDARD, batch_rows=30)
    return rows, standard.standard_import(feed, products, last, empty, AT, posting)


def test_standard_headers(posted):
    rows, tables = posted
    expected = []
    for b in range(0, len(rows), 30):
        batch = rows[b : b + 30]
        if any(r["item_total_sale_price"] is None for r in batch):
            continue

        def total(column):
            return sum(Decimal(r[column]) for r in batch)

        dropped = sum(EXPIRIES[r["item_expiry_date"]] == "bad" for r in batch)
        expected.append(
            (
                501 + b // 30,
                five(total("item_total_cost_price")),
                five(total("item_total_sale_price")),
                five(total("item_total_vat")),
                five(total("item_total_after_vat")),
                dropped,
                686,
                AT,
            )
        )
    assert len(expected) == 7
    found = rows_of(
        tables["purchases"],
        "id", "total", "total_sale", "total_tax", "grand_total", "items_dropped", "supplier_id", "date",
    )
    assert found == expected


def kept(rows):
    refused = {i // 30 for i, r in enumerate(rows) if r["item_total_sale_price"] is None}
    return [
        (i, r)
        for i, r in enumerate(rows)
        if i // 30 not in refused and EXPIRIES[r["item_expiry_date"]] != "bad"
    ]


def test_standard_items_and_movements(posted):
    rows, tables = posted
    ids = dict(rows_of(tables["products"], "code", "id"))
    ids |= {str(n): 10 + n for n in range(0, 40, 3)}
    expected = [
        (i, 501 + i // 30, ids[r["item_code"]], r["item_code"], EXPIRIES[r["item_expiry_date"]],
         five(r["item_quantity"]), five(r["item_purchase_price"]), f"a{i}")
        for i, r in kept(rows)
    ]
    assert rows_of(
        tables["purchase_items"],
        "ord", "purchase_id", "product_id", "product_code", "expiry", "quantity",
        "real_unit_cost", "avz_item_code",
    ) == expected
    moves = tables["inventory_movements"]
    assert moves.count() == 3 * len(expected)
    balance = moves.filter("type <> 'purchase'").groupBy("ord").agg(F.sum("quantity").alias("q"))
    assert balance.filter("q <> 0").count() == 0
    places = moves.select("type", "location_id").distinct()
    assert rows_of(places) == [("purchase", 32), ("transfer_in", 42), ("transfer_out", 32)]
    assert rows_of(moves.filter("type = 'transfer_in'"), "reference_id")[0] == (1,)


def test_standard_transfer_and_quarantine(posted):
    rows, tables = posted
    header = tables["transfers"].filter("id = 1").first()
    batch = rows[:30]
    sale = sum(Decimal(r["item_total_sale_price"]) for r in batch)
    vat = sum(Decimal(r["item_total_sale_price"]) * Decimal(r["vat_value"]) for r in batch)
    assert (header.total, header.total_tax, header.grand_total) == (five(sale), five(vat), five(sale + vat))
    left = tables["quarantine"]
    refused = left.filter("left_out_as = 'batch refused'")
    assert rows_of(refused, "ord") == [(i,) for i in range(90, 120)]
    undated = {r.ord for r in left.filter("left_out_as = 'no date'").collect()}
    assert undated == {i for i in range(len(rows)) if not 90 <= i < 120
                       and EXPIRIES[rows[i]["item_expiry_date"]] == "bad"}
    log = rows_of(tables["run_log"], "batch_id", "status", "reason")
    assert log[3] == (3, "failed", "item_total_sale_price") and log[2][1] == "completed"
    report = tables["report"].collect()
    assert report[-1].id is None and report[-1].total_items == len(kept(rows))


def test_products_of_a_refused_batch_are_registered(posted):
    rows, tables = posted
    known = {str(n) for n in range(0, 40, 3)}
    unknown = {r["item_code"] for r in rows} - known
    assert {r.code for r in tables["products"].collect()} == unknown
    assert sorted(r.id for r in tables["products"].collect()) == list(range(50, 50 + len(unknown)))


def supplier_rows(count=200, seed=9):
    rng = random.Random(seed)
    return [
        {
            "item_code": None if i % 17 == 0 else str(rng.randrange(30)),
            "item_name": None if i % 13 == 0 else f"name {i}",
            "item_batch_number": None if i % 11 == 0 else "B",
            "item_expiry_date": rng.choice(list(EXPIRIES)),
            "item_quantity": str(rng.randrange(1, 9)),
            "item_purchase_price": "9.5",
            "vat_value": rng.choice(["5", "15"]),
            "item_cost_price": f"{rng.randrange(100, 999)}.25",
            "item_sale_price": None if i % 7 == 0 else f"{rng.randrange(100, 999)}.5",
            "supplier_id": None if i % 19 == 0 else str(7 if rng.random() < 1 / 3 else rng.randrange(5)),
            "supplier_name": f"S{i}",
        }
        for i in range(count)
    ]


def test_a_supplier_with_an_item_without_a_price_is_refused(spark):
    rows = supplier_rows()
    feed = layouts.typed(text_frame(spark, rows, layouts.SUPPLIER))
    none = spark.createDataFrame([], "id long")
    products = spark.createDataFrame([], "id long, code string")
    tables = supplier.supplier_import(feed, products, none, none, AT)
    reason = {}
    faulty = {
        r["supplier_id"] for r in rows
        if r["item_code"] and r["supplier_id"] and r["item_sale_price"] is None
    }
    for i, r in enumerate(rows):
        if r["item_code"] is None:
            reason[i] = "no code"
        elif r["supplier_id"] is None:
            reason[i] = "no supplier"
        elif r["supplier_id"] in faulty:
            reason[i] = "supplier refused"
    assert dict(rows_of(tables["quarantine"], "ord", "left_out_as")) == reason
    assert tables["purchase_items"].count() == len(rows) - len(reason)
    failed = {str(r.batch_id) for r in tables["run_log"].filter("status = 'failed'").collect()}
    assert failed == faulty


def test_supplier_import(spark):
    rows = supplier_rows()
    feed = layouts.typed(text_frame(spark, rows, layouts.SUPPLIER))
    products = spark.createDataFrame([(3, "1")], "id long, code string")
    purchases = spark.createDataFrame([(40,)], "id long")
    orders = spark.createDataFrame([(90,)], "id long")
    tables = supplier.supplier_import(feed, products, purchases, orders, AT, required=())

    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if r["item_code"] is not None and r["supplier_id"] is not None:
            groups[int(r["supplier_id"])].append((i, r))
    expected = []
    for place, key in enumerate(sorted(groups)):
        members = [r for _, r in groups[key]]
        cost = [Decimal(r["item_cost_price"]) * Decimal(r["item_quantity"]) for r in members]
        vat = [c * Decimal(r["vat_value"]) / 100 for c, r in zip(cost, members)]
        sale = [
            Decimal(r["item_sale_price"]) * Decimal(r["item_quantity"])
            for r in members
            if r["item_sale_price"]
        ]
        expected.append(
            (41 + place, key, members[0]["supplier_name"], five(sum(cost)), five(sum(sale)),
             five(sum(vat)), five(sum(cost) + sum(vat)))
        )
    assert rows_of(
        tables["purchases"], "id", "supplier_id", "supplier", "total", "total_sale", "total_tax", "grand_total"
    ) == expected
    assert rows_of(tables["purchase_orders"], "id", "purchase_id", "status") == [
        (91 + p, 41 + p, "pending") for p in range(len(groups))
    ]
    items = tables["purchase_items"].collect()
    assert len(items) == sum(map(len, groups.values()))
    assert len({r.avz_item_code for r in items}) == len(items)
    by_ord = {r.ord: r for r in items}
    for place, key in enumerate(sorted(groups)):
        for i, r in groups[key]:
            item = by_ord[i]
            assert (item.purchase_id, item.order_id) == (41 + place, 91 + place)
            late = r["item_expiry_date"] == "2999-12-31"
            parsed = EXPIRIES[r["item_expiry_date"]]
            assert item.expiry == (date(2262, 12, 31) if late else None if parsed == "bad" else parsed)
            assert item.product_name == (r["item_name"] or "empty product")
            assert item.batchno == (r["item_batch_number"] or "AAA")
    report = tables["report"].collect()
    assert report[-1].total_items == len(items)


def category_feed(spark, count=150):
    rng = random.Random(2)
    rows = []
    for i in range(count):
        row = dict.fromkeys(layouts.CATEGORY)
        row |= {
            "item_code": f" {rng.randrange(30)} ,{i}",
            "item_name": f"name {i}",
            "item_quantity": "2",
            "item_sale_price": "1,500.50",
            "item_cost_price": "1,000",
            "item_purchase_price": "900",
            "item_total_sale_price": "3,001.00",
            "item_total_cost_price": "2,000.00",
            "item_expiry_date": rng.choice(list(EXPIRIES)),
            "supplier": rng.choice(["s1", "s2", None]),
            "category": rng.choice(["TOOLS WITH VAT", "FOOD", None]),
            "group": rng.choice([" g1 ", "g2", None]),
        }
        rows.append(row)
    return rows, layouts.typed(
        text_frame(spark, rows, layouts.CATEGORY), keep_text=category.GROUPED_NUMBERS
    )


def test_category_metadata_and_import(spark):
    rows, feed = category_feed(spark)
    suppliers = spark.createDataFrame([(5, "s1")], "id long, name string")
    categories = spark.createDataFrame([(1, "FOOD", 0)], "id long, name string, parent_id long")
    metadata = category.category_metadata(feed, suppliers, categories)
    assert rows_of(metadata["suppliers"], "id", "name", "group_id") == [(6, "s2", 4)]
    found = rows_of(metadata["categories"], "id", "name", "parent_id", "slug")
    assert found == [
        (2, "TOOLS WITH VAT", 0, "tools-with-vat"),
        (3, "g1", 1, "g1"), (4, "g2", 1, "g2"), (5, "g1", 2, "g1"), (6, "g2", 2, "g2"),
    ]

    empty = spark.createDataFrame([], "id long")
    products = spark.createDataFrame([(1, "0")], "id long, code string")
    posting = replace(settings.CATEGORY, batch_rows=40)
    tables = category.category_import(
        feed, products, suppliers, categories, empty, empty, AT, posting
    )
    expected = []
    for b in range(0, len(rows), 40):
        batch = rows[b : b + 40]
        taxed = sum(r["category"] == "TOOLS WITH VAT" for r in batch)
        name = batch[-1]["supplier"]
        supplier_of = (5, "s1") if name == "s1" else (786, "Internal supplier")
        expected.append(
            (1 + b // 40, *supplier_of, 2000 * len(batch), 300 * taxed, 3001 * len(batch))
        )
    assert rows_of(
        tables["purchases"], "id", "supplier_id", "supplier", "total", "total_tax", "grand_total"
    ) == expected
    good = sum(EXPIRIES[r["item_expiry_date"]] != "bad" for r in rows)
    assert tables["purchase_items"].count() == tables["inventory_movements"].count() == good
    assert tables["inventory_movements"].select("type").distinct().collect()[0][0] == "purchase"
    codes = {r["item_code"].split(",")[0].strip() for r in rows} - {"0"}
    assert {r.code for r in tables["products"].collect()} == codes


def test_category_file_with_a_bad_number_is_refused(spark):
    rows, _ = category_feed(spark, 5)
    rows[3]["item_cost_price"] = "12 pounds"
    feed = layouts.typed(
        text_frame(spark, rows, layouts.CATEGORY), keep_text=category.GROUPED_NUMBERS
    )
    suppliers = spark.createDataFrame([], "id long, name string")
    categories = spark.createDataFrame([], "id long, name string, parent_id long")
    empty = spark.createDataFrame([], "id long")
    products = spark.createDataFrame([], "id long, code string")
    with pytest.raises(Exception, match="not a number: 12 pounds"):
        category.category_import(feed, products, suppliers, categories, empty, empty, AT)[
            "purchase_items"
        ].collect()


def test_priced_products(spark):
    rows = supplier_rows()
    feed = layouts.typed(text_frame(spark, rows, layouts.SUPPLIER))
    products = spark.createDataFrame(
        [(1, "3", "other", Decimal("1.00"))], "id long, code string, name string, cost decimal(18,6)"
    )
    result = catalogue.register_priced_products(feed, products, list(layouts.SUPPLIER))
    codes = {r["item_code"] for r in rows if r["item_code"]}
    assert {r.code for r in result["products"].collect()} == codes - {"3"}
    compared = result["comparison"].collect()
    first = next(r for r in rows if r["item_code"] == "3")
    assert [(r.code, r.file_cost, r.cost_differs) for r in compared] == [
        ("3", Decimal(first["item_cost_price"]), True)
    ]
    counters = result["counters"].first()
    assert (counters.rows_loaded, counters.codes_unique) == (200, len(codes))
    assert (counters.codes_existing, counters.codes_inserted) == (1, len(codes) - 1)


def test_an_unreadable_code_refuses_its_batch_of_priced_products(spark):
    rows = [{**r, "item_code": f"{i}.0"} for i, r in enumerate(supplier_rows(60))]
    rows[25]["item_code"] = "x1"
    rows[41]["item_code"] = None
    feed = layouts.typed(text_frame(spark, rows, layouts.SUPPLIER))
    products = spark.createDataFrame([], "id long, code string, name string, cost decimal(18,6)")
    result = catalogue.register_priced_products(
        feed, products, list(layouts.SUPPLIER), batch_rows=20
    )
    expected = {str(i) for i in range(60)} - {str(i) for i in range(20, 40)} - {"41"}
    assert {r.code for r in result["products"].collect()} == expected
    assert result["quarantine"].count() == 20
    assert rows_of(result["run_log"], "batch_id", "status") == [
        (0, "completed"), (1, "failed"), (2, "completed"),
    ]


def write_csv(path, rows, layout):
    lines = [",".join(f"h{i}" for i in range(len(layout)))]
    lines += [",".join(f'"{r[c]}"' if r[c] is not None else "" for c in layout) for r in rows]
    path.write_text("\n".join(lines) + "\n")


def test_jobs_run_from_files_and_can_be_repeated(spark, tmp_path):
    root = str(tmp_path / "store")
    standard_file, supplier_file = tmp_path / "standard.csv", tmp_path / "supplier.csv"
    rows = [r for r in standard_rows() if r["item_total_sale_price"]]
    write_csv(standard_file, rows, layouts.STANDARD)
    write_csv(supplier_file, supplier_rows(), layouts.SUPPLIER)

    def job(name, feed, run_id, *more):
        args = jobs.parser().parse_args(
            [name, "--feed", str(feed), "--store", root, "--run-id", run_id,
             "--at", "2025-06-01T08:00:00", *more]
        )
        jobs.run(spark, args)

    def table(name):
        return store.read_runs(spark, root, name)

    job("standard", standard_file, "r1")
    first = rows_of(table("purchases"), "id", "total", "grand_total")
    job("standard", standard_file, "r1")
    assert rows_of(table("purchases"), "id", "total", "grand_total") == first == [first[0]]
    good = sum(EXPIRIES[r["item_expiry_date"]] != "bad" for r in rows)
    assert table("inventory_movements").count() == 3 * good

    job("supplier", supplier_file, "r2", "--catalogue", f"{root}/products/run_id=r1")
    ids = [r.id for r in table("purchases").filter("run_id = 'r2'").collect()]
    assert sorted(ids) == list(range(2, 2 + len(ids)))
    codes = [r.code for r in table("products").collect()]
    assert len(codes) == len(set(codes))

    priced = [{**r, "item_code": f"9{i}.0"} for i, r in enumerate(supplier_rows(50))]
    write_csv(tmp_path / "priced.csv", priced, layouts.SUPPLIER)
    job("priced-products", tmp_path / "priced.csv", "r3", "--catalogue", f"{root}/products")
    job("priced-products", tmp_path / "priced.csv", "r3", "--catalogue", f"{root}/products")
    products = table("products").collect()
    assert [r for r in products if r.run_id == "r3"]
    assert len({r.code for r in products}) == len(products)
    assert {r.tax_rate for r in products if r.run_id == "r1"} == {Decimal(1)}

    sheet = tmp_path / "images.csv"
    sheet.write_text("product_code,image_url\nhot,http://a\nhot,http://b\nnope,http://c\n")
    job("images", sheet, "v1", "--catalogue", f"{root}/products/run_id=r1")
    catalogue_v1 = store.read_latest(spark, f"{root}/catalogue")
    assert catalogue_v1.filter("image_url_new IS NOT NULL").first().image_url_new == "http://b"
    counters = spark.read.option("header", True).csv(f"{root}/reports/counters-v1").first()
    assert tuple(counters) == ("3", "2", "1")
