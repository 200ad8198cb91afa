"""Batches, headers, reports and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.measures import with_discount_backout
from stockyard.operators import cleaning, posting, registration, reporting
from stockyard.operators.ordinals import with_batch, with_new_ids
from stockyard.registry.core import KEYS, RUN_TIME, Tables, amount, amounts, query, sums
from stockyard.registry.inputs import (
    batch_purchases,
    category_rows,
    numbered_posting,
    posted_rows,
    supplier_lines,
)
from stockyard.settings import CATEGORY, STANDARD, SUPPLIER

K = ", ".join(KEYS)


@query("row_ordinal", f"SELECT {K}, ord, ord // 1000 AS batch_id FROM ordered")
def row_ordinal(t: Tables) -> DataFrame:
    return with_batch(t.ordered).select(*KEYS, "ord", "batch_id")


@query(
    "batch_split",
    """SELECT ord // 1000 AS batch_id, COUNT(*) AS batch_size, MIN(ord) AS first_ord,
    MAX(ord) AS last_ord FROM ordered GROUP BY ord // 1000""",
)
def batch_split(t: Tables) -> DataFrame:
    return with_batch(t.ordered).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
    )


_HEADER_SUMS = sums(
    total="item_total_cost_price",
    total_net_purchase="item_total_cost_price",
    total_sale="item_total_sale_price",
    total_tax="item_total_vat",
    total_items="item_quantity",
)
_HEADER = ["total", "total_net_purchase", "total_sale", "total_tax", "total_items"]
_DROPPED = """COUNT(*) AS items_read,
    COUNT(CASE WHEN NOT expiry_ok THEN 1 END) AS items_dropped"""


@query(
    "purchase_per_batch",
    f"""SELECT batch_id, 686 AS supplier_id, 'Internal Supplier' AS supplier,
    32 AS warehouse_id, 'received' AS status, {_HEADER_SUMS},
    {sums(grand_total="item_total_after_vat")}, {_DROPPED} FROM posted GROUP BY batch_id""",
)
def purchase_per_batch(t: Tables) -> DataFrame:
    totals = posting.batch_totals(posted_rows(t))
    return posting.purchases_per_batch(totals, STANDARD, RUN_TIME).select(
        "batch_id", "supplier_id", "supplier", "warehouse_id", "status", *_HEADER,
        "grand_total", "items_read", "items_dropped",
    )


_SUPPLIER_SUMS = sums(
    total="item_total_cost_price",
    total_sale="item_total_sale_price",
    total_tax="item_total_vat",
    grand_total="item_total_after_vat",
)
_BY_SUPPLIER = f"""
SELECT supplier_id, ARG_MIN(supplier_name, ROW({K})) AS supplier, COUNT(*) AS items_read,
  {_SUPPLIER_SUMS},
  CAST(CAST(SUM(COALESCE(total_sale, 0)) AS DECIMAL(25,2)) AS DOUBLE) AS transfer_total
  FROM lines WHERE supplier_id IS NOT NULL GROUP BY supplier_id
"""
_SUPPLIER = [
    "supplier_id", "supplier", "items_read", "total", "total_sale", "total_tax", "grand_total",
    "transfer_total",
]


def supplier_headers(t: Tables) -> DataFrame:
    return posting.purchases_per_supplier(supplier_lines(t), SUPPLIER, RUN_TIME, ["ord"])


@query("purchase_per_supplier", _BY_SUPPLIER)
def purchase_per_supplier(t: Tables) -> DataFrame:
    return supplier_headers(t).select(*_SUPPLIER)


@query(
    "purchase_category_flow",
    f"""SELECT batch_id, ARG_MAX(found_id, ord) AS supplier_id,
    ARG_MAX(found_name, ord) AS supplier, 32 AS warehouse_id, {_HEADER_SUMS},
    {sums(grand_total="item_total_sale_price")} FROM category_lines GROUP BY batch_id""",
)
def purchase_category_flow(t: Tables) -> DataFrame:
    totals = posting.category_totals(category_rows(t), t.view("known_suppliers"), CATEGORY)
    return posting.purchases_category(totals, CATEGORY, RUN_TIME).select(
        "batch_id", "supplier_id", "supplier", "warehouse_id", *_HEADER, "grand_total"
    )


@query(
    "transfer_per_batch",
    f"""SELECT batch_id, 32 AS from_warehouse_id, 42 AS to_warehouse_id, 'completed' AS status,
    {sums(total="item_total_sale_price", total_cost="item_total_cost_price",
          total_tax="total_sale_vat")},
    CAST(CAST(SUM(total_sale) AS DECIMAL(25,2)) AS DOUBLE) AS grand_total
    FROM posted GROUP BY batch_id""",
)
def transfer_per_batch(t: Tables) -> DataFrame:
    totals = posting.batch_totals(posted_rows(t))
    return posting.transfers(totals, STANDARD, RUN_TIME).select(
        "batch_id", "from_warehouse_id", "to_warehouse_id", "status", "total", "total_cost",
        "total_tax", "grand_total",
    )


# Every third purchase belongs to another run and is left out.
_REPORT = """
SELECT h.batch_id + 1 AS id, total_items, total_stock, total, total_tax, grand_total
FROM (SELECT batch_id, CAST(SUM(item_total_cost_price) AS DECIMAL(25,5)) AS total,
        CAST(SUM(item_total_vat) AS DECIMAL(25,5)) AS total_tax,
        CAST(SUM(item_total_after_vat) AS DECIMAL(25,5)) AS grand_total
      FROM posted GROUP BY batch_id) h
JOIN (SELECT batch_id, COUNT(*) AS total_items,
        CAST(SUM(item_quantity) AS DECIMAL(25,5)) AS total_stock
      FROM posted WHERE expiry_ok GROUP BY batch_id) i ON h.batch_id = i.batch_id
WHERE (h.batch_id + 1) % 3 <> 0
"""
_REPORT_COLUMNS = ["id", "total_items", "total_stock", "total", "total_tax", "grand_total"]


def report(t: Tables) -> DataFrame:
    purchases = batch_purchases(t)
    items = posting.purchase_items(
        numbered_posting(t), STANDARD, RUN_TIME, keep=("purchase_id", "ord")
    )
    run_ids = with_batch(t.ordered).select((F.col("batch_id") + 1).alias("id")).distinct()
    return reporting.purchase_report(purchases, items, run_ids.filter("id % 3 <> 0"))


@query(
    "purchase_report",
    f"SELECT id, total_items, {amounts(*_REPORT_COLUMNS[2:])} FROM ({_REPORT}) r",
)
def purchase_report(t: Tables) -> DataFrame:
    return reporting.in_report_order(report(t)).select(*_REPORT_COLUMNS)


def _report_sums(columns: list[str]) -> str:
    return ", ".join(amount(f"COALESCE(SUM({c}), 0)", c) for c in columns)


@query(
    "report_grand_total",
    f"""WITH report AS ({_REPORT})
    SELECT 0 AS is_total, id, total_items, {amounts(*_REPORT_COLUMNS[2:])} FROM report
    UNION ALL SELECT 1, NULL, CAST(SUM(total_items) AS BIGINT),
    {_report_sums(_REPORT_COLUMNS[2:])} FROM report""",
)
def report_grand_total(t: Tables) -> DataFrame:
    return reporting.with_grand_total(report(t)).select("is_total", *_REPORT_COLUMNS)


@query(
    "surrogate_ids",
    f"""SELECT (SELECT MAX(id) FROM catalogue) + ROW_NUMBER() OVER (ORDER BY item_code) AS id,
    item_code AS code, name, {amount("vat_value", "tax_rate")}
    FROM (SELECT *, COALESCE(item_name, 'empty product') AS name, ROW_NUMBER() OVER
            (PARTITION BY item_code ORDER BY {K}) AS place FROM feed
          WHERE item_code IS NOT NULL) f
    WHERE place = 1 AND item_code NOT IN (SELECT code FROM catalogue)""",
)
def surrogate_ids(t: Tables) -> DataFrame:
    rows = cleaning.fill_text_defaults(cleaning.drop_null_key(t.ordered))
    stored = t.view("catalogue")
    new = registration.products_first(rows, stored, ["ord"])
    return with_new_ids(new, stored, ["code"]).select("id", "code", "name", "tax_rate")


@query(
    "product_report",
    f"""SELECT item_code AS product_code, item_name AS product_name,
    {sums(total_quantity="item_quantity", total_cost_price="item_cost_price",
          total_sale_price="item_sale_price")}
    FROM feed WHERE item_code IS NOT NULL AND item_name IS NOT NULL
    GROUP BY item_code, item_name""",
)
def product_report(t: Tables) -> DataFrame:
    items = t.feed.select(
        F.col("item_code").alias("product_code"),
        F.col("item_name").alias("product_name"),
        F.col("item_quantity").alias("quantity"),
        F.col("item_cost_price").alias("cost_price"),
        F.col("item_sale_price").alias("sale_price"),
    )
    return reporting.product_report(items)


@query(
    "purchase_order_copy",
    f"""SELECT 2000 + h.place AS id, 1000 + h.place AS purchase_id, h.supplier_id, supplier,
    'pending' AS status, total, grand_total, items_read, quantity
    FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY supplier_id) AS place
          FROM ({_BY_SUPPLIER}) s) h
    JOIN (SELECT supplier_id, {sums(quantity="item_quantity")} FROM lines GROUP BY supplier_id) i
      ON h.supplier_id = i.supplier_id""",
)
def purchase_order_copy(t: Tables) -> DataFrame:
    """Orders, with the items that carry their id counted back."""
    stored = t.table("region").select(F.lit(1000).alias("id"))
    stored_orders = t.table("region").select(F.lit(2000).alias("id"))
    purchases = with_new_ids(supplier_headers(t), stored, ["supplier_id"])
    orders = posting.purchase_orders(purchases, stored, stored_orders)
    items = posting.with_order_ids(cleaning.drop_null_key(t.ordered), orders)
    counted = items.groupBy(F.col("order_id").alias("id")).agg(
        F.sum("item_quantity").alias("quantity")
    )
    return orders.join(counted, "id").select(
        "id", "purchase_id", "supplier_id", "supplier", "status", "total", "grand_total",
        "items_read", "quantity",
    )


@query(
    "import_counters",
    """SELECT COUNT(*) AS rows_loaded, COUNT(*) - COUNT(item_code) AS rows_dropped,
    COUNT(DISTINCT item_code) AS codes_unique,
    COUNT(DISTINCT CASE WHEN c.code IS NULL THEN item_code END) AS codes_inserted,
    COUNT(DISTINCT c.code) AS codes_existing
    FROM feed f LEFT JOIN catalogue c ON f.item_code = c.code""",
)
def import_counters(t: Tables) -> DataFrame:
    return reporting.import_counters(t.feed, t.view("catalogue"))


@query(
    "discount_total",
    f"""SELECT supplier_id, {amount("SUM(CAST(value AS DECIMAL(25,5)))", "total_discount")}
    FROM (SELECT supplier_id, CASE WHEN item_discount > 0
            THEN CAST(item_cost_price AS DOUBLE) / (1 - CAST(item_discount AS DOUBLE))
                 - CAST(item_cost_price AS DOUBLE) ELSE 0 END AS value
          FROM feed WHERE item_code IS NOT NULL AND supplier_id IS NOT NULL) f
    GROUP BY supplier_id""",
)
def discount_total(t: Tables) -> DataFrame:
    rows = with_discount_backout(cleaning.drop_null_key(t.feed))
    return posting.discount_total(rows)
