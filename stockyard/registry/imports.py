"""Whole imports over the feed, from registration to posted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.measures import with_line_totals
from stockyard.operators import cleaning
from stockyard.plans.category import category_import, category_metadata
from stockyard.plans.standard import standard_import
from stockyard.plans.supplier import supplier_import
from stockyard.registry.core import CATEGORIES, KEYS, RUN_TIME, Tables, amount, amounts, query, sums

K = ", ".join(KEYS)
_HEADER = ["total", "total_sale", "total_tax", "grand_total"]


def _last_id(t: Tables, number: int) -> DataFrame:
    return t.table("region").select(F.lit(number).cast("bigint").alias("id"))


@query(
    "standard_import",
    f"""SELECT 501 + h.batch_id AS id, total_items, {amounts("total", "total_tax", "grand_total")},
    moved, {amount("0", "transferred")}
    FROM (SELECT batch_id, CAST(SUM(item_total_cost_price) AS DECIMAL(25,5)) AS total,
            CAST(SUM(item_total_vat) AS DECIMAL(25,5)) AS total_tax,
            CAST(SUM(item_total_after_vat) AS DECIMAL(25,5)) AS grand_total
          FROM posted WHERE item_code IS NOT NULL GROUP BY batch_id) h
    JOIN (SELECT batch_id, COUNT(*) AS total_items, 3 * COUNT(*) AS moved
          FROM posted WHERE item_code IS NOT NULL AND expiry_ok GROUP BY batch_id) i
      ON h.batch_id = i.batch_id""",
)
def standard(t: Tables) -> DataFrame:
    """Purchases with their items, and their movements, whose transfer halves cancel out."""
    rows = cleaning.drop_null_key(cleaning.fill_price_zero(t.ordered))
    feed = with_line_totals(rows).drop("total_sale", "total_sale_vat")
    tables = standard_import(
        feed.withColumn("item_ascon_code", F.col("item_batch_number")),
        t.view("catalogue"),
        _last_id(t, 500),
        _last_id(t, 500),
        RUN_TIME,
    )
    items = tables["purchase_items"].groupBy(F.col("purchase_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_items")
    )
    outside = F.when(F.col("type") != "purchase", F.col("quantity")).otherwise(F.lit(0))
    moves = tables["inventory_movements"].groupBy(F.col("reference_id").alias("id")).agg(
        F.count(F.lit(1)).alias("moved"), F.sum(outside).alias("transferred")
    )
    headers = tables["purchases"].select("id", "total", "total_tax", "grand_total")
    return headers.join(items, "id").join(moves, "id")


@query(
    "supplier_import",
    f"""WITH fresh AS (
      SELECT (SELECT MAX(id) FROM catalogue) + ROW_NUMBER() OVER (ORDER BY code) AS id, code
      FROM (SELECT DISTINCT item_code AS code FROM lines
            WHERE item_code NOT IN (SELECT code FROM catalogue)) n),
    headers AS (
      SELECT supplier_id, ROW_NUMBER() OVER (ORDER BY supplier_id) AS place
      FROM (SELECT DISTINCT supplier_id FROM lines WHERE supplier_id IS NOT NULL) s)
    SELECT 2000 + place AS order_id, 1000 + place AS purchase_id, ord,
      COALESCE(c.id, n.id) AS product_id, l.item_code AS product_code,
      COALESCE(l.item_name, 'empty product') AS product_name,
      COALESCE(l.item_batch_number, 'AAA') AS batchno,
      CAST(CAST(100000000000 AS BIGINT) + ord AS VARCHAR) AS avz_item_code,
      {amount("item_total_cost_price", "subtotal")}, {amount("item_total_vat", "item_tax")},
      {amount("total_sale", "total_sale")}
    FROM lines l JOIN ordered o USING ({K}) JOIN headers h ON l.supplier_id = h.supplier_id
    LEFT JOIN catalogue c ON l.item_code = c.code LEFT JOIN fresh n ON l.item_code = n.code""",
)
def supplier(t: Tables) -> DataFrame:
    """Items with the ids of their order, purchase and, new ones included, product."""
    tables = supplier_import(
        t.ordered, t.view("catalogue"), _last_id(t, 1000), _last_id(t, 2000), RUN_TIME,
        code_digits=12, required=(),
    )
    return tables["purchase_items"].select(
        "order_id", "purchase_id", "ord", "product_id", "product_code", "product_name",
        "batchno", "avz_item_code", "subtotal", "item_tax", "total_sale",
    )


def _category_feed(t: Tables) -> DataFrame:
    rows = cleaning.fill_price_zero(t.ordered, ["item_sale_price"])
    sale = F.col("item_sale_price") * F.col("item_quantity")
    return rows.select(
        "ord",
        F.col("raw_code").alias("item_code"),
        "item_name",
        "item_batch_number",
        "item_expiry_date",
        "item_quantity",
        F.col("item_sale_price").cast("string").alias("item_sale_price"),
        F.col("item_cost_price").cast("string").alias("item_cost_price"),
        "item_purchase_price",
        sale.cast("string").alias("item_total_sale_price"),
        F.col("item_total_cost_text").alias("item_total_cost_price"),
        F.col("supplier_name").alias("supplier"),
        "category",
        F.col("item_group").alias("group"),
    )


@query(
    "category_import",
    f"""SELECT 1 + batch_id AS id, ARG_MAX(found_id, ord) AS supplier_id,
    ARG_MAX(found_name, ord) AS supplier,
    {sums(total="item_total_cost_price", total_sale="item_total_sale_price",
          total_tax="item_total_vat", grand_total="item_total_sale_price")}
    FROM category_lines GROUP BY batch_id""",
)
def category(t: Tables) -> DataFrame:
    none = t.table("region").select(F.lit(0).cast("bigint").alias("id"))
    tables = category_import(
        _category_feed(t), t.view("catalogue"), t.view("known_suppliers"),
        t.view("known_groups"), none, none, RUN_TIME, rule=CATEGORIES,
    )
    return tables["purchases"].select("id", "supplier_id", "supplier", *_HEADER)


@query(
    "category_metadata",
    """WITH parents AS (
      SELECT (SELECT MAX(id) FROM known_categories) + ROW_NUMBER() OVER (ORDER BY name) AS id, name
      FROM (SELECT DISTINCT category AS name FROM feed
            WHERE category NOT IN (SELECT name FROM known_categories)) c),
    stored AS (SELECT id, name FROM known_categories UNION ALL SELECT id, name FROM parents)
    SELECT 'category' AS kind, id, name, CAST(0 AS BIGINT) AS parent_id FROM parents
    UNION ALL
    SELECT 'category', (SELECT MAX(id) FROM stored) + ROW_NUMBER() OVER (ORDER BY parent_id, name),
      name, parent_id
    FROM (SELECT DISTINCT TRIM(item_group) AS name, s.id AS parent_id
          FROM feed f JOIN stored s ON f.category = s.name WHERE item_group IS NOT NULL) p
    UNION ALL
    SELECT 'supplier', (SELECT MAX(id) FROM known_suppliers) + ROW_NUMBER() OVER (ORDER BY name),
      name, NULL
    FROM (SELECT DISTINCT supplier_name AS name FROM feed
          WHERE supplier_name NOT IN (SELECT name FROM known_suppliers)) s""",
)
def metadata(t: Tables) -> DataFrame:
    """Suppliers, categories and subcategories that a feed brings."""
    tables = category_metadata(
        _category_feed(t), t.view("known_suppliers"), t.view("known_categories")
    )
    categories = tables["categories"].select(
        F.lit("category").alias("kind"), "id", "name", "parent_id"
    )
    suppliers = tables["suppliers"].select(
        F.lit("supplier").alias("kind"), "id", "name", F.lit(None).cast("bigint").alias("parent_id")
    )
    return categories.unionByName(suppliers)
