"""Joins, lookups, registration and catalogue updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.operators import cleaning, registration, updates
from stockyard.operators import lookups as ops
from stockyard.operators.ordinals import with_batch
from stockyard.registry.core import KEYS, Tables, amount, query
from stockyard.registry.inputs import feed_keys, posted_rows, stored_keys
from stockyard.settings import CATEGORY
from stockyard.sources.keyed import write_keyed
from stockyard.staging import new_folder

K = ", ".join(KEYS)


def _first(key: str, condition: str = "TRUE") -> str:
    """SQL for the first feed row of each key."""
    return f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {K})
      AS place FROM feed WHERE {condition}) r WHERE place = 1"""


_STORED_KEYS = """
SELECT DISTINCT 'item_code' AS kind, item_code AS item FROM feed
  WHERE item_code {0} (SELECT code FROM catalogue)
UNION ALL SELECT DISTINCT 'supplier_name', supplier_name FROM feed
  WHERE supplier_name {0} (SELECT name FROM known_suppliers)
UNION ALL SELECT DISTINCT 'category', category FROM feed
  WHERE category {0} (SELECT name FROM known_categories)
"""


@query("existing_keys", _STORED_KEYS.format("IN"))
def existing_keys(t: Tables) -> DataFrame:
    return ops.existing_keys(feed_keys(t), stored_keys(t), ["kind", "item"])


@query("missing_keys", _STORED_KEYS.format("NOT IN"))
def missing_keys(t: Tables) -> DataFrame:
    return ops.missing_keys(feed_keys(t), stored_keys(t), ["kind", "item"])


@query(
    "codes_by_keyed_table",
    """SELECT DISTINCT item_code AS code, item_code IN (SELECT code FROM catalogue) AS is_stored
    FROM feed WHERE item_code IS NOT NULL""",
)
def codes_by_keyed_table(t: Tables) -> DataFrame:
    """Stored and missing codes, looked up in a table that is kept in buckets of the code."""
    stored = write_keyed(t.view("catalogue").select("id", "code"), new_folder(t.spark, "codes"), "1", "code")
    codes = t.feed.select(F.col("item_code").alias("code"))
    found = ops.existing_keys(codes, stored, ["code"]).withColumn("is_stored", F.lit(True))
    return found.unionByName(ops.missing_keys(codes, stored, ["code"]).withColumn("is_stored", F.lit(False)))


@query(
    "register_products_first",
    f"""SELECT item_code AS code, COALESCE(item_name, 'empty product') AS name,
    COALESCE(item_name, 'empty product') AS name_ar, {amount("vat_value", "tax_rate")}
    FROM ({_first("item_code", "item_code IS NOT NULL")}) f
    WHERE item_code NOT IN (SELECT code FROM catalogue)""",
)
def register_products_first(t: Tables) -> DataFrame:
    rows = cleaning.fill_text_defaults(cleaning.drop_null_key(t.ordered))
    return registration.products_first(rows, t.view("catalogue"), ["ord"])


@query(
    "register_products_priced",
    f"""SELECT item_code AS code, item_name AS name, item_name AS name_ar,
    {amount("COALESCE(item_cost_price, 0)", "cost")},
    {amount("COALESCE(item_sale_price, 0)", "price")}, {amount("5", "tax_rate")}
    FROM ({_first("item_code", "item_code IS NOT NULL")}) f
    WHERE item_code NOT IN (SELECT code FROM catalogue)""",
)
def register_products_priced(t: Tables) -> DataFrame:
    floats = t.ordered.withColumn("item_code", F.concat("item_code", F.lit(".0")))
    return registration.products_priced(floats, t.view("catalogue"), ["ord"])


@query(
    "register_products_category",
    f"""SELECT f.item_code AS code, f.item_code, f.item_name AS name, g.id AS category_id,
    {amount("item_cost_price", "cost")}, {amount("item_sale_price", "price")}
    FROM ({_first("item_code", "item_code IS NOT NULL")}) f
    LEFT JOIN known_groups g ON TRIM(f.item_group) = g.name
    WHERE f.item_code NOT IN (SELECT code FROM catalogue)""",
)
def register_products_category(t: Tables) -> DataFrame:
    rows = cleaning.trim_keys(t.ordered, ["item_group"])
    return registration.products_by_category(
        rows, t.view("catalogue"), t.view("known_groups"), ["ord"], code="raw_code"
    )


@query(
    "compare_existing",
    f"""SELECT code, f.item_name AS file_name, c.name AS stored_name,
    {amount("f.item_cost_price", "file_cost")}, {amount("c.cost", "stored_cost")},
    f.item_name IS DISTINCT FROM c.name AS name_differs,
    f.item_cost_price IS DISTINCT FROM c.cost AS cost_differs
    FROM ({_first("item_code", "item_code IS NOT NULL")}) f JOIN catalogue c
      ON f.item_code = c.code""",
)
def compare_existing(t: Tables) -> DataFrame:
    first = cleaning.keep_first(t.ordered, "item_code", ["ord"], ["item_name", "item_cost_price"])
    return ops.compare_existing(
        first, t.view("catalogue"), "item_code", "item_name", "item_cost_price"
    )


@query(
    "upsert_last_in_first_batch",
    f"""SELECT item_code AS code, item_name AS name, {amount("item_cost_price", "cost")},
    {amount("item_sale_price", "price")}, {amount("1", "tax_rate")}
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_code ORDER BY ord // 1000, ord DESC)
          AS place FROM ordered WHERE item_code IS NOT NULL) o
    WHERE place = 1 AND item_code NOT IN (SELECT code FROM catalogue)""",
)
def upsert_last_in_first_batch(t: Tables) -> DataFrame:
    rows = with_batch(t.ordered)
    return registration.products_last_in_first_batch(rows, t.view("catalogue")).select(
        "code", "name", "cost", "price", "tax_rate"
    )


@query(
    "product_id_lookup",
    f"""SELECT {K}, item_code, c.id AS product_id
    FROM feed f LEFT JOIN catalogue c ON f.item_code = c.code""",
)
def product_id_lookup(t: Tables) -> DataFrame:
    rows = t.feed.select(*KEYS, "item_code")
    return ops.with_product_id(rows, t.view("catalogue"), spread_by=KEYS)


@query(
    "supplier_or_default",
    f"""SELECT {K}, COALESCE(s.id, 786) AS supplier_id,
    COALESCE(s.name, 'Internal supplier') AS supplier_name
    FROM feed f LEFT JOIN known_suppliers s ON f.supplier_name = s.name""",
)
def supplier_or_default(t: Tables) -> DataFrame:
    return ops.with_supplier_or_default(
        t.feed.select(*KEYS, "supplier_name"),
        t.view("known_suppliers"),
        "supplier_name",
        CATEGORY.supplier_id,
        CATEGORY.supplier_name,
        spread_by=KEYS,
    ).drop("supplier_known")


@query(
    "register_suppliers",
    """SELECT (SELECT MAX(id) FROM known_suppliers) + ROW_NUMBER() OVER (ORDER BY name) AS id,
    4 AS group_id, 'supplier' AS group_name, name, name AS name_ar,
    'Main company' AS company
    FROM (SELECT DISTINCT supplier_name AS name FROM feed
          WHERE supplier_name NOT IN (SELECT name FROM known_suppliers)) s""",
)
def register_suppliers(t: Tables) -> DataFrame:
    found = registration.new_suppliers(t.feed, t.view("known_suppliers"))
    return found.drop("level", "external_id")


_CATEGORY_COLUMNS = """name AS code, name, LOWER(REPLACE(name, ' ', '-')) AS slug, parent_id,
    name AS description, 1 AS category_code"""


@query(
    "register_categories",
    f"""SELECT (SELECT MAX(id) FROM known_categories) + ROW_NUMBER() OVER (ORDER BY name) AS id,
    {_CATEGORY_COLUMNS}
    FROM (SELECT DISTINCT category AS name, 0 AS parent_id FROM feed
          WHERE category NOT IN (SELECT name FROM known_categories)) c""",
)
def register_categories(t: Tables) -> DataFrame:
    return registration.new_categories(t.feed, t.view("known_categories"))


@query(
    "register_subcategories",
    f"""SELECT (SELECT MAX(id) FROM known_groups) + ROW_NUMBER() OVER (ORDER BY parent_id, name)
      AS id, {_CATEGORY_COLUMNS}
    FROM (SELECT DISTINCT TRIM(item_group) AS name, k.id AS parent_id
          FROM feed f JOIN known_categories k ON f.category = k.name
          WHERE item_group IS NOT NULL) p
    WHERE NOT EXISTS (SELECT 1 FROM known_groups g
                      WHERE g.name = p.name AND g.parent_id = p.parent_id)""",
)
def register_subcategories(t: Tables) -> DataFrame:
    stored = t.view("known_categories").unionByName(t.view("known_groups"))
    return registration.new_subcategories(t.feed, stored)


_IMAGES = """
SELECT TRIM(product_code) AS code, TRIM(image_url) AS url, ROW_NUMBER() OVER
  (PARTITION BY TRIM(product_code) ORDER BY ord DESC) AS place
FROM image_sheet WHERE product_code IS NOT NULL AND image_url IS NOT NULL
"""


@query(
    "image_update",
    f"""SELECT c.id, c.code, COALESCE(i.url, 'old') AS image_url_new
    FROM catalogue c LEFT JOIN (SELECT * FROM ({_IMAGES}) s WHERE place = 1) i
      ON c.code = i.code""",
)
def image_update(t: Tables) -> DataFrame:
    products = t.view("catalogue").withColumn("image_url_new", F.lit("old"))
    return updates.update_images(products, t.view("image_sheet")).select(
        "id", "code", "image_url_new"
    )


@query(
    "image_counters",
    f"""SELECT COUNT(*) AS rows_loaded, COUNT(c.code) AS rows_updated,
    COUNT(*) - COUNT(c.code) AS rows_not_found
    FROM ({_IMAGES}) i LEFT JOIN catalogue c ON i.code = c.code""",
)
def image_counters(t: Tables) -> DataFrame:
    return updates.image_counters(t.view("catalogue"), t.view("image_sheet"))


def _number(column: str) -> str:
    return f"TRY_CAST({column} AS DECIMAL(18,6))"


_DISCOUNTS = f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ord DESC) AS place
FROM (SELECT ord, CAST(TRUNC(TRY_CAST(item_no AS DOUBLE)) AS BIGINT) AS id,
        {_number("cash_dis")} AS cash_discount, {_number("cash_dis2")} AS cash_dis2,
        {_number("cash_dis3")} AS cash_dis3, {_number("credit_dis")} AS credit_discount,
        {_number("credit_dis2")} AS credit_dis2, {_number("credit_dis3")} AS credit_dis3
      FROM discount_sheet WHERE TRY_CAST(item_no AS DOUBLE) IS NOT NULL) d
"""
_GOOD_DISCOUNT = "COALESCE(cash_discount, 0) < 1000000"


def _updated(column: str, old: str) -> str:
    return amount(f"CASE WHEN d.id IS NULL THEN {old} ELSE d.{column} END", column)


@query(
    "discount_update",
    f"""SELECT c.id, c.code, {_updated("cash_discount", "7")}, {_updated("cash_dis2", "NULL")},
    {_updated("cash_dis3", "NULL")}, {_updated("credit_discount", "8")},
    {_updated("credit_dis2", "NULL")}, {_updated("credit_dis3", "NULL")}
    FROM catalogue c LEFT JOIN (
      SELECT * FROM (SELECT * EXCLUDE (place), ROW_NUMBER() OVER (PARTITION BY id
        ORDER BY ord DESC) AS place FROM ({_DISCOUNTS}) a WHERE {_GOOD_DISCOUNT}) b
      WHERE place = 1) d ON c.id = d.id""",
)
def discount_update(t: Tables) -> DataFrame:
    products = t.view("catalogue").withColumns(
        {
            "cash_discount": F.lit(7).cast("decimal(10,4)"),
            "credit_discount": F.lit(8).cast("decimal(10,4)"),
        }
    )
    return updates.update_discounts(products, t.view("discount_sheet")).select(
        "id", "code", *updates.DISCOUNT_COLUMNS
    )


@query(
    "discount_counters",
    f"""SELECT COUNT(*) AS rows_loaded, COUNT(CASE WHEN good THEN c.id END) AS rows_updated,
    COUNT(CASE WHEN good AND c.id IS NULL THEN 1 END) AS rows_not_found,
    COUNT(CASE WHEN NOT good THEN 1 END) AS rows_in_error
    FROM (SELECT *, {_GOOD_DISCOUNT} AS good FROM ({_DISCOUNTS}) a) d
    LEFT JOIN catalogue c ON d.id = c.id""",
)
def discount_counters(t: Tables) -> DataFrame:
    return updates.discount_counters(t.view("catalogue"), t.view("discount_sheet"))


@query(
    "price_update",
    f"""SELECT c.id, c.code,
    {amount("CASE WHEN l.item_code IS NULL THEN c.cost ELSE l.item_cost_price END", "cost")},
    {amount("CASE WHEN l.item_code IS NULL THEN c.cost ELSE l.unit_sale END", "price")}
    FROM catalogue c LEFT JOIN (
      SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_code ORDER BY ord DESC)
        AS place FROM posted WHERE expiry_ok AND item_code IS NOT NULL) p WHERE place = 1) l
    ON c.code = l.item_code""",
)
def price_update(t: Tables) -> DataFrame:
    stored = t.view("catalogue")
    products = stored.withColumns(
        {"cost": F.col("cost").cast("decimal(25,5)"), "price": F.col("cost").cast("decimal(25,5)")}
    )
    prices = registration.last_price(posted_rows(t).filter("expiry_ok"))
    return updates.update_prices(products, prices).select("id", "code", "cost", "price")


@query(
    "exists_count",
    """SELECT code, COUNT(c.id) AS stored_rows, COUNT(c.id) > 0 AS is_stored
    FROM (SELECT DISTINCT item_code AS code FROM feed WHERE item_code IS NOT NULL) f
    LEFT JOIN catalogue c USING (code) GROUP BY code""",
)
def exists_count(t: Tables) -> DataFrame:
    codes = t.feed.select(F.col("item_code").alias("code"))
    return ops.exists_count(codes, t.view("catalogue"))
