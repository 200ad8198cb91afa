"""Queries over inputs that strain the operators: wide ids, odd dates, repeats, many files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions import dates
from stockyard.operators import lookups, updates
from stockyard.plans.category import category_import
from stockyard.plans.supplier import supplier_import
from stockyard.registry.core import CATEGORIES, KEYS, RUN_TIME, Tables, amount, query
from stockyard.registry.imports import _category_feed, _last_id
from stockyard.sources import feeds
from stockyard.sources.store import append_run, read_latest, read_runs, rewrite_snapshot
from stockyard.staging import new_folder

K = ", ".join(KEYS)
# Ids of 13 digits, as barcodes have.
_FAR = 6_291_100_000_000

_WIDE_SHEET = f"""SELECT p_partkey AS ord, CAST(CAST({_FAR} AS BIGINT) + p_partkey AS STRING) AS item_no,
  CASE WHEN p_partkey % 5 = 0 THEN '9999999999999' ELSE CAST(p_size AS STRING) END AS credit_dis,
  CAST(p_size % 7 AS STRING) AS credit_dis2, CAST(p_size % 3 AS STRING) AS credit_dis3,
  CAST(p_size AS STRING) AS cash_dis, CAST(p_size % 4 AS STRING) AS cash_dis2,
  CAST(p_size % 2 AS STRING) AS cash_dis3 FROM {{part}} WHERE p_partkey % 3 <> 0"""


@query(
    "discount_update_wide",
    f"""SELECT p_partkey + CAST({_FAR} AS BIGINT) AS id,
    CAST(CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 8 ELSE p_size END AS DOUBLE)
      AS credit_discount,
    CAST(CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 7 ELSE p_size END AS DOUBLE)
      AS cash_discount
    FROM part""",
)
def discount_update_wide(t: Tables) -> DataFrame:
    """Item numbers of 13 digits are kept; a value no discount can have changes nothing."""
    sheet = t._select(_WIDE_SHEET)
    products = t.table("part").select(
        (F.col("p_partkey") + F.lit(_FAR)).alias("id"),
        F.lit(7).cast("decimal(10,4)").alias("cash_discount"),
        F.lit(8).cast("decimal(10,4)").alias("credit_discount"),
    )
    return updates.update_discounts(products, sheet).select("id", "credit_discount", "cash_discount")


@query(
    "product_id_lookup_repeated",
    f"""SELECT {K}, f.item_code, c.id AS product_id FROM feed f LEFT JOIN (
      SELECT code, MIN(id) AS id FROM (SELECT code, id FROM catalogue
        UNION ALL SELECT code, id + 1000000 FROM catalogue) a GROUP BY code) c
    ON f.item_code = c.code""",
)
def product_id_lookup_repeated(t: Tables) -> DataFrame:
    """Every code stored twice: each feed row still comes once."""
    stored = t.view("catalogue").select("id", "code")
    later = stored.select((F.col("id") + 1_000_000).alias("id"), "code")
    found = lookups.with_product_id(t.feed, stored.unionByName(later), spread_by=KEYS)
    return found.select(*KEYS, "item_code", "product_id")


_FORMS = ("MMM yyyy", "d.M.yyyy", "yyyyMMdd", "M/d/yy", "MMMM d, yyyy", "M/yyyy", "yyyy.M.d", "d-MMM-yy")


@query(
    "expiry_forms",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    CAST(expiry AS VARCHAR) AS strict, CAST(expiry AS VARCHAR) AS clamped
    FROM (SELECT *, CAST(CASE WHEN l_orderkey % 8 IN (0, 5) THEN DATE_TRUNC('month', l_shipdate)
      ELSE l_shipdate END AS DATE) AS expiry FROM lineitem) l""",
)
def expiry_forms(t: Tables) -> DataFrame:
    """Month and year, two-digit years, dots and no marks at all, as files have them."""
    day = F.col("l_shipdate").cast("date")
    text = F.lit(None).cast("string")
    for i, form in enumerate(_FORMS):
        text = F.when(F.col("l_orderkey") % 8 == i, F.date_format(day, form)).otherwise(text)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = t.table("lineitem").select(*keys, text.alias("text"))
    strict, clamped = dates.strict_expiry(F.col("text")), dates.clamped_expiry(F.col("text"))
    return rows.select(*keys, strict.alias("strict"), clamped.alias("clamped"))


@query(
    "supplier_accept",
    f"""WITH priced AS (
      SELECT *, CASE WHEN supplier_id % 3 = 0 THEN item_sale_price
        ELSE COALESCE(item_sale_price, 0) END AS sale FROM feed),
    verdicts AS (
      SELECT supplier_id, COUNT(*) AS n, COUNT(*) - COUNT(sale) AS bad,
        SUM(item_cost_price * item_quantity) AS total
      FROM priced WHERE item_code IS NOT NULL AND supplier_id IS NOT NULL GROUP BY supplier_id)
    SELECT 'header' AS kind, CAST(supplier_id AS VARCHAR) AS name, n AS counted,
      {amount("total", "total")} FROM verdicts WHERE bad = 0
    UNION ALL SELECT CASE WHEN bad = 0 THEN 'completed' ELSE 'failed' END,
      CAST(supplier_id AS VARCHAR), n, {amount("CASE WHEN bad = 0 THEN n ELSE 0 END", "total")} FROM verdicts
    UNION ALL SELECT 'left out', 'no code', COUNT(*), NULL FROM priced WHERE item_code IS NULL
    UNION ALL SELECT 'left out', 'no supplier', COUNT(*), NULL FROM priced
      WHERE item_code IS NOT NULL AND supplier_id IS NULL
    UNION ALL SELECT 'left out', 'supplier refused', SUM(n), NULL FROM verdicts WHERE bad > 0
    UNION ALL SELECT 'items', 'posted', SUM(n), {amount("SUM(total)", "total")}
      FROM verdicts WHERE bad = 0""",
)
def supplier_accept(t: Tables) -> DataFrame:
    """A supplier with an item without a price is refused, and every row is accounted for."""
    whole = F.coalesce(F.col("item_sale_price"), F.lit(0).cast("decimal(14,4)"))
    sale = F.when(F.col("supplier_id") % 3 == 0, F.col("item_sale_price")).otherwise(whole)
    feed = t.ordered.withColumn("item_sale_price", sale)
    tables = supplier_import(
        feed, t.view("catalogue"), _last_id(t, 1000), _last_id(t, 2000), RUN_TIME, code_digits=12
    )
    money = "decimal(25,5)"
    header = tables["purchases"].select(
        F.lit("header").alias("kind"), F.col("supplier_id").cast("string").alias("name"),
        F.col("items_read").alias("counted"), F.col("total").cast(money).alias("total"),
    )
    log = tables["run_log"].select(
        F.col("status"), F.col("batch_id").cast("string"), F.col("rows_read"),
        F.col("rows_posted").cast(money),
    )
    out = tables["counters"].select(
        F.lit("left out"), F.col("left_out_as"), F.col("rows_left_out"), F.lit(None).cast(money)
    )
    items = tables["purchase_items"].agg(
        F.lit("items"), F.lit("posted"), F.count(F.lit(1)), F.sum("subtotal").cast(money)
    )
    return reduce(DataFrame.union, [header, log, out, items])


@query(
    "category_products",
    """WITH coded AS (SELECT *, TRIM(SPLIT_PART(raw_code, ',', 1)) AS code FROM ordered),
    fresh AS (
      SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY ord) AS place
        FROM coded WHERE code IS NOT NULL) c
      WHERE place = 1 AND code NOT IN (SELECT code FROM catalogue))
    SELECT f.code, g.id AS category_id
    FROM fresh f LEFT JOIN known_groups g ON TRIM(f.item_group) = g.name""",
)
def category_products(t: Tables) -> DataFrame:
    """New products of the category import, with the category that their group is stored as."""
    none = t.table("region").select(F.lit(0).cast("bigint").alias("id"))
    tables = category_import(
        _category_feed(t), t.view("catalogue"), t.view("known_suppliers"),
        t.view("known_groups"), none, none, RUN_TIME, rule=CATEGORIES,
    )
    return tables["products"].select("code", "category_id")


@query(
    "repeated_runs",
    """SELECT '007' AS run_id, COUNT(*) AS stored_rows FROM catalogue WHERE id % 2 = 0
    UNION ALL SELECT '2024-01-01', COUNT(*) FROM catalogue
    UNION ALL SELECT 'version 1', COUNT(*) FROM catalogue WHERE id % 2 = 0""",
)
def repeated_runs(t: Tables) -> DataFrame:
    """Runs and a version written twice under one name: the last attempt counts."""
    root, products = new_folder(t.spark, "store"), t.view("catalogue")
    even = products.where("id % 2 = 0")
    for run_id, rows in (("007", products), ("2024-01-01", even), ("2024-01-01", products), ("007", even)):
        append_run({"products": rows}, root, run_id)
    runs = read_runs(t.spark, root, "products").groupBy("run_id").agg(F.count(F.lit(1)).alias("stored_rows"))
    for rows in (products, even):
        rewrite_snapshot(rows, f"{root}/catalogue", "1")
    latest = read_latest(t.spark, f"{root}/catalogue")
    return runs.union(latest.agg(F.lit("version 1"), F.count(F.lit(1))))


@query(
    "scan_named_folder",
    "SELECT product_code, image_url FROM image_sheet",
)
def scan_named_folder(t: Tables) -> DataFrame:
    """Files whose columns come in another order each, read by the names in their headers."""
    folder = new_folder(t.spark, "named")
    sheet = t.view("image_sheet")
    for side, columns in ((0, ["product_code", "image_url"]), (1, ["image_url", "product_code"])):
        part = sheet.where(F.col("ord") % 4 < 2 if side else F.col("ord") % 4 >= 2).select(columns)
        kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        part.write.options(header=True, **kept).csv(f"{folder}/side{side}")
    rows = feeds.read_named(t.spark, [f"{folder}/side0", f"{folder}/side1"])
    return rows.select("product_code", "image_url")
