"""Cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.operators import cleaning as ops
from stockyard.registry.core import KEYS, Tables, amount, query
from stockyard.registry.inputs import feed_keys

K = ", ".join(KEYS)


@query(
    "drop_all_null",
    f"""SELECT {K}, item_code, item_name, item_expiry_date FROM feed
    WHERE item_code IS NOT NULL OR item_name IS NOT NULL OR item_expiry_date IS NOT NULL""",
)
def drop_all_null(t: Tables) -> DataFrame:
    cells = ["item_code", "item_name", "item_expiry_date"]
    return ops.drop_all_null(t.feed.select(*KEYS, *cells), cells)


@query(
    "drop_null_key", f"SELECT {K}, item_code, item_name FROM feed WHERE item_code IS NOT NULL"
)
def drop_null_key(t: Tables) -> DataFrame:
    return ops.drop_null_key(t.feed).select(*KEYS, "item_code", "item_name")


@query(
    "fill_price_zero",
    f"""SELECT {K}, {amount("COALESCE(item_cost_price, 0)", "item_cost_price")},
    {amount("COALESCE(item_sale_price, 0)", "item_sale_price")} FROM feed""",
)
def fill_price_zero(t: Tables) -> DataFrame:
    return ops.fill_price_zero(t.feed).select(*KEYS, "item_cost_price", "item_sale_price")


@query(
    "fill_text_defaults",
    f"""SELECT {K}, COALESCE(item_batch_number, 'AAA') AS item_batch_number,
    COALESCE(item_name, 'empty product') AS item_name FROM feed""",
)
def fill_text_defaults(t: Tables) -> DataFrame:
    return ops.fill_text_defaults(t.feed).select(*KEYS, "item_batch_number", "item_name")


@query(
    "strip_thousands",
    f"""SELECT {K}, item_total_cost_text AS cell,
    {amount("TRY_CAST(REPLACE(item_total_cost_text, ',', '') AS DECIMAL(18,6))", "total")}
    FROM feed""",
)
def strip_thousands(t: Tables) -> DataFrame:
    rows = t.feed.select(
        *KEYS,
        F.col("item_total_cost_text").alias("cell"),
        F.col("item_total_cost_text").alias("total"),
    )
    return ops.strip_thousands(rows, ["total"])


@query(
    "code_first_token", f"SELECT {K}, TRIM(SPLIT_PART(raw_code, ',', 1)) AS item_code FROM feed"
)
def code_first_token(t: Tables) -> DataFrame:
    return ops.with_first_code(t.feed, "raw_code").select(*KEYS, "item_code")


_FLOAT_CODE = """CASE k1 % 4 WHEN 0 THEN item_code || '.0' WHEN 1 THEN item_code || '.75'
    WHEN 2 THEN item_code || 'x' ELSE item_code END"""


@query(
    "code_integer_text",
    f"""SELECT {K}, cell, CAST(CAST(TRUNC(TRY_CAST(cell AS DOUBLE)) AS BIGINT) AS VARCHAR) AS code
    FROM (SELECT {K}, {_FLOAT_CODE} AS cell FROM feed) c""",
)
def code_integer_text(t: Tables) -> DataFrame:
    cells = t.feed.select(*KEYS, F.expr(_FLOAT_CODE).alias("cell"))
    return ops.with_integer_code(cells, "cell", "code")


@query(
    "trim_keys",
    """SELECT ord, TRIM(product_code) AS product_code, TRIM(image_url) AS image_url
    FROM image_sheet""",
)
def trim_keys(t: Tables) -> DataFrame:
    return ops.trim_keys(t.view("image_sheet"), ["product_code", "image_url"])


@query("slugify", f"SELECT {K}, item_name AS name, LOWER(REPLACE(item_name, ' ', '-')) AS slug FROM feed")
def slugify(t: Tables) -> DataFrame:
    return ops.with_slug(t.feed.select(*KEYS, F.col("item_name").alias("name")))


@query(
    "coerce_numeric",
    f"""SELECT CAST(TRUNC(TRY_CAST(item_no AS DOUBLE)) AS BIGINT) AS item_no,
    {amount("TRY_CAST(credit_dis AS DECIMAL(18,6))", "credit_dis")},
    {amount("TRY_CAST(credit_dis2 AS DECIMAL(18,6))", "credit_dis2")},
    {amount("TRY_CAST(cash_dis AS DECIMAL(18,6))", "cash_dis")}
    FROM discount_sheet WHERE TRY_CAST(item_no AS DOUBLE) IS NOT NULL""",
)
def coerce_numeric(t: Tables) -> DataFrame:
    columns = ["credit_dis", "credit_dis2", "cash_dis"]
    return ops.coerce_numeric(t.view("discount_sheet"), "item_no", columns).select(
        "item_no", *columns
    )


@query(
    "expiry_strict",
    """SELECT ord, item_expiry_date, CAST(expiry AS VARCHAR) AS expiry
    FROM posted WHERE expiry_ok""",
)
def expiry_strict(t: Tables) -> DataFrame:
    return ops.drop_bad_expiry(t.ordered).select("ord", "item_expiry_date", "expiry")


@query(
    "expiry_clamped",
    f"""SELECT {K}, item_expiry_date, CAST(CASE WHEN YEAR(day) > 2262
      THEN TRY_CAST(CONCAT('2262', STRFTIME(day, '-%m-%d')) AS DATE) ELSE day END AS VARCHAR)
      AS expiry
    FROM (SELECT *, CAST(TRY_CAST(item_expiry_date AS TIMESTAMP) AS DATE) AS day FROM feed) f""",
)
def expiry_clamped(t: Tables) -> DataFrame:
    return ops.with_clamped_expiry(t.feed).select(*KEYS, "item_expiry_date", "expiry")


@query(
    "dedupe_keep_first",
    f"""SELECT item_code, {K}, item_name, item_batch_number
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_code ORDER BY {K}) AS place FROM feed) f
    WHERE place = 1""",
)
def dedupe_keep_first(t: Tables) -> DataFrame:
    columns = [*KEYS, "item_name", "item_batch_number"]
    return ops.keep_first(t.ordered, "item_code", ["ord"], columns)


@query(
    "distinct_values",
    """SELECT DISTINCT 'item_code' AS kind, item_code AS item FROM feed WHERE item_code IS NOT NULL
    UNION ALL SELECT DISTINCT 'supplier_name', supplier_name FROM feed
      WHERE supplier_name IS NOT NULL
    UNION ALL SELECT DISTINCT 'category', category FROM feed WHERE category IS NOT NULL""",
)
def distinct_values(t: Tables) -> DataFrame:
    return feed_keys(t)


@query(
    "membership_filter",
    f"""SELECT {K}, category, 'in' AS side FROM feed WHERE category IN ('LARGE', 'PROMO', 'SMALL')
    UNION ALL SELECT {K}, category, 'out' FROM feed
      WHERE category IS NULL OR category NOT IN ('LARGE', 'PROMO', 'SMALL')""",
)
def membership_filter(t: Tables) -> DataFrame:
    """Both sides from one pass over the feed."""
    inside = ops.listed("category", ["LARGE", "PROMO", "SMALL"])
    side = F.when(inside, F.lit("in")).otherwise(F.lit("out"))
    return t.feed.select(*KEYS, "category", side.alias("side"))


@query(
    "project_rename",
    f"""SELECT item_no, cash_dis AS cash_discount, cash_dis2, cash_dis3,
    credit_dis AS credit_discount, credit_dis2, credit_dis3 FROM discount_sheet""",
)
def project_rename(t: Tables) -> DataFrame:
    names = {
        "item_no": "item_no",
        "cash_dis": "cash_discount",
        "cash_dis2": "cash_dis2",
        "cash_dis3": "cash_dis3",
        "credit_dis": "credit_discount",
        "credit_dis2": "credit_dis2",
        "credit_dis3": "credit_dis3",
    }
    return ops.project_rename(t.view("discount_sheet"), names)
