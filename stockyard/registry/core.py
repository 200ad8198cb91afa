"""Input views shared by the registered queries, and the registry itself.

The views turn the driver's tables into supplier feeds with the faults that real
files have. Their SQL runs in both engines; each query of the registry sees the
whole view.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.functions.numbers import money
from stockyard.operators.ordinals import with_ordinal
from stockyard.settings import CategoryRule
from stockyard.staging import inside

RUN_TIME = datetime(2025, 1, 1, 12, 0, 0)
CATEGORIES = CategoryRule(categories=("LARGE", "PROMO", "SMALL"))

# Sort keys that say where a feed row stands in its input.
KEYS = ["k1", "k2", "k3", "k4", "k5", "k6"]
_KEY_LIST = ", ".join(KEYS)

# The same keys in the raw rows. A hash of the source's path and the row index go last in the
# Spark sort, so that a large group of equal rows can be split; neither is kept.
_RAW_KEYS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
]
_FILE = "source_file"
_ROW_INDEX = "source_row"

VIEWS = {
    "raw_rows": """
SELECT {row_index} l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_shipdate,
  p_name, p_brand, p_type, p_retailprice, s_name
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
""",
    "feed": """
SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
  l_quantity AS k5, l_extendedprice AS k6, {ordinal}
  CASE WHEN l_partkey % 97 = 13 THEN NULL ELSE CAST(l_partkey AS STRING) END AS item_code,
  CASE WHEN l_partkey % 97 = 13 THEN NULL
       WHEN l_orderkey % 7 = 3
         THEN CONCAT(' ', CAST(l_partkey AS STRING), ' ,', CAST(l_orderkey AS STRING))
       ELSE CAST(l_partkey AS STRING) END AS raw_code,
  CASE WHEN l_partkey % 50 = 7 THEN NULL ELSE p_name END AS item_name,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL
       ELSE CONCAT('B', CAST(l_orderkey AS STRING)) END AS item_batch_number,
  CASE l_orderkey % 6
    WHEN 0 THEN NULL
    WHEN 1 THEN 'n/a'
    WHEN 2 THEN '2999-12-31'
    WHEN 3 THEN CONCAT(CAST(CAST(l_shipdate AS DATE) AS STRING), ' 00:00:00')
    ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS item_expiry_date,
  CAST(l_quantity AS DECIMAL(12,2)) AS item_quantity,
  CAST(p_retailprice AS DECIMAL(12,2)) AS item_cost_price,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.90 AS DECIMAL(3,2)) AS DECIMAL(14,4))
    AS item_purchase_price,
  CASE WHEN l_orderkey % 13 = 5 THEN NULL
       ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(1.25 AS DECIMAL(3,2))
                 AS DECIMAL(14,4)) END AS item_sale_price,
  CAST(l_tax * 100 AS DECIMAL(5,2)) AS vat_value,
  CAST(l_discount AS DECIMAL(5,2)) AS item_discount,
  CASE WHEN LENGTH(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)) > 6
       THEN CONCAT(
         SUBSTR(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), 1,
                LENGTH(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)) - 6), ',',
         SUBSTR(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING),
                LENGTH(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)) - 5, 6))
       ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS item_total_cost_text,
  CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE l_suppkey END AS supplier_id,
  s_name AS supplier_name, p_type AS category, CONCAT(' ', p_brand, ' ') AS item_group
FROM {raw_rows}
""",
    "catalogue": """
SELECT p_partkey + 1 AS id, CAST(p_partkey AS STRING) AS code, p_name AS name,
  CAST(CASE WHEN p_partkey % 9 = 0 THEN p_retailprice + 1 ELSE p_retailprice END
       AS DECIMAL(12,2)) AS cost
FROM {part} WHERE p_partkey % 4 <> 0
""",
    "known_suppliers": """
SELECT s_suppkey + 1 AS id, s_name AS name FROM {supplier} WHERE s_suppkey % 3 <> 0
""",
    "known_categories": """
SELECT DENSE_RANK() OVER (ORDER BY p_type) AS id, p_type AS name, 0 AS parent_id
FROM (SELECT DISTINCT p_type FROM {part} WHERE p_type < 'PROMO') t
""",
    # Brands stand for groups; every third is a stored subcategory of the first parent.
    "known_groups": """
SELECT 100 + DENSE_RANK() OVER (ORDER BY p_brand) AS id, p_brand AS name, 1 AS parent_id
FROM (SELECT DISTINCT p_brand FROM {part} WHERE p_brand < 'Brand#2') t
""",
    # Every 23rd code comes twice, and its later row counts.
    "image_sheet": """
SELECT p_partkey * 2 AS ord,
  CASE WHEN p_partkey % 10 = 9 THEN NULL
       ELSE CONCAT(' ', CAST(p_partkey AS STRING), ' ') END AS product_code,
  CASE WHEN p_partkey % 17 = 0 THEN NULL
       ELSE CONCAT('http://img/', CAST(p_partkey AS STRING), '.png ') END AS image_url
FROM {part}
UNION ALL
SELECT p_partkey * 2 + 1 AS ord, CAST(p_partkey AS STRING) AS product_code,
  CONCAT('http://img/', CAST(p_partkey AS STRING), '-b.png') AS image_url
FROM {part} WHERE p_partkey % 23 = 0
""",
    # Every 29th item number comes twice, and its later row counts.
    "discount_sheet": """
SELECT p_partkey * 2 AS ord,
  CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 19 = 1 THEN 'TOTAL'
       ELSE CAST(p_partkey AS STRING) END AS item_no,
  CASE WHEN p_size % 5 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END AS credit_dis,
  CAST(p_size % 7 AS STRING) AS credit_dis2, CAST(p_size % 3 AS STRING) AS credit_dis3,
  CASE WHEN p_partkey % 31 = 0 THEN '12345678' ELSE CAST(p_size AS STRING) END AS cash_dis,
  CAST(p_size % 4 AS STRING) AS cash_dis2, CAST(p_size % 2 AS STRING) AS cash_dis3
FROM {part}
UNION ALL
SELECT p_partkey * 2 + 1 AS ord, CONCAT(CAST(p_partkey AS STRING), '.0') AS item_no,
  '1.5' AS credit_dis, 'x' AS credit_dis2, '0.25' AS credit_dis3,
  '2.5' AS cash_dis, CAST(NULL AS STRING) AS cash_dis2, '0.75' AS cash_dis3
FROM {part} WHERE p_partkey % 29 = 0
""",
}

# Views that only the SQL side needs; Spark reaches them through its operators.
_DAY = "CAST(TRY_CAST(item_expiry_date AS TIMESTAMP) AS DATE)"
SQL_VIEWS = {
    "ordered": f"SELECT *, ROW_NUMBER() OVER (ORDER BY {_KEY_LIST}) - 1 AS ord FROM feed",
    # Supplier flow: rows with a code and their line totals.
    "lines": """
SELECT *, item_total_cost_price + item_total_vat AS item_total_after_vat,
  item_total_sale_price + total_sale_vat AS total_sale
FROM (SELECT *, item_sale_price * item_quantity AS item_total_sale_price,
        item_sale_price * item_quantity * vat_value AS total_sale_vat,
        item_cost_price * item_quantity AS item_total_cost_price,
        item_cost_price * item_quantity * vat_value * CAST(0.01 AS DECIMAL(3,2))
          AS item_total_vat
      FROM feed WHERE item_code IS NOT NULL) f
""",
    # Standard flow: missing prices as 0, in batches, with the strict expiry.
    "posted": f"""
SELECT *, item_total_cost_price + item_total_vat AS item_total_after_vat,
  item_total_sale_price + total_sale_vat AS total_sale,
  item_expiry_date IS NULL OR expiry IS NOT NULL AS expiry_ok
FROM (SELECT *, unit_sale * item_quantity AS item_total_sale_price,
        unit_sale * item_quantity * vat_value AS total_sale_vat,
        item_cost_price * item_quantity AS item_total_cost_price,
        item_cost_price * item_quantity * vat_value * CAST(0.01 AS DECIMAL(3,2))
          AS item_total_vat,
        CASE WHEN REGEXP_FULL_MATCH(item_expiry_date, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}')
             THEN TRY_CAST(item_expiry_date AS DATE)
             WHEN {_DAY} <= DATE '2262-04-11' THEN {_DAY} END AS expiry
      FROM (SELECT *, ord // 1000 AS batch_id,
              COALESCE(item_sale_price, CAST(0 AS DECIMAL(14,4))) AS unit_sale
            FROM ordered) o) f
""",
    # Category flow: totals from the grouped cost text, VAT by category.
    "category_lines": f"""
SELECT *, item_total_cost_price + item_total_vat AS item_total_after_vat,
  item_total_sale_price + total_sale_vat AS total_sale
FROM (SELECT *,
        CASE WHEN taxed THEN item_total_cost_price * CAST(0.15 AS DECIMAL(3,2)) ELSE 0 END
          AS item_total_vat,
        CASE WHEN taxed THEN item_total_sale_price * CAST(0.15 AS DECIMAL(3,2)) ELSE 0 END
          AS total_sale_vat
      FROM (SELECT o.*, ord // 1000 AS batch_id,
              COALESCE(o.category IN ('LARGE', 'PROMO', 'SMALL'), FALSE) AS taxed,
              CAST(REPLACE(item_total_cost_text, ',', '') AS DECIMAL(18,6))
                AS item_total_cost_price,
              COALESCE(item_sale_price, CAST(0 AS DECIMAL(14,4))) * item_quantity
                AS item_total_sale_price,
              COALESCE(s.id, 786) AS found_id,
              CASE WHEN s.id IS NULL THEN 'Internal supplier' ELSE s.name END AS found_name,
              CASE WHEN REGEXP_FULL_MATCH(item_expiry_date, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}')
                   THEN TRY_CAST(item_expiry_date AS DATE)
                   WHEN {_DAY} <= DATE '2262-04-11' THEN {_DAY} END AS expiry
            FROM ordered o LEFT JOIN known_suppliers s ON o.supplier_name = s.name) a) b
""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STAGED: dict[tuple[str, str], DataFrame] = {}


def _without_options(name: str) -> str:
    """A view's SQL without the columns that only staging adds."""
    return VIEWS[name].replace("{ordinal}", "").replace("{row_index}", "")


class Tables:
    """The driver's tables in one folder, and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str) -> DataFrame:
        return self._select(_without_options(name))

    def _select(self, text: str, **given: DataFrame) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", text)) - set(given)
        read = {n: self.view(n) if n in VIEWS else self.table(n) for n in names}
        return self.spark.sql(text, **read, **given)

    @property
    def feed(self) -> DataFrame:
        return self.view("feed")

    @property
    def ordered(self) -> DataFrame:
        """The feed with ``ord``.

        Raw rows are put in order and staged once per session and folder; each reader
        derives only the feed columns that it uses.
        """
        return self.laid_out(lambda rows: rows)

    def laid_out(self, arrange: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The feed with ``ord`` over its staged rows as ``arrange`` sorts or deals them out.

        Rows are moved as they are staged; the columns of the feed are derived afterwards.
        """
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _STAGED:
            lines = self.table("lineitem").select(
                "*",
                F.xxhash64("_metadata.file_path").alias(_FILE),
                F.col("_metadata.row_index").alias(_ROW_INDEX),
            )
            text = VIEWS["raw_rows"].replace("{row_index}", f"{_FILE}, {_ROW_INDEX},")
            rows = self._select(text, lineitem=lines)
            marks = [_FILE, _ROW_INDEX]
            with inside(None):
                _STAGED[key] = with_ordinal(rows, [*_RAW_KEYS, *marks], stage_as="feed", only_sorted_by=marks)
        return self._select(VIEWS["feed"].replace("{ordinal}", "ord,"), raw_rows=arrange(_STAGED[key]))


def forget_staged() -> None:
    """Make the next query stage its feed anew."""
    _STAGED.clear()


def plain(df: DataFrame) -> DataFrame:
    """Amounts as DOUBLE, rounded as they are stored, and dates as ISO text.

    Both engines have these types in common over their whole range.
    """

    def column(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return money(F.col(f.name)).cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.col(f.name).cast("string").alias(f.name)
        return F.col(f.name)

    return df.select([column(f) for f in df.schema.fields])


def amount(expression: str, name: str) -> str:
    """SQL for an amount as DOUBLE, rounded as it is stored."""
    return f"CAST(CAST({expression} AS DECIMAL(25,5)) AS DOUBLE) AS {name}"


def amounts(*columns: str) -> str:
    return ", ".join(amount(c, c) for c in columns)


def sums(**columns: str) -> str:
    """SQL for sums as amounts, by result name."""
    return ", ".join(amount(f"SUM({source})", name) for name, source in columns.items())


def with_views(body: str) -> str:
    """The statement with every view it mentions in front of it."""
    texts = {**{n: _without_options(n) for n in VIEWS}, **SQL_VIEWS}
    texts = {n: re.sub(r"\{(\w+)\}", r"\1", t) if n in VIEWS else t for n, t in texts.items()}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, text in texts.items():
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(text)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    clauses = ",\n".join(f"{n} AS ({texts[n].strip()})" for n in needed)
    head = body.lstrip()
    if head.upper().startswith("WITH "):
        return f"WITH {clauses},\n{head[5:]}"
    return f"WITH {clauses}\n{head}"


def query(name: str, sql: str | None = None):
    """Registers a function of :class:`Tables` as a query, with its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(build(Tables(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
