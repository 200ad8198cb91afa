"""Batch acceptance, sinks and the file-drop stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.measures import with_line_totals
from stockyard.operators import acceptance, cleaning, posting, reporting, updates
from stockyard.operators.ordinals import PRIME, round_numbers, with_batch, with_item_code
from stockyard.registry.core import RUN_TIME, Tables, amount, query, sums
from stockyard.registry.inputs import batch_purchases, numbered_posting
from stockyard.registry.lookups import image_update
from stockyard.registry.scans import as_text, write_csv
from stockyard.settings import STANDARD, SUPPLIER
from stockyard.sources import buckets, layouts
from stockyard.sources.store import append_run, read_runs, repeat_run, rewrite_snapshot, scan_store, write_report
from stockyard.staging import new_folder, stage
from stockyard.streaming.file_drop import import_drops

# Small batches, so that the feed has both good and bad ones.
_ROWS = 20
_BUCKETS = 16

_VERDICTS = f"""
SELECT ord // {_ROWS} AS batch_id, COUNT(*) AS rows_read,
  COUNT(CASE WHEN item_sale_price IS NULL THEN 1 END) AS rows_bad,
  COUNT(CASE WHEN item_sale_price IS NULL THEN 1 END) = 0 AS accepted,
  CASE WHEN COUNT(CASE WHEN item_sale_price IS NULL THEN 1 END) > 0
       THEN 'item_total_sale_price' END AS reason
FROM ordered GROUP BY ord // {_ROWS}
"""


def _batched(t: Tables) -> DataFrame:
    return with_batch(with_line_totals(t.ordered), _ROWS)


@query(
    "batch_accept",
    f"""SELECT ord, item_code, o.ord // {_ROWS} AS batch_id,
    CASE WHEN accepted THEN 'accepted' ELSE 'quarantine' END AS verdict
    FROM ordered o JOIN ({_VERDICTS}) v ON o.ord // {_ROWS} = v.batch_id""",
)
def batch_accept(t: Tables) -> DataFrame:
    rows = _batched(t)
    verdicts = stage(acceptance.batch_verdicts(rows), "verdicts")
    good = acceptance.accepted_rows(rows, verdicts).withColumn("verdict", F.lit("accepted"))
    bad = acceptance.quarantined_rows(rows, verdicts).withColumn("verdict", F.lit("quarantine"))
    return good.unionByName(bad).select("ord", "item_code", "batch_id", "verdict")


@query(
    "run_log",
    f"""SELECT 'standard import' AS step, batch_id,
    CASE WHEN accepted THEN 'completed' ELSE 'failed' END AS status, rows_read,
    CASE WHEN accepted THEN rows_read ELSE 0 END AS rows_posted, reason
    FROM ({_VERDICTS}) v""",
)
def run_log(t: Tables) -> DataFrame:
    return acceptance.run_log(acceptance.batch_verdicts(_batched(t)), "standard import")


@query(
    "item_codes",
    "SELECT ord, CAST(CAST(100000000000 AS BIGINT) + ord AS VARCHAR) AS avz_item_code FROM ordered",
)
def item_codes(t: Tables) -> DataFrame:
    """Twelve digits, so that the codes last for any number of rows."""
    return with_item_code(t.ordered.select("ord"), digits=12)


_SECRET, _DIGITS = 20_250_101, 12


def _shuffled_sql() -> str:
    """The rounds of shuffled codes as nested statements."""
    columns = 10 ** (_DIGITS // 2)
    rows = 9 * 10 ** (_DIGITS - 1) // columns
    sql = f"SELECT ord, ord // {columns} AS r, ord % {columns} AS c FROM ordered"
    for number in round_numbers(_SECRET):
        for part, other, size in (("r", "c", rows), ("c", "r", columns)):
            kept = f"ord, {other}, ({other} + {number}) % {PRIME} AS m, {part} AS old"
            sql = f"""SELECT ord, {other},
              (old + (m * m + 48271 * m + {number}) % {PRIME}) % {size} AS {part}
              FROM (SELECT {kept} FROM ({sql}) a) b"""
    first = 10 ** (_DIGITS - 1)
    return f"SELECT ord, CAST({first} + r * {columns} + c AS VARCHAR) AS avz_item_code FROM ({sql}) z"


@query("item_codes_shuffled", _shuffled_sql())
def item_codes_shuffled(t: Tables) -> DataFrame:
    """Codes of twelve digits that show no order, for every row of the feed."""
    return with_item_code(t.ordered.select("ord"), digits=_DIGITS, secret=_SECRET)


_ITEM_SOURCES = (
    "item_code", "item_name", "item_quantity", "item_cost_price", "item_purchase_price",
    "item_sale_price", "expiry", "item_batch_number", "avz_item_code",
)


@query(
    "append_tables",
    """SELECT 'purchases' AS table_name, 'r1' AS run_id, COUNT(DISTINCT batch_id) AS stored_rows
      FROM posted
    UNION ALL SELECT 'purchase_items', 'r1', COUNT(*) FROM posted WHERE expiry_ok
    UNION ALL SELECT 'inventory_movements', 'r1', 3 * COUNT(*) FROM posted WHERE expiry_ok""",
)
def append_tables(t: Tables) -> DataFrame:
    """Purchases, items and movements written twice under one run id, and the purchases once
    more by themselves; stored once.

    The rows are looked up once, by the columns they are made of, and their totals worked out
    again for each table.
    """
    ids = ["purchase_id", "transfer_id", "product_id"]
    rows = stage(numbered_posting(t).select(*ids, "vat_value", *_ITEM_SOURCES), "posted")
    rows = with_line_totals(rows)
    tables = {
        "purchases": stage(batch_purchases(t), "purchases"),
        "purchase_items": posting.purchase_items(rows, STANDARD, RUN_TIME, keep=("purchase_id",)),
        "inventory_movements": posting.movements(rows, STANDARD, RUN_TIME),
    }
    root = new_folder(t.spark, "store")
    append_run(tables, root, "r1")
    repeat_run(tables, root, "r1")
    append_run({"purchases": tables["purchases"]}, root, "r1")
    stored = None
    for name in tables:
        counted = read_runs(t.spark, root, name).groupBy("run_id").agg(
            F.count(F.lit(1)).alias("stored_rows")
        )
        part = counted.select(F.lit(name).alias("table_name"), "run_id", "stored_rows")
        stored = part if stored is None else stored.unionByName(part)
    return stored


@query(
    "rewrite_by_key",
    """SELECT c.id, c.code, COALESCE(i.url, 'old') AS image_url_new
    FROM catalogue c LEFT JOIN (
      SELECT * FROM (SELECT TRIM(product_code) AS code, TRIM(image_url) AS url,
        ROW_NUMBER() OVER (PARTITION BY TRIM(product_code) ORDER BY ord DESC) AS place
        FROM image_sheet WHERE product_code IS NOT NULL AND image_url IS NOT NULL) s
      WHERE place = 1) i ON c.code = i.code""",
)
def rewrite_by_key(t: Tables) -> DataFrame:
    """The updated catalogue as a new version, read back."""
    return rewrite_snapshot(image_update(t), new_folder(t.spark, "catalogue"), "2")


@query(
    "rewrite_buckets",
    """WITH told AS (
      SELECT TRIM(product_code) AS code, TRIM(image_url) AS url, ord FROM image_sheet
      WHERE product_code IS NOT NULL AND image_url IS NOT NULL AND ord % 3 = 0),
    news AS (SELECT code, ARG_MAX(url, ord) AS url FROM told GROUP BY code)
    SELECT c.id, c.code, n.url AS image_url_new FROM catalogue c LEFT JOIN news n ON c.code = n.code""",
)
def rewrite_buckets(t: Tables) -> DataFrame:
    """A catalogue in buckets, of which a sheet rewrites those that it touches, read back.

    The first update tells a third of the images, the column comes with it.
    """
    root, sheet = new_folder(t.spark, "catalogue"), t.view("image_sheet").where("ord % 3 = 0")
    buckets.write_buckets(t.view("catalogue").select("id", "code"), root, "1", "code", _BUCKETS)
    codes = updates.image_rows(sheet).select(F.col("product_code").alias("code"))
    buckets.update_buckets(t.spark, root, "2", codes, "code", lambda part: updates.update_images(part, sheet))
    return buckets.read_buckets(t.spark, root, ["id", "code", "image_url_new"])


@query(
    "add_missing_columns",
    f"""SELECT id, code, {amount("cost", "cash_discount")}, {amount("NULL", "cash_dis2")},
    {amount("NULL", "cash_dis3")}, {amount("cost", "credit_dis2")},
    {amount("NULL", "credit_dis3")} FROM catalogue""",
)
def add_missing_columns(t: Tables) -> DataFrame:
    discount = F.col("cost").cast("decimal(10,4)")
    products = t.view("catalogue").withColumns({"cash_discount": discount, "credit_dis2": discount})
    return updates.add_missing_columns(products).select(
        "id", "code", "cash_discount", "cash_dis2", "cash_dis3", "credit_dis2", "credit_dis3"
    )


_PRODUCT_REPORT = ["total_quantity", "total_cost_price", "total_sale_price"]


@query(
    "report_sink",
    f"""SELECT item_code AS product_code, item_name AS product_name,
    {sums(total_quantity="item_quantity", total_cost_price="item_cost_price",
          total_sale_price="item_sale_price")}
    FROM feed WHERE item_code IS NOT NULL AND item_name IS NOT NULL
    GROUP BY item_code, item_name""",
)
def report_sink(t: Tables) -> DataFrame:
    """The product report as parquet, read back."""
    items = t.feed.select(
        F.col("item_code").alias("product_code"),
        F.col("item_name").alias("product_name"),
        F.col("item_quantity").alias("quantity"),
        F.col("item_cost_price").alias("cost_price"),
        F.col("item_sale_price").alias("sale_price"),
    )
    path = new_folder(t.spark, "report")
    write_report(reporting.product_report(items), path, "parquet")
    return scan_store(t.spark, path)


def post_supplier_drop(rows: DataFrame) -> DataFrame:
    """Purchases per file and supplier of the rows that a drop brought."""
    lines = with_line_totals(cleaning.drop_null_key(layouts.typed(rows)))
    return posting.purchases_per_supplier(
        lines, SUPPLIER, RUN_TIME, ["ord"], within=("source_file",)
    )


_DROP_SUMS = ["total", "total_sale", "total_tax", "grand_total"]


@query(
    "file_drop_stream",
    f"""SELECT supplier_id, MIN(supplier_name) AS supplier, COUNT(*) AS items_read,
    {sums(total="item_total_cost_price", total_sale="item_total_sale_price",
          total_tax="item_total_vat", grand_total="item_total_after_vat")}
    FROM lines WHERE supplier_id IS NOT NULL GROUP BY supplier_id""",
)
def file_drop_stream(t: Tables) -> DataFrame:
    """The feed dropped as CSV files, posted per file by the stream, summed per supplier."""
    # Rows carry few enough digits to make one stored amount per file exact to 5 places.
    dropped = write_csv(as_text(t.feed, layouts.SUPPLIER), "drops")
    target, checkpoint = new_folder(t.spark, "posted"), new_folder(t.spark, "stream")
    import_drops(t.spark, dropped, layouts.SUPPLIER, post_supplier_drop, target, checkpoint)
    return t.spark.read.parquet(target).groupBy("supplier_id").agg(
        F.min("supplier").alias("supplier"),
        F.sum("items_read").alias("items_read"),
        *[F.sum(c).alias(c) for c in _DROP_SUMS],
    )
