"""Derived measures, items and movements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions import measures as ops
from stockyard.operators import cleaning, posting
from stockyard.registry.core import CATEGORIES, KEYS, RUN_TIME, Tables, amount, amounts, query
from stockyard.registry.inputs import category_rows, numbered_posting, supplier_lines
from stockyard.settings import CATEGORY, STANDARD

K = ", ".join(KEYS)
_LINE = [
    "item_total_sale_price",
    "total_sale_vat",
    "total_sale",
    "item_total_cost_price",
    "item_total_vat",
    "item_total_after_vat",
]


@query(
    "sale_vat_plain",
    f"""SELECT {K}, {amount("price * vat_value", "total_sale_vat")},
    {amount("price + price * vat_value", "total_sale")}
    FROM (SELECT *, item_sale_price * item_quantity AS price FROM feed) f""",
)
def sale_vat_plain(t: Tables) -> DataFrame:
    total = F.col("item_sale_price") * F.col("item_quantity")
    return ops.with_sale_vat(t.feed.withColumn("item_total_sale_price", total)).select(
        *KEYS, "total_sale_vat", "total_sale"
    )


@query("line_totals", f"SELECT {K}, {amounts(*_LINE)} FROM lines")
def line_totals(t: Tables) -> DataFrame:
    """No total hangs on the place of a row, so the feed is not put in order."""
    return ops.with_line_totals(cleaning.drop_null_key(t.feed)).select(*KEYS, *_LINE)


@query(
    "line_totals_unit_vat",
    f"""SELECT {K}, {amount("item_purchase_price * item_quantity", "item_total_purchase_price")},
    {amount("unit_vat", "item_total_vat")},
    {amount("item_cost_price * item_quantity + unit_vat", "item_total_after_vat")},
    COALESCE(item_batch_number, 'AAA') AS item_batch_number,
    COALESCE(item_name, 'empty product') AS item_name
    FROM (SELECT *, item_cost_price * vat_value * CAST(0.01 AS DECIMAL(3,2)) AS unit_vat
          FROM feed) f""",
)
def line_totals_unit_vat(t: Tables) -> DataFrame:
    rows = cleaning.fill_text_defaults(ops.with_line_totals_unit_vat(t.feed))
    return rows.select(
        *KEYS,
        "item_total_purchase_price",
        "item_total_vat",
        "item_total_after_vat",
        "item_batch_number",
        "item_name",
    )


_CATEGORY = ["item_total_vat", "item_total_after_vat", "total_sale_vat", "total_sale"]


@query("category_vat", f"SELECT {K}, category, {amounts(*_CATEGORY)} FROM category_lines")
def category_vat(t: Tables) -> DataFrame:
    sale = cleaning.fill_price_zero(t.feed, ["item_sale_price"])
    rows = cleaning.strip_thousands(sale, ["item_total_cost_text"]).withColumns(
        {
            "item_total_cost_price": F.col("item_total_cost_text"),
            "item_total_sale_price": F.col("item_sale_price") * F.col("item_quantity"),
        }
    )
    return ops.with_category_vat(rows, CATEGORIES).select(*KEYS, "category", *_CATEGORY)


_BACKOUT = """
SELECT *, CASE WHEN share > 0 THEN after / NULLIF(1 - share, 0) ELSE after END AS before
FROM (SELECT *, CAST(item_cost_price AS DOUBLE) AS after, CAST(item_discount AS DOUBLE) AS share
      FROM feed) f
"""


@query(
    "discount_backout",
    f"""SELECT {K}, before AS price_before_discount,
    CASE WHEN share > 0 THEN before - after ELSE 0 END AS discount_value,
    CASE WHEN share > 0 THEN share * 100 END AS discount_percentage FROM ({_BACKOUT}) b""",
)
def discount_backout(t: Tables) -> DataFrame:
    return ops.with_discount_backout(t.feed).select(
        *KEYS, "price_before_discount", "discount_value", "discount_percentage"
    )


@query(
    "item_tax_plain",
    f"SELECT {K}, {amount('item_cost_price * item_quantity * vat_value', 'item_tax')} FROM feed",
)
def item_tax_plain(t: Tables) -> DataFrame:
    return ops.with_plain_item_tax(t.feed).select(*KEYS, "item_tax")


_NUMBERED = """
SELECT p.*, c.id AS product_id, batch_id + 1 AS purchase_id, batch_id + 1 AS transfer_id
FROM posted p LEFT JOIN catalogue c ON p.item_code = c.code WHERE expiry_ok
"""
_ITEM_SQL = f"""ord, product_id, item_code AS product_code, item_name AS product_name,
  CAST(expiry AS VARCHAR) AS expiry,
  item_batch_number AS batchno, {amount("item_cost_price", "net_unit_cost")},
  {amount("item_quantity", "quantity")}, {amount("unit_sale", "sale_price")},
  {amount("item_purchase_price", "real_unit_cost")}"""
_ITEM = [
    "ord", "product_id", "product_code", "product_name", "expiry", "batchno", "net_unit_cost",
    "quantity", "sale_price", "real_unit_cost",
]
_AMOUNTS = ["item_tax", "subtotal", "totalbeforevat", "main_net"]


@query(
    "item_projection",
    f"""SELECT {_ITEM_SQL}, purchase_id, 32 AS warehouse_id, 'received' AS status,
    {amount("item_total_vat", "item_tax")}, {amount("item_total_cost_price", "subtotal")},
    {amount("item_total_cost_price", "totalbeforevat")},
    {amount("item_total_after_vat", "main_net")} FROM ({_NUMBERED}) n""",
)
def item_projection(t: Tables) -> DataFrame:
    items = posting.purchase_items(
        numbered_posting(t), STANDARD, RUN_TIME, keep=("purchase_id", "ord")
    )
    return items.select(*_ITEM, "purchase_id", "warehouse_id", "status", *_AMOUNTS)


@query(
    "transfer_item_projection",
    f"""SELECT {_ITEM_SQL}, transfer_id, 42 AS warehouse_id, 'completed' AS status,
    {amount("total_sale_vat", "item_tax")}, {amount("total_sale", "subtotal")},
    {amount("item_total_sale_price", "totalbeforevat")}, {amount("total_sale", "main_net")}
    FROM ({_NUMBERED}) n""",
)
def transfer_item_projection(t: Tables) -> DataFrame:
    items = posting.transfer_items(
        numbered_posting(t), STANDARD, RUN_TIME, keep=("transfer_id", "ord")
    )
    return items.select(*_ITEM, "transfer_id", "warehouse_id", "status", *_AMOUNTS)


_MOVE_COLUMNS = """ord, product_id, item_batch_number AS batch_number,
      CAST(expiry AS VARCHAR) AS expiry_date"""


def _move(kind: str, sign: int, place: int, owner: str) -> str:
    return f"""SELECT {_MOVE_COLUMNS}, '{kind}' AS type,
      {amount(f"item_quantity * {sign}", "quantity")}, {place} AS location_id,
      {owner} AS reference_id, {amount("item_cost_price", "net_unit_cost")},
      {amount("unit_sale", "net_unit_sale")} FROM numbered"""


@query(
    "movement_fanout",
    f"""WITH numbered AS ({_NUMBERED})
    {_move("purchase", 1, 32, "purchase_id")} UNION ALL
    {_move("transfer_out", -1, 32, "transfer_id")} UNION ALL
    {_move("transfer_in", 1, 42, "transfer_id")}""",
)
def movement_fanout(t: Tables) -> DataFrame:
    moves = posting.movements(numbered_posting(t), STANDARD, RUN_TIME, keep=("ord",))
    return moves.select(
        "ord", "product_id", "batch_number", "expiry_date", "type", "quantity", "location_id",
        "reference_id", "net_unit_cost", "net_unit_sale",
    )


@query(
    "movement_single",
    f"""SELECT ord, item_code AS product_code, 'purchase' AS type,
    {amount("item_quantity", "quantity")}, 32 AS location_id,
    {amount("item_cost_price", "real_unit_cost")} FROM category_lines
    WHERE item_expiry_date IS NULL OR expiry IS NOT NULL""",
)
def movement_single(t: Tables) -> DataFrame:
    """The category flow moves each item once, and its real cost is the cost price."""
    rows = category_rows(t).filter("expiry_ok").withColumns(
        {
            "product_id": F.lit(None).cast("bigint"),
            "purchase_id": F.col("batch_id") + 1,
            "product_code": F.col("item_code"),
            "avz_item_code": F.lit(None).cast("string"),
        }
    )
    moves = posting.movements(
        rows, CATEGORY, RUN_TIME, with_transfer=False, keep=("ord", "product_code")
    )
    return moves.select(
        "ord", "product_code", "type", "quantity", "location_id", "real_unit_cost"
    )
