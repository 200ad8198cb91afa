"""Column names of the feed files, by position, and how text cells become numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.functions import numbers

# Column order of each file layout.
STANDARD = (
    "item_code", "item_name", "item_batch_number", "item_ascon_code", "item_expiry_date",
    "item_quantity", "item_sale_price", "item_total_sale_price", "item_purchase_price",
    "item_total_purchase_price", "item_cost_price", "item_total_cost_price", "vat_value",
    "item_total_vat", "item_total_after_vat",
)
SUPPLIER = (
    "item_code", "item_name", "item_batch_number", "item_expiry_date", "item_quantity",
    "item_purchase_price", "vat_value", "item_cost_price", "item_sale_price", "supplier_id",
    "supplier_name",
)
CATEGORY = (
    "item_code", "item_name", "stock_id", "item_packs_units", "item_quantity", "item_units",
    "item_sale_price", "item_cost_price", "item_purchase_price", "item_total_sale_price",
    "item_total_cost_price", "item_total_purchase_price", "item_batch_number",
    "item_expiry_date", "branch", "store", "supplier", "category", "group",
)
BARCODE = (
    "product_id", "item_name", "product_arabic_name", "item_code", "stock_id",
    "item_packs_units", "item_quantity", "item_units", "item_sale_price", "item_cost_price",
    "item_total_sale_price", "item_total_cost_price", "item_batch_number", "item_expiry_date",
    "branch", "store", "supplier", "category",
)
DISCOUNT = (
    "item_no", "credit_dis", "credit_dis2", "credit_dis3", "cash_dis", "cash_dis2", "cash_dis3",
)
IMAGE = ("product_code", "image_url")

# Fixed value: first cell of the header row that a discount file holds as data.
DISCOUNT_HEADER = "ITEM_NO"

_QUANTITIES = ("item_quantity", "item_packs_units", "item_units")
_IDS = ("supplier_id",)


def as_category(df: DataFrame) -> DataFrame:
    """Rows of the barcode layout with the columns of the category flow.

    The barcode is the code of an item; the id that the file gives to a product is not ours
    and goes. There are no groups, so new products have no category, and no purchase price
    beside the cost.
    """
    missing = [c for c in CATEGORY if c not in df.columns]
    return df.drop("product_id").withColumns({c: F.lit(None).cast("string") for c in missing})


def text_schema(layout: tuple[str, ...]) -> T.StructType:
    """Every column of a layout as text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in layout])


def _number_type(column: str) -> T.DataType | None:
    if column in _QUANTITIES:
        return numbers.QUANTITY
    if column in _IDS:
        return T.LongType()
    if column == "vat_value":
        return numbers.PERCENT
    if "price" in column or "total" in column:
        return numbers.PRICE
    return None


def typed(df: DataFrame, keep_text: Sequence[str] = ()) -> DataFrame:
    """Number columns parsed from text; a cell that does not parse becomes null.

    Columns of ``keep_text`` are left to a reader of their own.
    """

    def read(column: str, number_type: T.DataType) -> Column:
        if isinstance(number_type, T.LongType):
            return numbers.parse_id(F.col(column))
        return numbers.parse(F.col(column), number_type)

    types = {c: _number_type(c) for c in df.columns if c not in keep_text}
    return df.withColumns({c: read(c, t) for c, t in types.items() if t is not None})
