"""Supplier import: one purchase and one pending order per supplier."""

from __future__ import annotations

from calendar import timegm
from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.measures import with_line_totals
from stockyard.operators import acceptance, cleaning, lookups, posting, registration, reporting
from stockyard.operators.ordinals import with_item_code, with_new_ids
from stockyard.settings import ITEM_CODE_DIGITS, NO_IDS, SUPPLIER, Posting
from stockyard.staging import stage


# Columns without which an item cannot be stored, and so refuses its supplier.
REQUIRED = (
    "item_quantity",
    "item_purchase_price",
    "item_cost_price",
    "item_sale_price",
    "item_total_cost_price",
    "item_total_vat",
    "total_sale",
)


def supplier_import(
    feed: DataFrame,
    products: DataFrame,
    stored_purchases: DataFrame,
    stored_orders: DataFrame,
    run_time: datetime,
    settings: Posting = SUPPLIER,
    code_digits: int = ITEM_CODE_DIGITS,
    used_codes: int = 0,
    required: Sequence[str] = REQUIRED,
    ids: Mapping[str, int] = NO_IDS,
) -> dict[str, DataFrame]:
    """Tables posted by one feed of the supplier layout, typed and with ``ord``.

    A supplier is taken or refused as a whole: one of its items lacking a value of
    ``required`` refuses it. Refused rows and those without a code or a supplier go to the
    quarantine. Products are registered from every row that has a code. The reference number is made of
    the run time in seconds; it repeats and is no key. ``ids`` has the first id of tables
    whose ids were reserved.
    """
    number = f"PR-{timegm(run_time.timetuple())}"
    settings = replace(settings, reference_no=number, invoice_number=number)
    lines = cleaning.fill_text_defaults(with_line_totals(feed))
    rows = cleaning.drop_null_key(lines)
    named = rows.filter(F.col("supplier_id").isNotNull())
    verdicts = stage(acceptance.batch_verdicts(named, required, "supplier_id"), "verdicts")
    good = acceptance.accepted_rows(named, verdicts, "supplier_id")
    new_products = with_new_ids(
        registration.products_first(rows, products, ["ord"]), products, ["code"], ids.get("products")
    )
    catalogue = products.select("id", "code").unionByName(new_products.select("id", "code"))

    headers = posting.purchases_per_supplier(good, settings, run_time, ["ord"])
    purchases = with_new_ids(headers, stored_purchases, ["supplier_id"], ids.get("purchases"))
    orders = posting.purchase_orders(
        purchases, stored_purchases, stored_orders, ids.get("purchases"), ids.get("purchase_orders")
    )

    # Looked up are the columns that an item is made of; its totals are worked out again.
    bought = cleaning.with_clamped_expiry(good).select(
        "ord", "supplier_id", "item_code", "item_name", "item_batch_number", "expiry", "item_quantity",
        *dict.fromkeys(["item_cost_price", settings.real_cost_column]), "item_sale_price", "vat_value",
    )
    posted = posting.with_order_ids(lookups.with_product_id(bought, catalogue), orders)
    posted = with_item_code(stage(posted, "posted"), digits=code_digits, used=used_codes)
    posted = with_line_totals(posted)
    items = posting.purchase_items(
        posted, settings, run_time, keep=("purchase_id", "order_id", "ord")
    )
    no_code = lines.filter(F.col("item_code").isNull())
    no_supplier = rows.filter(F.col("supplier_id").isNull())
    refused = acceptance.quarantined_rows(named, verdicts, "supplier_id")
    left_out = acceptance.left_out(refused, "supplier refused")
    for part, reason in ((no_code, "no code"), (no_supplier, "no supplier")):
        left_out = left_out.unionByName(acceptance.left_out(part, reason))
    quarantine = stage(left_out, "quarantine")
    return {
        "products": new_products,
        "purchases": purchases,
        "purchase_orders": orders,
        "purchase_items": items,
        "quarantine": quarantine,
        "run_log": acceptance.run_log(verdicts, "supplier import", run_time, "supplier_id"),
        "counters": quarantine.groupBy("left_out_as").agg(F.count(F.lit(1)).alias("rows_left_out")),
        "report": reporting.with_grand_total(reporting.purchase_report(purchases, items)),
    }
