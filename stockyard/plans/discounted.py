"""Supplier import of discounted goods: one purchase per supplier, prices taken over.

The older variant of the supplier import: VAT is that of one unit, discounts are worked
back from the price after them, and the catalogue takes the prices of what was bought.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.measures import with_discount_backout, with_line_totals_unit_vat, with_plain_item_tax
from stockyard.functions.numbers import MONEY, money
from stockyard.operators import acceptance, cleaning, lookups, posting, registration, updates
from stockyard.operators.ordinals import with_item_code, with_new_ids
from stockyard.plans.supplier import REQUIRED
from stockyard.settings import ITEM_CODE_DIGITS, NO_IDS, SUPPLIER, Posting
from stockyard.staging import stage


def discounted_import(
    feed: DataFrame,
    products: DataFrame,
    stored_purchases: DataFrame,
    stored_orders: DataFrame,
    run_time: datetime,
    settings: Posting = SUPPLIER,
    code_digits: int = ITEM_CODE_DIGITS,
    used_codes: int = 0,
    ids: Mapping[str, int] = NO_IDS,
) -> dict[str, DataFrame]:
    """Tables posted by one feed of the supplier layout with ``item_discount`` and ``ord``.

    A row without a code or a supplier is left out. An item without a value that it needs
    refuses its supplier. One whose date cannot be read still counts in the purchase and is
    not posted. A missing discount is none; one of the whole price has no price before it,
    and counts as nothing in the purchase. ``catalogue`` is the products, new ones included,
    with the cost and price of the last posted item of their code.
    """
    lines = with_plain_item_tax(with_line_totals_unit_vat(cleaning.fill_text_defaults(feed)))
    lines = lines.withColumn("item_discount", F.coalesce("item_discount", F.lit(0)))
    rows = cleaning.drop_null_key(lines)
    named = cleaning.with_strict_expiry(rows.filter(F.col("supplier_id").isNotNull()))
    named = stage(with_discount_backout(named), "discounted")
    verdicts = stage(acceptance.batch_verdicts(named, REQUIRED, "supplier_id"), "verdicts")
    good = acceptance.accepted_rows(named, verdicts, "supplier_id")
    unknown = registration.products_first(rows, products, ["ord"])
    new_products = with_new_ids(unknown, products, ["code"], ids.get("products"))
    catalogue = products.select("id", "code").unionByName(new_products.select("id", "code"))

    headers = posting.purchases_per_supplier(good, settings, run_time, ["ord"])
    discounts = posting.discount_total(good)
    headers = headers.drop("total_discount").join(discounts, "supplier_id", "left").withColumn(
        "total_discount", F.coalesce("total_discount", F.lit(0).cast(MONEY))
    )
    purchases = with_new_ids(headers, stored_purchases, ["supplier_id"], ids.get("purchases"))
    orders = posting.purchase_orders(
        purchases, stored_purchases, stored_orders, ids.get("purchases"), ids.get("purchase_orders")
    )

    posted = lookups.with_product_id(good.filter("expiry_ok"), catalogue)
    posted = with_item_code(posted, digits=code_digits, used=used_codes)
    posted = stage(posting.with_order_ids(posted, orders), "posted")
    own = {
        "item_tax": money(F.col("item_tax")),
        "discount": F.coalesce(F.col("discount_percentage").cast("string"), F.lit("")),
        "item_discount": money(F.col("discount_value")),
        "discount1": money(F.col("discount_value")),
    }
    kept = ("purchase_id", "order_id", "ord")
    items = posting.purchase_items(posted, settings, run_time, keep=(*kept, *[c.alias(f"_{n}") for n, c in own.items()]))
    items = items.select(*[F.col(f"_{c}").alias(c) if c in own else c for c in items.columns if c[0] != "_"])
    priced = updates.update_prices(
        products.unionByName(new_products, allowMissingColumns=True), registration.last_price(posted)
    )
    no_code = acceptance.left_out(lines.filter(F.col("item_code").isNull()), "no code")
    no_supplier = acceptance.left_out(rows.filter(F.col("supplier_id").isNull()), "no supplier")
    refused = acceptance.left_out(acceptance.quarantined_rows(named, verdicts, "supplier_id"), "supplier refused")
    undated = acceptance.left_out(good.filter("NOT expiry_ok"), "no date")
    quarantine = no_code
    for part in (no_supplier, refused, undated):
        quarantine = quarantine.unionByName(part, allowMissingColumns=True)
    return {
        "products": new_products,
        "purchases": purchases,
        "purchase_orders": orders,
        "purchase_items": items,
        "quarantine": quarantine,
        "run_log": acceptance.run_log(verdicts, "discounted import", run_time, "supplier_id"),
        "catalogue": priced,
    }
