"""Category import: its metadata first, then purchases by batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.measures import in_taxed_category, with_category_vat
from stockyard.operators import acceptance, cleaning, lookups, posting, registration, reporting
from stockyard.operators.ordinals import next_id, with_batch, with_new_ids
from stockyard.settings import CATEGORY, NO_IDS, CategoryRule, Posting, SupplierDefaults
from stockyard.staging import stage

GROUPED_NUMBERS = (
    "item_sale_price",
    "item_cost_price",
    "item_total_sale_price",
    "item_total_cost_price",
)


def category_metadata(
    feed: DataFrame,
    suppliers: DataFrame,
    categories: DataFrame,
    defaults: SupplierDefaults = SupplierDefaults(),
    ids: Mapping[str, int] = NO_IDS,
) -> dict[str, DataFrame]:
    """New suppliers, categories and subcategories of a whole feed.

    Batches do not matter here: each only adds what is missing. ``ids`` has the first id of
    tables whose ids were reserved.
    """
    parents = registration.new_categories(feed, categories, first=ids.get("categories"))
    complete = categories.select("id", "name", "parent_id").unionByName(
        parents.select("id", "name", "parent_id")
    )
    after = None
    if "categories" in ids:
        after = parents.agg(F.coalesce(F.max("id") + 1, F.lit(ids["categories"]).cast("bigint"))).scalar()
    children = registration.new_subcategories(feed, complete, group="group", first=after)
    return {
        "suppliers": registration.new_suppliers(feed, suppliers, "supplier", defaults, ids.get("suppliers")),
        "categories": parents.unionByName(children),
    }


def category_import(
    feed: DataFrame,
    products: DataFrame,
    suppliers: DataFrame,
    categories: DataFrame,
    stored_purchases: DataFrame,
    stored_transfers: DataFrame,
    run_time: datetime,
    settings: Posting = CATEGORY,
    rule: CategoryRule = CategoryRule(),
    ids: Mapping[str, int] = NO_IDS,
    parsed: Callable[[], None] | None = None,
) -> dict[str, DataFrame]:
    """Tables posted by one feed of the category layout, with ``ord``.

    The four grouped number columns are still text here; rows are staged once they are
    parsed, and what follows from them by arithmetic is worked out by each reader. From then on
    ``feed`` is not read, and ``parsed``, if given, is called. Transfers have a header only, and
    each item moves stock once. ``ids`` has the first id of tables whose ids were reserved.
    """
    rows = cleaning.strip_thousands(feed, GROUPED_NUMBERS)
    rows = cleaning.with_strict_expiry(cleaning.with_first_code(rows, "item_code"))
    rows = lookups.with_supplier_or_default(
        rows, suppliers, "supplier", settings.supplier_id, settings.supplier_name, ["ord"]
    )
    rows = stage(rows, "rows")
    if parsed is not None:
        parsed()
    rows = with_batch(with_category_vat(rows, rule), settings.batch_rows)
    rows = rows.withColumn("avz_item_code", F.lit(None).cast("string"))

    unknown = registration.products_by_category(rows, products, categories, ["ord"], group="group")
    new_products = with_new_ids(unknown, products, ["code"], ids.get("products"))
    catalogue = products.select("id", "code").unionByName(new_products.select("id", "code"))

    verdicts = stage(acceptance.batch_verdicts(rows), "verdicts")
    good = acceptance.accepted_rows(rows, verdicts)
    totals = stage(posting.category_totals(good, suppliers, settings), "totals")
    purchase_id = next_id(stored_purchases, ids.get("purchases")) + F.col("batch_id")
    transfer_id = next_id(stored_transfers, ids.get("transfers")) + F.col("batch_id")
    purchases = posting.purchases_category(totals, settings, run_time).withColumn("id", purchase_id)

    taxed = in_taxed_category(rule).alias("_taxed")
    bought = good.filter("expiry_ok").select(*posting.item_sources(settings, taxed))
    posted = stage(lookups.with_product_id(bought, catalogue, spread_by=["ord"]), "posted")
    posted = with_category_vat(with_batch(posted, settings.batch_rows), rule, F.col("_taxed"))
    posted = posted.withColumns({
        "purchase_id": purchase_id, "transfer_id": transfer_id, "avz_item_code": F.lit(None).cast("string"),
    })
    items = posting.purchase_items(posted, settings, run_time, keep=("purchase_id", "ord"))
    return {
        "products": new_products,
        "purchases": purchases,
        "transfers": posting.transfers(totals, settings, run_time).withColumn("id", transfer_id),
        "purchase_items": items,
        "inventory_movements": posting.movements(
            posted, settings, run_time, with_transfer=False, keep=("ord",)
        ),
        "quarantine": acceptance.left_out(
            acceptance.quarantined_rows(rows, verdicts), "batch refused"
        ).unionByName(acceptance.left_out(good.filter("NOT expiry_ok"), "no date")),
        "run_log": acceptance.run_log(verdicts, "category import", run_time),
        "report": reporting.with_grand_total(reporting.purchase_report(purchases, items)),
    }
