"""Standard import: purchases by batch, with a transfer to the destination."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.measures import with_sale_vat
from stockyard.operators import acceptance, cleaning, lookups, posting, registration, reporting
from stockyard.operators.ordinals import next_id, with_batch, with_new_ids
from stockyard.settings import NO_IDS, STANDARD, Posting
from stockyard.staging import stage


def standard_import(
    feed: DataFrame,
    products: DataFrame,
    stored_purchases: DataFrame,
    stored_transfers: DataFrame,
    run_time: datetime,
    settings: Posting = STANDARD,
    ids: Mapping[str, int] = NO_IDS,
) -> dict[str, DataFrame]:
    """Tables posted by one feed of the standard layout, typed and with ``ord``.

    A row without a code or an amount refuses its batch. Products are registered from
    every batch, also from one that is refused later. Rows are staged, with the columns of
    items only, once they are accepted and looked up; every table is made of them. ``ids`` has
    the first id of tables whose ids were reserved; the others go on after the stored ones.
    """
    rows = with_batch(with_sale_vat(feed), settings.batch_rows)
    rows = cleaning.with_strict_expiry(rows).withColumn("avz_item_code", F.col("item_ascon_code"))
    unknown = registration.products_last_in_first_batch(rows, products)
    new_products = with_new_ids(unknown, products, ["code"], ids.get("products"))
    catalogue = products.select("id", "code").unionByName(new_products.select("id", "code"))

    required = ("item_code", *acceptance.REQUIRED)
    verdicts = stage(acceptance.batch_verdicts(rows, required), "verdicts")
    good = acceptance.accepted_rows(rows, verdicts)
    totals = stage(posting.batch_totals(good), "totals")
    purchase_id = next_id(stored_purchases, ids.get("purchases")) + F.col("batch_id")
    transfer_id = next_id(stored_transfers, ids.get("transfers")) + F.col("batch_id")
    purchases = posting.purchases_per_batch(totals, settings, run_time).withColumn(
        "id", purchase_id
    )
    transfers = posting.transfers(totals, settings, run_time).withColumn("id", transfer_id)

    bought = good.filter("expiry_ok").select(
        *posting.item_sources(settings, "avz_item_code", "item_total_vat", "item_total_after_vat", "vat_value")
    )
    posted = stage(lookups.with_product_id(bought, catalogue, spread_by=["ord"]), "posted")
    posted = with_sale_vat(with_batch(posted, settings.batch_rows))
    posted = posted.withColumns({"purchase_id": purchase_id, "transfer_id": transfer_id})
    items = posting.purchase_items(posted, settings, run_time, keep=("purchase_id", "ord"))
    report = reporting.purchase_report(purchases, items)
    return {
        "products": new_products,
        "purchases": purchases,
        "transfers": transfers,
        "purchase_items": items,
        "transfer_items": posting.transfer_items(
            posted, settings, run_time, keep=("transfer_id", "ord")
        ),
        "inventory_movements": posting.movements(posted, settings, run_time, keep=("ord",)),
        "quarantine": acceptance.left_out(
            acceptance.quarantined_rows(rows, verdicts), "batch refused"
        ).unionByName(acceptance.left_out(good.filter("NOT expiry_ok"), "no date")),
        "run_log": acceptance.run_log(verdicts, "standard import", run_time),
        "report": reporting.with_grand_total(report),
    }
