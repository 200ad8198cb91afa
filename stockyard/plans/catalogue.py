"""Catalogue jobs: priced products, image links and discounts."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.operators import acceptance, cleaning, lookups, registration, reporting, updates
from stockyard.operators.ordinals import with_batch, with_new_ids, with_ordinal
from stockyard.settings import BATCH_ROWS, NO_IDS
from stockyard.staging import stage


def register_priced_products(
    feed: DataFrame,
    products: DataFrame,
    file_columns: list[str],
    run_time: datetime | None = None,
    batch_rows: int = BATCH_ROWS,
    ids: Mapping[str, int] = NO_IDS,
) -> dict[str, DataFrame]:
    """New products of a supplier feed, those already stored beside their stored values,
    and the counts of both. ``feed`` has ``ord``.

    The first row of each code as written counts, and batches are made of these rows. A
    code that is no number refuses its batch; a missing code is passed over.
    """
    rows = cleaning.fill_price_zero(cleaning.drop_all_null(feed, file_columns))
    columns = ["ord", "item_name", "item_cost_price", "item_sale_price"]
    first = cleaning.keep_first(rows, "item_code", ["ord"], columns)
    first = with_ordinal(first.withColumnRenamed("ord", "file_ord"), ["file_ord"])
    first = with_batch(first, batch_rows)
    coded = cleaning.with_integer_code(first, "item_code", "code")
    readable = F.col("item_code").isNull() | F.col("code").isNotNull()
    coded = coded.withColumn("readable_code", F.when(readable, F.lit(True)))

    verdicts = stage(acceptance.batch_verdicts(coded, ["readable_code"]), "verdicts")
    good = acceptance.accepted_rows(coded, verdicts)
    new_products = registration.products_priced(good, products, ["ord"], "code")
    return {
        "products": with_new_ids(new_products, products, ["code"], ids.get("products")),
        "comparison": lookups.compare_existing(
            cleaning.keep_first(good, "code", ["ord"], ["item_name", "item_cost_price"]),
            products,
            "code",
            "item_name",
            "item_cost_price",
        ),
        "counters": reporting.import_counters(
            cleaning.with_integer_code(rows, "item_code"), products
        ),
        "quarantine": acceptance.quarantined_rows(coded, verdicts),
        "run_log": acceptance.run_log(verdicts, "priced products", run_time),
    }


def apply_images(products: DataFrame, sheet: DataFrame) -> dict[str, DataFrame]:
    """The catalogue with new image links, and the counts of the sheet."""
    return {
        "products": updates.update_images(products, sheet),
        "counters": updates.image_counters(products, sheet),
    }


def apply_discounts(products: DataFrame, sheet: DataFrame) -> dict[str, DataFrame]:
    """The catalogue with new discounts, and the counts of the sheet."""
    return {
        "products": updates.update_discounts(products, sheet),
        "counters": updates.discount_counters(products, sheet),
    }
