"""Feeds of the registered queries at the stages where several queries pick them up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.measures import with_category_vat, with_line_totals
from stockyard.operators import cleaning, lookups, posting
from stockyard.operators.ordinals import with_batch
from stockyard.registry.core import CATEGORIES, RUN_TIME, Tables
from stockyard.settings import CATEGORY, STANDARD


def supplier_lines(t: Tables) -> DataFrame:
    """Rows with a code and their line totals."""
    return with_line_totals(cleaning.drop_null_key(t.ordered))


def posted_rows(t: Tables) -> DataFrame:
    """Standard flow rows: missing prices as 0, totals, batches, strict expiry."""
    rows = with_line_totals(cleaning.fill_price_zero(t.ordered))
    return cleaning.with_strict_expiry(with_batch(rows)).withColumn(
        "avz_item_code", F.col("item_batch_number")
    )


def numbered_posting(t: Tables) -> DataFrame:
    """Posted rows with product, purchase and transfer ids; bad expiries are gone."""
    rows = posted_rows(t).filter("expiry_ok")
    return lookups.with_product_id(rows, t.view("catalogue"), spread_by=["ord"]).withColumns(
        {"purchase_id": F.col("batch_id") + 1, "transfer_id": F.col("batch_id") + 1}
    )


def batch_purchases(t: Tables) -> DataFrame:
    totals = posting.batch_totals(posted_rows(t))
    return posting.purchases_per_batch(totals, STANDARD, RUN_TIME).withColumn(
        "id", F.col("batch_id") + 1
    )


def category_rows(t: Tables) -> DataFrame:
    """Category flow rows: totals from grouped text, VAT by category, supplier found."""
    sale = cleaning.fill_price_zero(t.ordered, ["item_sale_price"])
    rows = cleaning.strip_thousands(sale, ["item_total_cost_text"]).withColumns(
        {
            "item_total_cost_price": F.col("item_total_cost_text"),
            "item_total_sale_price": F.col("item_sale_price") * F.col("item_quantity"),
        }
    )
    rows = cleaning.with_strict_expiry(with_batch(with_category_vat(rows, CATEGORIES)))
    return lookups.with_supplier_or_default(
        rows.drop("supplier_id"),
        t.view("known_suppliers"),
        "supplier_name",
        CATEGORY.supplier_id,
        CATEGORY.supplier_name,
        ["ord"],
    )


def feed_keys(t: Tables) -> DataFrame:
    """Distinct item codes, supplier names and categories, from one pass over the feed."""
    kinds = ["item_code", "supplier_name", "category"]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("item")) for k in kinds])
    return t.feed.select(F.inline(pairs)).dropna(subset=["item"]).distinct()


def stored_keys(t: Tables) -> DataFrame:
    """Keys of the three stored tables, of the same shape."""
    stored = [
        ("item_code", "catalogue", "code"),
        ("supplier_name", "known_suppliers", "name"),
        ("category", "known_categories", "name"),
    ]
    parts = [
        t.view(view).select(F.lit(kind).alias("kind"), F.col(key).alias("item"))
        for kind, view, key in stored
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
