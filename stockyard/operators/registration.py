"""New products, suppliers and categories found in a feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.functions import numbers, text
from stockyard.operators import cleaning
from stockyard.operators.ordinals import with_new_ids
from stockyard.settings import PRICED_TAX_RATE, STANDARD_TAX_RATE, SupplierDefaults


def _unknown(rows: DataFrame, products: DataFrame) -> DataFrame:
    keyed = rows.filter(F.col("code").isNotNull())
    return keyed.join(products.select("code"), "code", "left_anti")


def products_first(
    feed: DataFrame, products: DataFrame, order: Sequence[str], code: str = "item_code"
) -> DataFrame:
    """Unknown products, the first row of each code; its VAT becomes the tax rate."""
    rows = feed.withColumn("code", F.col(code).cast("string"))
    first = cleaning.keep_first(rows, "code", order, ["item_name", "vat_value"])
    return _unknown(first, products).select(
        "code",
        F.col("item_name").alias("name"),
        F.col("item_name").alias("name_ar"),
        F.col("vat_value").cast(numbers.PERCENT).alias("tax_rate"),
    )


def products_priced(
    feed: DataFrame, products: DataFrame, order: Sequence[str], code: str = "item_code"
) -> DataFrame:
    """Unknown products with cost and price, missing ones as 0, by integer code."""
    rows = cleaning.with_integer_code(cleaning.fill_price_zero(feed), code, "code")
    first = cleaning.keep_first(
        rows, "code", order, ["item_name", "item_cost_price", "item_sale_price"]
    )
    return _unknown(first, products).select(
        "code",
        F.col("item_name").alias("name"),
        F.col("item_name").alias("name_ar"),
        numbers.money(F.col("item_cost_price")).alias("cost"),
        numbers.money(F.col("item_sale_price")).alias("price"),
        F.lit(PRICED_TAX_RATE).cast(numbers.PERCENT).alias("tax_rate"),
    )


def products_by_category(
    feed: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    order: Sequence[str],
    code: str = "item_code",
    group: str = "item_group",
) -> DataFrame:
    """Unknown products, the first row of each code, with the category of their group.

    Groups are stored without blanks around them and looked up so. Of stored categories
    that share a name the one with the largest id counts.
    """
    rows = cleaning.trim_keys(cleaning.with_first_code(feed, code, "code"), [group])
    first = cleaning.keep_first(
        rows, "code", order, ["item_name", "item_cost_price", "item_sale_price", group]
    )
    known = categories.groupBy(F.col("name").alias(group)).agg(F.max("id").alias("category_id"))
    return _unknown(first, products).join(known, group, "left").select(
        "code",
        F.col("code").alias("item_code"),
        F.col("item_name").alias("name"),
        "category_id",
        numbers.money(F.col("item_cost_price")).alias("cost"),
        numbers.money(F.col("item_sale_price")).alias("price"),
    )


def products_last_in_first_batch(
    feed: DataFrame, products: DataFrame, code: str = "item_code"
) -> DataFrame:
    """Unknown products of the standard flow.

    A code is inserted in the first batch that has it, where later rows overwrite
    earlier ones; rows of later batches find the code stored and change nothing.
    """
    rows = feed.select(
        F.col(code).alias("code"),
        "item_name",
        "item_cost_price",
        "item_sale_price",
        (-F.col("batch_id")).alias("_early"),
        "ord",
    )
    chosen = cleaning.keep_last(
        rows, "code", ["_early", "ord"], ["item_name", "item_cost_price", "item_sale_price"]
    )
    return _unknown(chosen, products).select(
        "code",
        F.col("code").alias("item_code"),
        F.col("item_name").alias("name"),
        numbers.money(F.col("item_cost_price")).alias("cost"),
        numbers.money(F.col("item_sale_price")).alias("price"),
        F.lit(None).cast("bigint").alias("category_id"),
        F.lit(STANDARD_TAX_RATE).cast(numbers.PERCENT).alias("tax_rate"),
    )


def new_suppliers(
    feed: DataFrame,
    suppliers: DataFrame,
    key: str = "supplier_name",
    defaults: SupplierDefaults = SupplierDefaults(),
    first: int | None = None,
) -> DataFrame:
    """Unknown suppliers with ids in name order and the constants of a new supplier."""
    names = cleaning.distinct_values(feed.select(F.col(key).alias("name")), "name")
    unknown = names.join(suppliers.select("name"), "name", "left_anti")
    return with_new_ids(unknown, suppliers, ["name"], first).select(
        "id",
        F.lit(defaults.group_id).alias("group_id"),
        F.lit(defaults.group_name).alias("group_name"),
        "name",
        F.col("name").alias("name_ar"),
        F.lit(defaults.company).alias("company"),
        F.lit(defaults.level).cast("int").alias("level"),
        F.lit(None).cast("int").alias("external_id"),
    )


def _category_rows(named: DataFrame) -> DataFrame:
    return named.select(
        "id",
        F.col("name").alias("code"),
        "name",
        text.slug(F.col("name")).alias("slug"),
        F.col("parent_id").cast("bigint").alias("parent_id"),
        F.col("name").alias("description"),
        F.lit(1).alias("category_code"),
    )


def new_categories(
    feed: DataFrame, categories: DataFrame, key: str = "category", first: int | None = None
) -> DataFrame:
    """Unknown top-level categories with ids in name order."""
    names = cleaning.distinct_values(feed.select(F.col(key).alias("name")), "name")
    unknown = names.join(categories.select("name"), "name", "left_anti")
    numbered = with_new_ids(unknown, categories, ["name"], first)
    return _category_rows(numbered.withColumn("parent_id", F.lit(0)))


def new_subcategories(
    feed: DataFrame,
    categories: DataFrame,
    parent: str = "category",
    group: str = "item_group",
    first: Column | None = None,
) -> DataFrame:
    """Unknown (group, parent) pairs whose parent is stored, with ids in pair order.

    Of stored categories that share a parent's name the one with the largest id counts.
    """
    pairs = (
        feed.select(F.col(parent).alias("_parent"), text.strip(F.col(group)).alias("name"))
        .dropna()
        .distinct()
    )
    parents = categories.groupBy(F.col("name").alias("_parent")).agg(
        F.max("id").cast("bigint").alias("parent_id")
    )
    found = pairs.join(parents, "_parent").select("name", "parent_id")
    stored = categories.select("name", F.col("parent_id").cast("bigint").alias("parent_id"))
    unknown = found.join(stored, ["name", "parent_id"], "left_anti")
    return _category_rows(with_new_ids(unknown, categories, ["parent_id", "name"], first))


def last_price(items: DataFrame, code: str = "item_code", order: str = "ord") -> DataFrame:
    """The cost and sale price of the last item of each code."""
    return cleaning.keep_last(
        items.filter(F.col(code).isNotNull()), code, [order], ["item_cost_price", "item_sale_price"]
    ).select(
        F.col(code).alias("code"),
        numbers.money(F.col("item_cost_price")).alias("new_cost"),
        numbers.money(F.col("item_sale_price")).alias("new_price"),
    )
