"""Keyed updates of the catalogue, as a new version of the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.functions.numbers import DISCOUNT, WIDE
from stockyard.functions.text import strip
from stockyard.operators.cleaning import coerce_numeric

# Discount columns of the catalogue, and those that old tables lack.
DISCOUNT_COLUMNS = (
    "cash_discount",
    "cash_dis2",
    "cash_dis3",
    "credit_discount",
    "credit_dis2",
    "credit_dis3",
)
ADDED_DISCOUNT_COLUMNS = ("cash_dis2", "cash_dis3", "credit_dis2", "credit_dis3")
_DISCOUNT_LIMIT = 10 ** (DISCOUNT.precision - DISCOUNT.scale)


def add_missing_columns(
    products: DataFrame, columns: Sequence[str] = ADDED_DISCOUNT_COLUMNS
) -> DataFrame:
    """Adds the discount columns that the table lacks, filled with null."""
    absent = [c for c in columns if c not in products.columns]
    return products.withColumns({c: F.lit(None).cast(DISCOUNT) for c in absent})


def _last_rows(sheet: DataFrame, key: str, values: Sequence[str], order: str) -> DataFrame:
    """The last row of each key and how many sheet rows it stands for."""
    return sheet.groupBy(key).agg(
        F.max_by(F.struct(*values), order).alias("_new"), F.count(F.lit(1)).alias("sheet_rows")
    )


def _overwrite(products: DataFrame, news: DataFrame, key: str, targets: dict[str, str]):
    """Products with new values where the key matched; a matched null overwrites too."""
    joined = products.join(news.withColumn("_matched", F.lit(True)), key, "left")
    matched = F.coalesce(F.col("_matched"), F.lit(False))

    def value(column: str) -> Column:
        if column not in targets:
            return F.col(column)
        new = F.col(f"_new.{targets[column]}").cast(products.schema[column].dataType)
        return F.when(matched, new).otherwise(F.col(column)).alias(column)

    return joined.select([value(c) for c in products.columns])


def image_rows(sheet: DataFrame) -> DataFrame:
    """Sheet rows with both cells filled, trimmed."""
    filled = sheet.dropna(subset=["product_code", "image_url"])
    return filled.withColumns(
        {"product_code": strip(F.col("product_code")), "image_url": strip(F.col("image_url"))}
    )


def update_images(products: DataFrame, sheet: DataFrame, order: str = "ord") -> DataFrame:
    """Products with the image link of the last sheet row of their code."""
    rows = image_rows(sheet).withColumnRenamed("product_code", "code")
    if "image_url_new" not in products.columns:
        products = products.withColumn("image_url_new", F.lit(None).cast("string"))
    news = _last_rows(rows, "code", ["image_url"], order).drop("sheet_rows")
    return _overwrite(products, news, "code", {"image_url_new": "image_url"})


def _match_counts(rows: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """Sheet rows per key and whether the key is stored."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("sheet_rows"))
    known = products.select(key).filter(F.col(key).isNotNull()).distinct()
    return counted.join(known.withColumn("_stored", F.lit(True)), key, "left").withColumn(
        "_stored", F.coalesce("_stored", F.lit(False))
    )


def _rows_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("sheet_rows"))), F.lit(0))


def images_not_found(products: DataFrame, sheet: DataFrame) -> DataFrame:
    """Codes of the image sheet without a product, and how many rows name each."""
    rows = image_rows(sheet).groupBy(F.col("product_code").alias("code"))
    return rows.agg(F.count(F.lit(1)).alias("sheet_rows")).join(
        products.select("code").filter(F.col("code").isNotNull()), "code", "left_anti"
    )


def discounts_not_found(products: DataFrame, sheet: DataFrame) -> DataFrame:
    """Item numbers of the discount sheet without a product, and how many rows name each."""
    rows = discount_rows(sheet).groupBy("id").agg(F.count(F.lit(1)).alias("sheet_rows"))
    return rows.join(products.select("id"), "id", "left_anti")


def image_counters(products: DataFrame, sheet: DataFrame) -> DataFrame:
    """One row: sheet rows loaded, updated and not found."""
    rows = image_rows(sheet).withColumnRenamed("product_code", "code")
    return _match_counts(rows, products, "code").agg(
        F.coalesce(F.sum("sheet_rows"), F.lit(0)).alias("rows_loaded"),
        _rows_where(F.col("_stored")).alias("rows_updated"),
        _rows_where(~F.col("_stored")).alias("rows_not_found"),
    )


def discount_rows(sheet: DataFrame) -> DataFrame:
    """Sheet rows with a numeric item number, under stored names, as numbers.

    ``in_error`` marks rows with a value that the stored type cannot hold.
    """
    names = {"cash_dis": "cash_discount", "credit_dis": "credit_discount"}
    renamed = sheet.withColumnsRenamed(names).withColumnRenamed("item_no", "id")
    typed = coerce_numeric(renamed, "id", DISCOUNT_COLUMNS, WIDE)
    too_large = [F.coalesce(F.abs(F.col(c)) >= _DISCOUNT_LIMIT, F.lit(False)) for c in DISCOUNT_COLUMNS]
    checked = typed.withColumn("in_error", F.greatest(*too_large))
    return checked.withColumns({c: F.col(c).try_cast(DISCOUNT) for c in DISCOUNT_COLUMNS})


def update_discounts(products: DataFrame, sheet: DataFrame, order: str = "ord") -> DataFrame:
    """Products with the six discounts of the last good sheet row of their id."""
    rows = discount_rows(sheet).filter(~F.col("in_error"))
    news = _last_rows(rows, "id", DISCOUNT_COLUMNS, order).drop("sheet_rows")
    complete = add_missing_columns(products, DISCOUNT_COLUMNS)
    return _overwrite(complete, news, "id", {c: c for c in DISCOUNT_COLUMNS})


def discount_counters(products: DataFrame, sheet: DataFrame) -> DataFrame:
    """One row: sheet rows loaded, updated, not found and in error."""
    rows = discount_rows(sheet).withColumn("id", F.when(~F.col("in_error"), F.col("id")))
    return _match_counts(rows, products, "id").agg(
        F.coalesce(F.sum("sheet_rows"), F.lit(0)).alias("rows_loaded"),
        _rows_where(F.col("_stored")).alias("rows_updated"),
        _rows_where(F.col("id").isNotNull() & ~F.col("_stored")).alias("rows_not_found"),
        _rows_where(F.col("id").isNull()).alias("rows_in_error"),
    )


def update_prices(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Products with the cost and price of the last posted item of their code."""
    news = prices.select("code", F.struct("new_cost", "new_price").alias("_new"))
    return _overwrite(products, news, "code", {"cost": "new_cost", "price": "new_price"})
