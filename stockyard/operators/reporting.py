"""Reports and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.functions.numbers import money


def purchase_report(
    purchases: DataFrame, items: DataFrame, run_ids: DataFrame | None = None
) -> DataFrame:
    """One line per purchase of the run that has items, with their count and quantity.

    Items are counted per purchase before the join.
    """
    if run_ids is not None:
        purchases = purchases.join(run_ids.select("id"), "id", "left_semi")
    counted = (
        items.filter(F.col("purchase_id").isNotNull())
        .groupBy(F.col("purchase_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("total_items"), money(F.sum("quantity")).alias("total_stock"))
    )
    return purchases.select("id", "date", "total", "total_tax", "grand_total").join(counted, "id")


def in_report_order(report: DataFrame) -> DataFrame:
    """Report lines by date, then id."""
    return report.orderBy("date", "id")


def with_grand_total(report: DataFrame) -> DataFrame:
    """The report with a last line of sums, missing amounts as 0, from one pass over it."""
    sums = ["total_items", "total_stock", "total", "total_tax", "grand_total"]

    def line(column: str) -> Column:
        summed = F.sum(column)
        if column != "total_items":
            summed = money(summed)
        return F.when(F.grouping("id") == 1, F.coalesce(summed, F.lit(0))).otherwise(summed)

    return (
        report.rollup("id")
        .agg(
            F.grouping("id").cast("int").alias("is_total"),
            F.when(F.grouping("id") == 0, F.max("date")).alias("date"),
            *[line(c).alias(c) for c in sums],
        )
        .orderBy("is_total", "date", "id")
    )


def product_report(items: DataFrame) -> DataFrame:
    """Quantity, cost price and sale price summed per product code and name."""
    keyed = items.filter(F.col("product_code").isNotNull() & F.col("product_name").isNotNull())
    return keyed.groupBy("product_code", "product_name").agg(
        money(F.sum("quantity")).alias("total_quantity"),
        money(F.sum("cost_price")).alias("total_cost_price"),
        money(F.sum("sale_price")).alias("total_sale_price"),
    )


def import_counters(feed: DataFrame, products: DataFrame, key: str = "item_code") -> DataFrame:
    """One row: rows loaded and dropped, distinct codes, codes inserted and already stored.

    Codes are counted before the join, so the join sees one row per code.
    """
    counted = feed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = products.select(F.col("code").alias(key)).distinct().withColumn("_stored", F.lit(True))
    has_key = F.col(key).isNotNull()
    return counted.join(known, key, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_loaded"),
        F.coalesce(F.sum(F.when(~has_key, F.col("_n"))), F.lit(0)).alias("rows_dropped"),
        F.count_if(has_key).alias("codes_unique"),
        F.count_if(has_key & F.col("_stored").isNull()).alias("codes_inserted"),
        F.count_if(F.col("_stored").isNotNull()).alias("codes_existing"),
    )
