"""Derived amounts of a feed line.

Inputs are DECIMAL, so sums do not depend on the order of rows. Amounts keep all
their digits here and are rounded once, when a table is posted. A percentage is
applied as a product with 0.01, which is exact.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.settings import CategoryRule


def hundredth(value: Column) -> Column:
    """Value divided by 100."""
    return value * F.lit(Decimal("0.01"))


def with_sale_vat(df: DataFrame) -> DataFrame:
    """Sale VAT with the rate taken as given, and the sale total including it."""
    sale = F.col("item_total_sale_price")
    vat = sale * F.col("vat_value")
    return df.withColumns({"total_sale_vat": vat, "total_sale": sale + vat})


def with_line_totals(df: DataFrame) -> DataFrame:
    """Sale and cost totals of a line, with cost VAT in percent of the cost total."""
    sale = F.col("item_sale_price") * F.col("item_quantity")
    cost = F.col("item_cost_price") * F.col("item_quantity")
    vat = hundredth(cost * F.col("vat_value"))
    totals = df.withColumns(
        {
            "item_total_sale_price": sale,
            "item_total_cost_price": cost,
            "item_total_vat": vat,
            "item_total_after_vat": cost + vat,
        }
    )
    return with_sale_vat(totals)


def with_line_totals_unit_vat(df: DataFrame) -> DataFrame:
    """Older variant: VAT is that of one unit, and there is a purchase total."""
    cost = F.col("item_cost_price") * F.col("item_quantity")
    vat = hundredth(F.col("item_cost_price") * F.col("vat_value"))
    return with_line_totals(df).withColumns(
        {
            "item_total_purchase_price": F.col("item_purchase_price") * F.col("item_quantity"),
            "item_total_vat": vat,
            "item_total_after_vat": cost + vat,
        }
    )


def in_taxed_category(rule: CategoryRule = CategoryRule()) -> Column:
    """Whether a row's category is a listed one; a missing category is not."""
    return F.coalesce(F.col("category").isin(*rule.categories), F.lit(False))


def with_category_vat(
    df: DataFrame, rule: CategoryRule = CategoryRule(), taxed: Column | None = None
) -> DataFrame:
    """VAT on cost and sale for listed categories only; others keep their totals.

    ``taxed`` tells them apart where the category itself is gone.
    """
    taxed = in_taxed_category(rule) if taxed is None else taxed

    def vat(total: Column) -> Column:
        return F.when(taxed, total * F.lit(rule.rate)).otherwise(F.lit(0))

    cost, sale = F.col("item_total_cost_price"), F.col("item_total_sale_price")
    return df.withColumns(
        {
            "item_total_vat": vat(cost),
            "item_total_after_vat": cost + vat(cost),
            "total_sale_vat": vat(sale),
            "total_sale": sale + vat(sale),
        }
    )


def with_discount_backout(
    df: DataFrame, price: str = "item_cost_price", rate: str = "item_discount"
) -> DataFrame:
    """Price before a discount, the discount itself and its percentage.

    A rate of 1 leaves no price to work back from and gives null.
    """
    after = F.col(price).cast("double")
    share = F.col(rate).cast("double")
    before = F.try_divide(after, F.lit(1.0) - share)
    discounted = share > 0
    return df.withColumns(
        {
            "price_before_discount": F.when(discounted, before).otherwise(after),
            "discount_value": F.when(discounted, before - after).otherwise(F.lit(0.0)),
            "discount_percentage": F.when(discounted, share * 100),
        }
    )


def with_plain_item_tax(df: DataFrame) -> DataFrame:
    """Item tax as cost times quantity times the rate as given."""
    tax = F.col("item_cost_price") * F.col("item_quantity") * F.col("vat_value")
    return df.withColumn("item_tax", tax)
