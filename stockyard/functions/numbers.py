"""Number types and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stored types of amounts and of catalogue discounts.
MONEY = T.DecimalType(25, 5)
CENTS = T.DecimalType(25, 2)
DISCOUNT = T.DecimalType(10, 4)

# Types that text cells are read into before any arithmetic.
PRICE = T.DecimalType(18, 6)
QUANTITY = T.DecimalType(14, 4)
PERCENT = T.DecimalType(9, 4)
# Wide enough for any id or amount that a cell may hold, before it is checked.
WIDE = T.DecimalType(38, 6)


def money(value: Column) -> Column:
    """A value in the stored type of amounts."""
    return value.cast(MONEY)


def parse(text: Column, number_type: T.DataType = PRICE) -> Column:
    """Text as a number; null where it does not parse."""
    return text.try_cast(number_type)


def parse_id(text: Column) -> Column:
    """Text as a whole number, cut at the point; null where it does not parse."""
    return parse(text, WIDE).try_cast("bigint")


def parse_grouped(text: Column, number_type: T.DataType = PRICE) -> Column:
    """Text with thousands commas as a number; null where it does not parse."""
    return parse(F.replace(text, F.lit(","), F.lit("")), number_type)


def parse_grouped_or_fail(text: Column, number_type: T.DataType = PRICE) -> Column:
    """Like :func:`parse_grouped`, but text that is no number stops the job."""
    number = parse_grouped(text, number_type)
    complaint = F.concat(F.lit("not a number: "), text)
    return F.when(
        text.isNotNull() & number.isNull(), F.raise_error(complaint).cast(number_type)
    ).otherwise(number)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN turned into null in every floating-point column."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    if not floating:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})
