"""Row filters, defaults and duplicate handling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.functions import dates, numbers, text
from stockyard.settings import DEFAULT_BATCH_NUMBER, DEFAULT_ITEM_NAME


def drop_all_null(df: DataFrame, file_columns: Sequence[str]) -> DataFrame:
    """Rows with at least one file column filled."""
    return df.dropna(how="all", subset=list(file_columns))


def drop_null_key(df: DataFrame, key: str = "item_code") -> DataFrame:
    """Rows that have a key."""
    return df.filter(F.col(key).isNotNull())


def fill_price_zero(
    df: DataFrame, columns: Sequence[str] = ("item_cost_price", "item_sale_price")
) -> DataFrame:
    """Missing prices, NaN included, become 0."""
    return numbers.nan_to_null(df).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns}
    )


def fill_text_defaults(df: DataFrame) -> DataFrame:
    """Missing batch numbers and item names get their default text."""
    return df.fillna({"item_batch_number": DEFAULT_BATCH_NUMBER, "item_name": DEFAULT_ITEM_NAME})


def strip_thousands(
    df: DataFrame, columns: Sequence[str], number_type=numbers.PRICE, strict: bool = True
) -> DataFrame:
    """Money text such as 1,234.50 as numbers.

    With ``strict`` a cell that is no number fails the job, which refuses the whole
    file; otherwise such a cell becomes null and batch acceptance decides.
    """
    read = numbers.parse_grouped_or_fail if strict else numbers.parse_grouped
    return df.withColumns({c: read(F.col(c), number_type) for c in columns})


def with_first_code(df: DataFrame, source: str, target: str = "item_code") -> DataFrame:
    """The first of the codes that one cell may list."""
    return df.withColumn(target, text.first_token(F.col(source)))


def with_integer_code(df: DataFrame, source: str, target: str = "item_code") -> DataFrame:
    """Numeric codes as integer text."""
    return df.withColumn(target, text.integer_text(F.col(source)))


def trim_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys without blanks at either end."""
    return df.withColumns({c: text.strip(F.col(c)) for c in columns})


def with_slug(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds the slug of a name."""
    return df.withColumn("slug", text.slug(F.col(name)))


def coerce_numeric(
    df: DataFrame, key: str, columns: Sequence[str], number_type=numbers.PRICE
) -> DataFrame:
    """Numbers from text, null where it does not parse; rows without a numeric key go.

    :func:`without_numeric_key` gives the rows that go.
    """
    values = {c: numbers.parse(F.col(c), number_type) for c in columns}
    typed = df.withColumns({key: numbers.parse_id(F.col(key)), **values})
    return typed.filter(F.col(key).isNotNull())


def without_numeric_key(df: DataFrame, key: str) -> DataFrame:
    """Rows that :func:`coerce_numeric` leaves out, as they stand."""
    return df.filter(numbers.parse_id(F.col(key)).isNull())


def with_strict_expiry(df: DataFrame, raw: str = "item_expiry_date") -> DataFrame:
    """Adds ``expiry`` and ``expiry_ok``; a filled cell that is no date is not ok."""
    parsed = df.withColumn("expiry", dates.strict_expiry(F.col(raw)))
    return parsed.withColumn("expiry_ok", F.col(raw).isNull() | F.col("expiry").isNotNull())


def drop_bad_expiry(df: DataFrame, raw: str = "item_expiry_date") -> DataFrame:
    """Adds ``expiry`` and drops rows whose cell is filled but is no date."""
    return with_strict_expiry(df, raw).filter("expiry_ok").drop("expiry_ok")


def with_clamped_expiry(df: DataFrame, raw: str = "item_expiry_date") -> DataFrame:
    """Adds ``expiry`` with late years held to 2262; every row stays."""
    return df.withColumn("expiry", dates.clamped_expiry(F.col(raw)))


def keep_first(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key, the first in the stated order; null counts as one key.

    An aggregate, so copies of a hot key are combined before the shuffle. With ``columns``
    and one number as the order, equal values of a key are first reduced to their place by a
    hash aggregate; only what is left of a key is sorted to pick its row.
    """
    return _edge(df, key, order, columns, F.min_by)


def keep_last(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key, the last in the stated order."""
    return _edge(df, key, order, columns, F.max_by)


def _edge(df, key, order, columns, pick) -> DataFrame:
    kept = [c for c in (columns or df.columns) if c != key]
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    if columns and len(order) == 1 and isinstance(df.schema[order[0]].dataType, T.NumericType):
        values, edge = [c for c in kept if c != order[0]], F.min if pick is F.min_by else F.max
        df = df.groupBy(key, *values).agg(edge(position).alias(order[0]))
    chosen = df.groupBy(key).agg(pick(F.struct(*kept), position).alias("_row"))
    return chosen.select(key, "_row.*")


def distinct_values(df: DataFrame, column: str | Column) -> DataFrame:
    """The distinct non-null values of a column."""
    return df.select(column).dropna().distinct()


def members(df: DataFrame, column: str, values: Iterable | DataFrame) -> DataFrame:
    """Rows whose value is in a short list, or in the column of that name of a table."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column), column, "left_semi")
    return df.filter(listed(column, values))


def non_members(df: DataFrame, column: str, values: Iterable | DataFrame) -> DataFrame:
    """The complement of :func:`members`; null is a member of nothing."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column), column, "left_anti")
    return df.filter(~listed(column, values))


def listed(column: str, values: Iterable) -> Column:
    """Whether a value is in a short list; null is not."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def project_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the named columns, under their stored names."""
    return df.select([F.col(old).alias(new) for old, new in names.items()])
