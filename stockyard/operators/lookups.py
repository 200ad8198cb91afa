"""Joins of a feed with stored tables.

All are equi joins without hints: adaptive execution broadcasts a side whose
measured size is small, and splits skewed partitions of a sorted join otherwise.
Feed keys are reduced to distinct values before a join wherever the result allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.operators.cleaning import distinct_values

# Marks in front of a key and of what stands in for a missing one.
_KEY, _NO_KEY = "=", "#"


def existing_keys(feed: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct feed keys that are stored."""
    return feed.select(*keys).dropna().distinct().join(stored.select(*keys), keys, "left_semi")


def missing_keys(feed: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct feed keys that are not stored; null is no key."""
    return feed.select(*keys).dropna().distinct().join(stored.select(*keys), keys, "left_anti")


def look_up(
    feed: DataFrame,
    stored: DataFrame,
    key: str,
    columns: list[str],
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Left join on a unique stored text key.

    Null keys match nothing, yet a plain left join sends all their rows to one
    partition. ``spread_by`` names feed columns whose hash stands in for a missing key
    instead, behind a mark that no stored key has; a hash gives a repeated task the same
    places, and there are as many places as rows.

    Keys are joined behind a mark, so that both sides are shuffled for the join alone: a
    side that is still dealt out as its aggregate left it is not split where a key is hot.
    A text key is taken back from behind its mark afterwards, not moved a second time.
    """
    known = stored.filter(F.col(key).isNotNull()).select(_marked(F.col(key)).alias("_key"), *columns)
    asked = _marked(F.col(key))
    if spread_by:
        asked = F.coalesce(asked, F.concat(F.lit(_NO_KEY), F.xxhash64(*spread_by).cast("string")))
    keyed = feed.withColumn("_key", asked)
    if not isinstance(feed.schema[key].dataType, T.StringType):
        return keyed.join(known, "_key", "left").drop("_key")
    own = F.when(F.col("_key").startswith(_KEY), F.substring("_key", len(_KEY) + 1, F.length("_key")))
    found = keyed.drop(key).join(known, "_key", "left")
    return found.select(*[own.alias(key) if c == key else c for c in feed.columns], *columns)


def _marked(key: Column) -> Column:
    return F.concat(F.lit(_KEY), key)


def with_product_id(
    feed: DataFrame,
    products: DataFrame,
    key: str = "item_code",
    stored_key: str = "code",
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Adds ``product_id`` by code, null where the code is unknown.

    Of stored products that share a code the one with the smallest id counts.
    """
    known = products.groupBy(F.col(stored_key).alias(key)).agg(F.min("id").alias("product_id"))
    return look_up(feed, known, key, ["product_id"], spread_by)


def with_supplier_or_default(
    feed: DataFrame,
    suppliers: DataFrame,
    key: str,
    default_id: int,
    default_name: str,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Adds supplier id and name by supplier name, else those of the default supplier.

    ``supplier_known`` tells the two apart. Of stored suppliers that share a name the one
    with the smallest id counts.
    """
    known = suppliers.groupBy(F.col("name").alias(key)).agg(F.min("id").alias("_id"))
    found = look_up(feed, known, key, ["_id"], spread_by)
    matched = F.col("_id").isNotNull()
    return found.withColumns(
        {
            "supplier_name": F.when(matched, F.col(key)).otherwise(F.lit(default_name)),
            "supplier_known": matched,
            "supplier_id": F.coalesce(F.col("_id"), F.lit(default_id).cast("bigint")),
        }
    ).drop("_id")


def compare_existing(
    feed: DataFrame, products: DataFrame, key: str, name: str, cost: str
) -> DataFrame:
    """File values beside the stored ones for codes that are stored, with difference flags.

    ``feed`` holds one row per code; of stored products that share a code the one with the
    smallest id counts.
    """
    sheet = feed.select(
        F.col(key).alias("code"), F.col(name).alias("file_name"), F.col(cost).alias("file_cost")
    )
    values = F.struct(F.col("name").alias("stored_name"), F.col("cost").alias("stored_cost"))
    first = products.groupBy("code").agg(F.min_by(values, "id").alias("_stored"))
    return sheet.join(first.select("code", "_stored.*"), "code").withColumns(
        {
            "name_differs": ~F.col("file_name").eqNullSafe(F.col("stored_name")),
            "cost_differs": ~F.col("file_cost").eqNullSafe(F.col("stored_cost")),
        }
    )


def exists_count(codes: DataFrame, products: DataFrame, key: str = "code") -> DataFrame:
    """For each code, how many stored products have it, and whether any does."""
    counted = products.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return distinct_values(codes, key).join(counted, key, "left").select(
        key,
        F.coalesce("_n", F.lit(0)).alias("stored_rows"),
        F.coalesce(F.col("_n") > 0, F.lit(False)).alias("is_stored"),
    )
