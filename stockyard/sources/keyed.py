"""Stored tables kept in the order that lookups need them, so that only the feed is shuffled.

A keyed table is bucketed and sorted by its key, and its manifest says how. Joins by the key
read it bucket by bucket: the other side is dealt out to as many partitions, and the stored
side is not moved. Written once and looked up by every run after, that pays; a table with few
rows is broadcast by its size as any other.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.sources.manifest import Manifest, NotStoredError

_KEYED = "keyed"


def write_keyed(df: DataFrame, root: str, version: str, key: str, buckets: int | None = None) -> DataFrame:
    """Writes a version of a keyed table and returns it as read back.

    There are as many buckets as the session shuffles to, if no number is given. Rows with
    a missing key are kept out: they match nothing. What was read is never overwritten.
    """
    spark, attempt, table = df.sparkSession, uuid4().hex, f"stockyard_{uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = df.where(F.col(key).isNotNull()).repartition(buckets, key)
    writer = known.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{root.rstrip('/')}/attempt={attempt}").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")
    line = {"kind": _KEYED, "table": key, "run": version, "attempt": attempt, "bucket": buckets}
    Manifest(spark, root).commit([{**line, "schema": df.schema.json()}])
    return read_keyed(spark, root)


def read_keyed(spark: SparkSession, root: str) -> DataFrame:
    """The version of a keyed table that was committed last."""
    lines = Manifest(spark, root).lines().where(F.col("kind") == _KEYED)
    last = lines.orderBy(F.desc("number")).first()
    if last is None:
        raise NotStoredError(f"no version of {root} has been committed")
    table = f"stockyard_{uuid4().hex}"
    fields = T.StructType.fromJson(json.loads(last.schema)).fields
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY (`{last.table}`) SORTED BY (`{last.table}`) INTO {last.bucket} BUCKETS "
        f"LOCATION '{root.rstrip('/')}/attempt={last.attempt}'"
    )
    found = spark.table(table)
    # The frame knows its files and buckets; the session's catalogue need not.
    spark.sql(f"DROP TABLE {table}")
    return found
