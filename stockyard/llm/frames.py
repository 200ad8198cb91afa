"""Small helpers shared by the operators: names, staged rows, work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.staging import stage


def unused(df: DataFrame | Sequence[str], name: str) -> str:
    """``name``, with underscores added until no column is called so in any case."""
    columns = df.columns if isinstance(df, DataFrame) else df
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns that an operator is about to add, so that its own meaning holds."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in drop])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_row_id(df: DataFrame, name: str, stage_as: str) -> DataFrame:
    """Adds a unique number per row and stages the result, so that it holds for good.

    Repeated rows and rows without an id are told apart by it.
    """
    return stage(df.withColumn(name, F.monotonically_increasing_id()), stage_as)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While it lasts, jobs that start send Python at most so many rows at once.

    For rows with several whole texts, of which a task holds a batch on either side.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, most)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def added(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` with more fields, given as a DDL text."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def append(batch, **columns) -> pa.RecordBatch:
    """A batch or table with more columns."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, values in columns.items():
        names.append(name)
        arrays.append(values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values))
    return type(batch).from_arrays(arrays, names=names)


def binaries(parts: Sequence[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def joined(column, dtype) -> np.ndarray:
    """The arrays held by a binary column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)
