"""Batches are taken or refused as a whole."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns without which a batch cannot be posted.
REQUIRED = (
    "item_quantity",
    "item_total_cost_price",
    "item_total_sale_price",
    "item_total_after_vat",
    "item_total_vat",
    "total_sale_vat",
    "total_sale",
)


def _fault(required: Sequence[str]) -> Column:
    """The number of the first required column that a row lacks, else null."""
    faults = [F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(required)]
    return F.coalesce(*faults, F.lit(None).cast("int"))


def batch_verdicts(
    rows: DataFrame,
    required: Sequence[str] = REQUIRED,
    batch: str = "batch_id",
    order: str = "ord",
) -> DataFrame:
    """One row per batch: its rows, bad rows, and the first missing column met.

    The place of a faulty row and the number of its column share one integer, so the
    aggregate has buffers of fixed width and needs no sort; names come in at the end.
    """
    number, kinds = _fault(required), max(1, len(required))
    checked = rows.select(batch, (F.col(order) * kinds + number).alias("_first"))
    found = checked.groupBy(batch).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count("_first").alias("rows_bad"),
        F.min("_first").alias("_first"),
    )
    names = F.array(*[F.lit(c) for c in required]).cast("array<string>")
    return found.select(
        batch,
        "rows_read",
        "rows_bad",
        F.get(names, F.pmod("_first", F.lit(kinds)).cast("int")).alias("reason"),
        (F.col("rows_bad") == 0).alias("accepted"),
    )


def accepted_rows(rows: DataFrame, verdicts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows of batches that were taken."""
    return rows.join(verdicts.filter(~F.col("accepted")).select(batch), batch, "left_anti")


def left_out(rows: DataFrame, reason: str) -> DataFrame:
    """Rows for the quarantine, with the reason why they were not posted."""
    return rows.withColumn("left_out_as", F.lit(reason))


def quarantined_rows(rows: DataFrame, verdicts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows of batches that were refused."""
    return rows.join(verdicts.filter(~F.col("accepted")).select(batch), batch, "left_semi")


def run_log(
    verdicts: DataFrame,
    step: str,
    started: datetime | None = None,
    batch: str = "batch_id",
) -> DataFrame:
    """One line per batch, or per supplier, with its outcome."""
    log = verdicts.select(
        F.lit(step).alias("step"),
        F.col(batch).alias("batch_id"),
        F.when(F.col("accepted"), F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        "rows_read",
        F.when(F.col("accepted"), F.col("rows_read")).otherwise(F.lit(0)).alias("rows_posted"),
        "reason",
    )
    return log if started is None else log.withColumn("started", F.lit(started))
