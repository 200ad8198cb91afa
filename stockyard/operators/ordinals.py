"""Row positions, batches and new ids, without ever numbering rows in one task.

Rows are first laid out in order and written with a sequence number that is
increasing inside each part. Only the part sizes, one row per part, pass through
an un-partitioned window; their running total, staged as well, is added back to every
row, so that a reader of the result neither sorts nor counts again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.settings import BATCH_ROWS, ITEM_CODE_DIGITS
from stockyard.staging import stage

# monotonically_increasing_id holds the partition above the row's place in it.
_ROW_BITS = 33

# Shuffled codes: rounds, a prime whose square fits a BIGINT, and digits of rows and columns
# below it.
_ROUNDS = 4
PRIME = 2_147_483_647
_MOST_DIGITS = 18


def _sorted(df: DataFrame, keys: Sequence[str | Column], partitions: int | None) -> DataFrame:
    """Rows in order, in ranges of all keys; as many as the session shuffles to by default."""
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str | Column],
    name: str = "ord",
    stage_as: str = "ordered",
    partitions: int | None = None,
    only_sorted_by: Sequence[str] = (),
) -> DataFrame:
    """Adds the position of each row, from 0, under the given sort keys.

    The sort is range partitioned on all keys, so one hot first key does not have to
    fit a single task. Where many rows may share all keys, end the list with a
    column that tells them apart, such as path and row index of the source file. The
    sorted rows are staged, and every later reader sees the same positions.
    ``partitions`` says into how many ranges rows are sorted, one per GiB or so. Columns of
    ``only_sorted_by`` are not kept.
    """
    ranked = _sorted(df, keys, partitions).withColumn("_seq", F.monotonically_increasing_id())
    placed = stage(ranked.drop(*only_sorted_by), stage_as)
    part = F.shiftright("_seq", _ROW_BITS)
    row = F.col("_seq").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = placed.withColumns({"_part": part, "_row": row})

    sizes = numbered.groupBy("_part").agg((F.max("_row") + 1).alias("_rows"))
    starts = stage(_running_start(sizes, Window.orderBy("_part")), f"{stage_as}-starts")
    # One row per sort partition.
    located = numbered.join(F.broadcast(starts.drop("_rows")), "_part")
    return located.withColumn(name, F.col("_start") + F.col("_row")).drop(
        "_seq", "_part", "_row", "_start"
    )


def file_marks() -> list[Column]:
    """The file and file split of a scanned row, to be selected next to its columns."""
    return [
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ]


def with_file_ordinal(
    marked: DataFrame, name: str = "ord", per_file: bool = False, stage_as: str = "read"
) -> DataFrame:
    """Adds the position of each row in its input, files taken in path order.

    ``marked`` is a file scan with :func:`file_marks`. With ``per_file`` the count
    starts again in every file. The numbering itself shuffles no row: positions are
    found from the size of each file split, whose table Spark broadcasts or joins by
    its measured size.
    """
    split = ["source_file", "_block"]
    placed = stage(marked.withColumn("_seq", F.monotonically_increasing_id()), stage_as)
    sizes = placed.groupBy(*split).agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    starts = _running_start(sizes, Window.partitionBy("source_file").orderBy("_block"))
    if not per_file:
        files = sizes.groupBy("source_file").agg(F.sum("_rows").alias("_rows"))
        offsets = _running_start(files, Window.orderBy("source_file")).select(
            "source_file", F.col("_start").alias("_offset")
        )
        starts = starts.join(offsets, "source_file").withColumn(
            "_start", F.col("_start") + F.col("_offset")
        )
    starts = stage(starts, f"{stage_as}-starts")
    located = placed.join(starts.select(*split, "_first", "_start"), split)
    position = F.col("_start") + F.col("_seq") - F.col("_first")
    return located.withColumn(name, position).drop("_block", "_seq", "_first", "_start")


def _running_start(sizes: DataFrame, window) -> DataFrame:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def with_batch(df: DataFrame, rows: int = BATCH_ROWS, ordinal: str = "ord") -> DataFrame:
    """Adds ``batch_id``: consecutive slices of ``rows`` rows, from 0."""
    return df.withColumn("batch_id", F.expr(f"{ordinal} div {rows}"))


def next_id(stored: DataFrame, first: int | None = None) -> Column:
    """``first`` where it is known, else one more than the largest stored id, as a scalar
    subquery."""
    if first is not None:
        return F.lit(first).cast("bigint")
    return stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint") + 1).scalar()


def with_new_ids(
    df: DataFrame, stored: DataFrame, keys: Sequence[str | Column], first: int | Column | None = None
) -> DataFrame:
    """Adds ids, from ``first`` on or above the stored ones, handed out in the order of ``keys``.

    New rows are few beside the feed they were found in; staged, they are sorted without
    a second pass over it.
    """
    numbered = with_ordinal(stage(df, "new-rows"), keys, name="_ord", stage_as="new-ids")
    start = first if isinstance(first, Column) else next_id(stored, first)
    return numbered.select((start + F.col("_ord")).alias("id"), *df.columns)


def with_item_code(
    df: DataFrame,
    name: str = "avz_item_code",
    digits: int = ITEM_CODE_DIGITS,
    used: int = 0,
    ordinal: str = "ord",
    secret: int | None = None,
) -> DataFrame:
    """Adds a code of ``digits`` digits, unique over the run; running out is an error.

    With a ``secret`` the codes show no order: the position is shuffled over the whole range
    of codes, one to one, so codes stay unique over runs that go on with ``used`` and are
    the same when a run is repeated.
    """
    first = 10 ** (digits - 1)
    place = F.lit(used).cast(T.LongType()) + F.col(ordinal)
    spent = F.raise_error(F.lit(f"all item codes of {digits} digits are used"))
    found = place if secret is None else shuffled_place(place, digits, secret)
    code = (F.lit(first).cast(T.LongType()) + found).cast("string")
    return df.withColumn(name, F.when(place < 9 * first, code).otherwise(spent))


def shuffled_place(place: Column, digits: int, secret: int) -> Column:
    """A place of the codes of ``digits`` digits moved to another one, one to one.

    The 9 * 10**(digits - 1) places are a grid of rows and columns. In each of some rounds
    the row is turned by a number that hangs on the column and the secret, and then the
    column by one that hangs on the row. A turn can be undone, so no two places meet.
    """
    if not 2 <= digits <= _MOST_DIGITS:
        raise ValueError(f"codes of 2 to {_MOST_DIGITS} digits can be shuffled")
    columns = 10 ** (digits // 2)
    rows = 9 * 10 ** (digits - 1) // columns

    def turned(grid: Column, number: Column) -> Column:
        row = (grid["row"] + _scrambled(grid["column"], number)) % rows
        column = (grid["column"] + _scrambled(row, number)) % columns
        return F.struct(row.alias("row"), column.alias("column"))

    parts = F.struct(F.call_function("div", place, F.lit(columns)).alias("row"), (place % columns).alias("column"))
    return F.aggregate(
        F.array(*[F.lit(n).cast(T.LongType()) for n in round_numbers(secret)]),
        parts,
        turned,
        lambda grid: grid["row"] * columns + grid["column"],
    )


def round_numbers(secret: int) -> list[int]:
    """A number below the prime for each round."""
    return [(secret * (2 * i + 3) + 7919 * (i + 1)) % PRIME for i in range(_ROUNDS)]


def _scrambled(value: Column, number: Column) -> Column:
    """A number that follows from ``value``, in whole arithmetic that stays within 64 bits."""
    mixed = (value + number) % PRIME
    return (mixed * mixed + 48271 * mixed + number) % PRIME
