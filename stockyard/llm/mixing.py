"""Mixing of sources to target weights, fitted to the word by subset sums.

Each source takes all its documents as often as its target holds its whole size; the
rest of the target is filled with some documents once more. Documents are counted by
their exact length. Every length gives its share of the rest, rounded down; what the
rounding leaves is filled length by length, and the last words by a bounded knapsack over
the remaining counts. Which documents of a length are taken is decided by a seeded hash,
whose limit is found from counts of hash ranges, so a length or source that holds a third
of all rows is never ranked in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockyard.llm.frames import quoted, unused, with_row_id, without
from stockyard.staging import stage

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2
# Hash ranges in which the documents of a length are counted.
_RANGE_BITS = 12
_ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text) -> F.Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("bigint")


def targets(sizes: DataFrame, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from a row per source.

    Sources by code point, null last, weigh 3, 1, 2 and so on; a target stops at ``most``
    times its source's size, and what it leaves goes to the others by weight. Sources that
    stop are those with the smallest size per weight, so running sums in that order give
    the share per weight at which the targets add up.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    limit = F.col("source_size") * float(most)
    weighed = sizes.withColumns({"weight": F.get(weights, place), "limit": limit})
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    until, whole = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) * total - F.coalesce(F.sum("limit").over(until), F.lit(0.0))
    open_weight = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", left / open_weight)
    # The first level below its own source's limit holds for all that follow; levels that
    # stop more sources than need be are lower still.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    found = levels.withColumn("share", F.max(fits).over(whole))
    target = F.least("limit", F.coalesce(F.col("share") * F.col("weight"), F.col("limit")))
    return found.select("source", "source_size", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come to ``rest``.

    Exact where any choice of documents that keeps to the shares is; otherwise the nearest
    sum. Lengths are positive and distinct.
    """
    total = int((lengths * counts).sum())
    if rest <= 0 or not total:
        return np.zeros_like(counts)
    if rest >= total:
        return counts.copy()
    reserve = 8 * int(lengths.max())
    exact = counts * (max(0, rest - reserve) / total)
    take = np.minimum(np.floor(exact).astype(np.int64), counts)
    left = rest - int((take * lengths).sum())
    for i in np.argsort(take - exact, kind="stable"):
        if take[i] < counts[i] and lengths[i] <= left - reserve:
            take[i] += 1
            left -= int(lengths[i])
    return take + _knapsack(lengths, counts - take, left)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """Bounded knapsack: counts whose words come as near to ``room`` as can be."""
    most = room + int(lengths.max())
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    by = np.full(most + 1, -1, np.int64)
    bundles: list[tuple[int, int]] = []
    for i in np.random.default_rng(1).permutation(len(lengths)):
        count, bundle = min(int(counts[i]), most // int(lengths[i])), 1
        while count and not reached[room]:
            size = min(bundle, count)
            weight = size * int(lengths[i])
            fresh = np.flatnonzero(reached[: most + 1 - weight] & ~reached[weight:]) + weight
            reached[fresh] = True
            by[fresh] = len(bundles)
            bundles.append((int(i), size))
            count -= size
            bundle *= 2
    take = np.zeros_like(counts)
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - room))])
    while at:
        i, size = bundles[by[at]]
        take[i] += size
        at -= size * int(lengths[i])
    return take


def _fitted(histogram: pd.DataFrame) -> pd.DataFrame:
    """Copies and extra documents of each length of one source."""
    histogram = histogram.sort_values("size", ignore_index=True)
    size, target = int(histogram["source_size"].iloc[0]), float(histogram["target"].iloc[0])
    copies = int(target // size) if size else 0
    some = (histogram["size"] > 0).to_numpy()
    extra = np.zeros(len(histogram), np.int64)
    if size:
        lengths, counts = (histogram[c].to_numpy(np.int64)[some] for c in ("size", "n"))
        extra[some] = fit(lengths, counts, round(target - copies * size))
    return histogram.assign(copies=copies, extra=extra)[["source", "size", "n", "copies", "extra"]]


def _match(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi join in which nulls are equal."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") if c in on else c for c in right.columns])
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return left.join(renamed, equal, how).drop(*[f"_{c}" for c in on])


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to every row.

    ``copies`` says how often the mix takes the row, 0 to 2, and ``taken`` is that many times
    its size. A null or blank text has size 0 and adds nothing; rows without a source are a
    source of their own. Rows that are equal may stand in for each other; otherwise the
    choice hangs only on the seed, the key and the text, so reruns agree. Columns with a
    name of an added one are replaced.
    """
    df = without(df, *_ADDED)
    row, draw, group = (unused(df, n) for n in ("row", "draw", "group"))
    drawn = F.xxhash64(F.lit(seed), F.col(quoted(key)), F.col(quoted(text)))
    rows = with_row_id(
        df.withColumns({"size": word_count(F.col(quoted(text))), draw: drawn}), row, "sized"
    )
    light = rows.select(
        F.col(quoted(source)).alias("source"),
        "size",
        F.struct(F.col(quoted(draw)).alias("draw"), F.col(quoted(row)).alias("row")).alias("place"),
    ).withColumn("part", F.shiftright("place.draw", 64 - _RANGE_BITS))
    counted = stage(light.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "sizes")
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size"))
    goals = stage(targets(totals), "targets")

    histogram = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    named = _match(histogram, goals, ["source"])
    plan = stage(
        named.groupBy("source").applyInPandas(
            _fitted, "source string, size bigint, n bigint, copies int, extra bigint"
        ),
        "plan",
    )

    same = ["source", "size"]
    running = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    wanted = plan.where("extra > 0 AND extra < n").select(*same, "extra")
    edges = _match(parts, wanted, same).where("before < extra AND before + n >= extra")
    edges = edges.select(*same, "part", (F.col("extra") - F.col("before")).alias("nth"))
    ranked = _match(light, edges, [*same, "part"])
    nth = F.row_number().over(Window.partitionBy(*same, "part").orderBy("place"))
    limits = ranked.withColumn("rank", nth).where("rank = nth").select(*same, F.col("place").alias("limit"))

    chosen = _match(plan, limits, same, "left")
    chosen = _match(chosen, goals, ["source"]).select(
        F.col("source").alias(group), "size", "n", "copies", "extra", "limit", "source_size", "target"
    )
    place = F.struct(F.col(quoted(draw)).alias("draw"), F.col(quoted(row)).alias("row"))
    extra = (F.col("extra") == F.col("n")) | F.coalesce(place <= F.col("limit"), F.lit(False))
    joined = rows.alias("r").join(
        chosen.alias("c"),
        (F.col(f"r.{quoted(source)}").eqNullSafe(F.col(f"c.{quoted(group)}")))
        & (F.col("r.size") == F.col("c.size")),
    )
    copies = F.col("copies") + ((F.col("c.extra") > 0) & extra).cast("int")
    return joined.select(
        *[F.col(f"r.{quoted(c)}") for c in df.columns],
        F.col("r.size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("r.size")).cast("bigint").alias("taken"),
    )
