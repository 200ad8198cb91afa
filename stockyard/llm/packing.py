"""Packing of documents into sequences of bounded length.

A document is cut into full pieces and one shorter rest. Only the histogram of piece
lengths, at most one number per possible length, reaches the driver, where
:mod:`stockyard.llm.cutting` turns it into patterns. Pieces are ranked within their
length by counting per task and summing the counts, so a length that a third of all
pieces share is never sorted or held in one place; each rank then has its sequence and
its offset in a table that is bounded by the sequence length, not by the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockyard.llm.cutting import Pattern, solve
from stockyard.llm.frames import append, quoted, without
from stockyard.llm.tokens import TEXT_BYTES, encoder, ids_crc32
from stockyard.llm.words import slices
from stockyard.staging import stage

_ADDED = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pack(
    df: DataFrame,
    vocabulary: str,
    capacity: int = 1024,
    text: str = "text",
    end: int = 0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """A row per piece of a document: where it starts in it, and where it lies in a sequence.

    Columns in ``keep`` (all but the text, if none are named) go with each piece; those
    with a name of an added column are dropped. A null text counts as empty: its document
    is the end id alone. Repeated rows are documents of their own. An empty table has no
    pieces.
    """
    columns = [c for c in df.columns if c != text] if keep is None else list(keep)
    columns = without(df.select(*map(quoted, columns)), *_ADDED, "task", "rank").columns
    pieces = _pieces(df.select(*map(quoted, columns), F.col(quoted(text)).alias("_text")), vocabulary, capacity, end)
    sizes = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _Places(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["task", "length"]).select(
        *map(quoted, columns), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("rank")).alias("rank"),
    )

    def assign(batches):
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield append(batch.drop_columns(["rank"]), sequence_id=sequence, offset=offset)

    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(assign, f"{fields}, sequence_id bigint, offset bigint")


def _pieces(df: DataFrame, vocabulary: str, capacity: int, end: int) -> DataFrame:
    """Staged pieces, each with its task and its rank among the task's pieces of its length."""
    columns = [c for c in df.columns if c != "_text"]

    def cut(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "_text", TEXT_BYTES):
                ids, bounds = coder.encode_all(part.column("_text"), end)
                ids, sizes = ids.astype("<u4"), np.diff(bounds)
                many = -(-sizes // capacity)
                rows = np.repeat(np.arange(part.num_rows), many)
                start = (np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                length = np.minimum(capacity, sizes[rows] - start)
                at = bounds[rows] + start
                rank = np.empty(len(rows), np.int64)
                for i, n in enumerate(length.tolist()):
                    rank[i] = seen[n]
                    seen[n] += 1
                yield append(
                    part.select(columns).take(pa.array(rows)),
                    start=start, length=length, rank=rank, doc_tokens=sizes[rows],
                    ids_crc32=pa.array([ids_crc32(ids[a : a + n]) for a, n in zip(at, length)], pa.int64()),
                    task=np.full(len(rows), task, np.int64),
                ).select([*columns, "start", "length", "ids_crc32", "doc_tokens", "task", "rank"])
        coder.forget()

    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.select(*map(quoted, columns)).schema)
    schema = f"{fields}, {_PIECE}, task bigint, rank bigint" if columns else f"{_PIECE}, task bigint, rank bigint"
    return stage(df.mapInArrow(cut, schema), "pieces")


class _Places:
    """Sequence and offset by length and rank: runs of ranks that share a slot of a pattern."""

    def __init__(self, patterns: list[Pattern]):
        runs, used, sequence = [], Counter(), 0
        for pattern, times in patterns:
            offset = 0
            for length, copies in sorted(pattern.items(), reverse=True):
                for _ in range(copies):
                    runs.append((length, used[length], sequence, offset))
                    used[length] += times
                    offset += length
            sequence += times
        table = np.array(sorted(runs), np.int64).reshape(-1, 4)
        self.keys = (table[:, 0] << 48) + table[:, 1]
        self.first, self.sequence, self.offset = table[:, 1], table[:, 2], table[:, 3]

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(lengths):
            return lengths, ranks
        run = np.searchsorted(self.keys, (lengths << 48) + ranks, side="right") - 1
        return self.sequence[run] + ranks - self.first[run], self.offset[run]
