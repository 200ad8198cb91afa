"""Removal of passages that repeat anywhere, by exact counts of word windows.

A window is a run of ``size`` words of one text. A word goes when a window that covers
it starts with the same word sequence at any other place, in the same text or another.

1. Prefilter. Every window has an anchor: the least hash among the ``ANCHOR``-word runs
   inside it. Equal windows have equal anchors at different places, so a window whose
   anchor occurs once in the corpus is itself unique. Anchors (about one in fifteen
   places) are counted in a count-min sketch; the partitions' sparse sketches are merged
   cell by cell. Cells overestimate counts and never underestimate them, so no repeat is
   lost. What is broadcast is one bit per cell, with ``most_cells`` as its bound.
2. Exact pass. Windows whose anchor may repeat send their 128-bit hash, once per chunk
   of text, to the bucket of that hash, where equal hashes of all chunks meet. A chunk
   gets back those of its hashes that occur twice or more.
3. Texts and replies meet by chunk, and covered words are cut.

A window that a third of all texts share is one entry per chunk in step 2, and no
step holds more than one bucket, one sketch block or one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.frames import added, append, binaries, joined, quoted, unused, without
from stockyard.llm.words import (
    SLICE_BYTES,
    Words,
    find_words,
    mix,
    range_hashes,
    seeded,
    slices,
)
from stockyard.staging import stage

# Words of an anchor, and rows of the sketch.
ANCHOR = 8
DEPTH = 2
# Blocks in which the sketch is merged.
_BLOCKS = 64
_U64 = np.uint64
_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("many", "u1")])


def drop_repeated_windows(
    df: DataFrame,
    column: str = "text",
    size: int = 35,
    most_cells: int = 1 << 30,
    cells: int | None = None,
) -> DataFrame:
    """Adds ``kept_text``, ``n_words`` and ``n_removed`` to every row.

    ``kept_text`` holds the words that stay, joined by one space. A null or empty text has
    no words and an empty ``kept_text``; texts of fewer than ``size`` words keep all of
    them; repeated rows are texts of their own, so each loses what the other repeats.
    Columns that have one of the three names are replaced. ``cells`` sets the counters
    in a row of the sketch; without it there are at least four per expected anchor, up
    to ``most_cells``. A small sketch only lets more windows through to the exact pass.
    """
    df = without(df, "kept_text", "n_words", "n_removed")
    if size < ANCHOR:
        raise ValueError(f"windows have at least {ANCHOR} words")
    chunk, place = unused(df, "chunk"), unused(df, "place")
    texts = _chunked(df, column, chunk, place)
    total = texts.agg(F.sum(F.octet_length(quoted(column)))).first()[0] or 0
    if cells is None:
        cells = 1 << max(12, min(most_cells.bit_length() - 1, (4 * total // 70).bit_length()))
    bits = df.sparkSession.sparkContext.broadcast(_sketch(texts, column, size, cells))
    buckets = max(int(total >> 22), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    replies = _repeated(texts, column, chunk, size, bits, cells, buckets)
    return _cut(df, texts, replies, column, chunk, place, size, bits, cells)


def _chunked(df: DataFrame, column: str, chunk: str, place: str) -> DataFrame:
    """Stages the rows with the number of their chunk and their place in it."""

    def number(batches):
        following = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, column):
                rows = piece.num_rows
                yield append(
                    piece, **{chunk: np.full(rows, following), place: np.arange(rows, dtype=np.int32)}
                )
                following += 1

    schema = added(df, f"{quoted(chunk)} bigint, {quoted(place)} int")
    return stage(df.mapInArrow(number, schema), "chunks")


def _spread(values: np.ndarray, width: int, reduce) -> np.ndarray:
    """``reduce`` over every run of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        values = reduce(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return reduce(values[: len(values) - rest], values[rest:]) if rest else values


def _window_starts(words: Words, size: int) -> np.ndarray:
    """Word indices at which a window lies within one text."""
    counts = np.maximum(words.counts() - size + 1, 0)
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    return words.first[text] + (np.arange(len(text)) - first[text])


def _anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor of each, all runs' hashes, and the places of anchors."""
    starts, hashes = _window_starts(words, size), words.hashes(1)
    if not len(starts):
        return starts, np.zeros(0, _U64), np.zeros(0, _U64), starts
    begin = np.arange(len(hashes) - ANCHOR + 1)
    runs = range_hashes(hashes, begin, begin + ANCHOR, 3) | _U64(1)
    width = size - ANCHOR + 1
    least = _spread(runs, width, np.minimum)
    # A place is an anchor if the largest of the least hashes of the windows around it is its own.
    inside = np.zeros(len(runs) + width - 1, _U64)
    inside[starts + width - 1] = least[starts]
    places = np.flatnonzero(_spread(inside, width, np.maximum) == runs)
    return starts, least[starts], runs, places


def _cells(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    """The counter of each anchor in each row of the sketch, numbered through."""
    shift = _U64(64 - (cells.bit_length() - 1))
    return [(mix(anchors ^ s) >> shift) + _U64(i * cells) for i, s in enumerate(seeded(5, DEPTH))]


def _sketch(texts: DataFrame, column: str, size: int, cells: int) -> np.ndarray:
    """One bit per counter: whether it counted two anchors or more."""
    block = DEPTH * cells // _BLOCKS

    def count(batches):
        held, most = [], 1 << 22
        for batch in batches:
            for piece in slices(batch, column):
                _, _, runs, places = _anchors(find_words(piece.column(column)), size)
                held += _cells(runs[places], cells)
                if sum(map(len, held)) > most:
                    yield sparse(held)
                    held = []
        if held:
            yield sparse(held)

    def sparse(held):
        """The sketch of some texts: numbers of the cells in use, and whether beyond one."""
        cell, times = np.unique(np.concatenate(held), return_counts=True)
        bounds = np.searchsorted(cell, np.arange(_BLOCKS + 1, dtype=_U64) * _U64(block))
        marks = ((cell % _U64(block)) << _U64(1) | (times > 1)).astype("<u4")
        parts = [marks[a:b] for a, b in zip(bounds, bounds[1:])]
        return pa.record_batch(
            {"block": pa.array(np.arange(_BLOCKS, dtype=np.int32)), "marks": binaries(parts)}
        )

    def merge(table: pa.Table) -> pa.Table:
        marks = joined(table.column("marks"), "<u4")
        cell, times = np.unique(marks >> 1, return_counts=True)
        hot = np.zeros(block, bool)
        hot[cell[times > 1]] = True
        hot[(marks >> 1)[(marks & 1).astype(bool)]] = True
        number = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([number], pa.int32()), "bits": binaries([np.packbits(hot)])})

    partial = texts.select(quoted(column)).mapInArrow(count, "block int, marks binary")
    merged = partial.groupBy("block").applyInArrow(merge, "block int, bits binary").collect()
    whole = np.zeros((_BLOCKS, block // 8), np.uint8)
    for number, part in merged:
        whole[number] = np.frombuffer(part, np.uint8)
    return whole.ravel()


def _candidates(words: Words, size: int, bits: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that may repeat, and their 64-bit hashes."""
    starts, anchors, _, _ = _anchors(words, size)
    maybe = np.ones(len(starts), bool)
    for cell in _cells(anchors, cells):
        maybe &= (bits[cell >> _U64(3)] >> (_U64(7) - (cell & _U64(7))).astype(np.uint8)) & 1 == 1
    starts = starts[maybe]
    return starts, range_hashes(words.hashes(1), starts, starts + size, 1)


def _repeated(
    texts: DataFrame, column: str, chunk: str, size: int, bits, cells: int, buckets: int
) -> DataFrame:
    """For each chunk the hashes of its windows that occur twice or more in the corpus."""

    def send(batches):
        for batch in batches:
            for piece in slices(batch, column):
                numbers = piece.column(chunk).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), piece.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    yield entries(piece.slice(a, b - a).column(column), numbers[a])

    def entries(column, number):
        words = find_words(column)
        starts, first = _candidates(words, size, bits.value, cells)
        second = range_hashes(words.hashes(2), starts, starts + size, 2)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        fresh = np.ones(len(first), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(fresh)
        found = np.empty(len(at), _ENTRY)
        found["h1"], found["h2"] = first[at], second[at]
        found["many"] = np.diff([*at, len(first)]) > 1
        bucket = ((found["h1"] >> _U64(32)) * _U64(buckets) >> _U64(32)).astype(np.int32)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)] if len(bucket) else [0]
        parts = [found[a:b] for a, b in zip(edges, edges[1:])]
        return pa.record_batch(
            {
                "bucket": pa.array(bucket[edges[:-1]], pa.int32()),
                "sender": pa.array(np.full(len(parts), number), pa.int64()),
                "entries": binaries(parts),
            }
        )

    def meet(table: pa.Table) -> pa.Table:
        blobs = table.column("entries").to_pylist()
        found = np.frombuffer(b"".join(blobs), _ENTRY)
        sender = np.repeat(table.column("sender").to_numpy(), [len(b) // _ENTRY.itemsize for b in blobs])
        order = np.lexsort((found["h2"], found["h1"]))
        found, sender = found[order], sender[order]
        same = (found["h1"][1:] == found["h1"][:-1]) & (found["h2"][1:] == found["h2"][:-1])
        twice = found["many"].astype(bool)
        twice[1:] |= same
        twice[:-1] |= same
        hashes, sender = found["h1"][twice], sender[twice]
        order = np.argsort(sender, kind="stable")
        hashes, sender = hashes[order], sender[order]
        to, at = np.unique(sender, return_index=True)
        parts = [hashes[a:b] for a, b in zip(at, [*at[1:], len(hashes)])]
        return pa.table({"sender": pa.array(to, pa.int64()), "hashes": binaries(parts)})

    sent = texts.select(quoted(column), quoted(chunk)).mapInArrow(
        send, "bucket int, sender bigint, entries binary"
    )
    return sent.groupBy("bucket").applyInArrow(meet, "sender bigint, hashes binary")


def _cut(df, texts, replies, column, chunk, place, size, bits, cells) -> DataFrame:
    """Joins texts with the replies to their chunk and cuts the words that repeats cover."""

    names = df.columns

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.sort_by(place).combine_chunks()
        batch = pa.RecordBatch.from_arrays(
            [rows.column(c).combine_chunks() for c in rows.column_names], names=rows.column_names
        )
        repeated = np.unique(joined(answers.column("hashes"), "<u8"))
        kept, counts, removed = [], [], []
        for piece in slices(batch, column, SLICE_BYTES):
            words = find_words(piece.column(column))
            starts, hashes = _candidates(words, size, bits.value, cells)
            at = np.minimum(np.searchsorted(repeated, hashes), max(len(repeated) - 1, 0))
            starts = starts[repeated[at] == hashes] if len(repeated) else starts[:0]
            change = np.zeros(len(words.starts) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + size, -1)
            gone = np.cumsum(change[:-1]) > 0
            lost = np.concatenate([[0], np.cumsum(gone)])[words.first]
            counts.append(words.counts())
            removed.append(np.diff(lost))
            for i, (a, b) in enumerate(zip(words.first, words.first[1:])):
                every = words.text(i).split()
                if removed[-1][i]:
                    every = [every[k] for k in np.flatnonzero(~gone[a:b])]
                kept.append(b" ".join(every).decode())
        return pa.table(
            {
                **{c: batch.column(c) for c in names},
                "kept_text": pa.array(kept, pa.string()),
                "n_words": pa.array(np.concatenate(counts), pa.int64()),
                "n_removed": pa.array(np.concatenate(removed), pa.int64()),
            }
        )

    sender = replies.withColumnRenamed("sender", chunk)
    left, right = texts.groupBy(quoted(chunk)), sender.groupBy(quoted(chunk))
    schema = added(df, "kept_text string, n_words bigint, n_removed bigint")
    return left.cogroup(right).applyInArrow(cut, schema)


SQL = """
WITH texts AS (
  SELECT ROW_NUMBER() OVER () AS r, doc_id,
    REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT r, i, ARRAY_TO_STRING(LIST_SLICE(w, i, i + 34), ' ') AS window_text
  FROM (SELECT r, w, UNNEST(RANGE(1, LEN(w) - 33)) AS i FROM texts)
), repeated AS (
  SELECT r, i FROM windows QUALIFY COUNT(*) OVER (PARTITION BY window_text) > 1
), covered AS (
  SELECT DISTINCT r, i + k AS p FROM repeated, RANGE(35) AS steps(k)
), words AS (
  SELECT r, UNNEST(w) AS word, UNNEST(RANGE(1, LEN(w) + 1)) AS p FROM texts
), kept AS (
  SELECT r, STRING_AGG(word, ' ' ORDER BY p) AS kept_text, COUNT(*) AS n_kept
  FROM words ANTI JOIN covered USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words,
  CAST(LEN(w) - COALESCE(n_kept, 0) AS BIGINT) AS n_removed,
  SHA256(COALESCE(kept_text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
