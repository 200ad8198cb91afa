"""Bottom-k fingerprints of word shingles.

A fingerprint keeps the ``k`` smallest distinct hashes of a text's five-word shingles.
Fingerprints of parts merge by keeping the smallest of all; two of them estimate
resemblance and containment of their texts, and one estimates how many distinct shingles
its text has. A text of one to four words has one shingle, itself; a text without words,
or a null one, has none, and is taken as alike to others without words only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.frames import quoted
from stockyard.llm.shards import id_ranges
from stockyard.llm.words import SLICE_BYTES, find_words, shingles

K = 128
WORDS = 5


def sketches(texts: pa.Array, k: int = K, size: int = WORDS) -> list[np.ndarray]:
    """The ``k`` smallest distinct shingle hashes of each text, ascending."""
    words = find_words(texts)
    found = shingles(words, words.hashes(1), size, whole=True)
    return [smallest(found.hashes[a:b], k) for a, b in zip(found.first, found.first[1:])]


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    while len(hashes) > 4 * k:
        # Repeats may leave fewer than k distinct values among the smallest.
        few = np.partition(hashes, 4 * k)[: 4 * k]
        distinct = np.unique(few)
        if len(distinct) > k:
            return distinct[:k]
        hashes = np.unique(hashes)
        break
    return np.unique(hashes)[:k]


def merge(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of several parts taken together."""
    return smallest(np.concatenate([*parts, np.zeros(0, np.uint64)]), k)


def distinct_shingles(sketch: np.ndarray, k: int = K) -> float:
    """How many distinct shingles the text has; exact below ``k``."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) * 2.0**64 / (float(sketch[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated Jaccard likeness of two sketches' texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of the first text's shingles that the second has."""
    if not len(a):
        return 1.0
    like = resemblance(a, b, k)
    mine, other = distinct_shingles(a, k), distinct_shingles(b, k)
    return min(1.0, like * (mine + other) / ((1.0 + like) * mine))


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K) -> DataFrame:
    """Adds the fingerprint of each text as a hex string, replacing a column of that name."""

    @F.pandas_udf("string")
    def of(texts):
        return texts.__class__([to_text(s) for s in sketches(pa.array(texts, pa.string()), k)])

    return df.withColumn(name, of(F.col(quoted(text))))


_RESULT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_in_next double, distinct_shingles double"
)


def edit_report(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited form, a row per document.

    The edited form has the last quarter of the code points replaced by as many first ones
    of the next text in ascending ``key`` order; the last text is followed by the first.
    Null texts count as empty; rows of one key follow each other by a hash of the text,
    rows without a key come last; a table of one row is followed by itself. Other columns are left out.
    """
    df = df.select(
        F.col(quoted(key)).cast("bigint").alias("key"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    ranges = id_ranges(df, "key", "text")
    # Two texts: the first of all, and the first of the rows without a key.
    of_all = df.agg(F.min_by("text", F.struct(F.col("key").isNull(), "key", "tie"))).first()[0]
    keyless = df.where("key IS NULL").agg(F.min_by("text", "tie")).first()[0]

    def place(batches):
        """Ranges of keys; the first rows of a range follow the range before as well.

        Texts travel compressed one by one, which takes less space than Spark's own blocks.
        """
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [pack(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            batch = batch.set_column(1, "text", pa.array(packed, pa.binary()))
            keys = batch.column("key")
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            values = keys.fill_null(0).to_numpy()
            number = np.where(known, np.searchsorted(ranges, values, side="right"), len(ranges) + 1)
            yield piece(batch, number, 0)
            heads = np.flatnonzero(known & np.isin(values, ranges))
            if len(heads):
                yield piece(batch.take(pa.array(heads)), number[heads] - 1, 1)

    def piece(batch, number, tail):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(number, pa.int32()),
                pa.array(np.full(batch.num_rows, tail, np.int32)),
                batch.column("key"),
                batch.column("tie"),
                batch.column("text"),
            ],
            names=["range", "tail", "key", "tie", "text"],
        )

    def pairs(batches) -> Iterator[tuple[int | None, str, str]]:
        """Key, text and following text of every row that is not a tail."""
        held, unpack = None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for number, tail, key, _, packed in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpack(packed).decode()
                if held is not None:
                    yield held[1], held[2], text if held[0] == number else after(held[0])
                held = None if tail else (number, key, text)
        if held is not None:
            yield held[1], held[2], after(held[0])

    def after(number):
        return keyless if number == len(ranges) and keyless is not None else of_all

    def report(batches):
        held, size = [], 0
        for row in pairs(batches):
            held.append(row)
            size += len(row[1])
            if size > SLICE_BYTES // 2:
                yield reported(held)
                held, size = [], 0
        if held:
            yield reported(held)

    def reported(held: Sequence[tuple]):
        keys, texts, following = zip(*held)
        sizes = [len(t) for t in texts]
        edited = [t[: n - n // 4] + f[: n // 4] for t, n, f in zip(texts, sizes, following)]
        # A row's next text is the next row's, but for the last one and at range ends.
        own = sketches(pa.array(texts, pa.string()), k)
        other = [i for i in range(len(texts)) if i + 1 == len(texts) or following[i] is not texts[i + 1]]
        rest = sketches(pa.array([following[i] for i in other], pa.string()), k)
        nexts = dict(zip(other, rest))
        near = [nexts[i] if i in nexts else own[i + 1] for i in range(len(texts))]
        changed = sketches(pa.array(edited, pa.string()), k)
        return pa.record_batch(
            {
                "key": pa.array(keys, pa.int64()),
                "n_chars": pa.array(sizes, pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [to_text(s) for s in own],
                "edited_fingerprint": [to_text(s) for s in changed],
                "near_edited": [resemblance(a, b, k) for a, b in zip(own, changed)],
                "near_next": [resemblance(a, b, k) for a, b in zip(own, near)],
                "contained_in_next": [containment(a, b, k) for a, b in zip(own, near)],
                "distinct_shingles": [distinct_shingles(s, k) for s in own],
            }
        )

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(ranges) + 2)
    placed = df.mapInArrow(place, "range int, tail int, key bigint, tie bigint, text binary")
    ordered = placed.repartition(parts, "range").sortWithinPartitions("range", "tail", "key", "tie")
    return ordered.mapInArrow(report, f"key bigint, {_RESULT}").withColumnRenamed("key", key)
