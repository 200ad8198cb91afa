"""Token ids as binary shards in id order, with Elias-Fano boundaries, and their reader.

A shard is one row of a Parquet file: the ids of consecutive documents in one array of
two or four bytes per id, the end of each document in it, and the document ids, both as
Elias-Fano lists. A row of ``offsets`` per shard says how many ids stand before it.
Shards are cut at quantiles of the document id, so each row of text moves once, and a
shard is closed at ``SHARD_IDS`` ids, so no writer holds more than one shard and one
document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockyard.llm.frames import quoted
from stockyard.llm.succinct import EliasFano
from stockyard.llm.tokens import TEXT_BYTES, encoder
from stockyard.llm.words import slices
from stockyard.staging import new_folder

SHARD_IDS = 1 << 20
# Most bytes of text per range of document ids, as far as the ids allow.
RANGE_BYTES = 1 << 24

_SHARD = "range int, shard int, n_docs bigint, n_ids bigint, base bigint, docs binary, ends binary, ids binary"


def id_ranges(df: DataFrame, key: str, text: str) -> np.ndarray:
    """Ends of ranges of ``key`` that hold about ``RANGE_BYTES`` of text each at most.

    There is a range per shuffle partition at least. One number per range comes from an
    approximate quantile over one light column.
    """
    size = df.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    ranges = max(int(size // RANGE_BYTES) + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    accuracy = max(10_000, 20 * ranges)
    ends = df.agg(F.percentile_approx(quoted(key), shares, accuracy)).first()[0] if shares else None
    return np.unique(np.array(ends or [], np.int64))


def write_shards(
    df: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = 0
) -> None:
    """Encodes every whole text, appends ``end`` and writes shards in ascending ``key`` order.

    A null text counts as empty: its document is the end id alone. Rows of one key stand
    next to each other, ordered by their ids, so reruns agree; rows without a key come last.
    Other columns are left out. An empty table writes no shard.
    """
    df = df.select(F.col(quoted(key)).cast("bigint").alias("key"), F.col(quoted(text)).alias("text"))
    ranges = id_ranges(df, "key", "text")

    def encode(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            for piece in slices(batch, "text", TEXT_BYTES):
                keys = piece.column("key")
                known = keys.is_valid().to_numpy(zero_copy_only=False)
                number = np.searchsorted(ranges, keys.fill_null(0).to_numpy(), side="left")
                number = np.where(known, number, len(ranges) + 1)
                ids, bounds = coder.encode_all(piece.column("text"), end)
                bounds = (bounds * coder.dtype.itemsize).astype(np.int32)
                held = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids))]
                yield pa.record_batch(
                    {
                        "range": pa.array(number, pa.int32()),
                        "key": keys,
                        "ids": pa.Array.from_buffers(pa.binary(), piece.num_rows, held),
                    }
                )

    def write(batches):
        coder = encoder(vocabulary)
        held, current, shard = [], None, 0
        size = 0
        for batch in batches:
            for number, key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                new = number != current or (held and (held[0][0] is None) != (key is None))
                if held and (new or size + len(ids) > SHARD_IDS * coder.dtype.itemsize):
                    yield packed(held, current, shard, coder.dtype)
                    held, size, shard = [], 0, shard + 1
                if number != current:
                    current, shard = number, 0
                held.append((key, ids))
                size += len(ids)
        if held:
            yield packed(held, current, shard, coder.dtype)

    def packed(held, number, shard, dtype):
        keys, ids = zip(*held)
        base = keys[0]
        docs = None if base is None else EliasFano.of(np.array([k - base for k in keys])).to_bytes()
        ends = np.cumsum([len(i) // dtype.itemsize for i in ids])
        columns = {
            "range": pa.array([number], pa.int32()),
            "shard": pa.array([shard], pa.int32()),
            "n_docs": pa.array([len(keys)], pa.int64()),
            "n_ids": pa.array([int(ends[-1])], pa.int64()),
            "base": pa.array([base], pa.int64()),
            "docs": pa.array([docs], pa.binary()),
            "ends": pa.array([EliasFano.of(ends).to_bytes()], pa.binary()),
            "ids": pa.array([b"".join(ids)], pa.binary()),
        }
        return pa.record_batch(columns)

    spark = df.sparkSession
    encoded = df.mapInArrow(encode, "range int, key bigint, ids binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(ranges) + 2)
    ordered = encoded.repartition(parts, "range").sortWithinPartitions("range", "key", "ids")
    ordered.mapInArrow(write, _SHARD).write.option("compression", "zstd").parquet(f"{path}/shards")
    # One row per shard: at most one per MiB of ids and two per range and partition.
    sizes = spark.read.parquet(f"{path}/shards").select("range", "shard", "n_ids")
    before = Window.orderBy("range", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    starts.write.parquet(f"{path}/offsets")


def read_shards(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """A row per document: key, ``start`` (ids before it), ``n_tokens`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    return _read(spark, path, key, digest=False)


def read_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """As :func:`read_shards`, with the crc32 of the ids in place of the ids."""
    return _read(spark, path, key, digest=True)


def _read(spark: SparkSession, path: str, key: str, digest: bool) -> DataFrame:
    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                yield unpacked(shard)

    def unpacked(shard):
        count = shard["n_docs"]
        ids = np.frombuffer(shard["ids"], f"<u{len(shard['ids']) // shard['n_ids']}").astype("<u4")
        ends = EliasFano.from_bytes(shard["ends"]).values()
        starts = np.concatenate([[0], ends[:-1]])
        if shard["docs"] is None:
            keys = pa.nulls(count, pa.int64())
        else:
            keys = pa.array(EliasFano.from_bytes(shard["docs"]).values() + shard["base"], pa.int64())
        texts = [ids[a:b] for a, b in zip(starts, ends)]
        return pa.record_batch(
            {
                "range": pa.array(np.full(count, shard["range"], np.int32)),
                "shard": pa.array(np.full(count, shard["shard"], np.int32)),
                "key": keys,
                "inside": pa.array(starts, pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()),
                "ids": pa.array([zlib.crc32(t) for t in texts], pa.int64())
                if digest
                else pa.array([t.tobytes() for t in texts], pa.binary()),
            }
        )

    kind = "bigint" if digest else "binary"
    schema = f"range int, shard int, key bigint, inside bigint, n_tokens bigint, ids {kind}"
    rows = spark.read.parquet(f"{path}/shards").mapInArrow(read, schema)
    starts = spark.read.parquet(f"{path}/offsets").select("range", "shard", "start")
    return rows.join(starts, ["range", "shard"]).select(
        F.col("key").alias(key),
        (F.col("start") + F.col("inside")).alias("start"),
        "n_tokens",
        F.col("ids").alias("ids_crc32" if digest else "ids"),
    )


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes shards to a new folder of the shared store and reads their digests back."""
    path = new_folder(df.sparkSession, "token-shards")
    write_shards(df, path, vocabulary, key, text)
    return read_digests(df.sparkSession, path, key)
