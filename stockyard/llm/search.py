"""Ranked lexical search by pipelined term partitioning.

The terms that the items ask for are dealt to owners by weight, the rarest first, so an
owner holds the postings of its terms. Items travel in bundles: a bundle of one block of
documents starts with no scores, visits the owners one after another, and at each of them
meets (by cogroup) the owner's postings of its block, whose integer gains are added to the
bundle's sparse accumulators, a score per document seen so far. After the last owner a
bundle holds its best documents, and the best of all blocks are selected.

A block is a share of the documents by hash, so neither a term that a third of all
documents hold nor an item that matches all of them meets in one task. Between owners an
accumulator is let go only if it cannot win: if its score and the largest gains that the
owners ahead can still add stay below the scores that enough other documents of its block
have already. The result is that of the full sum.

What is broadcast is one bit per slot of a table of ``SLOTS``, which tells terms that
no item asks for; terms that share a slot are told apart by a join later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockyard.llm.frames import quoted
from stockyard.llm.words import Words, find_words, slices
from stockyard.staging import stage

OWNERS = 4
# Documents of a block and items of a bundle, about.
BLOCK_DOCS = 8192
BUNDLE_ITEMS = 256
# Slots of the prefilter: the most that is broadcast, in bits.
SLOTS = 1 << 22
# Bytes of text that a task takes apart at once.
_SLICE = 1 << 19

# Bytes of terms: digits, letters and all of other code points; A-Z in lower case.
_FOLD = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _FOLD[_low : _high + 1] = np.arange(_low, _high + 1)
_FOLD[0x41:0x5B] += 0x20

_BUNDLE = "cell int, item bigint, terms binary, owners binary, bounds binary, at binary, ids binary, known binary, scores binary"

_SCORED = "item bigint, at bigint, id bigint, known boolean, score bigint"


def find_terms(texts: pa.Array) -> Words:
    """The terms of each text, folded; a null text has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, bounds, buffer = texts.buffers()
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    folded = pa.py_buffer(_FOLD[data])
    return find_words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, bounds, folded], 0, texts.offset))


def _slot(terms: np.ndarray) -> np.ndarray:
    return (terms.astype(np.uint64) >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def _counted(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and how often it occurs there, for each different term of each text."""
    terms = words.hashes().view(np.int64)
    text = np.repeat(np.arange(len(words.offsets) - 1), words.counts())
    order = np.lexsort((terms, text))
    terms, text = terms[order], text[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], terms[first], np.diff(np.append(first, len(terms)))


def search(
    docs: DataFrame,
    items: DataFrame,
    most: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    owners: int = OWNERS,
    block_docs: int = BLOCK_DOCS,
    bundle_items: int = BUNDLE_ITEMS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score``: the best ``most`` documents per item.

    Weights and scores are integers, as the module says. Rows of one id are documents, or
    items, of their own; a document without an id comes before the others of its score. An
    item without a term, or whose terms no document holds, has no rows; neither have
    scores of 0, such as those of terms that every document holds often enough to weigh 0.
    Other columns are not read. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    asked = stage(_item_terms(items, item_key, item_text), "item-terms")
    slots = asked.select(F.explode("slots").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    wanted = np.zeros(SLOTS, bool)
    wanted[slots] = True
    found = stage(_postings(docs, key, text, spark.sparkContext.broadcast(np.packbits(wanted))), "postings", ["kind"])
    sizes = found.where("kind = 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    blocks = max(1, -(-sizes.docs // block_docs))
    bundles = max(1, -(-asked.count() // bundle_items))
    gains = _owned(found.where("kind = 1"), asked, sizes.docs, sizes.terms or 1, owners, blocks, bundles)
    travelling = _bundles(asked, gains, blocks, bundles)
    for owner in range(owners):
        mine = gains.where(F.col("owner") == owner).select("cell", "at", "id", "term", "gain")
        travelling = _visit(travelling, mine, owner, most, last=owner == owners - 1)
    doc = F.when(F.col("known"), F.col("id"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), doc.asc_nulls_first(), "at")
    ranked = travelling.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    names = asked.select("item", F.col("id").alias("name"))
    return ranked.join(names, "item").select(F.col("name").alias(item_key), "rank", doc.alias(key), "score")


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """A row per item with a term: its number, its id, and its different terms."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 33
        for batch in batches:
            owner, terms, _ = _counted(find_terms(batch.column("text")))
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.int64()))
            slots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_slot(terms), pa.int64()))
            numbers = pa.array(np.arange(following, following + batch.num_rows), pa.int64())
            yield pa.record_batch({"item": numbers, "id": batch.column("id"), "terms": lists, "slots": slots})
            following += batch.num_rows

    plain = items.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    rows = plain.mapInArrow(read, f"item bigint, id {kind}, terms array<bigint>, slots array<bigint>")
    return rows.where(F.size("terms") > 0)


def _postings(docs: DataFrame, key: str, text: str, wanted) -> DataFrame:
    """Of kind 0 a row per document that has a term, with ``n``, all its terms; of kind 1 a
    row per document and term that an item may ask for, with ``tf``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 33
        slots = np.unpackbits(wanted.value).view(bool)
        for batch in batches:
            for piece in slices(batch, "text", _SLICE):
                words = find_terms(piece.column("text"))
                owner, terms, tf = _counted(words)
                keep = slots[_slot(terms)]
                whole = np.flatnonzero(words.counts())
                rows = np.concatenate([whole, owner[keep]])
                kind = np.repeat(np.array([0, 1], np.int32), [len(whole), int(keep.sum())])
                yield pa.record_batch(
                    {
                        "kind": pa.array(kind),
                        "at": pa.array(rows + following, pa.int64()),
                        "id": piece.column("id").take(pa.array(rows)),
                        "n": pa.array(words.counts()[rows], pa.int64()),
                        "term": pa.array(np.concatenate([np.zeros(len(whole), np.int64), terms[keep]])),
                        "tf": pa.array(np.concatenate([np.zeros(len(whole), np.int64), tf[keep]]), pa.int64()),
                    }
                )
                following += piece.num_rows

    plain = docs.select(F.col(quoted(key)).cast("bigint").alias("id"), F.col(quoted(text)).alias("text"))
    return plain.mapInArrow(read, "kind int, at bigint, id bigint, n bigint, term bigint, tf bigint")


def _owned(
    postings: DataFrame, asked: DataFrame, docs: int, length: int, owners: int, blocks: int, bundles: int
) -> DataFrame:
    """Postings with what they add, by the owner of their term, for each bundle that asks."""
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asking = asked.select(F.explode("terms").alias("term"), _bundle_of(bundles).alias("bundle"))
    asking = asking.groupBy("term").agg(F.collect_set("bundle").alias("bundles"))
    weight = F.floor(1000 * F.ln((F.lit(2.0) * docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    terms = stage(counted.join(asking, "term").select("term", "bundles", weight.cast("bigint").alias("weight"),
                                                      "df"), "owned-terms")
    shares = [i / owners for i in range(1, owners)]
    # Terms count by their postings, so owners hold about as many each. Weights are whole
    # and below 1000 times the logarithm of the documents, so few are told apart.
    ends = terms.agg(F.percentile("weight", shares, F.col("df"))).first()[0] if shares else None
    owner = sum([F.when(F.col("weight") < F.lit(e), 1).otherwise(0) for e in ends or []], F.lit(0))
    norm = F.expr(f"{100 - 90} + (90 * n * {docs}L) DIV {length}L")
    gain = F.expr("weight * ((1000000000L * tf) DIV (1000 * tf + 8 * norm))")
    rows = postings.join(terms.select("term", "weight", "bundles", owner.alias("owner")), "term")
    rows = rows.withColumn("norm", norm).select(
        "owner", F.explode("bundles").alias("bundle"), "at", "id", "term", gain.alias("gain")
    )
    cell = F.col("bundle") * blocks + F.pmod(F.xxhash64("at"), F.lit(blocks))
    rows = rows.where("gain > 0").select("owner", cell.cast("int").alias("cell"), "at", "id", "term", "gain")
    return stage(rows, "gains", ["owner"])


def _bundle_of(bundles: int):
    return F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int")


def _bundles(asked: DataFrame, gains: DataFrame, blocks: int, bundles: int) -> DataFrame:
    """A row per item and block of documents: its terms, their owners and largest gains."""
    most = gains.groupBy("term").agg(F.first("owner").alias("owner"), F.max("gain").alias("bound"))
    each = asked.select("item", F.explode("terms").alias("term")).join(most, "term")
    grouped = each.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", "owner", "bound"))).alias("plan"))
    empty = F.lit(b"")
    rows = grouped.select(_bundle_of(bundles).alias("bundle"), "item", "plan").mapInArrow(
        _packed, "bundle int, item bigint, terms binary, owners binary, bounds binary"
    )
    first = F.col("bundle") * blocks
    return rows.select(
        F.explode(F.sequence(first, first + (blocks - 1))).alias("cell"), "item", "terms", "owners", "bounds",
        *[empty.alias(c) for c in ("at", "ids", "known", "scores")],
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans = [[[x[c] for x in plan] for c in ("term", "owner", "bound")] for plan in batch.column("plan").to_pylist()]
        kinds = {"terms": np.int64, "owners": np.int32, "bounds": np.int64}
        packed = {
            name: pa.array([np.array(p[i], kind).tobytes() for p in plans], pa.binary())
            for i, (name, kind) in enumerate(kinds.items())
        }
        yield pa.record_batch({"bundle": batch.column("bundle"), "item": batch.column("item"), **packed})


def _visit(bundles: DataFrame, postings: DataFrame, owner: int, most: int, last: bool) -> DataFrame:
    """Bundles after an owner: its gains are added, and what cannot win any more is let go.

    After the last owner a row per accumulator that is left.
    """

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [_accumulators(row) for row in left.select(_HELD).to_pylist()]
        at, term = (right.column(c).to_numpy() for c in ("at", "term"))
        ids = right.column("id")
        known = ids.is_valid().to_numpy()
        ids, gain = ids.fill_null(0).to_numpy(), right.column("gain").to_numpy()
        every = np.concatenate([at, *[h["at"] for h in held]])
        docs, where = np.unique(every, return_inverse=True)
        doc_id, doc_known = np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)
        doc_id[where] = np.concatenate([ids, *[h["ids"] for h in held]])
        doc_known[where] = np.concatenate([known, *[h["known"] for h in held]])
        order = np.argsort(term, kind="stable")
        term, gain, place = term[order], gain[order], where[: len(at)][order]
        scores, following = np.zeros(len(docs), np.int64), len(at)
        results = []
        for h in held:
            mine = where[following : following + len(h["at"])]
            following += len(mine)
            scores[mine] = h["scores"]
            terms = h["terms"][h["owners"] == owner]
            low, high = np.searchsorted(term, terms), np.searchsorted(term, terms, side="right")
            for a, b in zip(low, high):
                scores[place[a:b]] += gain[a:b]
            results.append(_best(scores, int(h["bounds"][h["owners"] > owner].sum()), docs, doc_id, doc_known, most))
            scores[:] = 0
        if last:
            return _opened(left.column("item").to_numpy(), results)
        columns = {c: pa.array([r[i].tobytes() for r in results], pa.binary()) for i, c in enumerate(_SCORES)}
        return pa.table({**{c: left.column(c) for c in left.column_names if c not in columns}, **columns})

    grouped = bundles.groupBy("cell").cogroup(postings.groupBy("cell"))
    return grouped.applyInArrow(add, _SCORED if last else _BUNDLE)


_KINDS = {
    "terms": np.int64, "owners": np.int32, "bounds": np.int64,
    "at": np.int64, "ids": np.int64, "known": bool, "scores": np.int64,
}
_HELD, _SCORES = list(_KINDS), ["at", "ids", "known", "scores"]


def _accumulators(row: dict) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(row[name], kind) for name, kind in _KINDS.items()}


def _best(scores, rest, docs, doc_id, known, most):
    """The accumulators that may still be among the best ``most``.

    ``rest`` is the most that any of them, or any other document, can still gain.
    """
    seen = np.flatnonzero(scores)
    if len(seen) > most:
        reached = np.partition(scores[seen], -most)[-most]
        seen = seen[scores[seen] + rest >= reached]
    if not rest and len(seen) > most:
        order = np.lexsort((docs[seen], doc_id[seen], known[seen], -scores[seen]))
        seen = seen[order[:most]]
    return docs[seen], doc_id[seen], known[seen], scores[seen]


def _opened(items: np.ndarray, results: list) -> pa.Table:
    """A row per accumulator."""
    many = [len(r[0]) for r in results]
    columns = [np.concatenate([np.zeros(0, _KINDS[c]), *[r[i] for r in results]]) for i, c in enumerate(_SCORES)]
    names = ("item", "at", "id", "known", "score")
    values = [np.repeat(items, many), *columns]
    return pa.table({n: pa.array(v) for n, v in zip(names, values)})


_TERMS = "REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH texts AS (
  SELECT doc_id, {_TERMS} AS t FROM documents
), sizes AS (
  SELECT COUNT(*) AS docs, SUM(LEN(t)) AS length FROM texts WHERE LEN(t) > 0
), postings AS (
  SELECT doc_id, n, term, COUNT(*) AS tf FROM (SELECT doc_id, LEN(t) AS n, UNNEST(t) AS term FROM texts)
  GROUP BY doc_id, n, term
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, UNNEST({_TERMS}) AS term FROM benchmark)
), weights AS (
  SELECT term, CAST(FLOOR(1000 * LN((2 * CAST(docs AS DOUBLE) + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w
  FROM postings, sizes GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), sizes
  GROUP BY item_id, doc_id
)
SELECT item_id, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
