"""Near-duplicate classes by Order MinHash and banded alignment.

Texts with the same words form a group first, and one of them stands for all. From each
of these, ``BANDS`` sketches are taken: a sketch orders the three-word shingles, each
labelled with its occurrence, by a random hash, takes the two smallest and keeps them in
the order they have in the text. Two texts share a sketch with a chance that falls with
their edit distance, and blocks that change places lower it, too. A sketch is a band, and
texts that share a band are candidates. Few edits can touch all shingles of a short text, so
it also has bands of two sketches each of its single words.

Within the groups of some bands each text is first aligned with one other, the head of its
group. That links most copies, so of the groups of the other bands only those that hold
several classes are looked at: their members are aligned with the head, where they are not in
its class, and then with drawn heads. In groups that still hold several classes all other
pairs are settled, block by block: a pair in one class needs no test, bounds by length and
common words rule most others out, and the rest are aligned. A pair is a link if the banded
alignment keeps ``least`` of the words of the longer text. Classes are the connected
components of the links.

Rows are staged once in buckets of their number, and so are candidate texts, so that pairs
and verdicts move to texts and not all texts to them. What only the search needs is deleted
when its result is staged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.alignment import similar
from stockyard.llm.components import components
from stockyard.llm.frames import arrow_rows, quoted, unused, without
from stockyard.llm.words import Shingles, find_words, mix, range_hashes, seeded, shingles, slices
from stockyard.staging import Scratch, stage, stage_bucketed

WORDS = 3
LEAST = 0.8
# With a fifth of the words replaced, single ones anywhere, half of the shingles stay, a third of
# those of both texts, and a sketch is shared with a chance of about 0.12: of 64 bands all
# differ for 3 pairs in 10,000.
BANDS = 64
# Texts of at most so many words have these bands as well.
SHORT = 64
SHORT_BANDS = 24
# Bands whose groups are aligned with their heads first.
FIRST_BANDS = 8
# Heads that a group of several classes is given before all its pairs are settled.
HEADS = 1
# Members, and bytes of their texts, in a block of a large group; smaller groups are settled
# so many at a time.
BLOCK = 2048
BLOCK_BYTES = 1 << 25
# Pairs of texts that a task is sent at once.
PAIR_ROWS = 512
# Cells of a text's counts of words, and of pairs of words, and pairs bounded at once.
_CELLS = 512
_COARSE = 64
_PAIRS = 4096
_U64 = np.uint64
_MOST = np.iinfo(np.uint64).max


def _occurrences(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shingle hashes that also tell the first, second, ... occurrence in a text apart."""
    text = np.repeat(np.arange(len(first) - 1, dtype=_U64), np.diff(first))
    own = mix(hashes + text * _U64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return hashes
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
    label = np.empty(len(own), _U64)
    label[order] = (np.arange(len(own)) - run).astype(_U64)
    return np.where(label > 0, mix(hashes + label * _U64(0xD6E8FEB86659FD93)), hashes)


def order_sketches(found: Shingles, count: int) -> np.ndarray:
    """``count`` Order MinHash values of each text that has a shingle; others get zeros."""
    many = np.diff(found.first)
    out = np.zeros((len(many), count), _U64)
    texts = np.flatnonzero(many)
    if not len(texts):
        return out
    begin, sizes = found.first[texts], many[texts]
    labelled = _occurrences(found.hashes, found.first)
    for i, (flip, odd) in enumerate(zip(seeded(11, count), seeded(12, count) | _U64(1))):
        value = (labelled ^ flip) * odd
        place = _smallest(value, begin, sizes)
        value[place] = _MOST
        second = _smallest(value, begin, sizes)
        early, late = np.minimum(place, second), np.maximum(place, second)
        out[texts, i] = mix(labelled[early] * _U64(3) + mix(labelled[late] + _U64(i)))
    return out


def _smallest(value: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place of the smallest value of each text."""
    least = np.minimum.reduceat(value, begin)
    places = np.flatnonzero(value == np.repeat(least, sizes))
    # Equal smallest values of one text: its first place counts.
    return places[np.searchsorted(places, begin)]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _short_bands(hashes: np.ndarray, first: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Bands of two sketches of single words for the texts marked in ``short``."""
    sizes = np.diff(first)
    kept = np.append(0, np.cumsum(sizes[short]))
    singles = Shingles(hashes[np.repeat(short, sizes)], np.arange(kept[-1]), kept)
    pairs = order_sketches(singles, 2 * SHORT_BANDS)
    place = np.arange(SHORT_BANDS, dtype=_U64) + _U64(1 << 32)
    return mix(pairs[:, 0::2] * _U64(5) + mix(pairs[:, 1::2] + place))


def band_table(texts: DataFrame, row: str, column: str, bands: int = BANDS) -> DataFrame:
    """For every text that is not null: a 128-bit hash of its words and its bands."""

    def sketch(batches):
        for batch in batches:
            for piece in slices(batch, column):
                words = find_words(piece.column(column))
                hashes = words.hashes(1)
                bounds = words.first[:-1], words.first[1:]
                found = shingles(words, hashes, WORDS, whole=True)
                keys = np.zeros((piece.num_rows, bands + SHORT_BANDS), _U64)
                keys[:, :bands] = mix(order_sketches(found, bands) + np.arange(bands, dtype=_U64))
                some = words.counts() > 0
                short = words.counts() <= SHORT
                keys[short, bands:] = _short_bands(hashes, words.first, short)
                given = np.ones(keys.shape, bool)
                given[~short, bands:] = False
                ends = np.append(0, np.cumsum(given.sum(1)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(keys[given]))
                yield pa.record_batch(
                    {
                        "row": piece.column(row),
                        "h1": _signed(range_hashes(hashes, *bounds, 1)),
                        "h2": _signed(range_hashes(words.hashes(2), *bounds, 2)),
                        "some": pa.array(some),
                        "bands": lists,
                    }
                )

    known = texts.where(F.col(quoted(column)).isNotNull()).select(quoted(row), quoted(column))
    return known.mapInArrow(sketch, "row bigint, h1 bigint, h2 bigint, some boolean, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``pairs`` with ``linked``: whether their texts are similar enough.

    A row is the ``a`` of a few pairs and meets its text in its bucket; it may be the ``b``
    of very many, so that side is shuffled, texts and pairs, and split where it is hot.
    """

    def align(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sides = []
                for name in ("text_a", "text_b"):
                    words = find_words(part.column(name))
                    hashes = words.hashes(1)
                    sides.append([hashes[a:b].tolist() for a, b in zip(words.first, words.first[1:])])
                linked = [similar(a, b, least) for a, b in zip(*sides)]
                yield pa.record_batch(
                    {"a": part.column("a"), "b": part.column("b"), "linked": pa.array(linked, pa.bool_())}
                )

    plain = texts.select("row", "text")
    heads = plain.join(pairs.select(F.col("b").alias("row")).distinct(), "row", "left_semi")
    left = pairs.join(plain.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    # Another name for the key, so that heads are shuffled again and not taken bucket by bucket.
    right = heads.select((F.col("row") + 0).alias("b"), F.col("text").alias("text_b"))
    found = left.join(right, "b").select("a", "b", "text_a", "text_b")
    return found.mapInArrow(align, "a bigint, b bigint, linked boolean")


def linked_classes(members: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` of every linked row among ``members``, rows (key, row, first).

    Members of one key share a band, one of the first ones where ``first`` is true; ``texts``
    has the text and the bands of each row. Three rounds align members with heads: those of
    the first bands with the smallest row of their group, those of the others likewise and
    those of the first with a drawn row, then all with ``HEADS`` drawn ones. From the second
    round on only groups that hold several classes take part, and only members outside the
    class of their head. What is left then is settled pair by pair. So at the end any two
    members of a group are in one class or not alike.
    """
    roots, left = None, members.where("first")
    for number in range(3):
        held = _rooted(left, roots)
        drawn = [F.xxhash64(F.lit(HEADS * number + i), "key", "row") for i in range(HEADS)]
        smallest = F.col("row") if number == 0 else F.when(F.col("first"), drawn[0]).otherwise(F.col("row"))
        chosen = [F.min_by(F.struct("row", "root"), d) for d in (drawn if number == 2 else [smallest])]
        mixed = _mixed(held, F.array(*chosen).alias("heads"))
        left = scratch.stage(held.join(mixed, "key"), "mixed")
        offers = left.select("row", "root", F.explode("heads").alias("head")).where("root <> head.root")
        pairs = offers.select(
            F.greatest("row", "head.row").alias("a"), F.least("row", "head.row").alias("b")
        )
        pairs = scratch.stage(pairs.distinct(), "pairs")
        with arrow_rows(scratch.spark, PAIR_ROWS):
            checked = scratch.stage(_verified(pairs, texts, least), "checked")
        roots = _merged(roots, checked.where("linked").select("a", "b"), scratch)
        # The two members of a pair have been compared.
        left = left.where("size > 2").select("key", "row", "first")
        if number == 0:
            left = left.unionByName(members.where("NOT first"))
    held = _rooted(left, roots)
    open_groups = scratch.stage(held.join(_mixed(held), "key").select("key", "row", "root", "size"), "open")
    return _merged(roots, scratch.stage(_settled(open_groups, texts, least), "settled"), scratch)


def _mixed(held: DataFrame, *more: Column) -> DataFrame:
    """The keys whose members are of several classes, with their ``size``."""
    groups = held.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), *more
    )
    return groups.where("low <> high").drop("low", "high")


def _settled(held: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links ``a``, ``b`` that join all alike members of each group in ``held``.

    A group above ``BLOCK`` members or ``BLOCK_BYTES`` of text is dealt into blocks, and each
    two blocks are settled by themselves; groups below are settled some at a time.
    """
    lengths = texts.select("row", F.octet_length("text").cast("bigint").alias("bytes"))
    weighed = held.join(lengths, "row")
    whole = weighed.groupBy("key").agg(F.sum("bytes").alias("whole"))
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("whole") / F.lit(BLOCK_BYTES))).cast("int")
    dealt = weighed.join(whole, "key").withColumn("blocks", F.greatest(blocks, F.lit(1)))
    small = F.col("blocks") == 1
    load = dealt.where(small).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    bundles = load.n // BLOCK + (load.bytes or 0) // BLOCK_BYTES + 1
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), "blocks").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    bundle = F.when(small, F.pmod(F.xxhash64("key"), F.lit(bundles))).otherwise(F.xxhash64("key", low, high))
    placed = paired.select("key", "row", "root", "block", low.alias("low"), high.alias("high"), bundle.alias("bundle"))

    def settle(table: pa.Table) -> pa.Table:
        links = _links(table.combine_chunks(), least)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return placed.join(texts, "row").groupBy("bundle").applyInArrow(settle, "a bigint, b bigint")


def _links(table: pa.Table, least: float) -> list[tuple[int, int]]:
    """Pairs that join all alike members of each two blocks in ``table``.

    A pair that shares several bands is looked at in the first of them only.
    """
    column = lambda name: table.column(name).to_numpy()
    rows, roots, keys, block = (column(n) for n in ("row", "root", "key", "block"))
    own, at, place = np.unique(rows, return_index=True, return_inverse=True)
    some = table.take(pa.array(at))
    words = find_words(some.column("text").combine_chunks())
    hashes = words.hashes(1)
    texts = [hashes[a:b] for a, b in zip(words.first, words.first[1:])]
    sizes = words.counts()
    singles = _bags(hashes, words.first)
    pairs = shingles(words, hashes, 2)
    doubles = _bags(pairs.hashes, pairs.first)
    told = _occurrences(hashes, words.first)
    told = [np.sort(told[a:b]) for a, b in zip(words.first, words.first[1:])]
    bounds = [(_coarse(singles), 1), (_coarse(doubles), 2), (singles, 1), (doubles, 2)]
    lists = some.column("bands").to_pylist()
    bands = np.zeros((len(own), max(map(len, lists))), np.int64)
    for line, values in zip(bands, lists):
        line[: len(values)] = values
    numbers = np.stack([np.unique(c, return_inverse=True)[1] for c in bands.T], axis=1)
    numbers = numbers.astype(np.min_scalar_type(len(own) + 1))
    others = np.where(bands == 0, len(own) + 1, numbers).astype(numbers.dtype)
    above: dict[int, int] = {}

    def root(node: int) -> int:
        while (up := above.get(node, node)) != node:
            above[node] = node = above.get(up, up)
        return node

    found = []
    order = np.lexsort((column("high"), column("low"), keys))
    shown = np.stack([keys[order], column("low")[order], column("high")[order]])
    cuts = np.flatnonzero((shown[:, 1:] != shown[:, :-1]).any(0)) + 1
    for members in np.split(order, cuts):
        low, high = column("low")[members[0]], column("high")[members[0]]
        left = members[block[members] == low]
        right = members[block[members] == high]
        for start in range(0, len(left), max(1, _PAIRS // max(1, len(right)))):
            part = left[start : start + max(1, _PAIRS // max(1, len(right)))]
            a, b = np.repeat(part, len(right)), np.tile(right, len(part))
            keep = roots[a] != roots[b]
            if low == high:
                keep &= rows[a] < rows[b]
            a, b = a[keep], b[keep]
            key = keys[a]
            a_root, b_root = roots[a], roots[b]
            a, b = place[a], place[b]
            keep = bands[a, (numbers[a] == others[b]).argmax(1)] == key
            a, b, a_root, b_root = a[keep], b[keep], a_root[keep], b_root[keep]
            longer = np.maximum(sizes[a], sizes[b])
            most = ((1.0 - least) * longer + 1e-9).astype(np.int64)
            keep = np.flatnonzero(np.abs(sizes[a] - sizes[b]) <= most)
            # An edit takes one word of the longer text away, and two pairs of neighbours.
            for bags, each in bounds:
                shared = np.minimum(bags[a[keep]], bags[b[keep]]).sum(1)
                keep = keep[shared >= longer[keep] - (each - 1) - each * most[keep]]
            for x, y, p, q, edits in zip(*(side[keep].tolist() for side in (a, b, a_root, b_root, most))):
                p, q = root(p), root(q)
                if p == q:
                    continue
                # Cells hold several words; an alignment costs far more than to count them all.
                needed = max(len(told[x]), len(told[y])) - _shared(told[x], told[y])
                if needed <= edits and similar(texts[x].tolist(), texts[y].tolist(), least, needed):
                    above[max(p, q)] = min(p, q)
                    found.append((int(own[x]), int(own[y])))
    return found


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values are in both of two sorted arrays of different values."""
    place = np.searchsorted(a, b)
    return int(np.count_nonzero(a[np.minimum(place, len(a) - 1)] == b)) if len(a) else 0


def _coarse(bags: np.ndarray) -> np.ndarray:
    """The same counts in fewer cells, quicker to compare."""
    return np.ascontiguousarray(bags.reshape(len(bags), -1, _COARSE).sum(1, dtype=np.int32))


def _bags(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many hashes of each text fall into each cell: two texts share at most what cells share."""
    texts = len(first) - 1
    cell = (hashes % _U64(_CELLS)).astype(np.int64) + np.repeat(np.arange(texts), np.diff(first)) * _CELLS
    return np.bincount(cell, minlength=texts * _CELLS).reshape(texts, _CELLS).astype(np.int32)


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the root of each row, itself if it is not linked yet."""
    if roots is None:
        return rows.withColumn("root", F.col("row"))
    found = rows.join(roots.withColumnRenamed("node", "row"), "row", "left")
    return found.withColumn("root", F.coalesce("root", "row"))


def _merged(roots: DataFrame | None, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes after more links: components of the links between present classes."""
    if roots is None:
        return components(linked, scratch.stage)
    a = _rooted(linked.withColumnRenamed("a", "row"), roots).select(F.col("root").alias("a"), "b")
    between = _rooted(a.withColumnRenamed("b", "row"), roots).select("a", F.col("root").alias("b"))
    joined = components(between, scratch.stage)
    fresh = joined.join(roots.select("node"), "node", "left_anti")
    above = joined.select(F.col("node").alias("root"), F.col("root").alias("upper"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    return scratch.stage(moved.union(fresh), "roots")


def near_duplicates(
    df: DataFrame,
    column: str = "text",
    key: str = "doc_id",
    least: float = LEAST,
    bands: int = BANDS,
) -> DataFrame:
    """Adds ``class_id``, ``class_size`` and ``kept`` to every row, replacing such columns.

    ``class_id`` is the smallest ``key`` of the class, null if none of its rows has a key;
    ``kept`` marks the one row of a class with that key (of equal ones, any single one).
    Texts without words are alike and form one class. A null text is a class of its own,
    as nothing is known of it. Texts of fewer than three words have one shingle, all of it.
    """
    df = without(df, "class_id", "class_size", "kept")
    scratch = Scratch(df.sparkSession, "near")
    row = unused(df, "row")
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.withColumn(row, F.monotonically_increasing_id()).repartition(buckets, row)
    rows = stage_bucketed(numbered, "documents", row)
    table = scratch.stage(band_table(rows, row, column, bands), "bands")
    groups = scratch.stage(table.groupBy("h1", "h2").agg(F.min("row").alias("head")), "groups")
    heads = groups.select(F.col("head").alias("row"))

    single = table.where("some").join(heads, "row", "left_semi")
    banded = single.select("row", F.posexplode("bands").alias("place", "key"))
    # A band has keys of its own, so all members of a key are of one kind.
    first = (F.col("place") < FIRST_BANDS) | F.col("place").between(bands, bands + FIRST_BANDS - 1)
    banded = banded.select("row", "key", first.alias("first"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = scratch.stage(banded.join(shared, "key").select("key", "row", "first"), "members")
    involved = members.select("row").distinct()
    texts = rows.select(F.col(quoted(row)).alias("row"), F.col(quoted(column)).alias("text"))
    texts = texts.join(involved, "row", "left_semi").join(table.select("row", "bands"), "row")
    texts = scratch.stage_bucketed(texts.repartition(buckets, "row"), "candidates", "row")

    roots = linked_classes(members, texts, least, scratch).withColumnRenamed("node", "head")
    placed = (
        table.select("row", "h1", "h2")
        .join(groups, ["h1", "h2"])
        .join(roots, "head", "left")
        .select("row", F.coalesce("root", "head").alias("root"))
    )
    keys = rows.select(F.col(quoted(row)).alias("row"), F.col(quoted(key)).alias("_key"))
    placed = scratch.stage(keys.join(placed, "row", "left").withColumn("root", F.coalesce("root", "row")), "placed")
    best = F.min(F.struct(F.col("_key").isNull(), "_key", "row"))
    classes = placed.groupBy("root").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size"))
    marked = placed.join(classes, "root").select(
        F.col("row").alias(row),
        F.col("best._key").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )
    marked = stage(marked, "classes")
    scratch.release()
    return rows.join(marked, row).drop(row)
