"""Repeated windows, near duplicates and fingerprints against plain computations."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stockyard.llm import alignment, fingerprints, neardup
from stockyard.llm.queries import op4_substring_dedup, op8_near_duplicates, op10_fingerprints
from stockyard.llm.substrings import drop_repeated_windows
from stockyard.llm.words import find_words, shingles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abé \n\t\x0b\x1c ", max_size=30)), max_size=6))
def test_words_and_their_hashes(texts):
    words = find_words(pa.array(texts, pa.string()))
    found = [
        [words.data[s:e].tobytes() for s, e in zip(words.starts[a:b], words.ends[a:b])]
        for a, b in zip(words.first, words.first[1:])
    ]
    assert found == [words_of(t) for t in texts]
    flat = [w for ws in found for w in ws]
    hashes = words.hashes()
    assert {(a == b, x == y) for a, x in zip(flat, hashes) for b, y in zip(flat, hashes)} <= {(True, True), (False, False)}
    windows = shingles(words, hashes, 2, whole=True)
    assert len(windows.hashes) == sum(max(len(ws) - 1, bool(ws)) for ws in found)


def cut_plainly(texts, size):
    counts = Counter(tuple(w[i : i + size]) for w in map(words_of, texts) for i in range(len(w) - size + 1))
    for text in texts:
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if counts[tuple(words[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        yield len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()


def test_repeated_windows_of_any_kind(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randrange(60))) for _ in range(60)]
    texts += ["x " * 40, None, "", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for cells in (None, 1 << 12):
        rows = drop_repeated_windows(df, size=12, cells=cells).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_removed, r.kept_text) for r in rows] == list(cut_plainly(texts, 12))


def test_repeated_windows_of_the_table(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    plain = dict(zip(texts, cut_plainly(texts.values(), 35)))
    for r in op4_substring_dedup(spark, folder).collect():
        words, gone, kept = plain[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (words, gone, hashlib.sha256(kept.encode()).hexdigest())


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 3), max_size=14),
    st.lists(st.integers(0, 3), max_size=14),
    st.integers(0, 15),
    st.integers(1, 5),
)
def test_banded_alignment(a, b, most, band):
    first, alignment.FIRST_BAND = alignment.FIRST_BAND, band
    try:
        distance = plain_distance(a, b)
        assert alignment.edit_distance(a, b, most) == (distance if distance <= most else None)
    finally:
        alignment.FIRST_BAND = first


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 3), max_size=14),
    st.lists(st.integers(0, 3), max_size=14),
    st.integers(0, 15),
    st.integers(1, 5),
    st.floats(0, 1),
)
def test_alignment_above_a_known_bound(a, b, most, band, share):
    first, alignment.FIRST_BAND = alignment.FIRST_BAND, band
    try:
        distance = plain_distance(a, b)
        bound = int(share * distance)
        assert alignment.edit_distance(a, b, most, bound) == (distance if distance <= most else None)
        found = alignment.edit_distance(a, b, most, bound, exact=False)
        assert found is None if distance > most else distance <= found <= most
    finally:
        alignment.FIRST_BAND = first


def test_a_band_is_no_wider_than_an_allowed_way_can_stray(monkeypatch):
    banded, bands = alignment._banded, []
    monkeypatch.setattr(alignment, "_banded", lambda *x: bands.append(x[3]) or banded(*x))
    a, b = [f"a{i}" for i in range(800)], [f"b{i}" for i in range(780)]
    assert alignment.edit_distance(a, b, 160) is None
    assert max(bands) == 90


def labelled(words):
    """Five-word shingles with their occurrence; a shorter text is one shingle."""
    seen, out = Counter(), set()
    for i in range(max(len(words) - 4, bool(words))):
        shingle = tuple(words[i : i + 5])
        out.add((shingle, seen[shingle]))
        seen[shingle] += 1
    return out


def test_classes_hold_all_alike_and_nothing_else(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: words_of(r.text) for r in rows}
    shown = {i: labelled(w) for i, w in words.items()}
    found = {r.doc_id: r.class_id for r in op8_near_duplicates(spark, folder).collect()}
    ids = sorted(words)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            like = len(shown[a] & shown[b]) / max(len(shown[a] | shown[b]), 1)
            if like >= 0.8:
                assert found[a] == found[b]
            if like > 0.05:
                longer = max(len(words[a]), len(words[b]))
                if alignment.edit_distance(words[a], words[b], int(0.2 * longer + 1e-9)) is not None:
                    root[find(a)] = find(b)
    # A class never joins texts that no chain of alike ones connects.
    for a in ids:
        assert find(a) == find(found[a])


def classes_by_brute_force(texts, share):
    """The smallest place of the class of each text, joined by alignments of pairs that ``share``."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if find(i) != find(j) and share(i, j) and alignment.edit_distance(a, b, most) is not None:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_large_families_of_texts_that_share_a_band(spark, monkeypatch):
    # The few alike pairs share no band of their own and rarely meet a drawn head.
    monkeypatch.setattr(neardup, "BLOCK", 64, raising=False)
    draw = random.Random(6)
    frame = [f"f{i}" for i in range(60)]
    texts = []
    for n in range(400):
        own = [f"w{n}x{i}" for i in range(24)]
        texts.append(frame + own)
        if n % 130 == 5:
            texts.append(frame + [w if i % 3 else "v" + w for i, w in enumerate(own)])
    draw.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bands = {r.row: np.array(r.bands) for r in neardup.band_table(df, "doc_id", "text").collect()}
    sizes = Counter(k for b in bands.values() for k in b.tolist())
    assert max(sizes.values()) > 100
    expected = classes_by_brute_force(texts, lambda i, j: bool((bands[i] == bands[j]).any()))
    assert len(set(expected)) < len(texts)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def test_pairs_with_too_few_common_words_are_not_aligned(monkeypatch):
    # Their words meet in the cells of the quick bounds, so only a count of them tells.
    draw, aligned = random.Random(9), []
    base = [f"w{i}" for i in range(750)]
    texts = [[w if draw.random() > 0.13 else f"v{n}x{i}" for i, w in enumerate(base)] for n in range(12)]
    texts.append([f"u{i}" if i % 16 == 0 else w for i, w in enumerate(texts[3])])
    similar = neardup.similar
    monkeypatch.setattr(neardup, "similar", lambda *x: aligned.append(x) or similar(*x))
    rows, none = np.arange(len(texts)), np.zeros(len(texts), np.int32)
    table = pa.table({"key": none.astype(np.int64) + 7, "row": rows, "root": rows, "block": none, "low": none,
                      "high": none, "text": [" ".join(t) for t in texts], "bands": [[7]] * len(texts)})
    assert neardup._links(table.combine_chunks(), 0.8) == [(3, 12)]
    common = [sum((Counter(a) & Counter(b)).values()) for i, a in enumerate(texts) for b in texts[:i]]
    assert len(aligned) == sum(c >= 600 for c in common) < len(common) / 4


def test_candidates_at_four_fifths_of_the_words(spark):
    draw = random.Random(8)
    texts, sizes = [], [10, 20, 40, 64, 80, 150, 400, 1000]
    for size in sizes:
        for _ in range(60):
            base = [f"w{draw.randrange(20_000)}" for _ in range(size)]
            gone = set(draw.sample(range(size), size // 5))
            texts += [base, [f"v{i}" if i in gone else w for i, w in enumerate(base)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bands = {r.row: set(r.bands) for r in neardup.band_table(df, "doc_id", "text").collect()}
    met = np.array([bool(bands[i] & bands[i + 1]) for i in range(0, len(texts), 2)]).reshape(len(sizes), -1)
    assert met.mean() > 0.99 and met.mean(1).min() > 0.95, met.mean(1)
    # Unrelated texts meet in no band.
    assert not any(bands[i] & bands[i + 2] for i in range(0, len(texts) - 2, 2))


def test_order_sketches_follow_the_edit_distance():
    draw = random.Random(2)
    base = [f"w{draw.randrange(10_000)}" for _ in range(400)]
    moved = base[200:] + base[:200]
    few = [w if draw.random() > 0.01 else "other" for w in base]
    words = find_words(pa.array([" ".join(t) for t in (base, moved, few)]))
    found = shingles(words, words.hashes(1), 5)
    sketch = neardup.order_sketches(found, 200)
    share = lambda i: float(np.mean(sketch[0] == sketch[i]))
    assert share(1) < 0.7 < share(2)


def test_fingerprints_of_the_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    found = op10_fingerprints(spark, folder).orderBy("doc_id").collect()

    def shown(text):
        words = words_of(text)
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, bool(words)))}

    errors = []
    for i, (r, f) in enumerate(zip(rows, found)):
        after = rows[(i + 1) % len(rows)].text
        size = len(r.text)
        edited = r.text[: size - size // 4] + after[: size // 4]
        assert (f.doc_id, f.n_chars) == (r.doc_id, size)
        assert f.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, estimate in ((edited, f.near_edited), (after, f.near_next)):
            a, b = shown(r.text), shown(other)
            errors.append(abs(len(a & b) / max(len(a | b), 1) - estimate))
        assert abs(f.distinct_shingles - len(shown(r.text))) <= 0.4 * len(shown(r.text)) + 1
    assert np.mean(errors) < 0.02 and np.max(errors) < 0.2
    by_text = {}
    for r, f in zip(rows, found):
        assert by_text.setdefault(r.text, f.fingerprint) == f.fingerprint


def test_fingerprints_merge_and_contain():
    draw = random.Random(5)
    base = [f"w{draw.randrange(5000)}" for _ in range(3000)]
    whole, half, rest = (
        fingerprints.sketches(pa.array([" ".join(t)]), 256)[0] for t in (base, base[:1502], base[1498:])
    )
    assert np.array_equal(fingerprints.merge([half, rest], 256), whole)
    assert abs(fingerprints.containment(half, whole, 256) - 1.0) < 0.1
    assert abs(fingerprints.containment(whole, half, 256) - 0.5) < 0.1
    assert np.array_equal(fingerprints.from_text(fingerprints.to_text(whole)), whole)
    many = np.array([3, 3, 3, 1, 1, 2] * 200, np.uint64)
    assert fingerprints.smallest(many, 2).tolist() == [1, 2]
