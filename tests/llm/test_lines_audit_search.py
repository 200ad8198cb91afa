"""Line removal, the filter audit and lexical search against plain computations."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockyard.llm import audit, linedup, search
from stockyard.llm.queries import op11_line_dedup

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def cut_plainly(rows, least_chars, least_docs):
    """(id, text) rows; a missing id is one document before all others."""
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least_chars:
                holders[line_key(line)].add(order(doc))
    last = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(line_key(x), order(doc)) <= order(doc)]
        yield doc, "\n".join(kept), len(lines), len(lines) - len(kept)


LINES = ["Alpha beta", " alpha BETA\t", "ÄLPHA beta", "älpha beta", "short", "gamma delta ", "gamma delta\r", "", " ", "中文中文中文"]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_of_any_table(spark, batches, fanout):
    draw = random.Random(batches)
    rows = [
        (draw.choice([None, *range(25)]), draw.choice([None, "", "\n".join(draw.choices(LINES, k=draw.randrange(1, 9)))]))
        for _ in range(90)
    ]
    rows += rows[:5] + [(99, "Alpha beta"), (99, "alpha beta\nother line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cut = linedup.drop_repeated_lines(df, least_chars=6, batches=batches, fanout=fanout)
    found = Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in cut.collect())
    assert found == Counter(cut_plainly(rows, 6, 3))


def test_lines_with_clashing_columns_and_no_rows(spark):
    columns = "doc_id long, text string, doc int, t1 int, gone string, N_LINES int, body string, place int"
    rows = [(i, "the very same line of text\nown", 1, 2, "g", 3, "b", 4) for i in range(4)]
    df = spark.createDataFrame(rows, columns)
    found = linedup.drop_repeated_lines(df)
    assert found.columns == ["doc_id", "text", "doc", "t1", "gone", "body", "place", "kept_text", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.kept_text, r.gone, r.place) for r in found.collect()) == [
        (0, "own", "g", 4), (1, "own", "g", 4), (2, "own", "g", 4), (3, rows[0][1], "g", 4),
    ]
    assert linedup.drop_repeated_lines(df.limit(0)).collect() == []


def test_a_long_text_and_a_line_of_all_documents(spark):
    common = "a line that every document holds"
    long = "\n".join(f"line number {i} of a long text" for i in range(60_000))
    texts = [common] * 300 + [long + "\n" + common, long, long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in linedup.drop_repeated_lines(df).collect()}
    assert {found[i] for i in range(300)} == {(1, 1, "")}
    assert found[300][:2] == (60_001, 60_000) and found[300][2] == common
    assert found[301][:2] == (60_000, 60_000) and found[302] == (60_000, 0, long)


def test_runs_take_batches_in_any_order_and_compact(spark):
    runs = linedup.LineRuns(spark, least_docs=3, fanout=2, buckets=3)
    draw, holders = random.Random(2), defaultdict(set)
    batches = [list(range(n, 40, 7)) for n in range(7)]
    for docs in batches:
        rows = [(d, h, -h) for d in docs for h in draw.choices(range(30), k=5)]
        for d, h, _ in rows:
            holders[h].add(d)
        runs.add(spark.createDataFrame(rows, "doc long, h1 long, h2 long"))
    assert sum(map(len, runs.levels)) <= 3
    found = {r.h1: r.last for r in runs.repeated().collect()}
    runs.close()
    assert found == {h: max(d) for h, d in holders.items() if len(d) >= 3}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stockyard_line_run")]


def test_settled_keys_add_nothing_and_joins_merge(spark):
    runs = linedup.LineRuns(spark, least_docs=3, fanout=9, buckets=2)
    line = lambda docs: spark.createDataFrame([(d, 1, 1) for d in docs], "doc long, h1 long, h2 long")
    runs.add(line([10, 11, 12]))
    runs.add(line([1, 2]))
    runs.add(line([13]))
    assert [spark.table(t).count() for level in runs.levels for t in level] == [1, 0, 1]
    assert [r.last for r in runs.repeated().collect()] == [13]
    runs.close()


def test_no_python_in_the_plan_of_lines(spark, folder):
    plan = op11_line_dedup(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("count", [1, 2, 4, 5])
def test_intervals_cover_every_order_once(count):
    orders = list(permutations(range(count)))
    seen = defaultdict(list)
    for mask, step, low, high in audit.intervals(count):
        for rank in range(low, high):
            seen[mask, rank].append(step)
    for mask in range(1, 1 << count):
        for rank, order in enumerate(orders):
            expected = 1 + next(i for i, f in enumerate(order) if mask >> f & 1)
            assert seen[mask, rank] == [expected]


def audit_plainly(docs, labels):
    marks = defaultdict(lambda: [0, 0])
    for doc, quality, toxic in labels:
        if doc is not None:
            marks[doc][0] |= quality == 1
            marks[doc][1] |= toxic == 1
    order = lambda i: (i is not None, i or 0)
    least = {}
    for doc, text, _ in docs:
        least[text or ""] = min(least.get(text or "", order(doc)), order(doc))
    parts = defaultdict(list)
    for doc, text, lang in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text or "")) > 3 * len(text or ""),
            "D": bool(re.search(r"[#$%&*|]", text or "")),
            "E": order(doc) > least[text or ""],
        }
        good, toxic = marks[doc] if doc is not None else (0, 0)
        parts[lang or ""].append(({k for k, v in fails.items() if v}, good, toxic))
    rows = []
    for part, held in parts.items():
        removed_by = Counter()
        begun = len(rows)
        for chain in map("".join, permutations("ABCDE")):
            left = list(held)
            for step, letter in enumerate(chain, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                removed_by[letter] += len(gone)
                every = sum(letter in d[0] for d in held)
                alone = sum(d[0] == {letter} for d in held)
                rows.append([part, chain, step, len(left), len(gone), every - len(gone), alone,
                             sum(d[1] for d in gone), sum(d[2] for d in gone)])
        for row in rows[begun:]:
            row.append(removed_by[row[1][row[2] - 1]])
    return sorted(map(tuple, rows))


NAMES = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_audit_of_any_table(spark):
    draw = random.Random(6)
    texts = [None, "", " ".join(f"w{i}" for i in range(250)), "x " * 300, "ONE two", "a # b", " ".join(f"w{i}" for i in range(400))]
    docs = [(draw.choice([None, *range(30)]), draw.choice(texts), draw.choice([None, "", "en", "de"])) for _ in range(80)]
    docs += docs[:6]
    labels = [(draw.choice([None, *range(30)]), draw.choice([None, 0, 1]), draw.choice([None, 0, 1])) for _ in range(40)]
    df = spark.createDataFrame([(*d, 7, "r") for d in docs], "doc_id long, text string, lang string, part int, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.filter_audit(df.repartition(3), marks)
    assert sorted(tuple(r) for r in found.select(NAMES).collect()) == audit_plainly(docs, labels)
    assert audit.filter_audit(df.limit(0), marks).collect() == []
    assert audit.filter_audit(df, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("p", 0, 4, 1, 0), ("p", 3, 2, 0, 1), ("p", 2, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in audit.audit(masks, "xy").collect()}
    assert [(rows["xy", s].removed, rows["xy", s].kept) for s in (1, 2)] == [(2, 5), (1, 4)]
    assert [(rows["yx", s].removed, rows["yx", s].redundant) for s in (1, 2)] == [(3, 0), (0, 2)]
    assert (rows["xy", 1].shapley, rows["xy", 2].shapley, rows["xy", 2].unique_fails) == (2, 4, 1)
    with pytest.raises(ValueError):
        audit.audit(masks, "yx")


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [] if text is None else TERM.findall(text.translate(FOLD))


def search_plainly(docs, items, most):
    """Scores of (place, id, text) rows, the best of each item first."""
    held = [(i, doc, Counter(terms_of(text))) for i, (doc, text) in enumerate(docs)]
    held = [(i, doc, c, sum(c.values())) for i, doc, c in held if c]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, _, c, _ in held for t in c)
    found = []
    for name, text in items:
        scores = []
        for _, doc, c, n in held:
            m = 100 - 90 + 90 * n * total // length
            score = 0
            for t in set(terms_of(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        for rank, (score, known, doc) in enumerate(sorted(scores)[:most], 1):
            found.append((name, rank, doc if known else None, -score))
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aBé1_ .\x7f\x00中", max_size=20)), max_size=6))
def test_terms(texts):
    words = search.find_terms(pa.array(texts, pa.string()))
    found = [
        [words.data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b])]
        for a, b in zip(words.first, words.first[1:])
    ]
    assert found == [terms_of(t) for t in texts]


@pytest.mark.parametrize("owners, block_docs, bundle_items", [(1, 1000, 1000), (3, 40, 4), (6, 7, 2)])
def test_search_of_any_table(spark, owners, block_docs, bundle_items):
    draw = random.Random(owners)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(3000)]
    text = lambda n: " ".join(draw.choices(words, k=draw.randrange(n)))
    docs = [(draw.choice([None, *range(200)]), draw.choice([None, "", text(60), text(60), "W1, w1-W2"])) for _ in range(240)]
    items = [(i % 9, draw.choice([None, "", "nowhere", text(25), text(25), text(25)])) for i in range(14)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, at int").repartition(5)
    asked = spark.createDataFrame([(*i, "t") for i in items], "item_id long, text string, terms string").repartition(2)
    found = search.search(df, asked, 10, owners=owners, block_docs=block_docs, bundle_items=bundle_items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: [(v is not None, v or 0) for v in r]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(search_plainly(docs, items, 10), key=key)
    for a, b in ((df.limit(0), asked), (df, asked.limit(0)), (df.where("text = ''"), asked)):
        assert search.search(a, b).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in range(50, 0, -1)] + [(0, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "SAME")], "item_id long, text string")
    found = search.search(docs, items, block_docs=8).orderBy("rank").collect()
    assert [r.doc_id for r in found] == list(range(1, 11)) and [r["rank"] for r in found] == list(range(1, 11))


def test_what_is_let_go_cannot_win():
    scores = np.zeros(40, np.int64)
    scores[:30] = np.arange(1, 31)
    ids, known = np.arange(40), np.ones(40, bool)
    docs, *_, left = search._best(scores, 5, np.arange(40), ids, known, 10)
    assert sorted(left) == list(range(16, 31)) and len(docs) == 15
    assert len(search._best(scores, 0, np.arange(40), ids, known, 10)[0]) == 10
