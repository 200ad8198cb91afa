"""Quality rules, pages, languages and the language model."""

from __future__ import annotations

import math
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.llm import attention, language, lm
from stockyard.llm.html import main_text
from stockyard.llm.queries import ORACLES, QUERIES, VOCABULARY, op3_lm_score, op7_language_id
from stockyard.llm.quality import with_quality
from stockyard.llm.tokens import encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(answer.fetchall())


def test_rules_reject_junk_and_keep_prose(spark):
    prose = "it is the story of a man who was at sea and by the end of that year he had not seen land "
    texts = {
        "prose": prose * 1 + "again. " + prose.upper()[:10],
        "short": "only a few words here",
        "symbols": " ".join(f"{w}###" for w in prose.split()),
        "menu": " | ".join(w for w in prose.split() if len(w) > 3),
        "shouting": " ".join(f"{w.upper()}!!" for w in prose.split()),
        "lines": "the same line again and again\n" * 9,
        "repeats": "one two three four five six seven " * 6,
    }
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    kept = {r.name: r.kept for r in with_quality(df).collect()}
    assert kept == {name: name == "prose" for name in texts}
    assert with_quality(df).where("kept").count() == 1


PAGES = {
    "": "",
    "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>One &amp;\n two.<br>Three</p>"
    "<p>Short.</p><section class='comments'><p>I like it</p></section></article><footer>&copy; x</footer>": (
        "Title One & two. Three Short."
    ),
    "<header><h1>Site</h1></header><main><p>Body text</p><form><p>Name</p></form><p>End</p></main>"
    "<aside><p>Other</p></aside>": "Body text End",
    "<div class='cookie-notice'><p>We use cookies and like to say so at some length, again and again.</p></div>"
    "<div><p>The text of the page is long enough to be found by its length alone, as it goes on and on.</p>"
    "<p>Done.</p></div><div id='sidebar'><p>Latest</p></div>": (
        "The text of the page is long enough to be found by its length alone, as it goes on and on. Done."
    ),
    "<article><p>a<b>b</b> c&lt;d&gt;</p><script>if (a < b) { x = '</p>' }</script><p>e</p><!-- <p>no</p> --></article>": (
        "ab c<d> e"
    ),
    "<article><p>cut off <a href='x": "cut off",
    "<p>1 < 2 and 3 > 2</p>": "1 < 2 and 3 > 2",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    assert main_text(page) == PAGES[page]


def test_cards_do_not_take_the_place_of_the_body():
    body = "The body of this page is written in a main part and is long enough to be its text."
    cards = "<article><h3>Card</h3><p>Teaser</p></article>" * 3
    assert main_text(f"<main><div><p>{body}</p><p>{body}</p></div>{cards}</main>") == f"{body} {body}"
    # Without a main part, too, and lines of links alone are no text of an article.
    assert body in main_text(f"<div><p>{body}</p><p>{body}</p></div>{cards}")
    links = "<p><a href='/'>Next page</a></p>" * 4
    assert main_text(f"<article><p>{body}</p>{links}</article>") == body


def test_what_an_article_holds_stays():
    assert main_text("<html><head><title>x</title><body><article><p>Hello world</p></article>") == "Hello world"
    assert main_text("<head><meta><title>T</title><script>'<div>'</script><div><p>Of the page</p></div>") == "Of the page"
    link = "<p><a href='/'>{}</a></p>"
    assert main_text(f"<article><p>One two.</p>{link.format('Read it')}</article>") == "One two. Read it"
    middle = "".join(link.format(i) for i in "abc")
    assert main_text(f"<article><p>One two.</p>{middle}<p>End.</p></article>") == "One two. a b c End."
    short = "".join(f"<p>paragraph number {i}</p>" for i in range(12))
    assert main_text(short) == " ".join(f"paragraph number {i}" for i in range(12))
    for label in ("share-price", "header-image text", "alert-history", "ad-hoc"):
        assert main_text(f"<article><p>a b</p><div class='{label}'><p>c</p></div></article>") == "a b c"
    for label in ("share-buttons", "comment-list", "x cookie-notice", "ads", "related-posts", "nav-bar-left"):
        assert main_text(f"<article><p>a b</p><div class='{label}'><p>c</p></div></article>") == "a b"


@pytest.mark.parametrize("mark", ["<script ", "<a ", "<!--", "<div class='", "<title>", "<head>", "<style x='", "<p>", "</div>"])
def test_long_pages_of_broken_markup(mark):
    began = time.process_time()
    assert main_text("<article><p>x</p></article>" + mark * 200_000) == "x"
    assert time.process_time() - began < 10


class Plain(HTMLParser):
    """Lines of a page of the table; three blank ones stand for each part that is left out."""

    LEFT_OUT = ("nav", "footer", "script", "style", "title")

    def __init__(self, page):
        super().__init__()
        self.lines, self.text, self.out, self.article = [], "", None, False
        self.feed(page)
        self.close()
        self.end_line()

    def end_line(self):
        if self.text.split():
            self.lines.append((" ".join(self.text.split()), self.article))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if self.out:
            return
        if tag in self.LEFT_OUT or dict(attrs).get("class") == "ad":
            self.end_line()
            self.lines += [("", False)] * 3
            self.out = tag
        elif tag not in ("b", "a", "i"):
            self.end_line()
        self.article |= tag == "article"

    def handle_endtag(self, tag):
        if self.out:
            self.out = None if tag == self.out else self.out
        elif tag not in ("b", "a", "i"):
            self.end_line()
        self.article &= tag != "article"

    def handle_data(self, data):
        self.text += "" if self.out else data


def text_by_windows(page):
    """Line blocks by the book: sums of three lines, begun above 80 where any is, ended at none."""
    lines = [text for text, _ in Plain(page).lines]
    sums = [sum(map(len, lines[i : i + 3])) for i in range(len(lines))]
    least = 80 if max(sums, default=0) > 80 else 0
    begun, kept = False, []
    for text, total in zip(lines, sums):
        begun = total > 0 if begun else total > least
        if begun and text:
            kept.append(text)
    return " ".join(kept)


def test_pages_of_the_table(spark, folder):
    """Of each page its article; without the tag that says so the windows alone find the text."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    found = {r.page_id: r.text for r in QUERIES["op2_html_text"](spark, folder).collect()}
    assert set(found) == {p.page_id for p in pages}
    for p in pages:
        assert found[p.page_id] == " ".join(text for text, own in Plain(p.html).lines if own)
        bare = p.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(bare) == text_by_windows(bare)


def test_main_text_of_null():
    assert main_text(None) == ""


def test_held_out_languages(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = op7_language_id(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_the_sample_of_languages_is_bounded_and_has_rare_ones(spark):
    """Nine tenths of the rows are copies of one text, and one language has a few rows only."""
    rows = [(i, "the same words again and again", "en") for i in range(4500)]
    rows += [(5000 + i, f"der hund und die katze {i}", "de") for i in range(480)]
    rows += [(9000 + i, f"el perro y la playa {i}", "es") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = language._drawn(df.selectExpr("CAST(doc_id AS STRING) AS key", "text", "lang AS label"), 300, 3)
    kept = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    assert kept["es"] == 20 and 100 < kept["de"] < 350 and 400 < kept["en"] < 700
    model = language.train(df, F.lit(True), sample=300)
    assert sorted(model.names) == ["de", "en", "es"]
    told = language.with_language(df, model).where("lang <> lang_pred").count()
    assert told < 0.02 * len(rows)


def test_temperature_and_sparsity():
    draw = np.random.default_rng(1)
    labels = draw.integers(0, 3, 4000)
    scores = np.eye(3)[labels] * 1.5 + draw.gumbel(size=(4000, 3))
    assert 0.5 < language.temperature(4.0 * scores, labels) / language.temperature(scores, labels) / 4 < 2
    rows = [(np.array([c, 5]), np.array([1.0, 0.01]), int(c)) for c in draw.integers(0, 3, 300)]
    weights = language.learn(rows, 3, size=8)
    assert (np.argmax(weights[:3], axis=1) == [0, 1, 2]).all() and not weights[6].any()


def test_attention_slopes_and_windows():
    draw = np.random.default_rng(0)
    start = attention.Weights.start(9, np.ones(5) / 5)
    w = attention.Weights(*[a.astype(float) for a in start.arrays()])
    sequence = np.append(draw.integers(0, 8, 150), 8)
    inputs, targets, owner = attention.windows(sequence, np.array([0, 0, 40, 151]), 9)
    assert sorted(Counter(owner.tolist())) == [1, 2] and (targets >= 0).sum() == 151
    classes = np.where(targets >= 0, targets % 5, -1)
    _, slopes = attention.gradients(w, inputs[:3], classes[:3])
    for weights, slope in zip(w.arrays(), slopes):
        at = tuple(draw.integers(0, s) for s in weights.shape)
        was, step = weights[at], 1e-5
        weights[at] = was + step
        more, _ = attention.gradients(w, inputs[:3], classes[:3])
        weights[at] = was - step
        less, _ = attention.gradients(w, inputs[:3], classes[:3])
        weights[at] = was
        assert slope[at] == pytest.approx((more - less) / (2 * step), abs=1e-7)
    # What follows a token has no say in its score.
    before = attention.log_probability(w, inputs[-1:], classes[-1:])
    changed = inputs[-1:].copy()
    last = np.flatnonzero(classes[-1] >= 0)[-1]
    changed[0, attention.LENGTH - attention.STEP + last + 1 :] = 0
    assert attention.log_probability(w, changed, classes[-1:]) == pytest.approx(before)


def test_scores_of_the_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: WORD.findall(r.text.translate(LOWER)) for r in rows}
    trained = {i for i in words if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(w for i in trained for w in words[i])
    total, kinds = sum(counts.values()) + len(trained), len(counts) + 1

    def worth(count):
        return math.log10((count + 0.5) / (total + 0.5 * (kinds + 1)))

    for r in op3_lm_score(spark, folder).collect():
        mine = words[r.doc_id]
        assert r.held_out == (r.doc_id not in trained)
        assert (r.n_tokens, r.train_tokens) == (len(mine) + 1, total)
        assert r.n_known == 1 + sum(w in counts for w in mine)
        assert r.base_score == pytest.approx(worth(len(trained)) + sum(worth(counts[w]) for w in mine))
        assert math.isfinite(r.score) and r.score < 0


def test_a_round_trains_on_every_window(spark):
    # Every document is a window; each of a thousand kinds occurs in one of them only.
    dtype = encoder(VOCABULARY).dtype
    kinds = np.minimum(np.arange(len(lm._opens(VOCABULARY))), lm.KINDS - 2)
    classes = np.arange(lm.KINDS) % lm.CLASSES
    weights = attention.Weights.start(lm.KINDS, np.ones(lm.CLASSES) / lm.CLASSES)
    model = lm.Model(kinds, np.zeros(len(kinds)), classes, None, weights, 0, 0, 0)
    docs = [[1500, n // 26 if n % 26 == 0 else 1200, 1501] for n in range(26_000)]
    rows = [(True, bytearray(np.array(d, dtype).tobytes())) for d in docs]
    ids = spark.createDataFrame(rows, "learn boolean, ids binary").coalesce(1)
    after = lm._round(ids, VOCABULARY, model, 0, lm.RATE)
    changed = (after.embed != weights.embed).any(1)
    assert changed[:1000].all() and not changed[1000:1200].any()


def test_a_round_keeps_steps_too_small_for_single_precision(spark):
    dtype = encoder(VOCABULARY).dtype
    kinds = np.minimum(np.arange(len(lm._opens(VOCABULARY))), lm.KINDS - 2)
    classes = np.arange(lm.KINDS) % lm.CLASSES
    weights = attention.Weights.start(lm.KINDS, np.ones(lm.CLASSES) / lm.CLASSES)
    model = lm.Model(kinds, np.zeros(len(kinds)), classes, None, weights, 0, 0, 0)
    rows = [(True, bytearray(np.array([n, 1500, n], dtype).tobytes())) for n in range(100)]
    ids = spark.createDataFrame(rows, "learn boolean, ids binary").coalesce(1)
    model.weights = lm._round(ids, VOCABULARY, model, 0, 1e-12)
    first = np.abs(model.weights.embed - weights.embed)
    assert 0 < first[:100].max(1).min() and first.max() < 1e-10 and not first[100:1500].any()
    again = lm._round(ids, VOCABULARY, model, 1, 1e-12)
    assert (again.embed != model.weights.embed)[:100].any(1).all()
    assert attention.Fit(again, 1e-12).weights.embed.dtype == np.float32


def test_looked_up_scores_are_the_models():
    draw = np.random.default_rng(3)
    w = attention.Weights.start(30, np.ones(6) / 6)
    w = w.like(w.flat() * 2)
    inputs, targets, _ = attention.windows(np.append(draw.integers(0, 29, 200), 29), np.array([0, 201]), 30)
    classes = np.where(targets >= 0, targets % 6, -1)
    loss, _ = attention.gradients(w, inputs, classes)
    assert -attention.log_probability(w, inputs, classes).sum() / 201 == pytest.approx(loss, rel=1e-4)


def plain_slopes(w, inputs, targets):
    """The slopes of a batch, with queries, keys, values and mixtures each worked out."""
    scale, step = np.float32(attention.WIDTH**-0.5), attention.STEP
    x = w.embed[inputs] + w.place
    q, k, v = x[:, step:] @ w.query, x @ w.key, x @ w.value
    seen = np.arange(2 * step) <= step + np.arange(step)[:, None]
    seen = seen & (inputs != len(w.embed) - 1)[:, None]
    share = np.exp(np.where(seen, q @ k.transpose(0, 2, 1) * scale, -np.inf))
    share /= share.sum(-1, keepdims=True)
    mixture = share @ v
    state = (x[:, step:] + mixture @ w.mixed).reshape(-1, attention.WIDTH)
    slope = np.exp(state @ w.out + w.bias)
    slope /= slope.sum(-1, keepdims=True)
    rows = np.flatnonzero(targets.reshape(-1) >= 0)
    slope[rows, targets.reshape(-1)[rows]] -= 1
    slope[targets.reshape(-1) < 0] = 0
    slope /= len(rows)
    d_state = (slope @ w.out.T).reshape(x[:, step:].shape)
    tall = lambda a: a.reshape(-1, attention.WIDTH)
    d_mixture = d_state @ w.mixed.T
    d_share = d_mixture @ v.transpose(0, 2, 1)
    d_v = share.transpose(0, 2, 1) @ d_mixture
    d_scores = share * (d_share - (d_share * share).sum(-1, keepdims=True)) * scale
    d_q, d_k = d_scores @ k, d_scores.transpose(0, 2, 1) @ q
    d_x = d_k @ w.key.T + d_v @ w.value.T
    d_x[:, step:] += d_state + d_q @ w.query.T
    d_embed = np.stack([np.bincount(inputs.reshape(-1), c, len(w.embed)) for c in tall(d_x).T], axis=1)
    return [
        d_embed, d_x.sum(0), tall(x[:, step:]).T @ tall(d_q), tall(x).T @ tall(d_k), tall(x).T @ tall(d_v),
        tall(mixture).T @ tall(d_state), state.T @ slope, slope.sum(0),
    ]


class PlainFit:
    """Adam as it is written down, every number in double precision."""

    def __init__(self, w, rate):
        self.weights, self.rate, self.step = w, rate, 0
        self.flat = w.flat().astype(float)
        self.mean, self.power = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def take(self, inputs, targets):
        self.step += 1
        slope = np.concatenate([s.ravel() for s in plain_slopes(self.weights, inputs, targets)]).astype(float)
        slope *= min(1.0, 1.0 / max(np.sqrt(slope @ slope), 1e-12))
        self.mean = 0.9 * self.mean + 0.1 * slope
        self.power = 0.99 * self.power + 0.01 * slope * slope
        fixed = self.mean / (1 - 0.9**self.step) / (np.sqrt(self.power / (1 - 0.99**self.step)) + 1e-8)
        self.flat = self.flat - self.rate * fixed
        self.weights = self.weights.like(self.flat)


def test_a_step_is_the_plain_one_for_less():
    draw = np.random.default_rng(7)
    sequence = np.minimum(draw.zipf(1.3, 20_000) - 1, lm.KINDS - 2)
    first = np.arange(0, 20_001, 400)
    sequence[first[1:] - 1] = lm.KINDS - 1
    inputs, targets, _ = attention.windows(sequence, first, lm.KINDS)
    targets = np.where(targets >= 0, targets % lm.CLASSES, -1)
    start = attention.Weights.start(lm.KINDS, np.ones(lm.CLASSES) / lm.CLASSES)
    seconds, ends = [], []
    for kind in (PlainFit, attention.Fit):
        fit, spent = kind(start, lm.RATE), []
        for at in range(0, 600, attention.BATCH):
            began = time.process_time()
            fit.take(inputs[at : at + attention.BATCH], targets[at : at + attention.BATCH])
            spent.append(time.process_time() - began)
        seconds.append(np.median(spent))
        ends.append(fit.weights)
    for plain, found in zip(*(w.arrays() for w in ends)):
        assert found.dtype == np.float32
        assert np.abs(found - plain).max() < 2e-3 and np.abs(found - plain).mean() < 2e-5
    assert (start.embed == attention.Weights.start(lm.KINDS, np.ones(lm.CLASSES)).embed).all()
    assert seconds[1] < 0.75 * seconds[0]


def score_by_loops(model, ids):
    """The log10 chance of one text, token by token, number by number."""
    w, step = model.weights, attention.STEP
    kinds = [int(model.kinds[i]) for i in ids] + [lm.KINDS - 1]
    before = [lm.KINDS - 1, *kinds[:-1]]
    total = 0.0
    for t, kind in enumerate(kinds):
        start = (t // step - 1) * step
        seen = [(i - start, before[i]) for i in range(max(start, 0), t + 1)]
        inputs = {place: w.embed[k].astype(float) + w.place[place] for place, k in seen}
        own = inputs[t - start]
        query = own @ w.query / math.sqrt(attention.WIDTH)
        weight = {place: math.exp(float(query @ (x @ w.key))) for place, x in inputs.items()}
        whole = sum(weight.values())
        mixture = sum(weight[place] / whole * (x @ w.value) for place, x in inputs.items())
        odds = (own + mixture @ w.mixed) @ w.out + w.bias
        total += float(odds[model.classes[kind]] - math.log(sum(math.exp(float(o)) for o in odds)))
        total += float(model.in_class[before[t], kind])
        total += float(model.in_kind[ids[t]]) if t < len(ids) else 0.0
    return total / math.log(10)


def test_scores_token_by_token():
    draw = np.random.default_rng(5)
    size = 5000
    kinds = draw.integers(0, lm.KINDS - 1, size)
    classes = np.append(draw.integers(0, lm.CLASSES - 1, lm.KINDS - 1), lm.CLASSES - 1)
    chances = np.log(draw.random((lm.KINDS, lm.KINDS)).astype(np.float32) + 1e-3)
    weights = attention.Weights.start(lm.KINDS, draw.random(lm.CLASSES) + 0.1)
    weights.embed *= 3
    model = lm.Model(kinds, np.log(draw.random(size) + 1e-3), classes, chances, weights, 1, 1, 1)
    texts = [draw.integers(0, size, n) for n in (0, 1, 31, 32, 33, 150)]
    first = np.append(0, np.cumsum([len(t) for t in texts]))
    found = model.log10_scores(lm.Ids(np.concatenate(texts), first))
    assert found == pytest.approx([score_by_loops(model, t.tolist()) for t in texts], rel=1e-4)
