"""Main text of web pages by line-block distribution.

Markup is stripped block by block: each block is a line. Parts that cannot be the article
(menus, scripts, forms, adverts, reader comments and the like, by tag or by the words of
their class, id or role) become runs of blank lines. The lengths of lines, links not
counted, are summed over a sliding window; where the sum surges above a threshold the
text begins, and where it dives to zero the text ends. A page on which nothing surges is
short, and its text begins with its first line. Of the articles, the main part and the
rest of a page, the one with most text outside links counts, a marked character as ``PRIOR``;
if that part is marked its lines weigh as much and surge early, and lines outside it surge only
if they are as long as the longest in it. Lines of links alone weigh nothing, but inside that
part a few of them in a row, or any with text after them, are part of the text.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockyard.llm.frames import added, append, without
from stockyard.llm.words import slices

# Lines in a window, and the characters that make a surge.
WINDOW = 3
SURGE = 80
# How many characters one in an article or main part counts for.
PRIOR = 8

_LABEL = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[a-z]+")

_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_NEVER_TEXT = frozenset("nav footer aside form button menu dialog fieldset label input".split())
_WHOLE = frozenset("html body article main".split())
# What a head holds. Anything else ends it, whether it is closed or not.
_IN_HEAD = frozenset("meta link base basefont bgsound html".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr p li".split())

_INLINE = frozenset("a b i em strong span img script style title head body link meta iframe svg".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title)\b"
    r"(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|</?[a-z!?][^<>]*+(?:>|\Z)"
    # A tag that the next one cuts off.
    rf"|</?(?:{'|'.join(sorted(_BLOCKS | _NEVER_TEXT | _INLINE))})\b[^<>]*+",
    re.S | re.I,
)
# Last words of a label that name a holder; what it holds is said before them.
_HOLDER = re.compile(
    r"list|box|block|wrap|wrapper|container|area|section|bar|panel|items?|inner|outer|content|main|top|bottom|"
    r"left|right|center|groups?|rows?|col|cols|columns?|buttons?|links?|icons?|posts?|articles?|stories|form"
)
# Words of labels. Parts with the first kind stay out even around an <article>.
_ASIDE = re.compile(
    r"comments?|discussion|disqus|repl(?:y|ies)|respond|related|recommend\w*"
)
_FRAME = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|menus?|nav|navbar|navigation|"
    r"breadcrumbs?|sidebar|widgets?|footer|header|masthead|share|sharing|social|newsletter|subscribe|"
    r"subscription|signup|login|search|pagination|pager|toolbar|copyright|disclaimer|complementary|contentinfo"
)


def _subject(label: str) -> str:
    """What a name of one or more words stands for: its last word that names no holder."""
    words = _PART.findall(label)
    while len(words) > 1 and _HOLDER.fullmatch(words[-1]):
        words.pop()
    return words[-1] if words else ""


def _kind(name: str, rest: str, inside: bool) -> str | None:
    """Why an element is left out: ``aside``, ``frame`` or not at all."""
    if name in ("aside",):
        return "aside"
    if name in _NEVER_TEXT or (name == "header" and not inside):
        return "frame"
    if rest and name != "html" and name != "body":
        if _HIDDEN.search(rest):
            return "frame"
        for label in _LABEL.finditer(rest):
            words = [_subject(w) for w in (label[1] or label[2] or label[3] or "").lower().split()]
            if any(_ASIDE.fullmatch(w) for w in words):
                return "aside"
            if name not in _WHOLE and any(_FRAME.fullmatch(w) for w in words):
                return "frame"
    return None


def _lines(page: str) -> list[tuple[str, int, int]]:
    """Blocks of a page: text, characters outside links, and 2 in an article, 1 in a main part."""
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    link = article = main = linked = 0
    skipped, kind, depth, head = "", "", 0, False
    at = 0

    def close():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            lines.append((text, max(0, len(text) - linked), 2 if article else 1 if main else 0))
        parts.clear()
        linked = 0

    for token in _TOKEN.finditer(page):
        if token.start() > at and not skipped:
            between = page[at : token.start()]
            head = head and not between.strip()
            if not head:
                parts.append(between)
                if link:
                    linked += token.start() - at
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "head":
            head = not token["end"]
            continue
        if head and name in _IN_HEAD:
            continue
        head = False
        if skipped:
            if name == skipped:
                depth += -1 if token["end"] else 1
                if depth == 0:
                    skipped = ""
                continue
            starts = name in ("article", "main") and not token["end"]
            if not (starts and kind == "frame" and _kind(name, token["rest"], True) is None):
                continue
            skipped = ""
        if name not in _BLOCKS and name not in _NEVER_TEXT:
            if name == "a":
                link = 0 if token["end"] else 1
            elif name != "span" and not token["end"] and token["rest"]:
                kind = _kind(name, token["rest"], article > 0) or ""
                if kind and name not in _VOID:
                    skipped, depth = name, 1
            continue
        close()
        link = 0
        if token["end"]:
            if name == "article":
                article = max(0, article - 1)
            elif name == "main":
                main = max(0, main - 1)
            continue
        kind = _kind(name, token["rest"], article > 0) or ""
        if kind:
            lines += [("", 0, 0)] * WINDOW
            if name not in _VOID:
                skipped, depth = name, 1
        elif name == "article":
            article += 1
        elif name == "main":
            main += 1
    if not skipped and at < len(page):
        parts.append(page[at:])
    close()
    return lines


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by one space; empty if there is none."""
    lines = _lines(page or "")
    # The part with most text counts; marks count for more than none.
    held = [sum(n * (PRIOR if m else 1) for _, n, m in lines if m == part) for part in range(3)]
    mark = max(range(3), key=lambda part: (held[part], part))
    blocks: list[tuple[str, int, bool]] = []
    for text, n, m in lines:
        if text and blocks and mark and blocks[-1][2] != (m == mark):
            blocks += [("", 0, m == mark)] * WINDOW
        blocks.append((text, n, m == mark))
    weights = np.array([n * (PRIOR if mark and own else 1) for _, n, own in blocks], np.int64)
    if not weights.any():
        return ""
    if mark:
        _weigh_links(blocks, weights)
    sums = np.convolve(weights, np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    most = int(sums.max())
    surge = SURGE // PRIOR if mark else SURGE
    if most <= surge:
        surge = 0
    # Text outside the part needs windows as long as the longest in it.
    outside = max(SURGE, most // PRIOR) if mark else surge
    kept, inside = [], False
    for (text, _, own), block in zip(blocks, sums.tolist()):
        inside = block > 0 if inside else block > (surge if own else outside)
        if inside and text:
            kept.append(text)
    return " ".join(kept)


def _weigh_links(blocks: list[tuple[str, int, bool]], weights: np.ndarray) -> None:
    """Gives lines of links alone in the part that counts the weight of one character.

    Of those at its end only fewer than ``WINDOW`` in a row get it: more are a menu.
    """
    bare = [own and bool(text) and not weight for (text, _, own), weight in zip(blocks, weights.tolist())]
    texts = [i for i, (_, _, own) in enumerate(blocks) if own and weights[i]]
    if not texts:
        return
    behind = [i for i, b in enumerate(bare) if b and i > texts[-1]]
    for i, b in enumerate(bare):
        if b and (i < texts[-1] or len(behind) < WINDOW):
            weights[i] = 1


def with_main_text(df: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars``, its code points, replacing such columns.

    A null page, an empty one and one without an article have an empty text. A tag that is
    never closed, or markup cut off in the middle, ends with the page. Equal pages get
    equal texts.
    """
    df = without(df, *[c for c in ("text", "n_chars") if c != column.lower()])

    def extract(batches):
        for batch in batches:
            for piece in slices(batch, column):
                texts = [main_text(p) for p in piece.column(column).to_pylist()]
                yield append(
                    piece, text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64())
                )

    return df.mapInArrow(extract, added(df, "text string, n_chars bigint"))
