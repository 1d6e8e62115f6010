"""Main text of web pages: the best contiguous region by maximum-scoring subsequence.

A page is a row of words and tags. Elements that are never part of an article (menus, forms, scripts and so on, by tag
name or role) are taken out first. What a class or id calls an advert, comment and the like is an aside, unless it holds
the page's labelled article: it is taken out too, but where no article is labelled its own best run counts, at half its
sum, against the page's. Words then score positive and tags negative: each kind's weight is
the log-odds of standing inside an article, learned from a sample of pages whose markup labels the article (exactly one
`article` or `main` element). One linear scan finds the run with the largest sum, the longer one on a tie; its text is
the result, one line per block.

Null and empty pages have empty text, as have pages without words. Unclosed comments and tags reach to the page's end.
Repeated rows are read each. Without labelled pages all words weigh 1, paragraph and inline tags next to nothing, other
tags 4. An empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.llm.shared import sample_texts

#: Labelled pages that the weights are learned from, at most.
LABELLED_PAGES = 400
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(script|style|title|textarea|xmp|iframe|noembed|noframes)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|</?[a-z][^>]*+(?:>|\Z)",
    re.I | re.S,
)
MARKS = re.compile(r"\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements, roles and words of class or id that are not part of an article.
NEVER = frozenset("head nav footer aside form button select option noscript template svg math object canvas audio video menu dialog fieldset applet map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments commentlist disqus replies reply respond related recommended share sharing social subscribe "
    "subscription newsletter signup login search pagination pager toolbar widget widgets skip tracking".split()
)
HOLDERS = frozenset(("article", "main"))
#: Parts of a class name after which it says what an element has or lacks, not what it is.
ABOUT = frozenset("no has have with without hide hides show shows is not".split())
#: An aside's run counts for so much of its sum against the run outside of all asides.
ASIDE_SHARE = 0.5
OPENED = re.compile(r"<(article|main)[\s/>]", re.I)
WORD, BLOCK, ASIDE = "#word", "#block", "#aside"


def _foreign(name: str, attributes: str, inside: bool) -> str:
    """NEVER for what is no part of an article in any case, ASIDE for what its class or id calls so, or nothing."""
    if name in NEVER or (name == "header" and not inside):
        return "never"
    if not attributes or name in ("html", "body"):
        return ""
    aside = ""
    for match in MARKS.finditer(attributes):
        kind = match[1].lower()
        value = (match[2] or match[3] or match[4] or "").lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "role" and value in ROLES):
            return "never"
        if kind in ("class", "id"):
            parts = [p for one in value.split() for p in _named_parts(one)]
            if any(p in NAMED for p in parts) or ("header" in parts and not inside and name not in HOLDERS):
                aside = ASIDE
    return aside


def _named_parts(one: str) -> list[str]:
    """Parts of one class name, without those that it says an element has or lacks."""
    parts = re.split(r"[^a-z0-9]+", one)
    cut = next((k for k, p in enumerate(parts[:-1]) if p in ABOUT), len(parts))
    return parts[:cut]


def events(page: str, clean: bool = True) -> list[tuple[str, str]]:
    """Tags as (name or /name, '') and text as (WORD, text) in page order; without foreign elements where clean."""
    return _read(page, clean)[0]


def _read(page: str, clean: bool) -> tuple[list[tuple[str, str]], list[list[tuple[str, str]]], bool]:
    """The page's events, those of each aside that was taken out of them, and whether the labelled element is among the first.

    The labelled element is the only `main` of a page, or else its only `article`. An aside that holds it stays.
    """
    opened = Counter(m[1].lower() for m in OPENED.finditer(page)) if clean else Counter()
    label = next((x for x in ("main", "article") if opened[x] == 1), "")
    asides: list[list[tuple[str, str]]] = []
    out: list[tuple[str, str]] = []
    frames: list[list] = []  # of open asides: name, depth, and the events around
    places: dict[str, list[int]] = {}  # of the frames of each name
    skipping, depth, holders, at, labelled = "", 0, 0, 0, False
    for match in TOKEN.finditer(page):
        if not skipping and match.start() > at:
            out.append((WORD, page[at : match.start()]))
        at = match.end()
        name = (match[3] or "").lower()
        if not name:
            continue
        close = bool(match[2])
        if skipping:
            if name == skipping:
                depth += -1 if close else 1
                if depth == 0:
                    skipping = ""
                    out.append((BLOCK, ""))
            continue
        if name in HOLDERS:
            holders = max(0, holders + (-1 if close else 1))
        bare = (match[4] or "").rstrip().endswith("/")
        foreign = _foreign(name, match[4] or "", holders > 0) if clean and not close and name not in VOID else ""
        if foreign == "never":
            if name in HOLDERS:
                holders -= 1
            if not bare:
                skipping, depth = name, 1
            continue
        if not close and name == label:
            labelled = True
            for _, _, around in frames:  # what holds the labelled element is no aside
                around.append((BLOCK, ""))
            out = [x for _, _, around in frames for x in around] + out
            frames, places = [], {}
        elif foreign and not bare:
            places.setdefault(name, []).append(len(frames))
            frames.append([name, 1, out])
            out = []
            continue
        elif foreign:
            continue
        if places.get(name):
            mine = places[name][-1]
            frames[mine][1] += -1 if close else 1
            if frames[mine][1] == 0:
                while len(frames) > mine:  # asides within that were not closed end here, too
                    held, _, around = frames.pop()
                    places[held].pop()
                    asides.append(out)
                    out = around
                    out.append((BLOCK, ""))
                continue
        out.append((("/" if close else "") + name, ""))
    if not skipping and at < len(page):
        out.append((WORD, page[at:]))
    for _, _, around in reversed(frames):
        asides.append(out)
        out = around
    return out, asides, labelled


def count_labelled(page: str) -> tuple[Counter, Counter] | None:
    """Kinds of items inside and outside the one article of a page; None where the page labels none, or several."""
    items = events(page, clean=False)
    opened = [k for k, (name, _) in enumerate(items) if name in HOLDERS]
    closed = [k for k, (name, _) in enumerate(items) if name[1:] in HOLDERS and name[0] == "/"]
    if len(opened) != 1 or len(closed) != 1 or closed[0] < opened[0]:
        return None
    inside, outside = Counter(), Counter()
    for k, (name, text) in enumerate(items):
        counts = inside if opened[0] < k < closed[0] else outside
        counts[name] += len(text.split()) if name == WORD else 1
    return inside, outside


def learn(pages: DataFrame, text: str = "html", limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights of item kinds: log-odds inside an article, above 0 for words and below 0 for tags."""
    inside, outside = Counter(), Counter()
    for page in sample_texts(pages.where(F.col(text).rlike("(?i)<(article|main)[ >]")), text, limit):
        found = count_labelled(page)
        if found:
            inside += found[0]
            outside += found[1]
    kinds = set(inside) | set(outside)
    total_in, total_out = sum(inside.values()) + len(kinds), sum(outside.values()) + len(kinds)
    weights = {k: math.log((inside[k] + 1) / total_in) - math.log((outside[k] + 1) / total_out) for k in kinds}
    return {k: max(w, 0.1) if k == WORD else min(w, -0.001) for k, w in weights.items()}


def _weight(weights: dict[str, float], name: str) -> float:
    plain = name.lstrip("/")
    return weights.get(name, -0.001 if plain in INLINE or plain in ("p", "br", BLOCK) or name == BLOCK else -4.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the run with the largest sum, the longest on a tie; (0, 0) where none is above 0."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += score
        if total > best or (total == best and best > 0 and k + 1 - start > region[1] - region[0]):
            best, region = total, (start, k + 1)
    return region


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    items, asides, labelled = _read(page, True)
    word = weights.get(WORD, 1.0)

    def run(items: list[tuple[str, str]]) -> tuple[float, int, int]:
        scores = [word * len(text.split()) if name == WORD else _weight(weights, name) for name, text in items]
        lo, hi = best_region(scores)
        return sum(scores[lo:hi]), lo, hi

    best, lo, hi = run(items)
    for aside in [] if labelled else asides:
        total, first, last = run(aside)
        if total * ASIDE_SHARE > best:
            best, items, lo, hi = total * ASIDE_SHARE, aside, first, last
    blocks, parts = [], []
    for name, text in [*items[lo:hi], (BLOCK, "")]:
        if name == WORD:
            parts.append(text)
        elif name == "br":
            parts.append(" ")
        elif name.lstrip("/") not in INLINE:
            block = " ".join(html.unescape("".join(parts)).split())
            if block:
                blocks.append(block)
            parts = []
    return "\n".join(blocks)


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, text: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page: its keys, text and n_chars."""
    weights = learn(pages, text) if weights is None else weights
    slim = pages.select(*keys, text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(page.as_py(), weights) for page in part.column(text)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=[*keys, "text", "n_chars"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(read, f"{kinds}, text string, n_chars long")
