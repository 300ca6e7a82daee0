"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. A line weighs its characters, or nothing where
its elements say that it is not the article: menus, headers, footers, sidebars, forms,
notices, adverts, reader comments, or mostly links. Sums of ``LINES`` consecutive weights surge
where the text sets in and dive to zero behind it; a stretch whose sums reach the threshold is kept.

``<article>`` and ``<main>`` only change weights: if they hold most of the unlinked text, their lines
weigh more and those around them less. Lines within and outside of them are summed apart. An element
that only its class or id marks is not set aside if it holds most of the articles' text, or, on a page
without an article, most of the unlinked text: it is a wrapper.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm import texts

LINES = 3
THRESHOLD = 60
LINK_SHARE = 0.6
# Weights of a character in and outside of the articles of a page, if they hold most of its text.
WITHIN, AROUND = 4, 0.25

TAG = re.compile(
    r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)/?>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?][^>]*+>"
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mover mrow ms msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea svg annotation iframe object select title xmp".split())
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
# Of these, what may also be laid around a whole page.
AROUND_ALL = frozenset("form fieldset dialog".split())
ARTICLE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Parts of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar comment comments respond disqus "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations widget pagination pager toolbar "
    "hidden skip".split()
)
# Attributes one after the other, so that no name is looked for within a value or another name.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# What begins a tag; any other "<" is text.
TAG_START = re.compile(r"<[a-zA-Z/!?]")
PART = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def is_aside(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is set aside for what it is, and whether it may be laid around the page's text.

    The first is true for tags, roles and hidden elements; the second for those whose names mark them, and for
    forms and the like. Both are told apart from wrappers by what they hold.
    """
    loose = tag in AROUND_ALL
    aside = tag in ASIDE and not loose
    if tag in ("html", "body") or not attributes:
        return aside, loose
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if (
            name == "role" and value.lower() in ROLES
            or name == "hidden"
            or name == "aria-hidden" and value.lower() == "true"
        ):
            aside = True
        elif name in ("class", "id") and MARKS & set(PART.findall(CAMEL.sub(" ", value).lower())):
            loose = loose or tag not in ARTICLE
    return aside, loose


def lines_of(page: str) -> list[tuple[str, bool, bool, float]]:
    """``(text, set aside, in an article, share of links)`` of every block of the page, in order."""
    lines, pieces, linked, total = [], [], 0, 0
    # Open elements: name, number of the mark or 0, whether it is an article.
    stack: list[tuple[str, int, bool]] = []
    opened: Counter[str] = Counter()
    articles = links = 0
    # Marks of elements that are no wrappers unless an article's text is in them.
    strict: set[int] = set()
    marks: list[int] = []
    n_marks = 0

    def flush() -> None:
        nonlocal pieces, linked, total
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                lines.append((text, tuple(marks), articles > 0, linked / max(total, 1)))
            pieces, linked, total = [], 0, 0

    def close() -> str:
        nonlocal articles
        name, mark, article = stack.pop()
        opened[name] -= 1
        articles -= article
        if mark:
            marks.pop()
        return name

    def say(text: str) -> None:
        nonlocal linked, total
        if text:
            pieces.append(text)
            n = len(text.strip())
            total += n
            linked += n if links else 0

    at = 0
    while (match := TAG.search(page, at)) is not None:
        say(page[at : match.start()])
        at = match.end()
        if match[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if closing:
            if opened[tag]:
                while True:
                    name = close()
                    links -= name == "a"
                    if name == tag:
                        break
            continue
        if tag == "br":
            say(" ")
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}\s*>").search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or match[0].endswith("/>"):
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            # An open element of the kind ends where its next one begins.
            while stack and stack[-1][0] == tag:
                close()
        aside, loose = is_aside(tag, attributes)
        mark = 0
        if aside or loose:
            mark = n_marks = n_marks + 1
            marks.append(mark)
            if aside:
                strict.add(mark)
        stack.append((tag, mark, tag in ARTICLE))
        opened[tag] += 1
        articles += tag in ARTICLE
        links += tag == "a"
    say("" if TAG_START.match(page, at) else page[at:])
    flush()
    wrappers = wrappers_of(lines, strict)
    return [(text, not wrappers.issuperset(marks), article, share) for text, marks, article, share in lines]


def wrappers_of(lines: list[tuple[str, tuple[int, ...], bool, float]], strict: set[int]) -> set[int]:
    """Numbers of the marks whose elements hold most of the articles' text, or else of all unlinked text.

    Without an article the ``strict`` ones are no wrappers, and what they hold is not counted.
    """
    told = [x for x in lines if x[3] <= LINK_SHARE]
    within = [x for x in told if x[2]]
    told = within or [x for x in told if strict.isdisjoint(x[1])]
    held: Counter[int] = Counter()
    for text, marks, _, _ in told:
        for mark in marks:
            held[mark] += len(text)
    total = sum(len(x[0]) for x in told)
    return {mark for mark, n in held.items() if 2 * n > total}


def main_text(page: str) -> str:
    lines = lines_of(page)
    sizes = np.array([0 if aside else len(text) for text, aside, _, _ in lines], np.int64)
    within = np.array([article for _, _, article, _ in lines], bool)
    unlinked = np.array([share <= LINK_SHARE for *_, share in lines], bool)
    told = sizes * unlinked
    # Articles that hold the lesser part are teasers or comments, and weigh like any other text.
    mostly = 2 * told[within].sum() >= told.sum() and sizes[within].any()
    weights = np.where(within, WITHIN, AROUND) * np.where(within, sizes, told) if mostly else told.astype(float)
    # Lines in an article and around it are summed apart, so that neither carries the other.
    parts = [np.where(within, weights, 0), np.where(within, 0, weights)]
    sums = [_sums(part) for part in parts]
    threshold = min(THRESHOLD, max((s.max() for s in sums if len(s)), default=0))
    if not threshold:
        return ""
    kept = np.zeros(len(lines), bool)
    for part, summed in zip(parts, sums, strict=True):
        # A stretch of lines runs from the surge to the dive: LINES lines without weight.
        surging = np.concatenate([[False], summed > 0, [False]])
        turns = np.flatnonzero(surging[1:] != surging[:-1])
        for surge, dive in zip(turns[::2], turns[1::2], strict=True):
            if summed[surge:dive].max() >= threshold:
                kept[surge:dive] |= part[surge:dive] > 0
    return " ".join(lines[i][0] for i in np.flatnonzero(kept))


def _sums(weights: np.ndarray) -> np.ndarray:
    padded = np.concatenate([weights, np.zeros(LINES - 1)])
    return sum(padded[k : k + len(weights)] for k in range(LINES))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts.chunks(batches, "html"):
        out = [main_text(page) if page else "" for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id").cast(pa.int64()),
                batch.column("url"),
                pa.array(out, pa.string()),
                pa.array([len(text) for text in out], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    Null and empty pages, and pages without text, give an empty text. Ids and urls stay as
    they are, null included; repeated rows answer alike; other columns are ignored. Unclosed elements end
    with their parent or the page, an unclosed comment or script hides the rest.
    """
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
