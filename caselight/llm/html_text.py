"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one for each block of the page. A line's weight
is the length of its text outside links, and nothing if links are half of it. In
an article or main element it weighs ``BONUS`` more; in a menu, header, footer,
sidebar, notice, advert, form or reader comment it weighs nothing. Weights are
summed over a sliding window of lines. Where the sums surge past a threshold that
the page's largest sum sets, the main text begins, where they dive to nothing it
ends, and what lies between is kept. Markup never chooses lines by itself.

As a window cannot tell a short line at the edge of the text from one beside it,
two things are added to a run: lines with a weight that adjoin its begin, and
lines with a weight in a container that the run has lines of directly.

A page is read where it lies; nothing is shuffled.

Defined results: NULL or empty html gives the empty text. Open tags at the end
of a cut page are closed there; of an element that is not shown and not closed,
only scripts, styles, templates, text areas and comments go on to the page's
end. A page without any markup is one block. A column named as the result is
replaced; all others pass through.
"""

from __future__ import annotations

import bisect
import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as t

from caselight.llm import text as T

WINDOW = 3
SURGE = 80
BONUS = 40

# What elements are, and what authors call those beside the text.
RAW = "script style template textarea"
UNSEEN = "noscript select svg iframe object canvas title button"
# Of these, unclosed ones hold their text up to the next block.
LABELS = frozenset("title select button".split())
BESIDE = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div body td blockquote details".split())
# Elements whose end tag may be left out, and what begins after their end; lists
# and tables within them hold others of the kind.
ENDED_BY = {
    "p": BREAKS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"},
}
HOLDERS = frozenset("ul ol menu dir dl table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BESIDE_NAMES = (
    "ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "sidebar", "side", "rail", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer",
    "header", "masthead", "topbar", "toolbar", "comment", "comments", "disqus", "respond", "social", "share",
    "sharing", "related", "recommended", "pagination", "pager", "login", "signup", "search",
)
# Words that say no more than where or what a part of a page is.
NEUTRAL_NAMES = (
    "site", "page", "main", "global", "top", "bottom", "left", "right", "inner", "outer", "box", "block", "wrap", "wrapper",
    "container", "content", "section", "area", "slot", "unit", "bar", "list", "item", "items", "links", "panel", "row", "col",
)
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())

_RAW = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW.replace(" ", "|") + r")(?=[\s/>])([^>]*)>", re.DOTALL | re.IGNORECASE
)
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in RAW.split()}
_UNSEEN = re.compile(r"<(/?)(" + UNSEEN.replace(" ", "|") + r")(?=[\s/>])([^>]*)>", re.IGNORECASE)
_BLOCK = re.compile(r"</?(?:" + "|".join(sorted(BREAKS)) + r")(?=[\s/>])", re.IGNORECASE)
_HEAD = re.compile(r"<head(?=[\s/>])[^>]*>", re.IGNORECASE)
_HEAD_END = re.compile(r"</head\s*>", re.IGNORECASE)
_UNQUOTED = re.compile(r"""=\s*[^\s"']+/$""")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_NAMES, _NEUTRAL = frozenset(BESIDE_NAMES), frozenset(NEUTRAL_NAMES)


def attributes(told: str) -> dict[str, str]:
    """What a tag says, by name; of a name given twice, the first value."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(told):
        found.setdefault(name.lower(), references.unescape(a or b or c))
    return found


def names_beside(one: str) -> bool:
    """Whether a class or id names something beside the text: by one such word, or
    several put together with neutral ones or numbers only."""
    parts = [x for x in re.split(r"[-_]+", one) if x]
    named = [x in _NAMES for x in parts]
    return any(named) and all(k or x in _NEUTRAL or x.isdigit() for k, x in zip(named, parts))


def _is_beside(name: str, told: str, within: bool) -> bool:
    """Whether an element's content is beside the main text. A header within an
    article is the article's own."""
    if name in BESIDE:
        return True
    if name == "header":
        return not within
    if not told or name in ("html", "body"):
        return False
    said = attributes(told)
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or _NONE.search(said.get("style", "")):
        return True
    if said.get("role", "").lower() in BESIDE_ROLES:
        return True
    tokens = f"{said.get('class', '')} {said.get('id', '')}".lower().split()
    return any(names_beside(x) and not (within and x.endswith(("header", "main"))) for x in tokens)


def _is_empty(told: str) -> bool:
    """Whether a tag closes itself; a slash may also end a value without quotes."""
    return told.endswith("/") and not _UNQUOTED.search(told)


def _seen(page: str) -> str:
    """The page without elements that are not shown."""
    kept, at = [], 0
    while tag := _RAW.search(page, at):
        kept += page[at : tag.start()], " "
        at = tag.end()
        if tag[1] and not _is_empty(tag[2]):
            end = _RAW_END[tag[1].lower()].search(page, at)
            at = end.end() if end else len(page)
    page = "".join(kept) + page[at:]
    if (head := _HEAD.search(page)) and (end := _HEAD_END.search(page, head.end())):
        # A head that a block stands in has ended before it.
        if not _BLOCK.search(page, head.end(), end.start()):
            page = page[: head.start()] + " " + page[end.end() :]

    # An end tag closes the last open element of its name.
    opened: dict[str, list[tuple[int, int]]] = {}
    found = []
    for tag in _UNSEEN.finditer(page):
        name = tag[2].lower()
        if not tag[1] and not _is_empty(tag[3]):
            opened.setdefault(name, []).append(tag.span())
        elif tag[1] and opened.get(name):
            found.append((opened[name].pop()[0], tag.end()))
        else:
            found.append(tag.span())
    blocks = [x.start() for x in _BLOCK.finditer(page)] if LABELS & opened.keys() else []
    for name, tags in opened.items():
        for first, last in tags:
            if name in LABELS:
                k = bisect.bisect(blocks, first)
                last = blocks[k] if k < len(blocks) else len(page)
            found.append((first, last))
    kept, at = [], 0
    for first, last in sorted(found):
        if first >= at:
            kept += page[at:first], " "
        at = max(at, last)
    return "".join(kept) + page[at:]


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """Text, weight and container of every block in page order. Blocks beside the
    main text have weight -1. A container is the innermost open element that holds
    blocks, by the order in which these begin."""
    page = _seen(page)
    lines: list[tuple[str, int, int]] = []
    open_: list[tuple[str, int]] = [("", 0)]
    begun = 0
    words: list[str] = []
    linked = 0
    in_link = main_depth = 0
    outside, depth = None, 0
    inner: Counter[str] = Counter()

    def end(beside: bool) -> None:
        nonlocal linked
        if words:
            text = " ".join(references.unescape("".join(words)).split())
            if text:
                weight = len(text) - linked if 2 * linked < len(text) else 0
                lines.append((text, -1 if beside else weight + BONUS * (main_depth > 0), open_[-1][1]))
        words.clear()
        linked = 0

    last = 0
    for tag in _TAG.finditer(page):
        words.append(page[last : tag.start()])
        if in_link:
            linked += len(words[-1])
        last = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing, told = tag[1], tag[3]
        if name in BREAKS or name == "br":
            if name == "br":
                words.append(" ")
            else:
                end(outside is not None)
        if name in CONTAINERS and not _is_empty(told):
            if not closing:
                begun += 1
                open_.append((name, begun))
            elif any(x == name for x, _ in open_):
                while open_.pop()[0] != name:
                    pass
        if name == "a":
            in_link = 0 if closing else 1
        if outside in ENDED_BY and name in BREAKS:
            held = any(inner[x] for x in HOLDERS)
            if name == outside and closing and not held or not closing and not held and name in ENDED_BY[outside]:
                outside = None
            elif not closing:
                inner[name] += not _is_empty(told)
            elif inner[name]:
                inner[name] -= 1
                if not any(inner[x] for x in HOLDERS):
                    for x in ENDED_BY:
                        inner[x] = 0
            elif name != outside and name != "p":
                # The end of what the element lies in.
                outside = None
        if name in VOID or _is_empty(told):
            continue
        if outside is not None:
            if outside not in ENDED_BY and name == outside:
                depth += -1 if closing else 1
                if not depth:
                    end(True)
                    outside = None
        elif not closing and _is_beside(name, told, main_depth > 0):
            end(False)
            outside, depth = name, 1
            inner.clear()
        elif name in MAIN:
            main_depth = max(0, main_depth + (-1 if closing else 1))
    words.append(page[last:])
    end(outside is not None)
    return lines


def surges(weights: list[int], least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs [first, last) of lines from a surge to the dive after it. A run
    begins where the sum of the next lines passes ``least``, at the first of
    them that weighs anything, and ends where the sum is nothing."""
    n = len(weights)
    sums = [sum(weights[k : k + window]) for k in range(n)]
    found, k = [], 0
    while k < n:
        if sums[k] < least or not weights[k]:
            k += 1
            continue
        first = k
        while k < n and sums[k] > 0:
            k += 1
        found.append((first, k))
    return found


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The blocks of the main text, joined by an empty line."""
    lines = lines_of(page or "")
    weights = [max(0, w) for _, w, _ in lines]
    top = max((sum(weights[k : k + window]) for k in range(len(weights))), default=0)
    kept: set[int] = set()
    for first, last in surges(weights, max(1, min(SURGE, top / 2)), window):
        while first and weights[first - 1]:
            first -= 1
        kept.update(range(first, last))
    held = {lines[k][2] for k in kept if weights[k]}
    kept.update(k for k, (_, w, container) in enumerate(lines) if w > 0 and container in held)
    return "\n\n".join(lines[k][0] for k in sorted(kept) if lines[k][1] >= 0)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in ``out``."""
    others = [f for f in pages.schema.fields if f.name.lower() != out.lower()]
    schema = t.StructType([*others, t.StructField(out, t.StringType())])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.parts(batch, html):
                texts = pa.array([main_text(x) for x in part.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), texts], names=schema.names)

    return pages.mapInArrow(run, schema)
