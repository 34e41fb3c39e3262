"""Main text of web pages by the distribution of text over lines.

Markup is stripped first: comments, scripts, styles and what a page marks as furniture
(navigation, headers, footers, sidebars, forms, dialogs, and elements whose class, id or
role says advert, notice, menu, comment and the like). What remains is one line per block
element, in page order. Text lengths are summed over windows of ``WINDOW`` lines. The text
begins where the sums surge and ends where they dive back for good, and everything
between is kept.

Linked text counts against a line. A sum must reach a share of the median sum, which one
long block can't raise. From the dive on the text runs to the next line of links or the
end of the element it stands in, so closing lists of short lines stay in; short lines at
the end of a page are stray only behind a line of links.

What a page marks as its article (``article``, ``main``, or a container named so) weighs
the lines: those of the strongest mark always reach the level, links or not, those of
weaker marks count with their length and unmarked ones with half of it, and their sums do
not borrow from stronger lines. No line between surge and dive is dropped for its mark.

Text is decoded (character references), white space inside a block becomes one space,
blocks are trimmed and joined by a line feed. Unclosed and truncated markup is read as
browsers do: a cut tag or comment at the end is dropped, an element ends with its parent.

Defined results: a null page counts as empty and has an empty text; whole pages are read;
rows, repeated rows and other columns are kept, columns with the name of a result are
replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from marketlens.tables import Tables

WINDOW = 3
#: A window sum counts from this share of the median sum.
SHARE = 0.25

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose whole content is no text of the page.
_DROPPED = frozenset("aside button canvas datalist dialog footer form head header iframe label legend map menu nav object search select svg template textarea noscript".split())
#: Elements kept on the stack, so that their end can be found.
_HELD = _DROPPED | frozenset("article main section div ul ol dl table span figure details fieldset blockquote body html center".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = re.compile(r"</(script|style|textarea|title|xmp|noscript|iframe|noembed)\b", re.I)
_RAW_NAMES = frozenset("script style textarea title xmp noscript iframe noembed".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[a-z]+|[0-9]+")
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies complementary dialog disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup popups promo promoted promotion promotions related "
    "replies reply search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar tooltip widget widgets alert alertdialog form".split()
)
_REMARKS = frozenset("comment comments disqus replies reply".split())
_ARTICLE = frozenset("article articlebody post postbody story entry main content".split())
_ENDS = frozenset(".!?…:;\"'”’»)")
_SPACE = re.compile(r"\s+")
#: What is no tag of the page, and the start and end tags of elements that may be left open.
_OPENED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|noscript|iframe|noembed)\b.*?(?:</\1\b|\Z)|<(/?)(div|span|section)\b", re.I | re.S)


class Line:
    __slots__ = ("inside", "linked", "parts")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.inside = 0


def _names(attributes: str) -> tuple[set[str], bool]:
    """Words in class, id, role and itemprop; and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    if attributes:
        for name, value in _NAMED.findall(attributes):
            value = value.strip("\"'").lower()
            if name.lower() == "hidden":
                hidden = True
            elif name.lower() == "aria-hidden":
                hidden |= value == "true"
            else:
                words.update(_PARTS.findall(value))
    return words, hidden


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """``(text, linked characters, rank of the marked article around it)`` of every block outside furniture.

    Ranks: 3 in an article, 2 in the main part, 1 in a container named like one, 0 elsewhere.
    """
    lines: list[tuple[str, int, int]] = []
    text: list[str] = []
    linked = 0
    # open elements: name, dropped, rank, dropped only by its name and no place for remarks
    stack: list[tuple[str, bool, int, bool]] = []
    named: Counter[str] = Counter()  # how many of each name are open
    dropped, rank, links = False, 0, 0
    at, end = 0, len(page)
    lacking: set[str] | None = None  # elements without an end tag, looked for when needed

    def finish() -> None:
        nonlocal text, linked
        if text:
            line = _SPACE.sub(" ", "".join(text)).strip()
            if line:
                lines.append((line, linked, rank))
            text, linked = [], 0

    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            mark = end
        if mark > at and not dropped:
            piece = unescape(page[at:mark])
            text.append(piece)
            if links:
                linked += len(piece.strip())
        if mark == end:
            break
        after = page[mark + 1 : mark + 2]
        if after in ("!", "?"):
            close = page.find("-->", mark + 4) if page.startswith("<!--", mark) else page.find(">", mark)
            at = end if close < 0 else close + (3 if page.startswith("<!--", mark) else 1)
            continue
        if not (after.isascii() and after.isalpha()) and not (after == "/" and page[mark + 2 : mark + 3].isalpha()):
            if after == "" and mark + 1 == end:  # a cut tag
                break
            if not dropped:
                text.append("<")
            at = mark + 1
            continue
        tag = _TAG.match(page, mark)
        if tag is None:
            close = page.find(">", mark)
            if close < 0:
                break  # cut off inside a tag
            closing, name, attributes = page[mark + 1] == "/", re.split(r"[\s/>]", page[mark + 1 : close].lstrip("/"), maxsplit=1)[0].lower(), ""
            at = close + 1
        else:
            closing, name, attributes = bool(tag[1]), tag[2].lower(), tag[3]
            at = tag.end()
        if name in _BLOCKS:
            finish()
        elif name == "br" and not dropped:
            text.append(" ")
        if name in _RAW_NAMES and not closing:
            until = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = until.end() if until else end
            continue
        if name == "a":
            links = 0 if closing else 1
        if name not in _HELD or name in _VOID:
            continue
        if closing:
            if named[name]:
                last = ""
                while last != name:
                    last = stack.pop()[0]
                    named[last] -= 1
                dropped, rank = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            continue
        if attributes.endswith("/") and name == "svg":
            continue
        words, hidden = _names(attributes)
        remarks = bool(words & _REMARKS)
        furniture = name in _DROPPED and not (name == "header" and rank == 3) or hidden or bool(words & _FURNITURE) and name not in ("body", "html") and not (name == "article" and not remarks)
        if dropped and name in ("article", "main") and not remarks and all(x[3] for x in stack if x[1]):
            lacking = left_open(page) if lacking is None else lacking
            if all(x[0] in lacking for x in stack if x[1]):
                while stack and stack[-1][1]:  # an advert or notice that was never closed
                    named[stack.pop()[0]] -= 1
                dropped, rank = False, stack[-1][2] if stack else 0
        inner = rank
        if not furniture and not dropped:
            inner = max(rank, 3 if name == "article" else 2 if name == "main" or "main" in words and "role" in attributes else 1 if words & _ARTICLE and name in ("div", "section") else 0)
        stack.append((name, dropped or furniture, inner, not dropped and furniture and name in ("div", "span", "section") and not remarks or dropped and bool(stack) and stack[-1][3]))
        named[name] += 1
        dropped, rank = stack[-1][1], stack[-1][2]
    finish()
    return lines


def left_open(page: str) -> set[str]:
    """Names of the elements that have fewer end tags than start tags."""
    balance: Counter[str] = Counter()
    for _, closing, name in _OPENED.findall(page):
        balance[name.lower()] += -1 if closing else 1
    return {name for name, n in balance.items() if name and n > 0}


def window_sums(lengths: Sequence[int], window: int = WINDOW) -> list[int]:
    """Sum of the lengths of each line and the lines after it, ``window`` lines in all."""
    sums, running = [], sum(lengths[:window])
    for i, length in enumerate(lengths):
        sums.append(running)
        running += (lengths[i + window] if i + window < len(lengths) else 0) - length
    return sums


def surge_and_dive(lengths: Sequence[int], share: float, window: int = WINDOW, ranks: Sequence[int] = ()) -> tuple[int, int]:
    """First line of the text and the line after its last; equal where there is no text.

    The surge is the first line with text whose window reaches ``share`` of the median sum;
    the dive is after the last line with text whose window, taken backwards, reaches it,
    and after the lines with text of the same rank that follow it without a break. Lines
    of the highest rank above 0 always reach it; windows hold no lines of higher rank.
    """
    if not any(lengths):
        return 0, 0
    ranks = ranks or [0] * len(lengths)
    best = max(r for n, r in zip(lengths, ranks) if n)
    ahead, behind = {}, {}
    for rank in set(ranks):
        own = [n if r <= rank else 0 for n, r in zip(lengths, ranks)]
        ahead[rank], behind[rank] = window_sums(own, window), window_sums(own[::-1], window)[::-1]
    least = max(1.0, share * float(np.median([x for n, x in zip(lengths, window_sums(lengths, window)) if n])))
    reach = [i for i, (n, r) in enumerate(zip(lengths, ranks)) if n and (r == best > 0 or max(ahead[r][i], behind[r][i]) >= least)]
    surge = next((i for i in reach if ranks[i] == best > 0 or ahead[ranks[i]][i] >= least), 0)
    dive = next((i for i in reversed(reach) if ranks[i] == best > 0 or behind[ranks[i]][i] >= least), -1)
    while 0 <= dive < len(lengths) - 1 and lengths[dive + 1] and ranks[dive + 1] == ranks[dive]:
        dive += 1
    return min(surge, dive + 1), dive + 1


def main_text(page: str | None, window: int = WINDOW, share: float = SHARE) -> str:
    lines = lines_of(page or "")
    ranks = [r for _, _, r in lines]
    best = max(ranks, default=0)
    # linked text counts against a line, but not under the strongest mark; unmarked lines of a marked page weigh half
    lengths = [len(t) if r == best > 0 else max(0, len(t) - 2 * linked) // (2 if r == 0 < best else 1) for t, linked, r in lines]
    # behind a line of links, last short lines that end no sentence are stray
    stray, at = min(40, max(lengths, default=0) // 4), len(lines)
    while at > 1 and ranks[at - 1] == 0 and (lengths[at - 1] < stray and lines[at - 1][0][-1] not in _ENDS or not lengths[at - 1]):
        at -= 1
    links = next((i for i in range(at, len(lines)) if not lengths[i] and lines[i][1]), len(lines))
    lengths[links:] = [0] * (len(lines) - links)
    first, end = surge_and_dive(lengths, share, window, ranks)
    return "\n".join(t for t, _, _ in lines[first:end])


def extract(pages: DataFrame, html: str = "html", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The pages with ``text`` in place of the html column."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, window, share) for x in batch.column(batch.schema.names.index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return pages.select(*names, html).mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def query(spark: SparkSession, folder: str) -> DataFrame:
    done = extract(Tables(spark, folder).pages.select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
