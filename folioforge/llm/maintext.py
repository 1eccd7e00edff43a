"""HTML extraction by line-block distribution.

Markup is stripped: what stands between two borders of blocks becomes a line.  A line weighs as many
code points as it has outside links, and nothing in menus, footers, adverts and other parts that are
never the article.  Weights are summed over a sliding window of lines; text starts where the sum surges
and ends where it dives to nothing; what lies between is kept (Chen, "cx-extractor", 2009).  Where a page
declares its article by an element, lines outside weigh nothing and lines inside at least a surge, so
articles of few words are found too.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, pieces

#: Lines of a window, and the weight of one that counts as a surge.
WINDOW, SURGE = 3, 80

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements without text of the article, whatever they hold.
NEVER = frozenset("applet audio button canvas datalist head iframe math noembed noframes noscript object option picture script select style svg template textarea title video".split())
#: Elements that are not the article: always, or unless they hold it (an unclosed menu, a form around the page).
OUTSIDE_ALWAYS = frozenset("aside dialog footer".split())
OUTSIDE = frozenset("form header menu nav search".split())
#: Classes, ids and roles that say the same; as a part of a longer name ("has-sidebar"), unless they hold it.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense alert author-box banner breadcrumb breadcrumbs byline-share captcha colophon comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup popular promo promoted promotion recommendations recommended related replies reply respond response search share sharebar sharing sidebar signup skip skip-link social sponsor sponsored subscribe subscription teaser toolbar topbar trending widget widgets".split()
)
#: Words of class, id, role and itemprop that declare an article.
ARTICLE = frozenset("article articlebody article-body article-content entry-content main maincontent main-content post post-body post-content story story-body".split())
#: Parts of longer names that say nothing.
PARTS = frozenset("hidden popular reply response search skip social alert".split())
#: What a start of one of these ends: an open element of the set, up to the nearest of the borders.
IMPLIED = {
    **{t: (frozenset(["p"]), frozenset("button table td th caption object".split())) for t in BLOCKS - frozenset("td th tr tbody thead tfoot li dd dt caption body html head".split())},
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript")}
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"©|\(c\)|copyright\b|all rights reserved", re.I)


@dataclass(eq=False, slots=True)
class Element:
    """An opened element: what it says of itself, what it holds, and from the top down, where it stands."""

    name: str
    parent: Element | None = None
    drops: bool = False  # never the article
    hinted: bool = False  # not the article, unless it holds it
    declares: bool = False  # the article
    holds: bool = False  # an article, or a title and paragraphs
    titles: int = 0
    paragraphs: int = 0
    within: bool = False  # an element that declares the article
    outside: bool = False
    linked: bool = False
    titled: bool = False


def _opened(name: str, attrs: str, parent: Element) -> Element:
    e = Element(name, parent, name in NEVER or name in OUTSIDE_ALWAYS, name in OUTSIDE, name in ("article", "main"), within=parent.within)
    if name == "header" and e.within:
        e.hinted = False  # an article's own header has its title
    if attrs.strip(" \t\n\r\f/"):
        found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attrs)}
        e.drops |= "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDES.search(found.get("style", "")))
        if name not in ("html", "body"):
            said = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop")).split()
            words = {f(w).replace("_", "-") for w in said for f in (str.lower, lambda w: _CAMEL.sub("-", w).lower())}
            parts = set().union(*(w.split("-") for w in words)) - PARTS
            if e.within:
                words, parts = words - {"header"}, parts - {"header"}
            e.declares |= not words.isdisjoint(ARTICLE)
            if not words.isdisjoint(HINTS):
                e.drops |= not (e.declares and name in ("article", "main") and not words.isdisjoint(ARTICLE))
            e.hinted |= name not in ("article", "main") and not parts.isdisjoint(HINTS)
    e.declares &= not (e.drops or e.hinted)
    e.within |= e.declares
    return e


def _closed(e: Element) -> None:
    """Tells the parent what the element held."""
    p = e.parent
    if e.drops or e.hinted and not e.holds:
        return
    p.holds |= e.holds or e.declares
    p.titles += e.titles + (e.name == "h1")
    p.paragraphs += e.paragraphs + (e.name == "p")
    p.holds |= p.hinted and p.name not in OUTSIDE - {"form"} and p.titles > 0 and p.paragraphs > 1


def _lines(page: str) -> list[list[tuple[str, Element]]]:
    """The lines of a page in their order, each as pieces of text with their elements: one pass over the tags
    with a stack of open elements."""
    stack, every, lines, now, at = [Element("")], [], [], [], 0
    opened: Counter[str] = Counter()

    def border() -> None:
        nonlocal now
        if now:
            lines.append(now)
            now = []

    def pop(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            opened[e.name] -= 1
            if e.name in BLOCKS:
                border()
            _closed(e)

    while at < len(page):
        m = _TAG.search(page, at)
        if text := page[at : m.start() if m else len(page)]:
            now.append((html.unescape(text), stack[-1]))
        if not m:
            break
        at, name = m.end(), (m["name"] or m["name2"] or "").lower()
        if name in BLOCKS:
            border()
        if m["end"] or m["end2"]:
            if opened[name]:
                pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name == "br":
            now.append((" ", stack[-1]))
        if not name or name in VOID:
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        ended, borders = IMPLIED.get(name, ((), ()))
        if any(opened[x] for x in ended):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in borders:
                    break
                if stack[k].name in ended:
                    pop(k)
                    break
        e = _opened(name, m["attrs"] or m["attrs2"] or "", stack[-1])
        stack.append(e)
        every.append(e)
        opened[name] += 1
    border()
    pop(1)
    for e in every:  # parents come first
        p = e.parent
        e.outside = p.outside or e.drops or e.hinted and not e.holds
        e.linked, e.titled = p.linked or e.name == "a", p.titled or e.name == "h1"
    return lines


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text of a page's article: its blocks, joined by an empty line."""
    joined = lambda pieces: " ".join("".join(t for t, _ in pieces).split())
    texts, weights, inside, titles = [], [], [], []
    for line in _lines(page):
        kept = [(t, e) for t, e in line if not e.outside]
        text = joined(kept)
        if text or joined(line):  # a line that is not the article's stays as an empty one
            texts.append(text)
            weights.append(len(joined([(t, e) for t, e in kept if not e.linked])))
            inside.append(any(e.within for t, e in kept if t.strip()))
            titles.append(any(e.titled for t, e in kept if t.strip()))
    declared = any(inside)
    if declared:
        titled = any(a and b for a, b in zip(inside, titles))
        weights = [max(w, surge) if a or b and not titled else 0 for w, a, b in zip(weights, inside, titles)]
    n, runs, k = len(texts), [], 0
    sums = [sum(weights[k : k + window]) for k in range(n)]
    while k < n:
        end = k
        if weights[k] and sums[k] >= surge:  # it surges here
            while end < n and sums[end]:  # up to where it dives
                end += 1
            while end > k and (not weights[end - 1] or weights[end - 1] < surge and _RIGHTS.match(texts[end - 1])):
                end -= 1
            runs.append((k, end))
        k = max(end, k + 1)
    if not runs:  # nothing surges: the heaviest run of lines that weigh anything
        bounds = [k for k in range(n + 1) if (k < n and weights[k] > 0) != (k > 0 and weights[k - 1] > 0)]
        runs = sorted(zip(bounds[::2], bounds[1::2]), key=lambda r: -sum(weights[r[0] : r[1]]))[:1]
    return "\n\n".join(texts[k] for a, b in runs for k in range(a, b) if texts[k] and (weights[k] or not declared))


@gives_back
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in pieces(batches, 2):
        texts = [main_text(page or "") for page in some.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """The main text of every page: (page_id, url, text, n_chars).  Blocks have their character references
    decoded and white space turned into one space, and are joined by two line feeds; n_chars counts code points.

    Defined cases: a null or empty page, or one without an article, has an empty text.  Markup that ends in
    the midst of a tag loses that tag alone; elements that are never closed end with their parent.  Pages may
    be as long as a string can be and as deeply nested.  Repeated rows are judged each by itself; an empty
    table gives no rows; other columns are ignored, whatever their names.

    No shuffle: a page is read where it lies.
    """
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(_extract, f"{kinds}, text string, n_chars long")
