"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped and each block element becomes a line. A line weighs its length in code points; markup changes weights
only: link text weighs nothing and text outside paragraphs, headings, lists and tables a quarter; lines of an article or
main element weigh SURGE more each; lines of boilerplate elements, and those outside the article of a page that has one,
weigh nothing. Weights are summed over a sliding window of lines. Where the sum rises above a threshold is a surge point,
where it falls to nothing a dive point, and lines with weight between a surge and its dive are kept.

Defined results: null or blank html gives an empty text; markup that is cut off or not closed is read as far as it goes;
character references are decoded once, with or without a semicolon as browsers do; a line break inside a block is white
space; equal pages have equal texts; repeated rows are kept; pages of any length are read whole, in time that grows with
their length; an empty table gives no rows; other columns, whatever their names, are kept out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_rows

#: Lines in a window.
WINDOW = 3
#: Weight of a window above which a line block surges; half the page's greatest window if that is less.
SURGE = 86

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
#: Elements whose content is not markup.
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template iframe svg textarea".split()}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose whole content is boilerplate.
_DROPPED = frozenset("nav footer aside form title button select dialog menu object audio video canvas map label fieldset".split())
#: Words of a class, id or role that mark boilerplate.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promotion recommended related replies reply respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar warning widget widgets".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("html body article main h1 h2 h3 h4 h5 h6 p span b i em strong a td th tr table tbody li".split())


#: Elements whose own text is prose; other containers' text weighs a quarter.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption summary".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; comments and elements that hold no text have an empty name.

    Each character is looked at a bounded number of times: a quote that is never closed makes quotes count no more.
    """
    at, quotes, size = 0, True, len(html)
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, "", False, ""
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = end + 1 if end >= 0 else size
            yield start, at, "", False, ""
            continue
        m = _TAG.match(html, start)
        if m is None:
            continue
        end, k = -1, m.end()
        while quotes and (stop := _STOP.search(html, k)):
            if stop[0] == ">":
                end = stop.start()
                break
            k = html.find(stop[0], stop.end()) + 1
            if not k:
                break
        if end < 0:
            quotes = False
            end = html.find(">", m.end())
        if end < 0:  # cut off
            yield start, size, "", False, ""
            return
        name, at = m[2].lower(), end + 1
        if name in _RAW and not m[1]:
            close = _RAW[name].search(html, at)
            at = close.end() if close else size
            name = ""
        yield start, at, name, bool(m[1]), html[m.end() : end]


def _boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in _DROPPED or name == "header" and not in_article:
        return True
    for m in _NAMED.finditer(attributes):
        words = re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())
        found = [w for w in words if w in _MARKS]
        if found and not (name in ("html", "body", "main") or "has" in words or "with" in words or "no" in words):
            reader = not _COMMENTS.isdisjoint(found)
            if not in_article and name == "article" and not reader or in_article and m[1].lower() == "id" and (name in _HEADINGS or name == "section" and not reader):
                continue
            if name in _NEVER and name != "article" and m[1].lower() == "class" and not {"comment", "comments", "ad", "ads", "advert", "advertisement", "notice", "share", "sponsored", "breadcrumb", "copyright"} & set(found):
                continue
            return True
    return False


def lines(html: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, weight, in an article) of each line of a page, and whether it has an article element."""
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    links = 0  # characters of link text in the open line
    dropped, depth = "", 0  # the boilerplate element that is open, and how often
    article = link = 0
    seen = prose = False

    def close() -> None:
        nonlocal links
        line = " ".join(unescape("".join(text)).split())
        if line:
            own = max(0, len(line) - links)
            out.append((line, 0 if dropped else SURGE + len(line) if article else own if prose else own / 4, article > 0))
        text.clear()
        links = 0

    at = 0
    for start, end, name, closing, attributes in tags(html):
        if start > at:
            text.append(html[at:start])
            if link:
                links += len(unescape(html[at:start]).strip())
        at = end
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCKS:
            close()
            prose = name in _PROSE and not closing
        if name == "a":
            link = 0 if closing else 1
        if name in _VOID or attributes.endswith("/") and not closing and name not in _BLOCKS:
            continue
        if dropped:
            if name == dropped:
                depth += -1 if closing else 1
            if not depth or name in ("article", "main", "body") and (dropped != name) and (closing or name != "body" and not article):
                if text:
                    close()
                dropped, depth = "", 0
            else:
                continue
        if not closing and name != dropped and _boilerplate(name, attributes, article > 0):
            if text:
                close()
            dropped, depth = name, 1
            out.append(("", 0, False))
            continue
        if name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
            seen = True
    if at < len(html):
        text.append(html[at:])
    close()
    return out, seen


def window_sums(weights: list[float]) -> list[float]:
    """Weight of the WINDOW lines from each line on."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def between(weights: list[float], threshold: float) -> list[bool]:
    """Whether each line lies between a surge point and its dive point."""
    keep, open_ = [], False
    for x in window_sums(weights):
        open_ = x > threshold or open_ and x > 0
        keep.append(open_)
    return keep


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found, has_article = lines(html)
    weights = [n if inside or not has_article else 0 for _, n, inside in found]
    if not any(weights):
        weights = [n for _, n, _ in found]
    keep = between(weights, min(SURGE, max(window_sums(weights), default=0) / 2))
    return "\n\n".join(line for (line, _, _), n, k in zip(found, weights, keep) if k and n)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, "page_id long, url string, text string, n_chars long")
