"""HTML extraction by line-block distribution.

Markup is stripped to lines, one per block. Sums of text lengths over sliding windows of lines surge where the
article begins and dive to nothing where it ends; the text between the points of the largest swell is kept.
Elements that are never article text (menus, scripts, notices ...) leave one empty line. An article or main element that is
in no other one is a swell by its own marks: from its first line to its last, whatever is inside.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; a swell ends where a whole window is empty.
WINDOW = 3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*\Z""", re.S)
_HINTS = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math", "title", "canvas"}
_DROPPED = _RAW | {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "input", "audio", "video", "fieldset"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_EDGES = {"article", "main"}
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu "
    "nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead toolbar share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup popup modal overlay login search widget pagination pager skip".split()
)
_READERS = {"comment", "comments", "reply", "replies", "disqus", "respond"}
_FRAME = {"header", "banner", "complementary", "contentinfo", "dialog", "alert"}


def _dropped(name: str, attributes: str, inside: bool) -> bool:
    if name in _DROPPED or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, value in _HINTS.findall(attributes):
        key, value = key.lower(), re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", value.strip("\"'")).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id", "role"):
            words = set(re.split(r"[^a-z]+", value))
            if words & _READERS or name not in _EDGES and (words & _NAMES or not inside and words & _FRAME):
                return True
    return False


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, length that counts, number of the outermost article or main it is in, 0 outside) of each line: length 0 for
    empty lines and for text in links outside article and main."""
    made: list[tuple[str, int, int]] = []
    text: list[str] = []
    linked = regions = here = 0
    stack: list[tuple[str, bool]] = []  # open elements: name, dropped
    depth = {"dropped": 0, "a": 0, "inside": 0}
    at = 0

    def end_line() -> None:
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split()) if text else ""
        if whole:
            made.append((whole, max(0, len(whole) - linked), here))
        text.clear()
        linked = 0

    def gap(n: int) -> None:
        end_line()
        if n > 1 or not made or made[-1][0]:  # neighbouring dropped elements leave one empty line
            made.extend([("", 0, 0)] * n)

    def close(k: int) -> None:
        for name, gone in stack[k:]:
            depth["dropped"] -= gone
            depth["a"] -= name == "a"
            depth["inside"] -= name in _EDGES
        edge = not depth["inside"] and any(n in _EDGES and not gone for n, gone in stack[k:])
        block = any(n in _BLOCKS for n, _ in stack[k:])
        del stack[k:]
        if not depth["dropped"]:
            if edge:
                gap(WINDOW)
            elif block:
                end_line()

    while True:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not depth["dropped"]:
            text.append(piece)
            here = regions if depth["inside"] else 0
            linked += len(piece) if depth["a"] and not depth["inside"] else 0
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if closing:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None:
                close(k)
            elif name in _BLOCKS and not depth["dropped"]:
                end_line()
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in _CLOSED_BY.get(name, ()):
                close(k)
                break
            if stack[k][0] in _BLOCKS:
                break
        gone = _dropped(name, m[3], depth["inside"] > 0)
        if not depth["dropped"]:
            if gone and name in _BLOCKS | _RAW:
                gap(1)
            elif name in _EDGES and not depth["inside"]:
                gap(WINDOW)
                regions += 1
            elif name in _BLOCKS:
                end_line()
            elif name == "br":
                text.append(" ")
        if name in _RAW:
            shut = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = shut.end() if shut else len(page)
        elif name not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append((name, gone))
            depth["dropped"] += gone
            depth["a"] += name == "a"
            depth["inside"] += name in _EDGES
    if not depth["dropped"]:
        end_line()
    return made


def main_text(page: str | None) -> str:
    """The lines of the outermost article or main with most text; on a page without, those between the surge and the dive of
    the largest swell. Joined by a line break; of equals the first."""
    rows = lines(page or "")
    size = [n for _, n, _ in rows]
    inside = [0] * (max((r for *_, r in rows), default=0) + 1)
    for _, n, region in rows:
        inside[region] += n
    if any(inside[1:]):
        best = inside.index(max(inside[1:]), 1)
        return "\n".join(t for t, _, region in rows if region == best)
    sums = [sum(size[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(size))]
    best, best_size, start = (0, 0), 0, None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i  # surge
        elif not s and start is not None:
            swell = sum(size[start:i])  # dive
            if swell > best_size:
                best, best_size = (start, i), swell
            start = None
    return "\n".join(t for t, *_ in rows[best[0] : best[1]] if t)


def extract(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text in ``into`` (replacing a column of that name).

    A NULL or empty page, or one without text that counts outside dropped elements, gives an empty text. Every
    row stays, repeated rows give the same text, cut-off markup is read as far as it goes. One pass, no shuffle.
    """

    @F.pandas_udf("string")
    def extracted(batch: pd.Series) -> pd.Series:
        return batch.map(main_text)

    return pages.withColumn(into, extracted(F.coalesce(F.col(page), F.lit(""))))
