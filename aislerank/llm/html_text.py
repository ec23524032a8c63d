"""Main text of web pages by the distribution of line blocks.

Markup is stripped and a page becomes lines, one for each block element, in page order. What pages mark as a menu, header,
footer, sidebar, notice, advert, form or comment, by tag, role, class or id, is markup in this sense and gives no line; no
tag or name says that something is main text. Text inside links counts nothing. The edge of an area (div, section,
article, ...) stands for AREA empty lines, that of a list, table or quotation for one.

The length of a line block is the sum over WINDOW lines. A dive point is a block of length 0; it ends a run of lines. A
surge is a block of at least SURGE characters. The text is every run with a surge. A page without any surge has too little
text to tell, and all its lines are kept.

Character references are decoded, white space in a line becomes one space, empty lines go, and lines are joined by \\n in
page order. Pages are read whole. A null page is an empty one and gives an empty text; so do pages without text. Rows are
kept one for one; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislerank.llm.common import ready, table

WINDOW = 3
SURGE = 80
AREA = 2

#: Element names of HTML by what they do here.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_HIDDEN = _RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog",
                  "svg", "canvas", "object", "audio", "video", "map", "datalist", "fieldset"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4",
          "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p",
          "pre", "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "tr", "ul"}
_AREAS = {"div", "section", "article", "main", "details", "center", "body"} | (_HIDDEN & _BLOCK)
_GROUPS = {"ul", "ol", "dl", "table", "figure", "blockquote"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert",
          "alertdialog", "form"}
#: Words in class or id that name what is not main text.
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "bottom", "breadcrumb",
          "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr",
          "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
          "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies",
          "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
          "subscribe", "subscription", "toolbar", "topbar", "trending", "widget"}
_OPEN = {"article", "main", "body", "html"}  # names on these say what the page is about, not what the element is

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


def _is_apart(name: str, rest: str) -> bool:
    """Whether an element holds no main text."""
    if name in _HIDDEN:
        return True
    if not rest or name in _OPEN:
        return False
    for found in _ATTRIBUTE.finditer(rest):
        key, value = found[1].lower(), (found[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDING.search(value):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and any(p.lower() in _NAMES for p in _PARTS.findall(value)):
            return True
    return False


def lines(page: str) -> list[tuple[str, int]]:
    """(text, characters outside links) of every line, and empty lines at the edges of areas and groups."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    counted = 0
    stack: list[tuple[str, bool]] = []  # open elements: name, apart
    apart = links = 0

    def add(piece: str) -> None:
        nonlocal counted
        if apart or not piece:
            return
        text.append(piece)
        if not links:
            counted += len(piece)

    def end_line() -> None:
        nonlocal text, counted
        line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if line:
            out.append((line, min(counted, len(line))))
        text, counted = [], 0

    def edge(name: str) -> None:
        if not apart:  # what is stripped leaves no gap
            out.extend([("", 0)] * (AREA if name in _AREAS else name in _GROUPS))

    def pop(name: str) -> None:
        nonlocal apart, links
        if not any(n == name for n, _ in stack):
            return
        while stack:
            found, was_apart = stack.pop()
            apart -= was_apart
            links -= found == "a"
            if found == name:
                return

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["close"]:
            if name in _BLOCK:
                end_line()
            edge(name)
            pop(name)
            continue
        if name in _BLOCK:
            end_line()
        if name in _RAW:
            closing = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = closing.end() if closing else len(page) if name in ("script", "style", "title", "textarea") else at
            continue
        if name in _VOID or token["rest"].endswith("/") and name not in _BLOCK:
            continue
        if name == "p":  # a paragraph, list entry or cell ends the one before it
            _implied(stack, {"p"}, pop)
        elif name in ("li", "option", "tr", "td", "th", "dt", "dd"):
            _implied(stack, {name, "p"}, pop)
        was_apart = _is_apart(name, token["rest"] or "")
        stack.append((name, was_apart))
        apart += was_apart
        edge(name)
        links += name == "a"
    end_line()
    return out


def _implied(stack: list, names: set[str], pop) -> None:
    """End an open element of these names unless another container was opened inside it."""
    for found, _ in reversed(stack):
        if found in names:
            pop(found)
            return
        if found in _BLOCK:
            return


def runs_of(lengths: list[int]) -> list[range]:
    """Lines between dive points: from a line with characters to the last one before WINDOW lines without any."""
    runs, start, last = [], None, 0
    for i, n in enumerate(lengths):
        if n:
            if start is not None and i - last > WINDOW:
                runs.append(range(start, last + 1))
                start = None
            start, last = i if start is None else start, i
    return runs if start is None else [*runs, range(start, last + 1)]


def main_text(page: str | None) -> str:
    rows = lines(page or "")
    lengths = [n for _, n in rows]
    blocks = [sum(lengths[i : i + WINDOW]) for i in range(len(rows))]
    runs = [run for run in runs_of(lengths) if any(blocks[i] >= SURGE for i in run)]
    chosen = [i for run in runs for i in run] if runs else range(len(rows))
    return "\n".join(rows[i][0] for i in chosen if rows[i][0])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ready(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kept = pages.select("page_id", "url", F.col("html").cast("string"))
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return kept.mapInArrow(read, schema)


def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
