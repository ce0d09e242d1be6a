"""Main text of web pages by line-block distribution."""

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tables import slices

# Lines per window; a window with as many characters outside links belongs to a text.
WINDOW = 3
SURGE = 80
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that are never part of a text, and words of their classes, ids and roles that say so of other elements.
APART = {"nav", "footer", "aside", "form", "button", "select", "svg", "menu", "dialog", "canvas", "audio", "video", "object",
         "map", "head"}
APART_WORDS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "ad", "ads", "advert", "adverts",
    "advertisement", "banner", "sponsor", "sponsored", "promo", "promoted", "cookie", "cookies", "consent", "gdpr", "notice",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments",
    "replies", "reply", "disqus", "discussion", "respond", "share", "sharing", "social", "related", "recommended",
    "pagination", "pager", "toolbar", "widget", "masthead", "search", "toc", "skip", "alert", "complementary", "contentinfo",
}
BLOCKS = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p",
          "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption"}
# Elements that hold lines together: those of the first kind whole, of the second those that follow each other.
WHOLE = {"article", "main"}
HOLDERS = WHOLE | {"body", "div", "section", "td", "center"}
_MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"""
                     r"""((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*+)(?:>|\Z)""", re.DOTALL)
_LABEL = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}


def is_apart(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds menus, notices, adverts, comments and the like. A header within a text heads the text."""
    if name in APART or name == "header" and not inside:
        return True
    if name in ("body", "html", "main", "article") and "comment" not in attributes.lower() or not attributes:
        return False
    found = {w.lower() for m in _LABEL.finditer(attributes) for w in _NAME.findall(m[1] or m[2] or m[3] or "")}
    return not found.isdisjoint(APART_WORDS)


def lines_of(page: str) -> list[tuple[str, int, tuple[int, str]]]:
    """The page without markup: (text, characters outside links, (number, name) of its holder) of each block with text.

    Elements that are apart are left out. An element ends with its own end tag or that of an element around it.
    """
    lines, pieces, linked = [], [], 0
    # (name, holder, whether the element is apart, whether it is a link)
    stack = []
    holder, number, apart, links, at = (0, "body"), 0, 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join(references.unescape("".join(pieces)).split())
        if text:
            lines.append((text, max(0, len(text) - linked), holder))
        pieces.clear()
        linked = 0

    def add(text):
        nonlocal linked
        if not apart and text:
            pieces.append(text)
            if links:
                linked += len(text)

    while True:
        found = _MARKUP.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at:found.start()])
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in ("td", "th", "br"):
            if name in BLOCKS:
                if not apart:
                    flush()
            else:
                add(" ")
        if found[1]:
            if any(s[0] == name for s in stack):
                while True:
                    closed = stack.pop()
                    apart -= closed[2]
                    links -= closed[3]
                    holder = closed[1]
                    if closed[0] == name:
                        break
        elif name in RAW:
            if not (found[3] or "").rstrip().endswith("/") or name in ("script", "style"):
                end = _END[name].search(page, at)
                at = end.start() if end else len(page)
        elif name not in VOID and not (found[3] or "").endswith("/"):
            if name in BLOCKS and stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                holder = stack.pop()[1]
            out = is_apart(name, found[3] or "", holder[1] in WHOLE)
            if out and not apart:
                flush()
            stack.append((name, holder, out, name == "a"))
            apart += out
            links += name == "a"
            if name in HOLDERS and holder[1] not in WHOLE:
                number += 1
                holder = (number, name)
    flush()
    return lines


def main_lines(lines: list[tuple[str, int, tuple[int, str]]], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between the surge and the dive around the richest window, and the rest of what holds them.

    Each line starts a window of ``window`` lines. Going out from the richest one, the text begins where windows surge
    over ``surge`` characters outside links and ends where they dive below. If the richest lines stand in an article
    or main element, the text is that element; else lines next to the text that share their holder belong to it.
    """
    if not lines:
        return []
    sizes = [size for _, size, _ in lines]
    sums = [sum(sizes[i:i + window]) for i in range(len(sizes))]
    peak = max(range(len(sums)), key=lambda i: (sums[i], -i))
    richest = max(range(peak, min(peak + window, len(lines))), key=lambda i: (sizes[i], -i))
    holder = lines[richest][2]
    if holder[1] in WHOLE:
        return [text for text, _, at in lines if at == holder]
    first = last = richest
    while first and sums[first - 1] >= surge and sizes[first - 1]:
        first -= 1
    while last + 1 < len(lines) and sums[last + 1] >= surge and sizes[last + 1]:
        last += 1
    while first and lines[first - 1][2] == holder:
        first -= 1
    while last + 1 < len(lines) and lines[last + 1][2] == holder:
        last += 1
    return [text for text, _, _ in lines[first:last + 1]]


def main_text(page: str) -> str:
    return "\n".join(main_lines(lines_of(page)))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Markup, scripts, styles and elements that are menus, page headers, footers, sidebars, notices, adverts, forms or
    reader comments go; the rest is lines, one per block element, of which ``main_lines`` keeps the article. Character
    references are decoded, white space within a line becomes one space, lines are joined by one newline. A page
    without text, an empty or a null one has an empty text. Markup that is cut off or never closed is read as far as it
    goes. Repeated rows are read each; null ids and urls are kept; nothing is shuffled.
    """
    plain = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"),
                         F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    kinds = [plain.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def read(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(t) for t in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return plain.mapInArrow(read, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
