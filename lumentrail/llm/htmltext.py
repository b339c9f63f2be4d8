"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. Over sliding windows of lines the lengths
of text are summed, with text in links not counted; the main text begins where the sums surge and ends
where they dive. Elements that by their tag, role or class name hold menus, forms, notices, adverts or
comments contribute no lines. If the page marks its main part with ``article`` or ``main``, only the lines
inside can be chosen, and the kept range grows to all of them: short lines at its ends, as a headline,
belong to the text though their window sums are small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.shared import text_batches

WINDOW = 3
#: A surge is a window sum above this share of the page's largest sum, and of at least LEAST characters.
SURGE, LEAST = 0.15, 60

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is no markup, or no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are left out with all they hold.
OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "math", "canvas", "audio", "video", "object", "map", "datalist", "head", "fieldset"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar", "note"}
OUT_NAMES = re.compile(
    r"(?i)(?<![a-z])(?:ads?|adverts?|advertisements?|adsense|adbox|banner|sponsored|sponsor|promo|promoted|cookies?|consent|gdpr|notices?|popup|modal|overlay|paywall|newsletter|subscribe|subscription|signup|sign-up|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toc|sidebar|side-bar|side|widget|related|recommend(?:ed|ations?)|more-stories|popular|trending|share|sharing|social|follow-us|tags?|tagcloud|"
    r"header|site-header|masthead|topbar|footer|site-footer|copyright|legal|disclaimer|disqus|comments?|commentlist|comment-list|respond|replies|discussion|feedback|form|search|skip-link|hidden|sr-only|visually-hidden)(?![a-z])"
)
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *OUT,
}
#: The start of one of these closes an open element of these kinds.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is left out by its tag, role, class or id. ``inside``: it lies in the marked main part."""
    if tag in OUT:
        return True
    if tag == "header" and not inside:
        return True
    if not attributes.strip():
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in OUT_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main", "h1"):
            # inside the article a header is its own, with the headline
            if any(not (inside and "header" in m[0].lower()) for m in OUT_NAMES.finditer(value)):
                return True
    return False


def lines_of(html: str) -> list[tuple[str, int, int]]:
    """The page's blocks in order: text, characters of it in links, number of the marked main part around it (0: none).

    Void elements and unclosed or wrongly nested ones are taken as browsers take them, as far as that matters
    for what a left-out element holds: an end tag closes up to its own start, and is ignored if there is none.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    links, stack, part, parts_seen = 0, [], 0, 0  # stack: tag, what it left out before, part before
    skipping, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, min(links, len(text)), part))
            parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if not skipping and text:
            parts.append(text)
            if in_link:
                links += len(text)

    def pop() -> None:
        nonlocal part, skipping, in_link
        tag, skipped, before = stack.pop()
        if tag in BLOCK or before != part:
            flush()
        skipping -= skipped
        in_link -= tag == "a"
        part = before

    at, n = 0, len(html)
    while at < n:
        k = html.find("<", at)
        if k < 0:
            add(html[at:])
            break
        add(html[at:k])
        if m := SKIP.match(html, k):
            at = m.end()
            continue
        if not (m := TAG.match(html, k)):
            if re.match(r"</?[a-zA-Z]", html[k : k + 3]) and html.find(">", k) < 0:
                break  # a tag cut off by the end of the page
            add("<")
            at = k + 1
            continue
        at, tag, attributes = m.end(), m[2].lower(), m[3]
        if m[1]:
            if tag == "p" and not any(t == "p" for t, *_ in stack):
                flush()
            if any(t == tag for t, *_ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            add(" ")
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            if any(t == "p" for t, *_ in stack) and not skipping:
                while any(t == "p" for t, *_ in stack):
                    pop()
            flush()
        if (closes := CLOSES.get(tag)) and stack and stack[-1][0] in closes:
            pop()
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        skipped = int(_left_out(tag, attributes, part > 0))
        stack.append((tag, skipped, part))
        if tag in ("article", "main") or re.search(r"(?i)role\s*=\s*[\"']?main\b", attributes) or re.search(r"(?i)itemprop\s*=\s*[\"']?articleBody\b", attributes):
            if not part:
                parts_seen += 1
                part = parts_seen
        skipping += skipped
        in_link += tag == "a"
    flush()
    return out


def main_text(html: str | None) -> str:
    """The main text: blocks in page order, joined by a line feed. Null and empty pages have none."""
    lines = lines_of(html) if html else []
    if any(part for *_, part in lines):
        weight: dict[int, int] = {}
        for text, links, part in lines:
            if part:
                weight[part] = weight.get(part, 0) + len(text) - links
        best = max(weight.values())
        # several marked parts of a kind, as chapters, all belong; slight ones are teasers
        keep = {p for p, w in weight.items() if w >= SURGE * best}
        return "\n".join(text for text, _, part in lines if part in keep)
    if not lines:
        return ""
    own = np.array([len(text) - links for text, links, _ in lines])
    sums = np.convolve(own, np.ones(WINDOW, int))[WINDOW - 1 :]  # of each line and those after it
    rise = max(LEAST, SURGE * sums.max())
    first = last = None
    best = (0, 0, 0)
    for i in range(len(own) + 1):  # surge: from a sum above the level whose first line has text; dive: a window of nothing
        if first is None:
            if i < len(own) and sums[i] >= rise and own[i] > 0:
                first = last = i
        elif i == len(own) or sums[i] < rise * 0.25:
            last = max(j for j in range(first, i) if own[j] > 0)
            best = max(best, (int(own[first : last + 1].sum()), -first, last))
            first = None
    if not best[0]:
        i = int(own.argmax())
        return lines[i][0] if own[i] else ""
    return "\n".join(text for text, links, _ in lines[-best[1] : best[2] + 1] if 2 * links < len(text) or not links)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row, over its whole html.

    Rows are independent, so repeated rows, ids and null ids come back as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return text_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
