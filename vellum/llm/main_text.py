"""Main text of web pages by line-block distribution.

The markup is scanned once.  Block elements end a line; a line collects the text between two such
borders with character references decoded and white space folded.  Each line has a weight: its
length without link text, or nothing where it stands inside an element that never holds article
text (menus, headers, footers, sidebars, notices, adverts, forms, comments: by element name, role,
class or id).  Weights are summed over windows of ``WINDOW`` lines.  A run of lines surges where
the sum first rises above nothing at a line of weight and dives where the window is empty again;
the text is kept between the two.  Where a page marks its article, only the marked lines have
weight; otherwise every run is kept, however light beside the others.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; a run ends only at a gap of so many lines without weight.
WINDOW = 3
#: What parts the blocks of a text in the table of :func:`extract`.
BETWEEN = "\n\n"
#: A line of which links are more than this share has no weight where no article is marked.
LINK_SHARE = 0.5

#: Elements whose whole content is never text.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "title")
#: Elements that end a line.
BLOCK = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav
ol optgroup option p pre section summary table tbody td tfoot th thead tr ul video audio""".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text.
SIDE = frozenset("nav aside footer form header menu button dialog fieldset".split())
#: Roles that hold no article text.
SIDE_ROLES = frozenset("""navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar
toolbar""".split())
#: Words of a class or an id that name such parts.
SIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead toolbar cookie cookies consent
gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related
recommended recommendations comment comments disqus respond reply replies widget widgets pagination pager skip
copyright disclaimer""".split())
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
#: What can end a tag or begin a quoted value in it.
_NEXT = re.compile(r"""=\s*(["'])|>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def scanner(page: str) -> Callable[[int], tuple[int, int, bool, str, str] | None]:
    """A function from a place to the next tag: (beginning, end, whether an end tag, name, attributes).

    Comments and declarations are tags without a name; None where no tag ends any more.  Places only grow.

    A quoted value may hold ``>``.  A quote that is not closed, or whose partner lies behind a ``>`` and ends no
    value, is stray: the tag ends at its first ``>``.  Each quote and border is looked for once, so the time
    is linear in the page whatever is broken in it.
    """
    quotes = {'"': -1, "'": -1}

    def partner(quote: str, after: int) -> int:
        if quotes[quote] < after:
            found = page.find(quote, after)
            quotes[quote] = len(page) if found < 0 else found
        return quotes[quote]

    def tag_end(at: int) -> int:
        first = -1
        while m := _NEXT.search(page, at):
            if not m[1]:
                return m.end()
            stop = partner(m[1], m.end())
            if first <= m.end():
                first = page.find(">", m.end())
                if first < 0:
                    return first
            if first < stop and (stop == len(page) or page[stop + 1: stop + 2] not in (">", "/", " ", "\t", "\n", "\r", "\f")):
                return first + 1
            at = stop + 1
        return -1

    def next_tag(at: int) -> tuple[int, int, bool, str, str] | None:
        m = _OPEN.search(page, at)
        if not m:
            return None
        if m[2]:
            end = tag_end(m.end())
        elif m[0] == "<!--":
            end = page.find("-->", m.end()) + 3
            end = len(page) if end < 3 else end
        else:
            end = page.find(">", m.end()) + 1 or -1
        return None if end < 0 else (m.start(), end, bool(m[1]), (m[2] or "").lower(), page[m.end(): end - 1] if m[2] else "")

    return next_tag


def _is_side(name: str, attributes: str, in_article: bool) -> bool:
    if name in SIDE:
        return not (name == "header" and in_article)
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role" and value.strip() in SIDE_ROLES or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and not SIDE_WORDS.isdisjoint(_WORD.findall(value)):
            return True
    return False


def _is_article(name: str, attributes: str) -> bool:
    return name in ("article", "main") or "role" in attributes and any(
        k.lower() == "role" and (a or b or c).lower() in ("main", "article")
        for k, a, b, c in _ATTRIBUTE.findall(attributes))


def lines_of(page: str) -> tuple[list[tuple[str, int, bool, bool]], bool]:
    """Lines (text, characters in links, beside the article, inside a marked article); any marked."""
    lines, parts, links = [], [], 0
    stack: list[tuple[str, bool, bool, bool]] = []  # name, side, article, link
    side = article = link = 0
    marked, at, end = False, 0, len(page)

    def close() -> None:
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                lines.append((text, links, side > 0, article > 0))
            parts, links = [], 0

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            plain = entities.unescape(raw) if "&" in raw else raw
            parts.append(plain)
            if link:
                links += len(plain.strip())

    opened: dict[str, int] = {}  # elements of each name on the stack

    def pop() -> str:
        nonlocal side, article, link
        name, s, a, k = stack.pop()
        side, article, link = side - s, article - a, link - k
        opened[name] -= 1
        return name

    next_tag = scanner(page)
    while tag := next_tag(at):
        begin, stop, ending, name, attributes = tag
        text(page[at: begin])
        at = stop
        if not name:
            continue
        if name in RAW and not ending:
            if not attributes.rstrip().endswith("/"):
                closed = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
                at = closed.end() if closed else end
            continue
        if name in BLOCK:
            close()
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if ending:
            if opened.get(name):
                while pop() != name:
                    pass
        elif name not in ("p", "li", "b", "i", "em", "strong", "span", "html", "body") or "=" in attributes:
            if name == "a":  # links do not nest
                while stack and link:
                    pop()
            now = _is_article(name, attributes)
            entry = (name, _is_side(name, attributes, article > 0), now, name == "a")
            marked |= now
            stack.append(entry)
            opened[name] = opened.get(name, 0) + 1
            side, article, link = side + entry[1], article + entry[2], link + entry[3]
    text(page[at:])
    close()
    return lines, marked


def runs_of(weights: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) of every run: windows of lines whose summed weight stays above nothing."""
    if not len(weights):
        return []
    summed = np.convolve(weights, np.ones(window, np.int64))[window - 1:]  # from a line on
    runs, start = [], None
    for i, (own, ahead) in enumerate(zip(weights.tolist(), summed.tolist())):
        if start is None and own > 0:
            start = i
        elif start is not None and ahead == 0:
            runs.append((start, i))
            start = None
    if start is not None:
        runs.append((start, len(weights)))
    return runs


def main_blocks(page: str | None) -> list[str]:
    """Blocks of the main text of one page, in page order."""
    lines, marked = lines_of(page or "")
    if marked and not any(inside and not beside for _, _, beside, inside in lines):
        marked = False  # an empty mark says nothing
    weights = np.array([0 if beside or marked and not inside or not marked and links > LINK_SHARE * len(text)
                        else len(text) for text, links, beside, inside in lines], np.int64)
    runs = runs_of(weights)
    return [lines[i][0] for a, b in runs for i in range(a, b) if weights[i] > 0 or
            not lines[i][2] and (lines[i][3] or not marked)]


def main_text(page: str | None) -> str:
    """Main text of one page: its blocks with an empty line between them."""
    return BETWEEN.join(main_blocks(page))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    ``text`` holds the kept blocks with an empty line between them.  A null or empty page, and one without
    article text, has the empty text.  Null ids and urls stay null, repeated rows give repeated rows, an empty table an empty table; other columns are
    ignored.  Pages are read whole whatever their length; broken markup is read as far as it goes.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(_texts, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
