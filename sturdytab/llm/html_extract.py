"""HTML extraction by line-block distribution.

The markup is stripped into lines, one per block element, with character references decoded and white space reduced to
single spaces. Lines of page furniture (navigation, asides, forms, adverts, notices, comments, page headers and footers, told by
element, role, class or id) are left out first. Elements that may stand around a whole page although they are marked as furniture (a
`form`, a class such as `has-sidebar` that does not begin with the mark) are wrappers, on which the windows decide: if what is
outside them has no surge, those with a surge of their own belong to the page, the outermost first; if there is no text outside, those that hold
a menu, header or footer do so, too. A line's weight is the length of its text outside links; the block at a
line is the sum of weights over `BLOCK` lines. Text surges where a block reaches `SURGE`, or the page's largest block if
that is less, and dives where a whole block is empty; a surge reaches back over the lines with text that adjoin it.

If the page declares an article (`article`, `main`, role main, item property articleBody), a line inside weighs its whole
length and `SURGE` more, so any text there is a surge; stretches inside and outside are summed apart, and those outside must
reach `SURGE` by themselves. A marked `article`, and one in furniture that is closed as it should be, is furniture.

Only the text between surge and dive counts: a page without any gives an empty text, as do a null or empty html.
Broken markup is read leniently: unclosed elements end with their parent, hidden ones too; an unclosed comment, script or
other raw text ends with the page.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, need, slices

BLOCK = 3
SURGE = 86
WRAPPERS = 8  # wrappers within each other that are told apart

# HTML elements by what they do to text.
HIDDEN = "script style noscript template textarea title svg math iframe object canvas audio video select datalist".split()
RAW = "script style textarea title iframe".split()
FOREIGN = "svg math".split()
FURNITURE = "nav footer aside form menu dialog button fieldset search".split()
INLINE = ("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture "
          "progress q ruby rb rp rt s samp small source span strike strong sub sup time track tt u var wbr").split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
ARTICLE = "article main".split()
PARTS = "nav header footer".split()
# Words of classes, ids and roles that mark furniture.
MARKS = ("ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent "
         "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation "
         "menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended share sharing social comment comments "
         "reply replies disqus respond footer masthead toolbar pagination pager skip complementary contentinfo search").split()
HEADER_MARKS = "header topbar banner masthead".split()
READER_MARKS = "comment comments reply replies disqus respond review reviews".split()  # never around a page

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z]+")
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in RAW}
IS_HIDDEN, IS_FURNITURE, IS_INLINE = frozenset(HIDDEN), frozenset(FURNITURE), frozenset(INLINE)
IS_RAW, IS_FOREIGN = frozenset(RAW), frozenset(FOREIGN)
IS_VOID, IS_ARTICLE, IS_MARK, IS_HEADER = frozenset(VOID), frozenset(ARTICLE), frozenset(MARKS), frozenset(HEADER_MARKS)
IS_READER, IS_PART = frozenset(READER_MARKS), frozenset(PARTS)


def leads(said: dict[str, str]) -> bool:
    """Whether a class or id begins with a mark: `comment-item` does, `has-sidebar` does not."""
    firsts = (WORDS.match(x) for x in (said.get("class", "") + " " + said.get("id", "")).split())
    return any(m and m[0] in IS_MARK for m in firsts)


def role_of(name: str, attrs: str, inside: bool) -> str:
    """What an element is by its name and what its attributes say: `furniture`, `shell` (furniture that may hold an article),
    `wrapper` (a shell that may also be around a page without one), `article` or nothing."""
    if name in IS_FURNITURE and name != "form" or name == "header" and not inside:
        return "furniture"
    said = {}
    if attrs.strip(" /"):
        said = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in NAMED.finditer(attrs)}
    marked = set(WORDS.findall(" ".join((said.get("class", ""), said.get("id", ""), said.get("role", ""))))) if said else set()
    if name == "form":
        return "shell" if inside or marked & (IS_MARK | IS_READER) else "wrapper"
    if name in IS_ARTICLE or said.get("role") == "main" or said.get("itemprop") == "articlebody":
        marked = set(WORDS.findall(said.get("class", "") + " " + said.get("id", "")))
        return "furniture" if inside and marked & IS_MARK or name == "article" and leads(said) else "article"
    if not said or name in ("html", "body"):
        return ""
    if "hidden" in said or said.get("aria-hidden") == "true":
        return "furniture"
    if not (marked & IS_MARK or not inside and marked & IS_HEADER):
        return ""
    if leads(said) or said.get("role") in IS_MARK:
        return "furniture"
    return "shell" if inside or marked & IS_READER else "wrapper"


def tags_of(page: str) -> Iterator[tuple[re.Match, int]]:
    """The tokens of a page, each with the place after it; an element of raw text is one token."""
    at = foreign = 0
    while m := TOKEN.search(page, at):
        at = m.end()
        name = (m["open"] or m["close"] or "").lower()
        if name in IS_FOREIGN:
            foreign = max(0, foreign + (-1 if m["close"] else 0 if m["attrs"].endswith("/") else 1))
        elif m["open"] and name in IS_RAW and not (foreign and m["attrs"].endswith("/")):
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
        yield m, at


class Open:
    """The open elements. Where one of a name stands, and whether blocks stand above it, is known without a search."""

    def __init__(self):
        self.stack: list[tuple[str, str, int]] = []  # name, role, beginning
        self.by_name: dict[str, list[int]] = {}
        self.by_role: dict[str, list[int]] = {}

    def push(self, name: str, role: str, at: int) -> None:
        depth = len(self.stack)
        self.stack.append((name, role, at))
        self.by_name.setdefault(name, []).append(depth)
        self.by_role.setdefault(role, []).append(depth)

    def pop(self) -> tuple[str, str, int]:
        name, role, at = self.stack.pop()
        self.by_name[name].pop()
        self.by_role[role].pop()
        return name, role, at

    def last(self, name: str) -> int | None:
        """Depth of the innermost element of a name."""
        depths = self.by_name.get(name)
        return depths[-1] if depths else None


def closed_tags(page: str) -> set[int]:
    """Where the elements begin that have an end of their own, as have all of their name around them."""
    tags = Open()
    ended: dict[int, int | None] = {}  # beginning of an element: that of the next one of its name around it
    for m, _ in tags_of(page):
        name = (m["open"] or m["close"] or "").lower()
        if m["open"] and name not in IS_VOID and name not in IS_RAW and not m["attrs"].endswith("/"):
            tags.push(name, "inline" if name in IS_INLINE else "block", m.start())
        elif m["close"]:
            depth = tags.last(name)
            blocks = tags.by_role.get("block")
            if depth is not None and not (name in IS_INLINE and blocks and blocks[-1] > depth):
                around = tags.by_name[name][-2:-1]
                ended[tags.stack[depth][2]] = tags.stack[around[0]][2] if around else None
                while len(tags.stack) > depth:
                    tags.pop()
    good: set[int] = set()
    for at in sorted(ended):
        if ended[at] is None or ended[at] in good:
            good.add(at)
    return good


def lines_of(page: str) -> tuple[list[tuple[str, int, bool, bool, tuple[int, ...]]], set[int]]:
    """(text, weight, furniture, in the article, wrappers around) of each line of the stripped page, and the wrappers that
    hold a menu, header or footer."""
    lines: list[tuple[str, int, bool, bool, tuple[int, ...]]] = []
    parts: list[str] = []
    linked = 0
    tags = Open()
    stack = tags.stack
    walls: list[int] = []  # depths of open blocks, paragraphs and hidden elements left out
    wrappers: list[int] = []
    around: tuple[int, ...] = ()
    shells: set[int] = set()
    closed: set[int] | None = None
    furniture = article = links = hidden = 0

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, 0 if furniture else max(0, len(text) - linked), furniture > 0, article > 0, around))
            parts.clear()
        linked = 0

    def leave() -> None:
        nonlocal furniture, article, links, hidden, around
        name, role, _ = tags.pop()
        if walls and walls[-1] == len(stack):
            walls.pop()
        furniture -= role in ("furniture", "shell")
        if role == "wrapper":
            wrappers.pop()
            around = around[:len(wrappers)]
        article -= role == "article"
        hidden -= role == "hidden"
        links -= name == "a" and role != "hidden"

    def enter(name: str, role: str, at: int) -> None:
        nonlocal furniture, article, links, hidden, around
        if not (name in IS_INLINE or name == "p" or role == "hidden"):
            walls.append(len(stack))
        tags.push(name, role, at)
        furniture += role in ("furniture", "shell")
        if name in IS_PART:
            shells.update(around)
        if role == "wrapper":
            wrappers.append(at)
            if len(wrappers) <= WRAPPERS:
                around += (at,)
        article += role == "article"
        hidden += role == "hidden"
        links += name == "a" and role != "hidden"

    def say(raw: str) -> None:
        nonlocal linked
        if hidden:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(" ".join(text.split()))

    def well_formed(at: int) -> bool:
        nonlocal closed
        if closed is None:
            closed = closed_tags(page)
        return at in closed

    at = 0
    for m, after in tags_of(page):
        if m.start() > at:
            say(page[at:m.start()])
        at = after
        if m["open"]:
            name = m["open"].lower()
            if name not in IS_INLINE:
                end_line()
            ends = m["attrs"].endswith("/")
            if hidden and name not in IS_INLINE and name not in IS_HIDDEN:
                # an unclosed hidden element ends with its paragraph, and does not hold an article
                depth = tags.by_role["hidden"][0]
                if not well_formed(stack[depth][2]):
                    low = depth if name in IS_ARTICLE else next(
                        (k for k in range(depth - 1, -1, -1) if stack[k][0] not in IS_INLINE), -1)
                    if name in IS_ARTICLE or low >= 0 and stack[low][0] == "p":
                        while len(stack) > low:
                            leave()
            if name in IS_RAW:
                continue
            if name in IS_HIDDEN:
                if not (ends and (name in IS_FOREIGN or not well_formed(m.start()))):
                    enter(name, "hidden", m.start())
                continue
            role = "" if hidden else role_of(name, m["attrs"], article > 0)
            if name in IS_ARTICLE and role == "article" and (furniture or wrappers) and not article:
                # an article can't stand in furniture that was left open
                if not any(well_formed(stack[d][2]) for d in tags.by_role.get("furniture", ())):
                    while stack and (furniture or wrappers):
                        leave()
            if name in IS_VOID or ends and name in IS_INLINE:
                continue
            enter(name, role, m.start())
        elif m["close"]:
            name = m["close"].lower()
            if name not in IS_INLINE:
                end_line()
            depth = tags.last(name)
            # a stray end of an inline element or paragraph does not close the blocks around it
            stray = (name in IS_INLINE or name == "p") and walls and depth is not None and walls[-1] >= depth
            if depth is not None and not stray:
                while len(stack) > depth:
                    leave()
    if at < len(page):
        say(page[at:])
    end_line()
    return lines, shells


def between(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """Surge and dive points: the runs of lines that hold the text."""
    n = len(weights)
    sums = [sum(weights[i:i + BLOCK]) for i in range(n)]
    runs, i, last = [], 0, 0
    while i < n:
        if sums[i] >= surge and weights[i]:
            first = dive = i
            while first > last and weights[first - 1]:
                first -= 1
            while dive < n and sums[dive]:
                dive += 1
            runs.append((first, dive))
            i = last = dive
        i += 1
    return runs


def largest_block(weights: list[int]) -> int:
    return max((sum(weights[i:i + BLOCK]) for i in range(len(weights))), default=0)


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, in the article) of the lines that are not furniture. As long as these have no surge, the wrappers
    one level further in that have one by themselves are opened; if these have no text at all, also those around parts of a
    page."""
    found, shells = lines_of(page)
    lines = [(text, len(text) + SURGE if inside else weight, inside, around)
             for text, weight, aside, inside, around in found if not aside]
    opened: set[int] = set()
    for level in range(WRAPPERS + 1):
        open_lines = [x for x in lines if all(w in opened for w in x[3])]
        most = largest_block([x[1] for x in open_lines])
        if most >= SURGE:
            break
        own: dict[int, list[int]] = {}
        for _, weight, _, around in lines:
            if len(around) > level and all(w in opened for w in around[:level]):
                own.setdefault(around[level], []).append(weight)
        further = {w for w, weights in own.items()
                   if largest_block(weights) >= SURGE or not most and w in shells and any(weights)}
        if not further:
            break
        opened |= further
    return [x[:3] for x in open_lines]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = page_lines(page)
    largest = largest_block([x[1] for x in lines])
    kept = []
    for _, stretch in itertools.groupby(lines, key=lambda x: x[2]):
        part = list(stretch)
        kept += [part[i][0] for a, b in between([x[1] for x in part], min(SURGE, largest)) for i in range(a, b)]
    return " ".join(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                 carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the carried columns, text. Repeated rows and null ids are pages like any other; a carried
    column named `text` is refused; other columns are ignored."""
    need(pages, id_col, html_col, *carry)
    bounded_batches(pages.sparkSession)
    if "text" in carry:
        raise ValueError("a carried column has the name of the result: text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    keyed = pages.select(F.struct(F.col(id_col), *(F.col(c) for c in carry)).alias("key"), F.col(html_col).alias("html"))
    out = keyed.mapInArrow(run, f"key {keyed.schema['key'].dataType.simpleString()}, text string")
    return out.select(*(F.col("key").getField(c).alias(c) for c in (id_col, *carry)), "text")
