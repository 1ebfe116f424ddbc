"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, and the text
lengths of lines are summed over a sliding window of lines; text inside links
counts against a line.  Lines that the markup marks as a menu, advert, form and
the like are left out first, so text goes on behind them.  Where the sums surge,
a run of main text begins; where they dive to nothing, it ends.  The text of all
runs is kept.

``article`` and ``main`` elements correct the ends of runs: inside of one a line
never weighs nothing, so a list of links makes no dive, and a run that surges in
one has all of its lines.  Where the elements that surge hold as much text as
any run has outside of them, theirs is the main text; else they are teasers, and
that of the runs outside is.  Elements in asides and among comments do not count,
nor do articles that are marked themselves.

A page is read from left to right once, in time proportional to its length,
however broken its markup is.

Null and empty pages, and pages of nothing but boilerplate, give the empty
text; a page too short to surge gives all its text that is not marked.  Pages of
any length are read whole.  Repeated rows give repeated rows, and equal lines
stay, each in its place.  An empty table gives an empty table.  Columns beyond
``page_id``, ``url`` and ``html`` are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import slices_of

# Element names and class words with their roles.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu button search fieldset".split())
BOILERPLATE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Marks that hold for articles inside, and class names of articles that tell the topic or what is absent.
_FIRM = re.compile(r"comment|disqus|replies|respond|related|recommended", re.I)
_TOPIC = re.compile(r"(?<![\w-])(?:category|tag|has|no|with)-[^\s\"'>]*", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Lines in a window, and characters in a window that make a surge.
WINDOW, SURGE = 3, 60

def _marked(name: str, attributes: str) -> bool:
    """Whether an element is boilerplate by its name or attributes."""
    if name in BOILERPLATE:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for k, a, b, c in _ATTR.findall(attributes):
        k, v = k.lower(), a or b or c
        if k in ("class", "id") and any(w.lower() in BOILERPLATE_WORDS for w in _WORD.findall(v)):
            return True
        if k == "role" and v.lower() in BOILERPLATE_ROLES:
            return True
        if k == "hidden" or k == "aria-hidden" and v.lower() == "true":
            return True
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
    return False


_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


class Token(NamedTuple):
    """A piece of text, or a tag: its name in lower case, ``/`` before that of an end tag, and its attributes."""

    name: str
    body: str


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` has its ``>``; -1 if nowhere.  Quotes count behind an equals sign."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        k = m.start() - 1
        while page[k].isspace():
            k -= 1
        close = page.find(m[0], m.end()) if page[k] == "=" else -1
        at = close + 1 if close >= 0 else m.end()
    return -1


def tokens(page: str) -> Iterator[Token]:
    """Text and tags in order, without comments and what raw elements hold."""
    at = done = 0
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            after = end + 3
        elif page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            after = end + 3
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            after = end + 1
        elif m := _NAME.match(page, start + 1):
            end = _tag_end(page, m.end())
            after = end + 1
        else:  # no markup
            at = start + 1
            continue
        if start > done:
            yield Token("", page[done:start])
        if end < 0:  # it never ends
            return
        if page[start + 1] not in "!?":
            name, attributes = m[0].lower(), page[m.end() : end]
            if name in _ENDS:
                if not attributes.endswith("/") or name not in ("svg", "math"):
                    close = _ENDS[name].search(page, after)
                    after = close.end() if close else len(page)
                yield Token("", " ")
            else:
                yield Token(name, attributes)
        else:
            yield Token("", " ")
        at = done = after
    if done < len(page):
        yield Token("", page[done:])


def _closed(found: list[Token]) -> set[int]:
    """Places of the start tags that have end tags."""
    opened: dict[str, list[int]] = {}
    out: set[int] = set()
    for i, t in enumerate(found):
        if t.name[:1] == "/":
            if starts := opened.get(t.name[1:]):
                out.add(starts.pop())
        elif t.name:
            opened.setdefault(t.name, []).append(i)
    return out


class Line(NamedTuple):
    """A block's text, how much of it counts, the number of the article or main element around it (0: none), and whether it is unmarked."""

    text: str
    weight: int
    container: int
    unmarked: bool


class _Open(NamedTuple):
    """An open element: name, whether it is marked, the container around, and whether its mark goes if it has no end."""

    name: str
    marked: bool
    container: int
    loose: bool


def lines_of(page: str) -> list[Line]:
    """Blocks in page order."""
    found = list(tokens(page))
    closed = _closed(found)
    out: list[Line] = []
    text: list[str] = []
    stack: list[_Open] = []
    depth: dict[str, int] = {}  # open elements by name
    linked = off = loose = container = containers = in_link = 0

    def close() -> None:
        nonlocal linked
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                out.append(Line(line, 0 if off else max(0, len(line) - 2 * linked), container, not off))
            text.clear()
        linked = 0

    def push(name: str, marked: bool, is_loose: bool = False) -> None:
        nonlocal off, loose
        stack.append(_Open(name, marked, container, is_loose))
        depth[name] = depth.get(name, 0) + 1
        off += marked
        loose += is_loose

    for i, (name, body) in enumerate(found):
        if not name:
            text.append(body)
            if in_link:
                linked += len(body)
            continue
        end, name = name[0] == "/", name.lstrip("/")
        if name in BLOCKS:
            close()
        elif name in ("br", "td", "th"):
            text.append(" ")
        if name == "a":
            in_link = 0 if end else int(i in closed)
            continue
        if name in VOID or body.endswith("/") and name not in BLOCKS:
            continue
        if end:
            if depth.get(name):
                while True:
                    e = stack.pop()
                    depth[e.name] -= 1
                    off -= e.marked
                    loose -= e.loose
                    container = stack[-1].container if stack else 0
                    if e.name == name:
                        break
            continue
        if name in ("article", "main"):
            if name == "article" and _marked(name, _TOPIC.sub("", body)):
                push(name, True)
                continue
            # An unclosed menu or advert before the text does not swallow it; asides and comments hold theirs.
            if loose and not container:
                stack = [e._replace(marked=False, loose=False) if e.loose else e for e in stack]
                off -= loose
                loose = 0
            if not container and not off:
                containers += 1
                container = containers
            push(name, False)
            continue
        if name not in BLOCKS and name not in ("span", "ins"):
            continue
        marked = name not in ("html", "head", "body") and _marked(name, body) or name == "header" and not container
        if name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") and not marked:
            continue  # they hold no blocks that matter, and are often left open
        firm = name == "aside" or _FIRM.search(body)
        push(name, marked, marked and not (firm and i in closed))
    close()
    return out


def runs(weights: list[int]) -> list[tuple[int, int]]:
    """First line and the one after the last of each run of main text, by surges and dives of the window sums."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    out, at = [], 0
    while at < n:
        if sums[at] < SURGE:
            at += 1
            continue
        start = end = at
        while end < n and sums[end]:
            end += 1
        at = end
        while not weights[start]:
            start += 1
        while not weights[end - 1]:
            end -= 1
        out.append((start, end))
    return out


def main_text(page: str | None) -> str:
    """Main text of one page: its blocks joined by newlines."""
    if not page:
        return ""
    lines = [x for x in lines_of(page) if x.unmarked]  # marked lines do not part the text around them
    inside: dict[int, list[int]] = {}
    for x in lines:
        if x.container:
            inside.setdefault(x.container, []).append(max(1, x.weight))
    surging = {c for c, weights in inside.items() if runs(weights)}
    others = [x for x in lines if x.container not in surging]
    found = runs([x.weight for x in others])
    if surging and sum(sum(inside[c]) for c in surging) >= max((sum(x.weight for x in others[a:b]) for a, b in found), default=0):
        return "\n".join(x.text for x in lines if x.container in surging)
    return "\n".join(x.text for a, b in found or [(0, len(others))] for x in others[a:b])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in slices_of(b.column(2)):
                texts = [main_text(h) for h in some]
                ids, urls = (b.column(k).slice(first, len(some)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
