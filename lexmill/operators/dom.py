"""HTML as trees: pruning of boilerplate, main content, splitting, Markdown.

The functions on strings are pure; the DataFrame operators call them batch by
batch and never gather rows.  A null page is an empty page.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Element names by what they mean for parsing, pruning and splitting.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ALWAYS_REMOVED = frozenset("script style noscript svg canvas iframe video audio source track embed object param map area".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}}
EMPTYABLE = frozenset("div span section article p".split())
SPLIT_AT = ("section", "article", "div", "h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "table")
# What class and id attributes of advertising and the like contain.
AD = re.compile(
    r"ad[-_]?|ads[-_]?|advert|banner|sponsor|promo|sidebar|widget|popup|modal|cookie|gdpr|consent|newsletter|subscribe|social[-_]?share|share[-_]?button|comment[-_]?section|related[-_]?post|recommended|trending",
    re.I,
)
CONTENT_NAMES = ("content", "main", "article", "post", "entry", "body")


@dataclass
class Comment:
    text: str


@dataclass
class Node:
    """An element; the document is one without a name."""

    name: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list[Node | str | Comment] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order, however deep."""
        todo = self.children[::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                yield x
                todo += x.children[::-1]

    def text(self) -> str:
        """All text, each string stripped."""
        out, todo = [], self.children[::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x.strip())
            elif isinstance(x, Node):
                todo += x.children[::-1]
        return "".join(out)

    def __str__(self) -> str:
        out: list[str] = []
        todo: list[tuple[Node | str | Comment, str]] = [(self, "")]  # with the name of the parent; end tags come as strings of no parent
        while todo:
            x, parent = todo.pop()
            if isinstance(x, str):
                out.append(x if parent in ("script", "style", "/") else escape(x, quote=False))
            elif isinstance(x, Comment):
                out.append(f"<!--{x.text}-->")
            else:
                if x.name:
                    attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in x.attrs.items())
                    out.append(f"<{x.name}{attrs}/>" if x.name in VOID else f"<{x.name}{attrs}>")
                    if x.name in VOID:
                        continue
                    todo.append((f"</{x.name}>", "/"))
                todo += [(c, x.name) for c in x.children[::-1]]
        return "".join(out)


def text_lengths(root: Node) -> dict[int, int]:
    """Length of each element's text, by the element's identity, in one pass."""
    out: dict[int, int] = {}
    for n in reversed([root, *root.walk()]):
        out[id(n)] = sum(len(c.strip()) if isinstance(c, str) else out[id(c)] if isinstance(c, Node) else 0 for c in n.children)
    return out


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # places of open elements, by name

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "table"})
        if tag in CLOSED_BY_SIBLING:
            self._close(CLOSED_BY_SIBLING[tag], STOPS.get(tag, set()))
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _innermost(self, names: set[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def _close(self, names: set[str], stops: set[str]) -> None:
        """Close the innermost element of one of the names, if no stop is open inside of it."""
        k = self._innermost(names)
        if k > self._innermost(stops):
            while len(self.open) > k:
                self.at[self.open.pop().name].pop()

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, set())

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def handle_comment(self, data: str) -> None:
        self.open[-1].children.append(Comment(data))


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def find(root: Node, name: str) -> Node | None:
    return next((n for n in root.walk() if n.name == name), None)


@dataclass(frozen=True)
class Pruner:
    """Removes boilerplate elements; which, the options say."""

    remove_nav: bool = True
    remove_footer: bool = True
    remove_header: bool = False
    remove_aside: bool = True
    remove_ads: bool = True
    remove_empty: bool = True
    min_text_length: int = 20

    def reason(self, node: Node) -> str:
        """Why an element goes; empty if it stays."""
        if getattr(self, f"remove_{node.name}", False) and node.name in ("nav", "footer", "header", "aside"):
            return node.name
        if self.remove_ads and AD.search(f"{' '.join((node.attrs.get('class') or '').split())} {node.attrs.get('id') or ''}"):
            return "ad_pattern"
        if node.attrs.get("hidden") or node.attrs.get("aria-hidden") == "true":
            return "hidden"
        style = (node.attrs.get("style") or "").replace(" ", "")
        return "hidden_style" if "display:none" in style or "visibility:hidden" in style else ""

    def prune(self, html: str) -> tuple[str, dict[str, int]]:
        """Pruned HTML and how many elements went for each reason, each outermost one counted once."""
        root, gone = parse(html), Counter()

        def sweep(why: Callable[[Node | str | Comment], str]) -> None:
            todo = [root]
            while todo:
                node = todo.pop()
                reasons = [why(c) for c in node.children]
                gone.update(filter(None, reasons))
                node.children = [c for c, reason in zip(node.children, reasons, strict=True) if not reason]
                todo += [c for c in node.children if isinstance(c, Node)]

        sweep(lambda c: "comment" if isinstance(c, Comment) else "")
        sweep(lambda c: c.name if isinstance(c, Node) and c.name in ALWAYS_REMOVED else "")
        sweep(lambda c: self.reason(c) if isinstance(c, Node) else "")
        for _ in range(3 * self.remove_empty):
            size = text_lengths(root)
            sweep(lambda c: "empty" if isinstance(c, Node) and c.name in EMPTYABLE and size[id(c)] < self.min_text_length else "")  # noqa: B023
        out = str(find(root, "body") or root)
        return re.sub(r"  +", " ", re.sub(r"\n\s*\n", "\n", out)), dict(gone)

    def main_content(self, html: str) -> str:
        """The page's main element, article or content-like container; else the pruned page."""
        root = parse(html)
        size = text_lengths(root)
        for name in ("main", "article"):
            node = find(root, name)
            if node is not None and size[id(node)] > 100:
                return str(node)
        boxes = [n for n in root.walk() if n.name in ("div", "section")]
        for pattern in CONTENT_NAMES:
            for attribute in ("class", "id"):
                for n in boxes:
                    if pattern in (n.attrs.get(attribute) or "").lower() and size[id(n)] > 200:
                        return str(n)
        return self.prune(html)[0]


def count_words(text: str) -> int:
    return len(text.split())


_SPLIT = re.compile(r"<(" + "|".join(SPLIT_AT) + r")(?=[\s/>])", re.I)


@dataclass(frozen=True)
class Chunk:
    content: str
    token_count: int
    split_tag: str | None = None


@dataclass(frozen=True)
class Splitter:
    """Cuts HTML over a token limit at structural elements; the pieces together are the input."""

    max_tokens: int = 6000
    overlap_tokens: int = 100
    count: Callable[[str], int] = count_words

    def cut(self, html: str) -> tuple[int, str]:
        """The structural start nearest the middle; without any, a line end past the first quarter, or the middle."""
        middle = len(html) // 2
        starts = [(abs(m.start() - middle), m.start(), m[1].lower()) for m in _SPLIT.finditer(html) if m.start() > 0]
        if starts:
            _, at, tag = min(starts, key=lambda s: s[0])
            return at, tag
        line = html.rfind("\n", 0, middle)
        return max(1, line if line > middle // 2 else middle), "unknown"

    def split(self, html: str) -> list[Chunk]:
        out: list[Chunk] = []
        todo: list[tuple[str, str | None]] = [(html, None)]
        while todo:
            text, tag = todo.pop()
            n = self.count(text)
            if n <= self.max_tokens or len(text) < 2:
                out.append(Chunk(text, n, tag))
                continue
            at, found = self.cut(text)
            todo += [(text[at:], None), (text[:at], found)]
        return out

    def split_with_overlap(self, html: str) -> list[Chunk]:
        """Each piece after the end of the one before it."""
        base, out = self.split(html), []
        for k, c in enumerate(base):
            text = c.content
            if k and self.overlap_tokens:
                text = f"<!-- continued -->\n{base[k - 1].content[-self.overlap_tokens * 4 :]}\n{text}"
            out.append(Chunk(text, self.count(text), c.split_tag) if k else c)
        return out


def to_markdown(html: str) -> str:
    """Markdown of HTML by rules: headings, lists, tables, code, links, images and emphasis."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 10_000_000))  # these functions call each other and nothing native between, so depth costs heap alone
    try:
        out = _blocks(parse(html))
    finally:
        sys.setrecursionlimit(before)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def _inline(node: Node) -> str:
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(re.sub(r"\s+", " ", c))
        elif isinstance(c, Node):
            inner = _inline(c)
            bare = inner.strip()
            if c.name == "br":
                parts.append("\n")
            elif c.name == "img":
                parts.append(f"![{c.attrs.get('alt') or ''}]({c.attrs.get('src') or ''})")
            elif c.name == "a" and c.attrs.get("href") and bare:
                parts.append(f"[{bare}]({c.attrs['href']})")
            elif c.name in ("strong", "b") and bare:
                parts.append(f"**{bare}**")
            elif c.name in ("em", "i") and bare:
                parts.append(f"*{bare}*")
            elif c.name == "code" and bare:
                parts.append(f"`{bare}`")
            elif c.name not in ("script", "style", "head"):
                parts.append(inner)
    return "".join(parts)


def _table(node: Node) -> str:
    rows = [[_inline(c).strip().replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.name in ("td", "th")] for r in node.walk() if r.name == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    head, *rest = rows
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rest])


def _blocks(node: Node, depth: int = 0) -> str:
    out: list[str] = []
    run = Node("")

    def flush() -> None:
        text = _inline(run).strip()
        if text:
            out.append(text)
        run.children = []

    for c in node.children:
        if not isinstance(c, Node) or c.name not in CLOSES_P | {"html", "body", "li", "tr", "td", "dt", "dd", "thead", "tbody", "head", "script", "style", "title"}:
            if not isinstance(c, Comment):
                run.children.append(c)
            continue
        flush()
        if c.name in ("head", "script", "style", "title"):
            continue
        if re.fullmatch("h[1-6]", c.name):
            text = re.sub(r"\s+", " ", _inline(c)).strip()
            out.append("#" * int(c.name[1]) + " " + text if text else "")
        elif c.name == "pre":
            code = find(c, "code")
            lang = re.search(r"language-(\w+)", (code.attrs.get("class") or "") if code else "")
            raw = "".join(x if isinstance(x, str) else "".join(y for y in x.children if isinstance(y, str)) for x in c.children if not isinstance(x, Comment))
            out.append(f"```{lang[1] if lang else ''}\n{raw.strip(chr(10))}\n```")
        elif c.name in ("ul", "ol"):
            items = [x for x in c.children if isinstance(x, Node) and x.name == "li"]
            for k, item in enumerate(items):
                mark = "- " if c.name == "ul" else f"{k + 1}. "
                body = _blocks(item, depth + 1).replace("\n\n", "\n").replace("\n", "\n" + " " * len(mark))
                items[k] = mark + body
            out.append("\n".join(items))
        elif c.name == "table":
            out.append(_table(c))
        elif c.name == "hr":
            out.append("---")
        elif c.name == "blockquote":
            out.append("\n".join("> " + line for line in _blocks(c).split("\n")))
        else:
            out.append(_blocks(c, depth))
    flush()
    return "\n\n".join(x for x in out if x.strip())


# DataFrame operators.


#: Characters of results, about, after which a batch of them is sent on.
BATCH_CHARS = 1 << 20


def _by_row(df: DataFrame, column: str, keep: list[str], schema: str, f: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows of ``keep`` with the tuples that ``f`` gives for each value of ``column``.

    Values are read one at a time, and results are sent on in small batches, so that a
    worker holds an Arrow batch of its input and little else, however many rows that has.
    """
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    types = to_arrow_schema(StructType.fromDDL(schema))

    def made(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(types)
        kept = [b.column(k).take(pa.array(at, pa.int32())) for k in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t.type) for c, t in zip(cols, types, strict=True)]], [*b.schema.names[: len(keep)], *types.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, size = [], [], 0
            for i, v in enumerate(b.column(len(keep))):
                for row in f(v.as_py() or ""):
                    at.append(i)
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, str))
                if size >= BATCH_CHARS:
                    yield made(b, at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield made(b, at, rows)

    return df.select(*keep, column).mapInArrow(run, ", ".join([*kinds, schema]))


def prune(pages: DataFrame, keep: list[str], html: str = "html", pruner: Pruner | None = None) -> DataFrame:
    """``keep``, ``original_size``, ``pruned_size``, ``pruned_html``, ``elements_removed``."""
    p = pruner or Pruner()

    def one(text: str) -> list[tuple]:
        out, gone = p.prune(text)
        return [(len(text), len(out), out, list(gone.items()))]

    return _by_row(pages, html, keep, "original_size int, pruned_size int, pruned_html string, elements_removed map<string,int>", one)


def main_content(pages: DataFrame, keep: list[str], html: str = "html", pruner: Pruner | None = None) -> DataFrame:
    p = pruner or Pruner()
    return _by_row(pages, html, keep, "main_html string", lambda t: [(p.main_content(t),)])


def split(pages: DataFrame, keep: list[str], html: str = "html", splitter: Splitter | None = None, overlap: bool = False) -> DataFrame:
    """``keep`` and the pieces: ``content``, ``token_count``, ``chunk_index``, ``total_chunks``, ``split_tag``."""
    s = splitter or Splitter()

    def one(text: str) -> list[tuple]:
        chunks = s.split_with_overlap(text) if overlap else s.split(text)
        return [(c.content, c.token_count, k, len(chunks), c.split_tag) for k, c in enumerate(chunks)]

    return _by_row(pages, html, keep, "content string, token_count int, chunk_index int, total_chunks int, split_tag string", one)


def markdown(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    return _by_row(pages, html, keep, "markdown string", lambda t: [(to_markdown(t),)])


def to_pieces(pages: DataFrame, keep: list[str], html: str = "html", pruner: Pruner | None = None, splitter: Splitter | None = None, pruned: bool = True) -> DataFrame:
    """``keep``, ``chunk_index``, ``markdown``: prune(), split() and markdown() of a page one after the other, in one worker."""
    p, s = pruner or Pruner(), splitter or Splitter()

    def one(text: str) -> list[tuple]:
        return [(k, to_markdown(c.content)) for k, c in enumerate(s.split(p.prune(text)[0] if pruned else text))]

    return _by_row(pages, html, keep, "chunk_index int, markdown string", one)
