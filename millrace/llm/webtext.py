"""Main text of web pages by consensus of the pages of a host.

Three steps: every page's containers are scored and the best named by its generalised path (tags and classes from the
root, digits replaced); the paths' scores are added up by host in Spark, which gives each host its winning path; each
page is then extracted anew from the containers on its host's path. A page that has no container on that path, and one
without a host, uses its own best container.

Elements lie apart from main text by their tag, by whole words of their class, id, role or name of a custom element (`no-`,
`has-` and the like turn a word off), or because they are hidden; inline elements are judged too. Words and tags
are guesses: where all that lies apart leaves next to nothing of a page, the largest part that was taken away comes back.

A page's text is its blocks in order, white space inside a block being one space, blocks being joined by two line
feeds. Null or empty html, and pages without text, give an empty text. Repeated pages vote and are extracted each. An
unclosed element ends with its parent, an unclosed attribute with its tag; a page cut off in the middle of a tag ends there. Elements may be nested to any depth.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, stored

#: A comment, a tag, or a declaration. A quoted value with a > inside counts as one only if something else than a name follows its end.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\">]*+\"|'[^'>]*+'|\"[^\"]*+\"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z))*+(?=>|\Z)|[^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"""(?<![\w-])(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
#: Elements that never hold text of a page.
NEVER = {"noscript", "template", "svg", "math", "object", "canvas", "head", "select", "datalist", "button", "label", "legend", "audio", "video", "map", "menu"}
#: Elements that hold the main text only where nothing else does.
RARELY = {"nav", "header", "footer"}
#: Elements that may wrap the main text of a page.
SELDOM = {"aside", "form", "dialog", "fieldset"}
BLOCKS = {"p", "div", "section", "article", "main", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "hr", "details", "summary", "center", "head", "legend", "menu"} | RARELY | SELDOM
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "legend"}
#: What else ends where an element begins.
CELLS = {"td", "th"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": CELLS, "th": CELLS, "tr": {"tr", *CELLS}, "body": {"head"}}
#: Words by which a class, id or role says that an element isn't main text.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion promotions banner nav navbar navigation menu menus sidebar header masthead footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar search skip copyright complementary contentinfo dialog".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: A word in front, or behind, by which a name speaks of something else than its element.
NEGATIONS = frozenset("no not non without with has have hide disable enable".split())
STATES = frozenset("open closed enabled disabled on off allowed active inactive".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
#: How small the rest of a page's text must be, as a share of an element's, for the element to come back: never, as a reader comment, a menu or footer, another guess, another with a heading.
HARD, COMMENT, OUTER, GUESS, HEADED = 0.0, 0.02, 0.02, 0.05, 0.5


class Node:
    """An element: pieces of text lie in it, and the blocks first:last of its page. apart is None, or the share by which it may come back."""

    __slots__ = ("apart", "code", "depth", "first", "headed", "last", "links", "name", "parent", "size", "tag", "text", "text_links")

    def __init__(self, tag: str, name: str, parent: Node | None, first: int, apart: float | None, code: int, depth: int):
        self.tag, self.name, self.parent, self.first, self.last, self.apart, self.code, self.depth = tag, name, parent, first, first, apart, code, depth
        self.text = self.text_links = self.size = self.links = 0
        self.headed = tag in {"h1", "main", "article"}


def says(value: str) -> float | None:
    """What the words of a class, id, role or custom element's name say."""
    out = None
    for token in value.split():
        parts = [p.lower() for p in PARTS.findall(token.partition("--")[0])]
        if not parts or parts[0] in NEGATIONS or parts[-1] in STATES:
            continue
        words = {*parts, *map("".join, zip(parts, parts[1:]))}
        if words & COMMENTS:
            return COMMENT
        if words & ASIDE:
            out = GUESS
    return out


def named(tag: str, attributes: str) -> tuple[str, int, float | None]:
    """Generalised name of an element, that name's code, and whether it lies apart."""
    apart = HARD if tag in NEVER else OUTER if tag in RARELY else GUESS if tag in SELDOM else says(tag) if "-" in tag else None
    classes = ""
    if "=" in attributes:
        for m in NAMES.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class":
                classes = ".".join(sorted(re.sub(r"\d+", "#", value).replace("/", "|").split()))
            if name == "style":
                apart = HARD if re.search(r"display\s*:\s*none", value, re.I) else apart
            elif apart is None and tag not in {"body", "html", "main"}:
                said = says(value)
                apart = said if tag != "article" or said == COMMENT else None
    if "hidden" in attributes.lower() and HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        apart = HARD
    name = f"{tag}.{classes}" if classes else tag
    return name, crc32(name.encode("utf-8", "surrogatepass")), apart


often = lru_cache(maxsize=1 << 13)(named)


def below(code: int, name_code: int) -> int:
    """Code of a path from that of its parent."""
    return (code * 0x100000001B3 ^ name_code) & 0xFFFFFFFFFFFFFFFF


def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


CLOSING = {tag: closing(tag) for tag in RAW}


class Page:
    """A page's elements in order (the root first), and its blocks, each a list of an element and a piece of text."""

    def __init__(self, page: str):
        self.root = self.top = Node("", "", None, 0, None, 0, 0)
        self.nodes, self.blocks, self.waiting = [self.root], [], []
        self.anchor: Node | None = None
        self.opened: Counter[str] = Counter()
        self.read(page)
        self.settle()

    def end_block(self) -> None:
        if self.waiting:
            self.blocks.append(self.waiting)
            self.waiting = []

    def leave(self, upto: Node) -> None:
        """Close all elements from the innermost up to one."""
        while True:
            node = self.top
            node.last = len(self.blocks)
            self.top = node.parent
            if node is self.anchor:
                self.anchor = None
            self.opened[node.tag] -= 1
            if node is upto:
                return

    def enclosing(self, tag: str) -> Node:
        """The innermost open element of a tag; there is one."""
        node = self.top
        while node.tag != tag:
            node = node.parent
        return node

    def block(self) -> Node:
        """The innermost open block."""
        node = self.top
        while node.parent is not None and node.tag not in BLOCKS:
            node = node.parent
        return node

    def say(self, text: str) -> None:
        n = len(text.strip())
        if n and self.top.tag == "head":
            self.leave(self.top)
        node = self.top
        node.text += n
        if self.anchor is not None:
            node.text_links += n
        if n or self.waiting:
            self.waiting.append((node, text))

    def read(self, page: str) -> None:
        at, unclosed = 0, set()
        while at < len(page):
            m = TOKEN.search(page, at)
            end = m.start() if m else len(page)
            if end > at:
                self.say(page[at:end])
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.close(tag)
            elif tag in RAW:
                if not m[3].endswith("/") and tag not in unclosed:
                    close = CLOSING[tag].search(page, at)
                    at = close.end() if close else len(page) if tag in {"script", "style"} else at
                    if not close:
                        unclosed.add(tag)
            else:
                self.open(tag, m[3])
        self.end_block()
        if self.top is not self.root:
            last = self.top
            while last.parent is not self.root:
                last = last.parent
            self.leave(last)
        self.root.last = len(self.blocks)

    def close(self, tag: str) -> None:
        if tag == "a":
            self.anchor = None
        if tag == "p" or tag in BLOCKS and self.opened[tag]:
            self.end_block()
        if self.opened[tag]:
            self.leave(self.enclosing(tag))

    def open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.anchor = self.top if "href" in attributes.lower() else None
        if tag == "br":
            self.say(" ")
        if tag in BLOCKS:
            self.end_block()
            if tag in ENDS_P and self.opened["p"] and (p := self.block()).tag == "p":
                self.leave(p)
            while self.top.tag in ENDS.get(tag, ()) or self.top.tag == "head":
                self.leave(self.top)
        elif tag in VOID:
            return
        name, code, apart = (often if len(attributes) < 200 else named)(tag, attributes)
        top = self.top
        if tag in BLOCKS:
            if tag in VOID:
                return
            self.top = Node(tag, name, top, len(self.blocks), apart, below(top.code, code), top.depth + 1)
        elif (apart is not None or self.opened[tag]) and not attributes.endswith("/"):
            self.top = Node(tag, "", top, len(self.blocks), apart, top.code, top.depth)
        else:
            return
        self.opened[tag] += 1
        self.nodes.append(self.top)

    def tally(self) -> None:
        """Sizes of all elements without what lies apart inside of them."""
        for n in self.nodes:
            n.size, n.links = n.text, n.text_links
        for n in reversed(self.nodes[1:]):
            n.parent.headed |= n.headed
            if n.apart is None:
                n.parent.size += n.size
                n.parent.links += n.links

    def settle(self) -> None:
        """Decide which elements lie apart, and hand that down."""
        self.tally()
        while True:
            rest, back = self.root.size - self.root.links, None
            hard: set[int] = set()
            for n in self.nodes[1:]:
                if n.apart == HARD or id(n.parent) in hard:
                    hard.add(id(n))
                elif n.apart is not None:
                    plain = n.size - n.links
                    least = HEADED if n.headed and n.apart == GUESS else n.apart
                    if rest < least * plain and (back is None or plain > back.size - back.links):
                        back = n
            if back is None:
                break
            while back is not None:
                back.apart, back = None, back.parent
            self.tally()
        for n in self.nodes[1:]:
            if n.parent.apart is not None:
                n.apart = n.parent.apart

    def containers(self) -> list[Node]:
        return [n for n in self.nodes if n.apart is None and (n is self.root or n.name and n.tag in CONTAINERS)]

    def text(self, spans: list[tuple[int, int]]) -> str:
        """The text of the blocks of spans, in page order."""
        out, at = [], 0
        for first, last in sorted(spans):
            for block in self.blocks[max(first, at) : max(last, at)]:
                said = SPACE.sub(" ", entities.unescape("".join([t for n, t in block if n.apart is None]))).strip()
                if said:
                    out.append(said)
            at = max(at, last)
        return "\n\n".join(out)


def path_of(node: Node) -> str:
    names = []
    while node.parent is not None:
        if node.name:
            names.append(node.name)
        node = node.parent
    return "/" + "/".join(reversed(names))


@lru_cache(maxsize=1 << 12)
def place_of(path: str) -> tuple[int, int]:
    """Depth and code of a path."""
    code, names = 0, path.split("/")[1:] if path != "/" else []
    for name in names:
        code = below(code, crc32(name.encode("utf-8", "surrogatepass")))
    return len(names), code


def score(node: Node, of: int) -> float:
    """How likely a container is the main one: its share of the page's text without links, with a start for telling tags and, of nearly equal ones, for the innermost."""
    text = max(0, node.size - 2 * node.links)
    kind = {"article": 1.0, "main": 0.9, "section": 0.6, "div": 0.6, "td": 0.5, "body": 0.3}.get(node.tag, 0.2)
    return text / max(1, of) * (1 + kind) + 0.002 * min(node.depth, 20) if text else 0.0


def best(nodes: list[Node]) -> tuple[Node, float]:
    of = max(n.size for n in nodes)
    scored = [(score(n, of), n) for n in nodes]
    top = max(s for s, _ in scored)
    return next((n, s) for s, n in scored if s == top)


def voted(html: str) -> tuple[str, float]:
    """Path and score of a page's best container."""
    page = Page(html)
    if not page.root.size:
        return "", 0.0
    node, points = best(page.containers())
    return path_of(node), points


def text_of(html: str, path: str | None) -> str:
    """Main text of a page by its host's path, or by its own best container if nothing is there."""
    page = Page(html)
    nodes = page.containers()
    place = place_of(path) if path else None
    spans = [(n.first, n.last) for n in nodes if n.size and (n.depth, n.code) == place]
    if not spans:
        node, _ = best(nodes)
        spans = [(node.first, node.last)]
    return page.text(spans)


def host(url: str = "url"):
    """Lower-case host of a URL column, or null."""
    return F.lower(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with the most points of each host, ties to the first in order. Points are summed on the way, so that a host's pages never meet."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            votes: dict[tuple[str, str], float] = {}
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path, points = voted(page.as_py() or "")
                if path:
                    votes[name, path] = votes.get((name, path), 0.0) + points
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array([round(v * 1e6) for v in votes.values()], pa.int64())], ["host", "path", "points"])

        return step

    votes = map_rows(pages.select(host().alias("host"), "html").filter("host IS NOT NULL"), "host string, path string, points long", make)
    summed = votes.groupBy("host", "path").agg(F.sum("points").alias("points"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("points"), F.col("path"))).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    winners = stored(host_paths(pages), "host-paths")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", host().alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [text_of(page.as_py() or "", path) for page, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
