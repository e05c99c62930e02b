"""Operator 10: main text of web pages by consensus host paths.

1. Every page is parsed and its containers are scored: paragraphs give their text, less what stands in links, to the
   container they are in and half of it to the next one out. The page votes for the path of its best container, or of the
   one around it where that holds text in several parts (up to article or main, never body as a whole). A path is
   the chain of tags and classes from the body, generalised: digits and hash-like endings of class names are left out.
2. Votes are counted by host and path; the path with most votes is the host's.
3. Every page is parsed again and its text is taken from all containers at its host's path, however short; a page without
   such a container uses all at the path of its own best one.

Inside a container, menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out by tag, role and class words. Words never decide over the consensus: an element around an article or main
element, or around the host's path, is not left out for its class, role or id (a layout "with-sidebar", a form around the
whole page), and a word after has, no, with and the like names no part. Each block's text has its character references
decoded and its white space turned into single spaces; blocks are joined by line feeds in page order. Nothing else is
dropped or cut.

Defined cases: null or empty html gives the empty text; a page without url or host has no host to agree with and uses its
own best container; a page without any container is one container itself; a page whose every text stands in elements with
such words is read as if they had none; unclosed and stray tags are allowed, an unclosed comment or script runs to the end
of the page. Equal votes go to the path that is first in code-point order, equal scores to the container that comes first.
Pages that repeat, also with their page_id, give a row and a vote each; an empty table gives no row; columns of any other
name than the three are not read. A page of any size is parsed whole, in one pass.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article blockquote body center div main section td".split())
DROPPED = frozenset("aside button datalist dialog fieldset footer form head input label menu nav option select".split())
RAW = "script|style|noscript|template|svg|math|iframe|object|audio|video|canvas|textarea|title"
CLOSES_PARAGRAPH = BLOCK - {"body", "html", "option", "legend"}
CLOSED_BY_LIKE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
LIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
# Words in class, id and role that mark what is not the article.
NOISE = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice outbrain overlay pagination popup promo promoted promotion related remark remarks replies respond responses share sharing sidebar sidenav signup skyscraper social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets alert complementary contentinfo search".split())

# Words that say whether a page has a part, not that an element is one.
ABOUT = frozenset("has have had no not non without with is are hide hides show shows before after includes supports".split())

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z) | <({RAW})\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*>|\Z)) | <[!?][^>]*+(?:>|\Z) | </([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z) | <([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+|["'])*+)(?:>|\Z)""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HASHED = re.compile(r"[-_]{1,2}[a-zA-Z]*\d\w*$|\d+")


#: Depth from which a path holds a digest of its beginning, so that paths stay short and different ones different.
DEEP = 40


class Node:
    __slots__ = ("tag", "path", "parent", "by_tag", "by_word", "noise", "score", "held", "link", "article", "depth", "outer")

    def __init__(self, tag: str, path: str, parent: Node | None, by_tag: bool, by_word: bool, link: bool):
        self.tag, self.path, self.parent, self.by_tag, self.by_word, self.score, self.held, self.link = tag, path, parent, by_tag, by_word, 0.0, 0.0, link
        self.noise = False  # set when the page is known as a whole
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.depth = parent.depth + 1 if parent is not None else 0
        self.outer = parent if parent is None or parent.tag in CONTAINER else parent.outer


def path_below(parent: Node, part: str) -> str:
    """The path of a child; that of a very deep one begins with a digest of its parent's."""
    if parent.depth < DEEP:
        return f"{parent.path}>{part}"
    return f"#{hashlib.sha256(parent.path.encode()).hexdigest()[:32]}>{part}"


def names_noise(value: str) -> bool:
    """Whether a class, id or role names a part that is not the article: by any of its words that no word before it turns into a remark."""
    for name in value.split():
        remark = False
        for w in WORD.findall(name.split("--")[0]):
            w = w.lower()
            if w in ABOUT:
                remark = True
            elif w in NOISE and not remark:
                return True
    return False


def generalise(tag: str, classes: list[str]) -> str:
    kept = sorted({g for c in classes if (g := HASHED.sub("", c).strip("-_"))})
    return ".".join([tag, *kept])


class Page:
    """Blocks of a page, each with its node, its text and how much of it is in links."""

    def __init__(self, source: str):
        self.blocks: list[tuple[Node, str, int]] = []
        self.containers: list[Node] = []
        self.nodes: list[Node] = []
        root = Node("body", "body", None, False, False, False)
        self.root = root
        self.containers.append(root)
        stack = [root]
        open_tags: Counter = Counter()
        parts: list[str] = []
        owner = root
        linked = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.blocks.append((owner, text, linked))
            linked = 0

        def pop_to(depth: int) -> None:
            nonlocal owner
            if any(n.tag in BLOCK for n in stack[depth:]):
                flush()
            open_tags.subtract(n.tag for n in stack[depth:])
            del stack[depth:]
            owner = next((n for n in reversed(stack) if n.tag in BLOCK), root)

        def text_seen(raw: str) -> None:
            nonlocal linked
            if raw:
                t = html.unescape(raw) if "&" in raw else raw
                parts.append(t)
                if stack[-1].link:
                    linked += len(t.strip())

        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                text_seen(source[at : m.start()])
            at = m.end()
            raw, close, tag, attributes = m.groups()
            if close:
                close = close.lower()
                if close in ("body", "html") or not open_tags[close]:
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == close:
                        pop_to(depth)
                        break
                continue
            if not tag:
                continue
            tag = tag.lower()
            if tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
                continue
            if tag in ("body", "html"):
                continue
            if tag in CLOSES_PARAGRAPH and open_tags["p"]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        pop_to(depth)
                        break
                    if stack[depth].tag in CONTAINER:
                        break
            if tag in CLOSED_BY_LIKE and any(open_tags[x] for x in LIKE.get(tag, (tag,))):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in LIKE.get(tag, (tag,)):
                        pop_to(depth)
                        break
                    if stack[depth].tag in CLOSED_BY_LIKE[tag]:
                        break
            if tag in BLOCK:
                flush()
            if tag in VOID:
                continue
            top = stack[-1]
            classes, named, hidden = [], False, False
            if attributes and not attributes.isspace():
                for name, value in ATTRIBUTE.findall(attributes):
                    name = name.lower()
                    if name in ("class", "id", "role"):
                        value = html.unescape(value.strip("\"'"))
                        if name == "class":
                            classes = value.split()
                        named = named or names_noise(value)
                    elif name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and re.search(r"display\s*:\s*none", value)):
                        hidden = True
            path = path_below(top, generalise(tag, classes)) if tag in BLOCK else top.path
            node = Node(tag, path, top, hidden or tag in DROPPED or (tag == "header" and not top.article), named, top.link or tag == "a")
            self.nodes.append(node)
            stack.append(node)
            open_tags[tag] += 1
            if tag in BLOCK:
                owner = node
                if tag in CONTAINER:
                    self.containers.append(node)
        if at < len(source):
            text_seen(source[at:])
        flush()
        self._judge(words=True)
        if self.blocks and all(n.noise for n, _, _ in self.blocks):
            self._judge(words=False)
        for n, text, linked in self.blocks:
            self._credit(n, len(text), linked)
        self.all_containers, self.containers = self.containers, [n for n in self.containers if not n.noise]

    def _judge(self, words: bool) -> None:
        """Which nodes are not of the article: by tag or word, their own or that of a node around them.

        What stands around the article or main element with most text is a frame, whatever words it bears, and so is a form
        there; such an element that is such a part itself frames nothing.
        """
        held: Counter = Counter()
        for n, text, linked in self.blocks:
            at = n
            while at is not None and at.article:
                if at.tag in ("article", "main"):
                    held[id(at)] += len(text) - 3 * linked
                at = at.parent
        framing = set()
        most = 0.0
        for tags in (("article", "main"), ("article",)):  # the second: an article that holds half of the main element or more
            first = max((n for n in self.nodes if n.tag in tags and not n.by_tag and not (words and n.by_word)), key=lambda n: held[id(n)], default=None)
            at = first.parent if first is not None and held[id(first)] >= most / 2 else None
            most = held[id(first)] if first is not None else 0.0
            while at is not None and id(at) not in framing:
                framing.add(id(at))
                at = at.parent
        for n in self.nodes:  # parents come first
            frame = id(n) in framing
            n.noise = n.parent.noise or (n.by_tag and not (frame and n.tag == "form")) or (words and n.by_word and not frame)

    def _credit(self, node: Node, size: int, linked: int) -> None:
        """A block's plain text counts for its container, half as much for the one around it."""
        if node.noise:
            return
        worth = size - 3.0 * linked
        share, at = 1.0, node if node.tag in CONTAINER else node.outer
        if at is not None:
            at.held += worth
        while at is not None and share > 0.2:
            at.score += worth * share
            share, at = share / 2, at.outer

    def best(self) -> Node:
        return max(self.containers, key=lambda n: n.score)  # the first among equals

    def main(self) -> Node:
        """The best container, or the one around it where that holds text in other parts too; not beyond article, main or below body."""
        node, whole = self.best(), {id(n): n.held for n in self.containers}
        parts: Counter = Counter()
        for n in reversed(self.containers):  # those inside come after those around them
            if n.outer is not None:
                whole[id(n.outer)] = whole.get(id(n.outer), 0.0) + max(0.0, whole[id(n)])
                parts[id(n.outer)] += whole[id(n)] > 0
        while node.tag not in ("article", "main") and node.outer is not None and node.outer is not self.root and parts[id(node.outer)] + (node.outer.held > 0) > 1:
            node = node.outer
        return node

    def at_path(self, path: str | None) -> list[Node]:
        """All containers at the path, or at the path of the page's own main container where none there carries text."""
        found = [n for n in self.containers if n.path == path]
        if any(n.score > 0 for n in found):
            return found
        # The host's path decides over words: a container there is taken out of the parts that they name.
        found = [n for n in self.all_containers if n.path == path] if path is not None else []
        if found:
            around = set()
            for n in found:
                at = n
                while at is not None and id(at) not in around:
                    around.add(id(at))
                    at = at.parent
            if not any(n.by_tag for n in self.nodes if id(n) in around):
                for n in self.nodes:
                    n.noise = n.parent.noise or n.by_tag or (n.by_word and id(n) not in around)
                held = {id(n) for n, _, _ in self.blocks if not n.noise}
                if any(not n.noise for n in found) and held:
                    return found
                self._judge(words=True)
        own = self.main()
        return [n for n in self.containers if n.path == own.path]

    def text(self, nodes: list[Node]) -> str:
        inside: dict[int, bool] = {id(n): True for n in nodes}

        def is_inside(node: Node | None) -> bool:
            way = []
            while node is not None and id(node) not in inside:
                way.append(id(node))
                node = node.parent
            found = node is not None and inside[id(node)]
            inside.update(dict.fromkeys(way, found))
            return found

        return "\n".join(t for n, t, _ in self.blocks if not n.noise and is_inside(n))


def vote(source: str | None) -> str | None:
    """Path of the page's best container; null without text."""
    if not source:
        return None
    node = Page(source).main()
    return node.path if node.score > 0 else None


def extract(source: str | None, path: str | None = None) -> str:
    """Main text of one page, from the given path where the page has it."""
    if not source:
        return ""
    page = Page(source)
    return page.text(page.at_path(path))


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of every host. Columns host and html are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, 8 << 20, "html"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vote(h) for h in batch.column(1).to_pylist()], pa.string())], ["host", "path"])

    votes = pages.where("host <> '' and html is not null").select("host", "html").mapInArrow(work, "host string, path string").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), "path")
    return counted.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").select("host", "path")


def extract_main(df: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text for every row."""
    pages = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1)).alias("host"), F.col(source).alias("html"))
    winners = materialise(host_paths(pages), "host-paths")
    # One row for each host: sent to every task while that is few, joined (hot hosts split by the engine) beyond.
    small = winners.count() <= 50_000
    with_path = pages.join(F.broadcast(winners) if small else winners, "host", "left").select("page_id", "url", "path", "html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, 8 << 20, "html"):
            texts = [extract(h, p) for p, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kept = with_path.select("page_id", "url").schema.fields
    return with_path.mapInArrow(work, T.StructType([*kept, T.StructField("text", T.StringType())]))
