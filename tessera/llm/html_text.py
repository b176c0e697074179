"""Main text of web pages by composite text density.

Each node of the page's tree has a density, its characters per tag, lowered by the share of its characters and
tags that are links. Tags, classes and ids that say menu, notice, form or comments lower a node's density to
a hundredth, and so what lies in it, unless it holds most of the body's text and no article or main lies
outside of it. A block's density sum adds up the densities of its child blocks and of the text between them; the block
with the largest sum, or the outermost block around it of half its density or nearer to that than to the body's,
holds the article. The threshold is the least density on the path from there up to the body: what lies beside the path
counts if it is as dense, and what lies in the article goes only if it is lowered below that.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?:(?P<attrs>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|(?P<loose>[^>]*+)(?:>|\Z))",
    re.DOTALL,
)
#: Elements whose content is never text of the page. The first are raw text up to their end tag, or the end of the page; of the others one without an end tag is no element.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
SKIPPED = RAW | {"noscript", "template", "svg", "math", "select"}
CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in SKIPPED}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt", "rp", "nobr",
}
#: Elements that say so too.
LEFT_OUT = {"head", "nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "object", "canvas", "audio", "video"}
#: Words of a class, id or role that say a block isn't part of the article.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|header|masthead|comments?|commentlist|respond|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|"
    r"complementary|contentinfo|search|dialog)(?:$|[\s_-])",
    re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"']+))?""", re.IGNORECASE)
#: An end tag implied by a start tag: the open elements it closes, and those it doesn't reach beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
#: What an open paragraph isn't closed through.
SCOPE = {"table", "td", "th", "caption", "button", "object", "html", "body"}
#: What is left of the density of blocks that say they aren't the article.
LOWERED = 0.01


class Node:
    """An element: its children and texts in page order, and counts of its whole content, less what is lowered."""

    __slots__ = ("tag", "parts", "parent", "inline", "flagged", "lowered", "ended", "depth", "links", "chars", "tags", "link_chars", "link_tags", "plain", "articles", "weight", "density", "total")

    def __init__(self, tag: str, parent: Node | None, inline: bool = False, flagged: bool = False):
        self.tag, self.parent, self.inline, self.flagged = tag, parent, inline, flagged
        self.parts: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.lowered = self.ended = False
        self.links = tag == "a" or inline and parent is not None and parent.links and not parent.ended
        self.chars = self.tags = self.link_chars = self.link_tags = self.plain = self.articles = 0
        self.weight, self.density, self.total = 1.0, 0.0, 0.0

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def _flagged(attrs: str) -> bool:
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role") and HINTS.search(value) or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of elements."""
    root = at = Node("html", None)
    pos = 0
    opened: Counter[str] = Counter()  # on the path to the current element

    def leave(node: Node) -> Node:
        """Closes the open elements up to and with this one."""
        up = at
        while up is not node:
            opened[up.tag] -= 1
            up = up.parent
        opened[node.tag] -= 1
        return node.parent

    def text(raw: str) -> None:
        if raw:
            s = entities.unescape(raw) if "&" in raw else raw
            at.parts.append(s)
            n = len(s) - s.count(" ") if s and not s.isspace() else 0
            at.chars += n
            if at.links and not at.ended:
                at.link_chars += n

    while m := TOKEN.search(page, pos):
        text(page[pos : m.start()])
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        attrs = m["attrs"] if m["attrs"] is not None else m["loose"] or ""
        if m["end"]:
            if opened[tag]:
                node = at
                while node.tag != tag and (tag not in INLINE or node.inline):
                    node = node.parent
                if node.tag == tag:
                    at = leave(node)
                elif tag == "a":  # its end stands within a block: the link ends, the element goes on
                    while node.tag != tag:
                        node = node.parent
                    node.ended = True
            elif tag == "p":
                at.parts.append(Node("br", at))
            continue
        if tag in SKIPPED:
            closed = CLOSES[tag].search(page, pos) if not attrs.endswith("/") or tag not in ("svg", "math") else None
            pos = closed.end() if closed else (pos if attrs.endswith("/") or tag not in RAW else len(page))
            continue
        if tag in VOID:
            at.parts.append(" " if tag != "hr" else Node("br", at))
            at.tags += tag not in ("br", "wbr")
            continue
        if tag == "html":
            continue
        inline = tag in INLINE
        if not inline:
            closes, reach = IMPLIED.get(tag, ({"p"}, SCOPE))
            node, last = at, None
            while any(opened[c] for c in closes) and node.tag not in reach and node.parent is not None:
                if node.tag in closes:
                    last = node
                    if tag not in IMPLIED:
                        break
                node = node.parent
            if last is not None:
                at = leave(last)
        child = Node(tag, at, inline, tag in LEFT_OUT or bool(attrs) and tag not in ("body", "article", "main") and _flagged(attrs))
        child.link_tags = int(tag == "a")
        at.parts.append(child)
        at = child
        opened[tag] += 1
    text(page[pos:])
    return root


def _measure(body: Node) -> list[Node]:
    """Counts each node's content, decides what is lowered, and gives the densities; the nodes, parents first."""
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.nodes()
    own = [(n.chars, n.tags, n.link_chars, n.link_tags) for n in order]
    for node in reversed(order):  # all text, to see who holds most of it
        node.plain += node.chars - node.link_chars
        node.articles += node.tag in ("article", "main") and node.plain > 0
        if node is not body:
            node.parent.plain += node.plain
            node.parent.articles += node.articles
    for node in order:
        node.lowered = node.flagged and node is not body and (2 * node.plain <= body.plain or node.articles < body.articles)
        node.weight = (node.parent.weight if node is not body else 1.0) * (LOWERED if node.lowered else 1.0)
    for node, counts in zip(order, own, strict=True):
        node.chars, node.tags, node.link_chars, node.link_tags = counts
    for node in reversed(order):
        up = node.parent
        if node is not body and not node.lowered:
            up.chars += node.chars
            up.tags += node.tags + (node.tag != "br")
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = body.link_chars / max(1, body.chars)
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share) * node.weight
    for node in order:
        inner = [p for p in node.nodes() if not p.inline]
        kept = [p for p in inner if not p.lowered]
        counts = (n - sum(getattr(p, c) for p in kept) for n, c in ((node.chars, "chars"), (node.tags - len(kept), "tags"), (node.link_chars, "link_chars"), (node.link_tags, "link_tags")))
        node.total = sum(p.density for p in inner) + density(*counts, share) * node.weight
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share`` is the share of the body's characters in links."""
    if chars <= 0:
        return 0.0
    tags, plain = max(1, tags), max(1, chars - link_chars)
    base = math.log(chars / plain * link_chars + share * chars + math.e)
    weight = math.log(chars / max(1, link_chars) * tags / max(1, link_tags)) / math.log(base + 1e-9) if base > 1 + 1e-9 else math.log(chars * tags + 1)
    return chars / tags * max(0.0, weight)


def _words(parts: list[Node | str], threshold: float) -> str:
    """The words of parts of a block; what is lowered below the threshold goes."""
    out: list[str] = []
    stack: list[Node | str] = [*reversed(parts)]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        elif not (part.lowered and part.density < threshold):
            if part.inline:
                stack += reversed(part.parts)
            else:
                out.append(" ")
                stack.append(" ")
                stack += reversed(part.parts)
    return " ".join("".join(out).split())


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by one space; empty if the page has no text but what is lowered."""
    root = parse(page)
    body = next((p for p in root.nodes() if p.tag == "body"), root)
    order = _measure(body)
    best = max((n for n in order if not n.inline or n is body), key=lambda n: (n.total, -n.depth))
    if best.total <= 0 or best.weight < 1:
        return ""
    node, near = best, min(best.density / 2, math.sqrt(best.density * body.density))
    while node is not body:
        node = node.parent
        if not node.inline and node is not body and node.density >= near:
            best = node
    path, node = [best], best
    while node is not body:
        node = node.parent
        path.append(node)
    threshold = min(n.density for n in path)
    # beside the path: blocks, and text between blocks, as dense as the threshold and mostly without links
    above = set(map(id, path)) - {id(best)}
    chosen: list[str] = []

    def loose(parts: list[Node | str]) -> None:
        chars = sum(len(p) - p.count(" ") if isinstance(p, str) and not p.isspace() else 0 if isinstance(p, str) else p.chars for p in parts)
        tags, links = sum(p.tags + 1 for p in parts if not isinstance(p, str)), sum(p.link_chars for p in parts if not isinstance(p, str))
        if chars and links * 4 < chars and density(chars, tags, links, int(links > 0), 0.0) >= threshold:
            chosen.append(_words(parts, threshold))

    stack: list[Node | list[Node | str]] = [body]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            loose(node)
        elif node is best or id(node) not in above and node.density >= threshold and node.link_chars * 4 < node.chars and node.weight == 1:
            chosen.append(_words(node.parts, threshold))
        elif not node.lowered:
            runs: list[Node | list[Node | str]] = []
            for part in node.parts:
                if isinstance(part, Node) and (not part.inline or id(part) in above):
                    runs.append(part)
                elif id(node) in above:
                    if not runs or isinstance(runs[-1], Node):
                        runs.append([])
                    runs[-1].append(part)
            stack += reversed(runs)
    return " ".join(filter(None, chosen))


def extract(df: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url"), output: str = "text") -> DataFrame:
    """Per row: the columns ``carry`` and the page's main text. Null or empty html gives an empty text.

    Pages are looked at one by one, whole; copies, ties and null keys need no rule.
    """
    both = df.selectExpr(*(f"`{c}`" for c in carry), f"`{html}` as __html")
    schema = both.drop("__html").schema.add(output, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html"):
            texts = [main_text(p) if p else "" for p in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(texts, pa.string())], names=[*carry, output])

    return both.mapInArrow(run, schema)
