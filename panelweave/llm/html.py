"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks, each with its place in the element tree. A
log-linear classifier gives every block the odds that it is content; the cost of
either label, -log of its probability, becomes the block's capacity from the
source and to the sink. Blocks that stand next to each other, and blocks of one
parent element, are joined by smoothness edges that weaken with their distance in
the tree. Maximum flow separates the blocks: those still reached from the source
are the article. So a title or a short paragraph that is boilerplate by itself is
content among paragraphs, and a sentence in an element of its own is not. The
classifier's weights are fixed parameters of this module, since pages have no
labels to learn from; names of classes are one kind of its features.

Rows: null and empty pages have an empty text; pages cut off in a tag, comment,
script or quote keep what stands before; very long pages are cut in time near
linear in their blocks; repeated rows are handled one by one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<name>/?[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<broken>/?[a-zA-Z][^\s/>]*)[^<>]*(?:>|\Z|(?=<))",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "noscript", "template", "svg", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "nobr", "object",
    "math", "semantics", "annotation", "mi", "mo", "mn", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "mpadded", "mphantom",
    "msub", "msup", "msubsup", "mover", "munder", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd",
}
#: An opening tag ends these open elements, up to the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"datalist"}), "body": ({"head"}, {"html"}),
}

AROUND = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
REMARKS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "sponsor", "cookie", "cookies", "consent", "gdpr"}
FRAME = {
    "banner", "promo", "promotion", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "share", "sharing", "social", "sidebar", "widget", "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs", "menu", "nav",
    "navbar", "navigation", "footer", "masthead", "topbar", "toolbar", "login", "search", "copyright", "pagination", "pager", "skip", "contentinfo",
    "complementary", "legal", "disclaimer", "trending", "teaser", "warning",
}
CORE = {"article", "main", "content", "post", "entry", "story", "articlebody"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    """An open block element: how it and those above bear on a block's odds.

    `around` and `remark`: it or one above is boilerplate by its tag, by its names.
    `nearest`: 1 or -1 if the nearest marked one is a core or a frame. `wall`: it is
    marked as boilerplate itself, so what is inside and outside stand apart.
    """

    __slots__ = ("tag", "parent", "depth", "number", "around", "remark", "core", "nearest", "wall")

    def __init__(self, tag: str, attrs: str, parent: Node | None, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.depth = parent.depth + 1 if parent else 0
        tokens, hidden = _tokens(attrs) if attrs else (set(), False)
        if tag in ("html", "body"):
            tokens = set()
        above_core = parent.core if parent else False
        core = tag in ("article", "main") or bool(tokens & CORE)
        around = tag in AROUND or hidden or (tag == "header" and not above_core)
        remark = bool(tokens & REMARKS)
        frame = bool(tokens & FRAME) or ("header" in tokens and not above_core and not core)
        self.around = around or (parent.around if parent else False)
        self.remark = remark or (parent.remark if parent else False)
        self.core = core or above_core
        self.nearest = (-1 if frame else 1 if core else 0) or (parent.nearest if parent else 0)
        self.wall = around or remark or frame


def _tokens(attrs: str) -> tuple[set[str], bool]:
    tokens, hidden = set(), False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            tokens.update(p.lower() for p in PART.findall(value))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return tokens, hidden


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: float):
        self.text, self.node, self.linked = text, node, linked


def blocks(html: str) -> list[Block]:
    """Text blocks in page order, white space folded, character references decoded."""
    found: list[Block] = []
    node = Node("html", "", None, 0)
    number, links, at = 1, 0, 0
    open_tags: Counter[str] = Counter()  # of the elements above and at `node`, but the root
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append(Block(text, node, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    while True:
        m = TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = (m["name"] or m["broken"] or "").lower()
        if not name:
            continue
        ending, tag = name[0] == "/", name.lstrip("/")
        if tag in RAW and not ending:
            if tag == "svg" and (m["attrs"] or "").rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            if end is None:  # it goes as far as what it stands in
                stop = re.compile(rf"</{re.escape(node.tag)}\b", re.I).search(html, at)
                at = stop.start() if stop else len(html)
            else:
                at = end.end()
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if ending else 1
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        close()
        links = 0
        if ending:
            if open_tags[tag]:  # else nothing is open that it could end
                while True:
                    last, node = node, node.parent
                    open_tags[last.tag] -= 1
                    if last.tag == tag:
                        break
        elif tag in VOID:
            continue
        else:
            closes, within = ENDS.get(tag, ({"p"}, {"td", "th", "li", "div", "article", "section", "body"}))
            top = up = node
            if any(open_tags[c] for c in closes):
                while up is not None and up.tag not in within:
                    if up.tag in closes and up.parent is not None:
                        top = up.parent
                    up = up.parent
            while node is not top:
                open_tags[node.tag] -= 1
                node = node.parent
            node = Node(tag, m["attrs"] or "", top, number)
            open_tags[tag] += 1
            number += 1
    close()
    return found


#: The classifier's log-odds: a base, so much for each doubling of the words, and
#: for each feature that a block has.
BASE, DOUBLING = -3.0, 0.7
WEIGHTS = {
    "linked": -3.0, "around": -7.0, "remark": -6.0, "frame": -6.0, "core": 2.0, "outside": -3.0, "heading": 0.5, "paragraph": 1.0, "item": -0.5, "sentence": 0.5, "rights": -3.0,
}


def features(block: Block, has_core: bool) -> dict[str, float]:
    """What a block is like. `outside`: the page has a core and the block is not in it."""
    node = block.node
    return {
        "linked": block.linked, "around": node.around, "remark": node.remark, "frame": node.nearest < 0, "core": node.nearest > 0,
        "outside": has_core and not node.core, "heading": node.tag in HEADINGS, "paragraph": node.tag in ("p", "blockquote", "pre", "figcaption"),
        "item": node.tag in ("li", "td", "th"), "sentence": block.text[-1] in ".!?…。", "rights": "©" in block.text or "all rights reserved" in block.text.lower(),
    }


def odds(block: Block, has_core: bool = False) -> float:
    """Log-odds that a block is content."""
    words = block.text.count(" ") + 1
    return BASE + DOUBLING * math.log2(1 + min(words, 60)) + sum(WEIGHTS[k] * v for k, v in features(block, has_core).items())


def tree_distance(a: Node, b: Node, wall: int = 2) -> int:
    """Steps in the tree; leaving or entering an element that is marked as
    boilerplate counts as `wall` more."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            steps += wall * a.wall
            a = a.parent
        else:
            steps += wall * b.wall
            b = b.parent
        steps += 1
    return steps


def smoothness(found: list[Block], adjacent: float = 2.0, kin: float = 0.5, fall: float = 8.0) -> list[tuple[int, int, float]]:
    """Edges between neighbours on the page, weaker by `fall` for each step in the
    tree beyond that of siblings, and to the last block of the same parent."""
    edges, last = [], {}
    for i, block in enumerate(found):
        if i:
            steps = tree_distance(found[i - 1].node, block.node)
            edges.append((i - 1, i, adjacent * fall ** -max(0, steps - 2)))
        parent = (block.node.parent or block.node).number
        if last.get(parent, i - 1) != i - 1 and not block.node.wall:
            edges.append((last[parent], i, kin))
        last[parent] = i
    return edges


def min_cut(excess: list[float], edges: list[tuple[int, int, float]], least: float = 1e-9) -> list[bool]:
    """Source side of the minimum cut. `excess` is a node's capacity from the
    source less that to the sink; edges hold in both directions (Dinic's phases)."""
    n = len(excess)
    left = list(excess)
    to: list[list[int]] = [[] for _ in range(n)]  # arc numbers; arc ^ 1 runs back
    head, room = [], []
    for a, b, w in edges:
        to[a].append(len(head))
        to[b].append(len(head) + 1)
        head += [b, a]
        room += [w, w]
    while True:
        level = [0 if x > least else -1 for x in left]
        queue = [i for i in range(n) if level[i] == 0]
        met = False
        for i in queue:
            met = met or left[i] < -least
            for arc in to[i]:
                if room[arc] > least and level[head[arc]] < 0:
                    level[head[arc]] = level[i] + 1
                    queue.append(head[arc])
        if not met:
            return [x >= 0 for x in level]
        following = [0] * n
        for start in range(n):
            path, i = [], start
            while left[start] > least:
                if left[i] < -least:
                    flow = min([left[start], -left[i], *[room[arc] for arc in path]])
                    left[start] -= flow
                    left[i] += flow
                    for arc in path:
                        room[arc] -= flow
                        room[arc ^ 1] += flow
                    path, i = [], start
                    continue
                while following[i] < len(to[i]):
                    arc = to[i][following[i]]
                    if room[arc] > least and level[head[arc]] == level[i] + 1:
                        break
                    following[i] += 1
                if following[i] < len(to[i]):
                    path.append(to[i][following[i]])
                    i = head[path[-1]]
                elif path:
                    i = head[path.pop() ^ 1]
                    following[i] += 1
                else:
                    break


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    has_core = any(b.node.core for b in found)
    # -log p(boilerplate) less -log p(content) is the log-odds itself
    return min_cut([odds(b, has_core) for b in found], smoothness(found))


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n".join(b.text for b, kept in zip(found, labels(found), strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    found = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
