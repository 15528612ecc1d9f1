"""A forgiving HTML parser that keeps block elements, and features of those."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Element categories of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What scripts, styles, the head and forms' fields hold is no text of the page; everything else is for the trees to judge.
RAW = frozenset("script style textarea title template iframe noembed noframes select datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav noscript ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"button", "noscript", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"} | {"hr"}
#: Start tag -> open elements that it ends, looked for up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|style|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    """A block element: its place in the tree and what it holds itself, outside its child blocks."""

    tag: str
    parent: int
    depth: int
    order: int  # among the children of its parent
    tokens: frozenset[str] = frozenset()
    hidden: bool = False
    runs: list[tuple[int, list[str]]] = field(default_factory=list)  # (place in the page, pieces of text)
    link_chars: int = 0
    links: int = 0
    led: bool = False  # its text begins in an inline element


def _tokens(attributes: str) -> tuple[frozenset[str], bool]:
    found, hidden = set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            found.update(w.lower() for w in _WORDS.findall(value))
    return frozenset(found), hidden


def parse(page: str) -> list[Node]:
    """Block elements in page order; the first is the root.  What raw elements hold is left out.

    Open elements are counted by tag, inline ones for each block, so that an end tag without a start
    costs nothing and a page takes time in proportion to its length, however broken it is.
    """
    nodes = [Node("html", -1, 0, 0)]
    children = [0]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, inline ones too, and the block each is in
    blocks: list[int] = [0]  # places of blocks in the stack
    inline: list[dict[str, int]] = [{}]  # inline elements open within each of them
    open_blocks: dict[str, int] = {"html": 1}
    at, place, anchors = 0, 0, 0
    fresh = True  # the next text begins a new run

    def text(raw: str) -> None:
        nonlocal place, fresh
        if not raw:
            return
        value = html.unescape(raw) if "&" in raw else raw
        node = nodes[stack[-1][1]]
        if fresh or not node.runs:
            if value.isspace():
                return
            if not node.runs:
                node.led = stack[-1][0] not in BLOCK
            node.runs.append((place, []))
            place += 1
            fresh = False
        node.runs[-1][1].append(value)
        if anchors:
            node.link_chars += len(value.strip())

    def pop_to(size: int) -> None:
        nonlocal anchors, fresh
        while len(stack) > size:
            tag, _ = stack.pop()
            if tag == "a":
                anchors -= 1
            if tag in BLOCK:
                fresh = True
                blocks.pop()
                inline.pop()
                open_blocks[tag] -= 1
            else:
                inline[-1][tag] -= 1

    while (m := _TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            # An inline end tag does not reach over a block.
            if (open_blocks.get(tag, 0) if tag in BLOCK else inline[-1].get(tag, 0)) and tag != "html":
                places = reversed(blocks) if tag in BLOCK else range(len(stack) - 1, 0, -1)
                pop_to(next(k for k in places if stack[k][0] == tag))
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "html" or tag == "body" and open_blocks.get("body"):
            continue
        if tag == "head":
            end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
            if end:
                at = end.end() if end[0][1] == "/" else end.start()
            continue
        if tag in CLOSES_P and stack[blocks[-1]][0] == "p":
            pop_to(blocks[-1])
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            if any(open_blocks.get(t) for t in ends):
                for k in reversed(blocks):
                    if stack[k][0] in ends:
                        pop_to(k)
                        break
                    if stack[k][0] in within:
                        break
        if tag in ("br", "hr"):
            if tag == "hr":
                fresh = True
            elif not fresh:
                text(" ")
            continue
        if tag in VOID:
            continue
        block = stack[-1][1]
        if tag in BLOCK:
            tokens, hidden = _tokens(attributes) if attributes else (frozenset(), False)
            nodes.append(Node(tag, block, nodes[block].depth + 1, children[block], tokens, hidden))
            children[block] += 1
            children.append(0)
            block = len(nodes) - 1
            fresh = True
        elif tag == "a":
            if any(t == "a" for t, _ in stack[-4:]):
                continue
            anchors += 1
            nodes[block].links += 1
        if not attributes.endswith("/") or tag in BLOCK:
            if tag in BLOCK:
                blocks.append(len(stack))
                inline.append({})
                open_blocks[tag] = open_blocks.get(tag, 0) + 1
            else:
                inline[-1][tag] = inline[-1].get(tag, 0) + 1
            stack.append((tag, block))
        elif tag == "a":
            anchors -= 1
    text(page[at:])
    return nodes


def run_text(pieces: list[str]) -> str:
    """A run's text with white space turned into single spaces, trimmed."""
    return " ".join("".join(pieces).split())


#: Tag groups, in the order of their features.
TAGS = ("p", "h1 hgroup", "h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu dir", "div center", "section main", "article", "nav", "header", "footer", "aside", "form fieldset button", "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption address details summary", "html body")
#: Attribute tokens are hashed into so many features; the trees learn what they speak for.
TOKENS = 64
_TAG_OF = {t: k for k, group in enumerate(TAGS) for t in group.split()}
_STOPS = re.compile(r"[.!?;:,…。！？]")
#: Tags and attribute tokens of a node, then the same of what it stands in.
_NAMES = len(TAGS) + TOKENS
WIDTH = 2 * _NAMES + 37


@lru_cache(1 << 16)
def _feature(token: str) -> int:
    return zlib.crc32(token.encode("utf-8")) % TOKENS


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: tag, attribute tokens, depth, and statistics of its subtree and its siblings."""
    n = len(nodes)
    own = np.zeros((n, 7))  # chars, link chars, stops, nodes, paragraphs, links, words
    before = np.zeros(n)
    parent = np.array([v.parent for v in nodes])
    out = np.zeros((n, WIDTH), dtype=np.float32)
    for k, v in enumerate(nodes):
        if v.runs:
            whole = " ".join(run_text(p) for _, p in v.runs)
            own[k, 0], own[k, 2], own[k, 6] = len(whole), len(_STOPS.findall(whole)), whole.count(" ") + 1
        own[k, 1], own[k, 3], own[k, 4], own[k, 5] = v.link_chars, 1, v.tag == "p", v.links
        if (g := _TAG_OF.get(v.tag)) is not None:
            out[k, g] = 1
        for token in v.tokens:
            out[k, len(TAGS) + _feature(token)] = 1
    before[1:] = np.cumsum(own[:, 0])[:-1]
    sub = own.copy()
    for k in range(n - 1, 0, -1):
        sub[parent[k]] += sub[k]
    total = max(1.0, sub[0, 0])
    siblings = np.zeros(n)
    sibling_chars = np.zeros(n)
    np.add.at(siblings, parent[1:], 1)
    np.add.at(sibling_chars, parent[1:], sub[1:, 0])
    same: dict[tuple[int, str], int] = {}
    for v in nodes[1:]:
        same[v.parent, v.tag] = same.get((v.parent, v.tag), 0) + 1
    up = np.maximum(parent, 0)
    # Nothing in a hidden element is seen.  What stands before a node, and whether numbers or inline elements lead its text.
    hidden, previous, last = np.zeros(n), np.zeros(n, dtype=np.int64), {}
    led, texts, digits, heading = (np.zeros(n) for _ in range(4))
    for k, v in enumerate(nodes):
        hidden[k] = v.hidden or (k > 0 and hidden[v.parent])
        previous[k] = last.get(v.parent, -1)
        last[v.parent] = k
        led[k], texts[k], heading[k] = v.led, bool(v.runs), _TAG_OF.get(v.tag) in (1, 2)
        digits[k] = bool(v.runs) and own[k, 0] < 200 and any(c.isdigit() for _, p in v.runs for x in p for c in x)
    sub_led, sub_texts = led.copy(), texts.copy()
    headings_before = np.cumsum(heading) - heading
    for k in range(n - 1, 0, -1):
        sub_led[parent[k]] += sub_led[k]
        sub_texts[parent[k]] += sub_texts[k]
    named = np.array([bool(v.tokens) for v in nodes], dtype=float)
    named_above = np.zeros(n)
    for k in range(1, n):
        named_above[k] = max(named[parent[k]], named_above[parent[k]])
    there = previous >= 0
    following = np.full(n, -1)
    following[previous[there]] = np.flatnonzero(there)
    after = following >= 0
    chars = np.maximum(sub[:, 0], 1)
    for k in range(1, n):  # whatever a node stands in, at any height
        np.maximum(out[parent[k], :_NAMES], out[parent[k], _NAMES : 2 * _NAMES], out=out[k, _NAMES : 2 * _NAMES])
    c = 2 * _NAMES
    columns = (
        [v.depth for v in nodes],
        np.log1p(sub[:, 0]),
        np.log1p(own[:, 0]),
        np.minimum(sub[:, 1] / chars, 1),
        np.log1p(sub[:, 3]),
        sub[:, 0] / sub[:, 3],
        sub[:, 0] / total,
        sub[:, 2] / chars * 100,
        chars / np.maximum(sub[:, 6], 1),
        np.log1p(sub[:, 4]),
        np.log1p(sub[:, 5]),
        [v.order / max(1.0, siblings[v.parent] - 1) if v.parent >= 0 else 0 for v in nodes],
        np.log1p(siblings[up]),
        [same.get((v.parent, v.tag), 1) / max(1.0, siblings[v.parent]) if v.parent >= 0 else 1 for v in nodes],
        np.log1p(sibling_chars[up] / np.maximum(siblings[up], 1)),
        sub[:, 0] / np.maximum(sibling_chars[up], 1),
        before / total,
        np.log1p(siblings),
        hidden,
        own[:, 0] / chars,
        np.log1p(sub[up, 0]),
        sub[up, 2] / chars[up] * 100,
        np.log1p(sub[up, 4]),
        np.minimum(sub[up, 1] / chars[up], 1),
        led,
        sub_led / np.maximum(sub_texts, 1),
        sub_led[up] / np.maximum(sub_texts[up], 1),
        digits,
        there & (heading[previous] > 0),
        there & (digits[previous] > 0),
        np.minimum(headings_before, 4),
        there * np.log1p(sub[previous, 0]),
        after * np.log1p(sub[following, 0]),
        after * np.minimum(sub[following, 1] / np.maximum(sub[following, 0], 1), 1),
        after * (own[following, 4] > 0),
        named,
        named_above,
    )
    out[:, c:] = np.stack([np.asarray(x, dtype=np.float32) for x in columns], axis=1)
    return out
