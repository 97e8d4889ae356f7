"""Main text of HTML pages by minimum cuts.

A page falls into blocks: runs of text between block-level tags. A logistic model of
shallow features (length, share of linked words, punctuation, place, depth) gives the
costs of calling a block content or boilerplate, the capacities of its edges to the two
terminals. Blocks next to each other, and blocks of
one parent that follow each other, are joined by smoothness edges, weaker the farther
apart they are in the element tree. The maximum flow separates content from
boilerplate at least cost (of equal cuts, the one with the least content).

The model learns from blocks that elements name themselves (article or main against
nav, footer, aside and the like), on a bounded sample of pages. These names are labels to
learn from and nothing else: no cost has them. Without such pages a fixed model serves.
Time and memory are in proportion to a page's length, at any depth.

Null pages have null text, pages without text the empty one. Malformed markup never
fails: unknown or unclosed tags end where their parent ends. What svg, template and
noscript hold is left out if they are closed before their parent ends; a self-closing
svg ends at its tag, and unclosed ones hide nothing. Only script, style, title and
comments run to the end of the page if they aren't closed.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append, field, smallest

#: The most pages to fit the model on.
SAMPLE = 2000
ADJACENT, SIBLING = 1.2, 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|(<(script|style|title)\b(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>).*?(</\2\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>",
    re.S | re.I,
)
_HIDES = frozenset("noscript svg template".split())
_HIDING = re.compile(r"<(?:noscript|svg|template)\b", re.I)
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GOOD = frozenset("article main".split())
_BAD = frozenset("nav footer aside header form select button menu".split())
_BAD_CLASS = re.compile(r"""(?:class|id|role)\s*=\s*["']?[^"'>]*\b(?:ads?|advert\w*|banner|nav\w*|menu|footer|sidebar|comments?|cookie\w*|promo\w*|share|social|related|breadcrumbs?)\b""", re.I)
_GOOD_CLASS = re.compile(r"""(?:class|id|role)\s*=\s*["']?[^"'>]*\b(?:article|main|content|post|entry|story)\b""", re.I)
_CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
_SPACE = re.compile(r"\s+")


class Block:
    """A block: its text, words in links, the number of its parent element, its depth, how many elements around it also hold the block before, its hint."""

    __slots__ = ("text", "linked", "parent", "depth", "common", "hint")

    def __init__(self, text: str, linked: int, parent: int, depth: int, common: int, hint: int):
        self.text, self.linked, self.parent, self.depth, self.common, self.hint = text, linked, parent, depth, common, hint


class Open:
    """The open elements of a page, with the places of each name: a closing tag finds its element, or that there is none, in one step."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, *rest) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, *rest))

    def last(self, name: str) -> int:
        """The place of the innermost one of a name, -1 if none is open."""
        places = self.places.get(name)
        return places[-1] if places else -1

    def cut(self, k: int) -> None:
        """Closes all from place k on."""
        while len(self.stack) > k:
            self.places[self.stack.pop()[0]].pop()


def tokens(page: str) -> Iterator[tuple[re.Match, int, str]]:
    """Comments, raw elements and tags of a page: match, end, name (empty for what is no tag)."""
    at = svg = 0
    while m := _TOKEN.search(page, at):
        at, name = m.end(), (m[5] or m[8] or "").lower()
        if name == "svg":
            svg = max(svg - 1, 0) if m[4] or m[7] else svg + (not m[0].endswith("/>"))
        elif svg and m[1] and (m[1].endswith("/>") or not m[3]):
            at = m.end(1)  # in an svg these are elements like others
        yield m, at, name


def hidden(page: str) -> dict[int, int]:
    """Where each closed svg, template or noscript starts and ends, of those in no other one."""
    out: dict[int, int] = {}
    opened = Open()  # name, start
    stack = opened.stack
    for m, end, name in tokens(page):
        if name not in _BLOCK and name not in _BAD and name not in _HIDES and name != "foreignobject" or name in _VOID:
            continue
        if not (m[4] or m[7]):
            if name in _BLOCK:  # ends an svg, if not in a foreignObject
                k = len(stack)
                while k and stack[k - 1][0] == "svg":
                    k -= 1
                opened.cut(k)
            if name not in ("svg", "foreignobject") or not m[0].endswith("/>"):
                opened.push(name, m.start())
            continue
        k = opened.last(name)
        if k < opened.last("template") and name not in _HIDES:  # these don't close what is around a template
            continue
        if k >= 0:
            if name in _HIDES:
                while out and next(reversed(out)) > stack[k][1]:
                    out.popitem()
                out[stack[k][1]] = end
            opened.cut(k)
    return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. hint: 1 inside article, main or the like, -1 inside nav, footer or the like, 0 otherwise; the innermost counts."""
    out: list[Block] = []
    opened = Open()  # block-level elements: name, number, hint
    stack = opened.stack
    parts: list[str] = []
    linked = links = number = at = 0
    lowest = 0  # the fewest elements open since the last block

    def flush() -> None:
        nonlocal linked, lowest
        text = "".join(parts)
        if text and not text.isspace():
            if "&" in text:
                text = entities.unescape(text)
            text = _SPACE.sub(" ", text).strip()
            if text:
                out.append(Block(text, linked, stack[-1][1] if stack else 0, len(stack), lowest, stack[-1][2] if stack else 0))
                lowest = len(stack)
        parts.clear()
        linked = 0

    hides = hidden(page) if _HIDING.search(page) else {}
    for m, end, name in tokens(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if links:
                linked += len(text.split())
        at = hides.get(m.start(), end)
        if at > end:
            flush()
            continue
        if not name:
            if m[1]:
                flush()
            continue
        closing, attributes = m[4] or m[7], m[6] or m[9] or ""
        if name == "a":
            links = 0 if closing else 1
        if name not in _BLOCK and name not in _BAD:
            if name in _VOID:
                parts.append(" ")
            continue
        flush()
        if closing:
            k = opened.last(name)
            if k >= 0:
                opened.cut(k)
                lowest = min(lowest, k)
                links = 0
            continue
        if name in _VOID:
            continue
        closes = _CLOSES.get(name)
        while closes and stack and stack[-1][0] in closes:
            opened.cut(len(stack) - 1)
            lowest = min(lowest, len(stack))
        number += 1
        hint = stack[-1][2] if stack else 0
        if name in _GOOD:
            hint = 1
        elif name in _BAD or ("=" in attributes and _BAD_CLASS.search(attributes)):
            hint = -1
        elif "=" in attributes and _GOOD_CLASS.search(attributes):
            hint = 1
        opened.push(name, number, hint)
    parts.append(page[at:])
    flush()
    return out


def shallow(found: list[Block]) -> np.ndarray:
    """Features of the blocks of a page."""
    n = len(found)
    out = np.empty((n, 7))
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        marks = b.text.count(".") + b.text.count(",") + b.text.count(";")
        out[i] = (1.0, np.log1p(words), min(b.linked / words, 1.0), min(marks / words, 1.0), min(i, n - 1 - i) / n, min(b.depth, 20) / 10, len(b.text) / (words * 10))
    return out


DEFAULT = np.array([-2.0, 1.0, -4.0, 1.0, 1.0, 0.0, 0.0])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression with balanced classes, by Newton steps."""
    if not (y == 1).any() or not (y == 0).any():
        return DEFAULT
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    w = np.zeros(x.shape[1])
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, g)
    return w


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of the least cut (the one with the fewest such nodes).

    source[i] is cut if i is on the sink's side, sink[i] if it is on the source's, an edge (both ways) if it is between them. Nodes
    whose terminal outweighs all their edges are settled first; what is left goes through Dinic's algorithm.
    """
    n = len(source)
    excess = [a - b for a, b in zip(source, sink, strict=True)]
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            around[i].append((j, w))
            around[j].append((i, w))
    pull = [sum(w for _, w in a) for a in around]
    side: list[bool | None] = [None] * n
    ready = deque(i for i in range(n) if excess[i] > pull[i] or excess[i] <= -pull[i])
    while ready:
        i = ready.popleft()
        if side[i] is not None or not (excess[i] > pull[i] or excess[i] <= -pull[i]):
            continue
        side[i] = excess[i] > pull[i]
        for j, w in around[i]:
            if side[j] is None:
                pull[j] -= w
                excess[j] += w if side[i] else -w
                if excess[j] > pull[j] or excess[j] <= -pull[j]:
                    ready.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        s, t = len(rest), len(rest) + 1
        to: list[int] = []
        capacity: list[float] = []
        out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

        def arc(a: int, b: int, forth: float, back: float) -> None:
            out[a].append(len(to))
            to.append(b)
            capacity.append(forth)
            out[b].append(len(to))
            to.append(a)
            capacity.append(back)

        for i in rest:
            if excess[i] > 0:
                arc(s, place[i], excess[i], 0.0)
            elif excess[i] < 0:
                arc(place[i], t, -excess[i], 0.0)
            for j, w in around[i]:
                if i < j and j in place:
                    arc(place[i], place[j], w, w)
        reached = _dinic(out, to, capacity, s, t)
        for i in rest:
            side[i] = reached[place[i]] >= 0
    return [bool(x) for x in side]


def _dinic(out: list[list[int]], to: list[int], capacity: list[float], s: int, t: int, least: float = 1e-9) -> list[int]:
    """Levels of the nodes that the source still reaches after the maximum flow; -1 for the others."""
    while True:
        level = [-1] * len(out)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if capacity[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return level
        turn, path, at = [0] * len(out), [], s
        while True:
            if at == t:
                flow = min(capacity[e] for e in path)
                for e in path:
                    capacity[e] -= flow
                    capacity[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if capacity[e] <= least)
                at = to[path[cut] ^ 1]
                del path[cut:]
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if capacity[e] > least and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(out[at]):
                path.append(out[at][turn[at]])
                at = to[path[-1]]
            elif at == s:
                break
            else:
                level[at] = -1
                at = to[path.pop() ^ 1]


def graph(found: list[Block], p: np.ndarray) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """Terminal capacities and smoothness edges of the blocks of a page; p: probability of content from the shallow features."""
    source, sink = (-np.log(np.maximum(1 - p, 1e-12))).tolist(), (-np.log(np.maximum(p, 1e-12))).tolist()
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT / (1 + 0.5 * (found[i - 1].depth + b.depth - 2 * b.common))))
        before = last.get(b.parent)
        if before is not None and before < i - 1:
            edges.append((before, i, SIBLING))
        last[b.parent] = i
    return source, sink, edges


def extract_page(page: str, w: np.ndarray) -> tuple[str, int, int]:
    """Main text, blocks, content blocks."""
    found = blocks(page)
    if not found:
        return "", 0, 0
    p = 1 / (1 + np.exp(-np.clip(shallow(found) @ w, -8, 8)))
    content = min_cut(*graph(found, p))
    return "\n".join(b.text for b, c in zip(found, content, strict=True) if c), len(found), sum(content)


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights of the shallow features, from at most sample pages (those of the smallest hashes)."""

    def run(batches):
        for batch in batches:
            x, y = [], []
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                if found:
                    x.append(shallow(found))
                    y += [b.hint for b in found]
            if x:
                named = np.array(y) != 0
                yield pa.RecordBatch.from_arrays([pa.array(list(np.concatenate(x)[named]), pa.list_(pa.float64())), pa.array((np.array(y)[named] > 0).astype(np.int32))], names=["x", "y"])

    texts = pages.select(field(pages, html).alias("__html")).where("__html is not null")
    rows = smallest(texts, sample, "__html").mapInArrow(run, "x array<double>, y int").toPandas()
    if not len(rows):
        return DEFAULT
    return fit(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float))


def extract(pages: DataFrame, w: np.ndarray, html: str = "html", drop_html: bool = False) -> DataFrame:
    """pages with text, n_blocks and n_content. Columns of these names are replaced."""

    def run(batch: pa.RecordBatch) -> tuple[None, list[pa.Array]]:
        out = [extract_page(x, w) if x is not None else (None, None, None) for x in batch.column(batch.schema.names.index(html)).to_pylist()]
        values = list(zip(*out, strict=True)) if out else [[], [], []]
        return None, [pa.array(values[0], pa.string()), pa.array(values[1], pa.int32()), pa.array(values[2], pa.int32())]

    return append(pages, run, "text string, n_blocks int, n_content int", needs=[html], drop=[html] * drop_html)
