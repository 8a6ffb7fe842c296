"""HTML extraction by a tree-structured graphical model.

Every DOM element is a variable with three states: page structure, main text, surroundings. Unary potentials come from its tag, the words of its class, id and role, its
link density and its text length; parent-child potentials connect the tree. Sum-product messages go up from the leaves and down from
the root, which gives each element's exact content marginal in time linear in the page. Potentials are counts from labelled pages: the
templates of ``html_pages`` and, if a table of labelled pages is given, a bounded sample of it. A page is a unit of work inside the scan: no
shuffle, memory of one page, and the model is small and broadcast.

Defined cases: a null or empty page has empty text; text outside any element is a paragraph; broken markup is closed as browsers close it; repeated rows and null ids keep their place; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regmart.llm.common import session
from regmart.llm.html_pages import PAGES

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br button select option output".split())
HIDDEN = frozenset("script style title head template noscript iframe svg select textarea button object".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
P_LIMITS = ("button", "td", "th", "caption", "table", "object", "body")
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "body": ("html",)}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPLIT = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    attributes: dict[str, str]
    text: int = 0
    linked: int = 0


@dataclass
class Dom:
    """Elements in page order, parents first; ``parts``: (element, text) or (element, None) where a block begins or ends."""

    nodes: list[Node] = field(default_factory=lambda: [Node("#root", -1, {})])
    parts: list[tuple[int, str | None]] = field(default_factory=list)


class Open:
    """The open elements, and for every tag the places in the stack where it is open."""

    def __init__(self, dom: Dom):
        self.nodes, self.parts = dom.nodes, dom.parts
        self.stack: list[int] = [0]
        self.at: dict[str, list[int]] = defaultdict(list)

    def innermost(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0 if none is open."""
        return max((places[-1] for tag in tags if (places := self.at.get(tag))), default=0)

    def push(self, i: int) -> None:
        self.at[self.nodes[i].tag].append(len(self.stack))
        self.stack.append(i)

    def close_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.nodes[self.stack.pop()].tag
            self.at[tag].pop()
            if tag not in INLINE:
                self.parts.append((self.stack[-1], None))

    def close_within(self, tags: Iterable[str], limits: Iterable[str]) -> None:
        """Closes the innermost element of ``tags`` unless one of ``limits`` is open inside it."""
        place = self.innermost(tags)
        if place and place > self.innermost(limits):
            self.close_to(place)


def parse(page: str) -> Dom:
    """One pass; every step looks only at the innermost open element of some tags, so deep pages take linear time."""
    dom, at, n = Dom(), 0, len(page)
    opened = Open(dom)
    nodes, parts, stack = dom.nodes, dom.parts, opened.stack

    def add_text(raw: str) -> None:
        text, node = entities.unescape(raw) if "&" in raw else raw, nodes[stack[-1]]
        parts.append((stack[-1], text))
        if own := len(text.strip()):
            node.text += own
            if opened.at["a"]:
                node.linked += own

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            add_text(page[at:])
            break
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if place := opened.innermost((name,)):
                opened.close_to(place)
            elif name in ("br", "p"):
                parts.append((stack[-1], " " if name == "br" else None))
        elif m[2]:
            name = m[2].lower()
            if name in CLOSES_P:
                opened.close_within(("p",), P_LIMITS)
            if name in SELF_CLOSING:
                opened.close_within(SELF_CLOSING[name], LIMITS[name])
            if name in VOID:
                if name in ("br", "hr"):
                    parts.append((stack[-1], " " if name == "br" else None))
                continue
            attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3] or "")} if m[3] and m[3].strip() else {}
            nodes.append(Node(name, stack[-1], attributes))
            if name not in INLINE:
                parts.append((stack[-1], None))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[^>]*>?", re.I).search(page, at)
                stop = end.start() if end else n
                nodes[-1].text = len(page[at:stop].strip())
                at = end.end() if end else n
                if name not in HIDDEN:
                    parts.append((len(nodes) - 1, entities.unescape(page[at:stop])))
            else:
                opened.push(len(nodes) - 1)
    opened.close_to(1)
    return dom


def features(dom: Dom) -> list[tuple[str, ...]]:
    """Names of each element's features."""
    nodes = dom.nodes
    text, linked = [x.text for x in nodes], [x.linked for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        text[nodes[i].parent] += text[i]
        linked[nodes[i].parent] += linked[i]
    out = []
    for i, x in enumerate(nodes):
        n = text[i]
        words = ""
        if x.attributes:
            words = " ".join(str(x.attributes.get(k) or "") for k in ("class", "id", "role")).lower()
        hints = (f"links {min(3, 4 * linked[i] // n)}", f"long {1 if n < 40 else 2 if n < 200 else 3}") if n else ("long 0",)
        tag = f"tag {x.tag if i or not x.text else 'p'}"
        out.append((tag, *(f"word {w}" for w in dict.fromkeys(SPLIT.split(words)) if w), *hints) if words.strip() else (tag, *hints))
    return out


STRUCTURE, CONTENT, SURROUNDING = range(3)


def marks(dom: Dom) -> list[int]:
    """States of the elements of a labelled page."""
    out: list[int] = []
    for x in dom.nodes:
        y = x.attributes.get("y")
        out.append(CONTENT if y == "1" else SURROUNDING if y == "0" or x.tag in HIDDEN else out[x.parent] if x.parent >= 0 else STRUCTURE)
    return out


@dataclass(frozen=True)
class Model:
    """``unary``: feature -> natural log potential of each state; ``edge[parent][child]``: parent-child potentials."""

    unary: dict[str, tuple[float, ...]]
    edge: list[list[float]]

    known: dict[tuple[str, ...], tuple[float, ...]] = field(default_factory=dict, compare=False)

    def potential(self, found: tuple[str, ...]) -> tuple[float, ...]:
        """Unary potential of each state, the largest 1."""
        if (out := self.known.get(found)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            logs = [sum(self.unary[f][k] for f in found if f in self.unary) for k in range(3)]
            out = self.known[found] = tuple(max(math.exp(x - max(logs)), 1e-30) for x in logs)
        return out

    def marginals(self, dom: Dom) -> list[float]:
        """P(content) of each element, by one upward and one downward pass of sum-product messages."""
        nodes = dom.nodes
        (e00, e01, e02), (e10, e11, e12), (e20, e21, e22) = self.edge
        belief = [self.potential(found) for found in features(dom)]
        up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            a, b, c = belief[i]
            p, q, r = e00 * a + e01 * b + e02 * c, e10 * a + e11 * b + e12 * c, e20 * a + e21 * b + e22 * c
            t = p + q + r
            up[i] = p, q, r = p / t, q / t, r / t
            x, y, z = belief[nodes[i].parent]
            x, y, z = x * p, y * q, z * r
            t = x + y + z
            belief[nodes[i].parent] = (max(x / t, 1e-30), max(y / t, 1e-30), max(z / t, 1e-30)) if t < 1e-60 else (x, y, z)
        out: list[tuple[float, float, float]] = []
        for i, node in enumerate(nodes):
            a, b, c = belief[i]
            if i:
                (x, y, z), (p, q, r) = out[node.parent], up[i]
                x, y, z = x / max(p, 1e-300), y / max(q, 1e-300), z / max(r, 1e-300)
                t = x + y + z
                a, b, c = a * (x * e00 + y * e10 + z * e20) / t, b * (x * e01 + y * e11 + z * e21) / t, c * (x * e02 + y * e12 + z * e22) / t
            t = a + b + c
            out.append((a / t, b / t, c / t))
        return [v[CONTENT] for v in out]


def fit(pages: Iterable[str], smoothing: float = 0.1) -> Model:
    """Potentials from labelled pages (elements marked with y)."""
    unary: dict[str, list[float]] = defaultdict(lambda: [0.0] * 3)
    edge, total = np.full((3, 3), smoothing), np.zeros(3)
    for page in pages:
        dom = parse(page)
        y = marks(dom)
        for i, (x, mine) in enumerate(zip(dom.nodes, features(dom))):
            total[y[i]] += 1
            for f in mine:
                unary[f][y[i]] += 1
            if x.parent >= 0:
                edge[y[x.parent], y[i]] += 1
    logs = {f: tuple(np.log((np.array(c) + smoothing) / (total + 3 * smoothing)).tolist()) for f, c in unary.items()}
    return Model(logs, (edge / edge.sum(axis=1, keepdims=True)).tolist())


def extract(page: str, model: Model, threshold: float = 0.5) -> str:
    """The main text: blocks joined by a blank line."""
    if not page:
        return ""
    dom = parse(page)
    keep = model.marginals(dom)
    banned = [False] * len(dom.nodes)
    for i, x in enumerate(dom.nodes):
        banned[i] = x.tag in HIDDEN or (x.parent >= 0 and banned[x.parent])
    blocks: list[str] = []
    now: list[str] = []
    for i, text in [*dom.parts, (0, None)]:
        if text is None:
            if now and (block := SPACE.sub(" ", "".join(now)).strip()):
                blocks.append(block)
            now = []
        elif keep[i] >= threshold and not banned[i]:
            now.append(text)
    return "\n\n".join(blocks)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def labelled_sample(pages: DataFrame, most: int, most_chars: int = 1 << 18, html_col: str = "html") -> list[str]:
    """At most ``most`` pages that carry y marks, none longer than ``most_chars``, by hash order."""
    fine = F.col(html_col).contains(' y="') & (F.length(html_col) <= most_chars)
    return [r[0] for r in pages.filter(fine).select(html_col).orderBy(F.xxhash64(html_col)).limit(most).collect()]


def extract_pages(pages: DataFrame, labelled: DataFrame | None = None, most_labelled: int = 500, threshold: float = 0.5) -> DataFrame:
    """page_id, url, main text and its length for every page."""
    model = fit([*PAGES, *(labelled_sample(labelled, most_labelled) if labelled is not None else [])])
    shared = session(pages).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x or "", shared.value, threshold) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, EXTRACTED)
