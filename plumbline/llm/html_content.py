"""Main text of web pages, by a tree-structured graphical model over the DOM.

Every block element is a variable with three states: frame of the page, part of the
article, or something beside it. A child depends on
its parent and its own tag (parent-child potentials); its class and id words, link
density, length and length of its own text depend on its state (node potentials). All potentials are relative
frequencies on labelled pages. Sum-product messages go up from the leaves and down from
the root once each, which gives the exact marginals of every node; the text of a block is
kept if its marginal to be article is at least one half.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import slices
from .html_labelled import labelled_pages

# Kinds of HTML elements.
DROPPED = frozenset("head script style title noscript template iframe object svg math canvas audio video select textarea datalist".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var nobr label output picture center".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: States: what holds the page together, the article, and what is around or set into it.
FRAME, ARTICLE, ASIDE = STATES = (0, 1, 2)
CONTENT = "data-content"


class Page:
    """Block elements of a page in document order, and its pieces of text."""

    __slots__ = ("tag", "parent", "names", "size", "linked", "label", "pieces")

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.size, self.linked, self.label = ["#root"], [-1], [()], [0], [0], [None]
        self.pieces: list[tuple[int, str]] = []  # (node, text); text None: a break
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # (tag, node that its text belongs to)
        depths: dict[str, list[int]] = {}  # where elements of a name are open; "" for all block elements
        unclosed: set[str] = set()  # names of which no end tag follows
        at = 0

        def opened(name: str, node: int, block: bool) -> None:
            depths.setdefault(name, []).append(len(stack))
            if block:
                depths.setdefault("", []).append(len(stack))
            stack.append((name, node))

        def closed(depth: int) -> None:
            """The element at ``depth`` ends, and all that it holds."""
            while len(stack) > depth:
                name, _ = stack.pop()
                depths[name].pop()
                if depths.get("") and depths[""][-1] == len(stack):
                    depths[""].pop()

        def nearest(names) -> int:
            return max((depths[n][-1] for n in names if depths.get(n)), default=0)

        end = len(source)
        while at < end:
            m = _TAG.search(source, at)
            start = m.start() if m else end
            if start > at:
                self._text(source[at:start], stack[-1][1], bool(depths.get("a")))
            if not m:
                break
            at = m.end()
            if m.lastindex is None:
                continue
            closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = name.lower()
            if closing:
                if name in ("p", "br") or name not in INLINE:
                    self.pieces.append((stack[-1][1], None))
                if depths.get(name):
                    closed(depths[name][-1])
                continue
            if name in DROPPED:
                if rest.endswith("/") and name not in RAW:
                    continue
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                if not close:
                    unclosed.add(name)
                if name == "head":  # its end may be missing: the body ends it too
                    close = re.compile(r"</head[\s>]|<body[\s>]", re.I).search(source, at)
                    if close and close[0].lower().startswith("<body"):
                        at = close.start()
                        continue
                if not close and name not in RAW:
                    continue
                at = source.find(">", close.start()) + 1 if close else end
                at = at or end
                self.pieces.append((stack[-1][1], None))
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self.pieces.append((stack[-1][1], None))
                continue
            if name in INLINE:
                if not rest.endswith("/"):
                    opened(name, stack[-1][1], False)
                continue
            self.pieces.append((stack[-1][1], None))
            walls = WALLS.get(name)
            shut = CLOSES.get(name) or {"p"}
            inner = nearest(shut)
            if inner and inner >= nearest(walls if walls else ("",)):
                closed(inner)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1][1])
            self.names.append(_name_words(rest) if rest else ())
            self.size.append(0)
            self.linked.append(0)
            self.label.append(int(rest.split(CONTENT, 1)[1][2]) if CONTENT in rest else None)
            if not rest.endswith("/"):
                opened(name, node, True)

    def _text(self, text: str, node: int, link: bool) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((node, text))
        n = len(text)
        self.size[node] += n
        if link:
            self.linked[node] += n

    def labels(self) -> list[int]:
        """States of a labelled page: a node without a label has its parent's, the root is FRAME."""
        out: list[int] = []
        for own, parent in zip(self.label, self.parent):
            out.append(own if own is not None else out[parent] if parent >= 0 else FRAME)
        return out

    def features(self) -> list[list[str]]:
        size, linked, own = list(self.size), list(self.linked), self.size
        for node in range(len(size) - 1, 0, -1):
            size[self.parent[node]] += size[node]
            linked[self.parent[node]] += linked[node]
        out = []
        for node, names in enumerate(self.names):
            n = size[node]
            share = linked[node] / n if n else 0
            out.append([*(names or ("unnamed",)), "links:%d" % (0 if share < 0.1 else 1 if share < 0.5 else 2), "size:%d" % (0 if n == 0 else 1 if n < 40 else 2 if n < 400 else 3),
                        "own:%d" % (0 if own[node] < 20 else 1 if own[node] < 80 else 2)])
        return out


def _name_words(rest: str) -> tuple[str, ...]:
    words = set()
    for value in _NAMES.findall(rest):
        for word in _WORD.findall("".join(value)):
            word = word.lower()
            words.add("name:" + word)
            if len(word) > 5:
                words.add("start:" + word[:5])
    return tuple(sorted(words))


class Model:
    """Potentials as relative frequencies on labelled pages, smoothed."""

    def __init__(self, pages: Iterable[str]):
        nodes, seen = [0] * len(STATES), [Counter() for _ in STATES]
        edges: dict[tuple[str, int], list[int]] = {}
        tags = {"*"}
        for source in pages:
            page = Page(source)
            label = page.labels()
            for node, found in enumerate(page.features()):
                state = label[node]
                nodes[state] += 1
                seen[state].update(found)
                if node:
                    tags.add(page.tag[node])
                    for tag in (page.tag[node], "*"):
                        edges.setdefault((tag, label[page.parent[node]]), [0] * len(STATES))[state] += 1
        self.node = {f: tuple((seen[s][f] + 0.5) / (nodes[s] + 1.0) for s in STATES) for f in set().union(*seen)}
        usual = {above: edges.get(("*", above), [0] * len(STATES)) for above in STATES}
        self.edge = {}
        for tag in tags:  # (above, state) potentials, drawn towards those of all tags
            rows = []
            for above in STATES:
                n, total = edges.get((tag, above), [0] * len(STATES)), sum(usual[above])
                prior = [(u + 0.5) / (total + 0.5 * len(STATES)) for u in usual[above]]
                rows.append(tuple((n[s] + 2 * prior[s]) / (sum(n) + 2) for s in STATES))
            self.edge[tag] = tuple(rows)

    def marginals(self, page: Page) -> list[tuple[float, float, float]]:
        """Probabilities of the states of every node."""
        parent, usual = page.parent, self.edge["*"]
        edge = [self.edge.get(tag, usual) for tag in page.tag]
        below = []  # node potential times the messages from below
        for found in page.features():
            a = b = c = 1.0
            for f in found:
                p = self.node.get(f)
                if p:
                    a, b, c = a * p[0], b * p[1], c * p[2]
            total = a + b + c
            below.append((a / total, b / total, c / total))
        below[0] = (1.0, 0.0, 0.0)
        up = [(1.0, 1.0, 1.0)] * len(parent)
        for node in range(len(parent) - 1, 0, -1):  # children follow their parents
            x, y, z = below[node]
            message = [r[0] * x + r[1] * y + r[2] * z for r in edge[node]]
            total = message[0] + message[1] + message[2]
            up[node] = a, b, c = message[0] / total, message[1] / total, message[2] / total
            x, y, z = below[parent[node]]
            x, y, z = x * a, y * b, z * c
            total = x + y + z
            below[parent[node]] = (x / total, y / total, z / total)
        belief = [below[0]]
        for node in range(1, len(parent)):
            (p, q, r), (a, b, c) = belief[parent[node]], up[node]
            p, q, r = p / a, q / b, r / c  # without what this child told its parent
            e, f, g = edge[node]
            x, y, z = below[node]
            x, y, z = x * (p * e[0] + q * f[0] + r * g[0]), y * (p * e[1] + q * f[1] + r * g[1]), z * (p * e[2] + q * f[2] + r * g[2])
            total = x + y + z
            belief.append((x / total, y / total, z / total))
        return belief

    def text(self, source: str) -> str:
        page = Page(source)
        keep = [p[ARTICLE] >= 0.5 for p in self.marginals(page)]
        blocks, now, owner = [], [], 0
        for node, text in page.pieces:
            if (text is None or node != owner) and now:
                blocks.append("".join(now))
                now = []
            owner = node
            if text is not None and keep[node]:
                now.append(text)
        blocks.append("".join(now))
        return " ".join(" ".join(blocks).split())


_MODEL: list[Model] = []


def trained() -> Model:
    """The model of the labelled pages, one for each Python worker."""
    if not _MODEL:
        _MODEL.append(Model(labelled_pages()))
    return _MODEL[0]


def extract(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row: the main text of the whole html.

    Null and empty html give an empty text, as does a page without any content. Markup
    that is cut off or not closed is read as far as it goes. Repeated rows give repeated
    rows, an empty table gives an empty table, further columns are ignored.
    """
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("html"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for whole in batches:
            for batch in slices([whole], "html", 4 << 20):
                texts = [model.text(page) for page in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                                 names=["key", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)
