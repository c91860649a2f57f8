"""HTML extraction by a tree-structured graphical model.

The nodes of the model are a page's blocks and its elements with a name; each is main content or not. What an
element looks like (tag, words of its class, id and role, share of linked text, length, punctuation) gives its own
potential, by logistic regression. Potentials between parent and child, one table for plain children and one for
children that name a role of their own, say how the states go together. Sum-product message passing, first up and
then down the tree, gives the exact marginal of every node; text below nodes that are more likely content than not
is the result. All potentials are learnt from labelled pages, of which at most ``MAX_PAGES`` are used.

The reader of HTML is lenient: tags may be left open, left out, misplaced or cut off, and text is never lost for it. A
head ends at the first text or tag that may not stand in it.
Scripts, styles, heads, controls and markup are no text. Character references are decoded, white space inside
a block (of any kind, no-break spaces too) is one space, blocks are joined by one space in page order.

Defined results: a null or empty page, or one without text, gives the empty text; text without any block or named element is
all there is to judge and is returned whole; repeated rows each get a row; an empty table gives an empty table.
Only id, URL and HTML are read.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import narrow, per_batch, texts, type_of

MAX_PAGES = 1_000

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SILENT = frozenset("head script style title textarea iframe noembed noframes template svg select option button".split())
IN_HEAD = frozenset("html head title meta link base script style template noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li tbody td tfoot th thead tr".split())
# An open element of the first kind ends where one of the second kind begins.
ENDS_AT = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "option": {"option"},
}
ENDING = frozenset().union(*ENDS_AT.values())
SCOPES = frozenset("html table td th caption object template".split())
LISTS = frozenset("ul ol menu dl table".split())
TABLE_PARTS = frozenset("tr td th tbody tfoot".split())
STOPS_P = SCOPES | {"button"}

TAG_GROUPS = {
    name: k for k, group in enumerate((
        ("article",), ("main",), ("section",), ("div",), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "dl", "menu"),
        ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "legend", "label"),
        ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("figure", "figcaption"), ("blockquote", "pre", "address"), ("html", "body"),
    )) for name in group
}
# Words of class, id and role, by what they tell; a trailing star stands for any ending.
WORDS = {
    "main": "article* content* post entry story main body text page hentry prose",
    "nav": "nav* menu* breadcrumb* pagination pager toc tabs navbar",
    "ad": "ad ads adv advert* adsense adsby* adslot sponsor* promo* banner* dfp",
    "notice": "cookie* consent* gdpr notice* alert* popup* modal overlay newsletter* subscri* paywall* dialog",
    "side": "side sidebar* aside related* recommend* widget* rail popular trending more sidebox",
    "comment": "comment* reply repl* disqus* discussion* respond responses thread reader*",
    "foot": "footer* copyright legal bottom colophon foot",
    "head": "header* masthead* topbar branding logo head",
    "social": "share* sharing social* follow*",
    "form": "search form login signup",
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![\w-])(class|id|role|data-main|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    tag: str
    parent: int
    words: frozenset[str]
    label: str | None = None
    hidden: bool = False
    chars: int = 0
    linked: int = 0
    count: int = 0
    points: int = 0


@dataclass
class Page:
    """The model's nodes, parents first, and the blocks: text with the node it belongs to."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)


def _attributes(raw: str) -> tuple[frozenset[str], str | None, bool]:
    words: set[str] = set()
    label, hidden = None, False
    if raw:
        for match in _NAMES.finditer(raw):
            name, value = match[1].lower(), match[2] or match[3] or match[4] or ""
            if name == "data-main":
                label = value
            elif name in ("hidden", "aria-hidden"):
                hidden = hidden or (name == "hidden" or value == "true")
            else:
                words.update(w.lower() for w in _WORD.findall(value))
    return frozenset(words), label, hidden


class Open:
    """The open elements, with the node each one's text belongs to. Finds the innermost of a name or kind at once,
    so that a page may be nested to any depth."""

    KINDS = {"block": BLOCK, "scope": SCOPES, "list": LISTS, "stops p": STOPS_P}

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.named: dict[str, list[int]] = {}
        self.kind: dict[str, list[int]] = {k: [] for k in self.KINDS}

    def __len__(self) -> int:
        return len(self.stack)

    def push(self, tag: str, owner: int) -> None:
        depth = len(self.stack)
        self.named.setdefault(tag, []).append(depth)
        for kind, tags in self.KINDS.items():
            if tag in tags:
                self.kind[kind].append(depth)
        self.stack.append((tag, owner))

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.named[tag].pop()
        for kind, tags in self.KINDS.items():
            if tag in tags:
                self.kind[kind].pop()
        return tag

    def last(self, tag: str) -> int:
        """Depth of the innermost open element of a name, or -1."""
        found = self.named.get(tag)
        return found[-1] if found else -1

    def last_of(self, kind: str) -> int:
        found = self.kind[kind]
        return found[-1] if found else -1

    def ended_by(self, tag: str) -> int | None:
        """Depth of the outermost element that ends where ``tag`` begins, within the innermost list or scope."""
        barrier = self.last_of("list")
        if tag not in TABLE_PARTS:
            barrier = max(barrier, self.last_of("scope"))
        found = []
        for name, ends in ENDS_AT.items():
            depths = self.named.get(name)
            if depths and tag in ends:
                k = bisect.bisect(depths, barrier)
                found += depths[k : k + 1]
        return min(found, default=None)


def read(source: str) -> Page:
    """Read a page. Elements that are neither blocks nor named don't become nodes; their text is their ancestor's."""
    page = Page([Node("body", -1, frozenset())])
    opened = Open()
    stack = opened.stack
    silent = links = 0
    block: list[tuple[int, str]] = []

    def flush() -> None:
        nonlocal block
        if block:
            page.blocks.append(block)
            block = []

    def close(depth: int) -> None:
        nonlocal silent, links
        while len(stack) > depth:
            tag = opened.pop()
            silent -= tag in SILENT
            links -= tag == "a"
            if tag in BLOCK:
                flush()

    def leave_head() -> None:
        """Close an open head, unless in a template in it."""
        depth = opened.last("head")
        if depth > opened.last("template"):
            close(depth)

    def text(raw: str) -> None:
        if silent and stack[-1][0] == "head" and raw.strip():
            leave_head()
        if not raw or silent:
            return
        value = html.unescape(raw)
        owner = stack[-1][1] if stack else 0
        block.append((owner, value))
        words = value.split()
        node = page.nodes[owner]
        size = sum(map(len, words))
        node.chars += size
        node.linked += size * (links > 0)
        node.count += len(words)
        node.points += sum(w[-1] in ".,;:!?" for w in words)

    at, end = 0, len(source)
    while at < end:
        match = _TOKEN.search(source, at)
        if match is None:
            text(source[at:])
            break
        text(source[at : match.start()])
        at = match.end()
        closing, tag, raw = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                flush()
                continue
            barrier = -1 if tag in BLOCK else opened.last_of("block")
            if tag != "body" and tag not in SCOPES:
                barrier = max(barrier, opened.last_of("scope"))
            depth = opened.last(tag)
            if depth >= max(barrier, 0):
                close(depth)
            continue
        if silent and tag not in IN_HEAD:
            leave_head()
        if tag == "br" or tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            depth = opened.last("p")
            if depth > opened.last_of("stops p"):
                close(depth)
        if tag in ENDING:
            depth = opened.ended_by(tag)
            if depth is not None:
                close(depth)
        if tag == "body" and opened.named.get("head"):
            close(opened.named["head"][0])
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[^>]*>?", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        words, label, hidden = _attributes(raw)
        parent = stack[-1][1] if stack else 0
        if tag in ("html", "body"):
            node = page.nodes[0]
            node.words, node.label, node.hidden = node.words | words, label or node.label, node.hidden or hidden
            owner = 0
        elif tag in BLOCK or words or label:
            page.nodes.append(Node(tag, parent, words, label, hidden))
            owner = len(page.nodes) - 1
        else:
            owner = parent
        if tag in BLOCK:
            flush()
        if raw.endswith("/") and tag not in BLOCK:
            continue
        opened.push(tag, owner)
        silent += tag in SILENT
        links += tag == "a"
    close(0)
    flush()
    return page


def _matcher() -> dict[str, re.Pattern]:
    return {kind: re.compile("|".join(w.replace("*", ".*") for w in words.split())) for kind, words in WORDS.items()}


KINDS = _matcher()
_known: dict[frozenset[str], tuple[int, ...]] = {}


def kinds(words: frozenset[str]) -> tuple[int, ...]:
    """Which kinds of words an element has in its names; each set of names is looked at once."""
    if not words:
        return ()
    if words not in _known:
        if len(_known) > 50_000:
            _known.clear()
        _known[words] = tuple(k for k, pattern in enumerate(KINDS.values()) if any(pattern.fullmatch(w) for w in words))
    return _known[words]


GROUPS = max(TAG_GROUPS.values()) + 2  # the last is any other tag
FEATURES = 1 + GROUPS + len(WORDS) + 8
MAIN = list(WORDS).index("main")


def features(page: Page) -> np.ndarray:
    """A row for each node. Lengths and shares are those of all text below it."""
    n = len(page.nodes)
    below = np.array([(x.chars, x.linked, x.count, x.points) for x in page.nodes], float)
    for i in range(n - 1, 0, -1):
        below[page.nodes[i].parent] += below[i]
    out = np.zeros((n, FEATURES))
    out[:, 0] = 1
    for i, node in enumerate(page.nodes):
        out[i, 1 + TAG_GROUPS.get(node.tag, GROUPS - 1)] = 1
        for k in kinds(node.words):
            out[i, 1 + GROUPS + k] = 1
        out[i, -1] = node.hidden
    # On a page that names no main part, what names no other role is more likely to be it.
    if not any(node.tag in ("article", "main") or MAIN in kinds(node.words) for node in page.nodes):
        out[:, -7] = [not names_a_role(node) for node in page.nodes]
        out[0, -8] = 1
    chars, linked, count, points = below.T
    out[:, -6] = linked / np.maximum(chars, 1)
    out[:, -5] = np.minimum(np.log1p(count) / 5, 2)
    out[:, -4] = points / np.maximum(count, 1)
    out[:, -3] = count == 0
    out[:, -2] = [sum(map(len, x.words)) > 0 for x in page.nodes]
    return out


def names_a_role(node: Node) -> int:
    return int(bool(kinds(node.words)) or node.tag in ("nav", "header", "footer", "aside", "form", "article", "main"))


@dataclass(frozen=True)
class HtmlModel:
    """``weights`` of the nodes' own log-odds, what the root has on top, and log P(child | parent) for both kinds of child."""

    weights: np.ndarray
    root: float
    edges: np.ndarray  # kind of child, state of the parent, state of the child

    def marginals(self, page: Page) -> np.ndarray:
        """The probability of being main content, of every node."""
        own = np.clip(features(page) @ self.weights, -12, 12)
        n = len(page.nodes)
        table = np.exp(self.edges).tolist()
        no, yes = [1.0] * n, np.exp(own).tolist()
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        kind = [names_a_role(x) for x in page.nodes]
        # Up: what the text below a node says about its parent.
        for i in range(n - 1, 0, -1):
            t, parent = table[kind[i]], page.nodes[i].parent
            a, b = t[0][0] * no[i] + t[0][1] * yes[i], t[1][0] * no[i] + t[1][1] * yes[i]
            up[i] = a, b
            no[parent] *= a
            yes[parent] *= b
            scale = no[parent] + yes[parent]
            no[parent] /= scale
            yes[parent] /= scale
        # Down: the belief of the parent without the child's own message.
        yes[0] *= math.exp(self.root)
        out = np.empty(n)
        out[0] = yes[0] / (no[0] + yes[0])
        for i in range(1, n):
            t, p = table[kind[i]], page.nodes[i].parent
            a, b = (1 - out[p]) / max(up[i][0], 1e-300), out[p] / max(up[i][1], 1e-300)
            x, y = (a * t[0][0] + b * t[1][0]) * no[i], (a * t[0][1] + b * t[1][1]) * yes[i]
            out[i] = y / (x + y)
        return out

    def text(self, source: str) -> str:
        page = read(source)
        keep = self.marginals(page) > 0.5 if len(page.nodes) > 1 else [True]
        blocks = (" ".join("".join(value for owner, value in block if keep[owner]).split()) for block in page.blocks)
        return " ".join(b for b in blocks if b)


def labels(page: Page) -> np.ndarray:
    """Whether each node is main content: its own mark, else that of its parent."""
    out = np.zeros(len(page.nodes), bool)
    for i, node in enumerate(page.nodes):
        out[i] = node.label == "yes" if node.label else i > 0 and out[node.parent]
    return out


def fit(sources: list[str], rounds: int = 250, rate: float = 0.5, decay: float = 1e-4) -> HtmlModel:
    """Potentials from labelled pages."""
    pages = [read(s) for s in sources]
    x = np.concatenate([features(p) for p in pages])
    y = np.concatenate([labels(p) for p in pages]).astype(float)
    weights, speed = np.zeros(FEATURES), np.zeros(FEATURES)
    for _ in range(rounds):
        gradient = x.T @ (1 / (1 + np.exp(-x @ weights)) - y) / len(y) + decay * weights
        speed = 0.9 * speed - rate * gradient
        weights = weights + speed
    counts = np.ones((2, 2, 2))
    for page in pages:
        own = labels(page).astype(int)
        for i, node in enumerate(page.nodes[1:], 1):
            counts[names_a_role(node), own[node.parent], own[i]] += 1
    edges = np.log(counts / counts.sum(axis=2, keepdims=True))
    # The regression's log-odds hold the overall share of content, which the edges bring as well; the root has no edge.
    share = math.log(y.mean() / (1 - y.mean()))
    weights[0] -= share
    return HtmlModel(weights, share, edges)


def extract(
    pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", max_pages: int = MAX_PAGES
) -> DataFrame:
    """``key``, ``url``, ``text`` (main text, empty if none) and ``n_chars`` of every page.

    ``labelled`` has ``html`` with ``data-main`` marks; at most ``max_pages`` of its pages are used, chosen by hash.
    """
    rows = labelled.select("html").where("html is not null").orderBy(F.xxhash64("html"), "html").limit(max_pages).collect()
    model = pages.sparkSession.sparkContext.broadcast(fit([r["html"] for r in rows]))

    def work(batch: pa.RecordBatch) -> dict:
        found = [model.value.text(t) for t in texts(batch, 2)]
        return {key: batch.column(0), url: batch.column(1), "text": found, "n_chars": [len(t) for t in found]}

    schema = f"`{key}` {type_of(pages, key)}, `{url}` string, text string, n_chars long"
    return per_batch(narrow(pages, key, url, source), schema, work)
