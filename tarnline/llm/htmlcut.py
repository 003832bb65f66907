"""Main-text extraction from HTML by minimum cut.

The page is cut into blocks (runs of text between block-level tags) within elements. A logistic classifier, trained here
on pages generated with known labels, gives the costs of either label, which are the capacities to the two terminals: a
block speaks for itself by its text alone (length, links, sentences, tag, place), an element by what its markup says, once
for every block inside. Neither decides alone: edges from blocks to their elements, from elements to the ones around them
(proximity in the tree), and between neighbouring blocks (adjacency) are the smoothness capacities. Max-flow (Dinic)
separates content from boilerplate; blocks on the source side are the main text.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, deque
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import add_struct

# attributes as far as the tag goes; nothing in it is tried twice, so a tag that never ends is read once, to the end of the page
_INSIDE = r"""(?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|noscript|template|svg|iframe|textarea|select)(?=[\s/>]){_INSIDE}>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_INSIDE})(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…]\s+\S")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements by what they say of the text inside.
_KINDS = {"article": 1, "main": 1, "nav": 2, "menu": 2, "header": 3, "footer": 4, "aside": 5, "form": 6, "button": 6, "dialog": 7, "head": 8, "title": 8}
#: Words of class, id and role attributes that mark page furniture, and those that mark reader comments.
_FURNITURE = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs pager pagination sidebar side related recommended recommendations share sharing social toolbar masthead footer copyright legal widget skip search alert disclaimer paywall contentinfo complementary".split())
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion feedback".split())
_BODYISH = frozenset("article content entry post story main body text".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())

FIELDS = StructType([StructField("text", StringType()), StructField("n_chars", LongType()), StructField("n_blocks", LongType()), StructField("n_kept", LongType())])
#: Columns of a block's features that tell what holds it; the others are about its text.
MARKUP = 11
#: Largest log-odds of a block by its text.
CLIP = 3.0
#: Capacities between neighbours in the page, more where both hang on one element, between a block and its element, and between elements.
NEXT_TO, SAME_PARENT, HOLDS, WITHIN = 0.3, 0.35, 6.0, 1.5


class Block:
    __slots__ = ("chars", "kinds", "linked", "node", "parent", "tag", "text")

    def __init__(self, text: str, tag: str, kinds: tuple[bool, ...], linked: int, node: int, parent: int) -> None:
        self.text, self.tag, self.kinds, self.linked, self.node, self.parent, self.chars = text, tag, kinds, linked, node, parent, len(text)


def parse(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Text blocks in page order, and elements: the number of the one around (-1: none) and the bits that its own markup adds. Broken markup is read as it stands: unknown end tags are skipped, open elements end with the page."""
    out: list[Block] = []
    elements = [(-1, 0)]
    # an open element: tag, kind bits, own number
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    open_: Counter[str] = Counter()
    buffer: list[str] = []
    linked = numbers = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip() if buffer else ""
        buffer.clear()
        if text:
            tag, bits, node = stack[-1]
            out.append(Block(text, tag, tuple(bool(bits >> k & 1) for k in range(1, 12)), min(linked, len(text)), node, stack[-2][2] if len(stack) > 1 else 0))
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(piece := page[at : m.start()])
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        name = m[3]
        if not name:
            if m[1]:
                buffer.append(" ")
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                in_link = 0 if m[2] else 1
            elif name == "br":
                buffer.append("\n")
            continue
        flush()
        in_link = 0
        if m[2]:
            while open_[name]:
                open_[closed := stack.pop()[0]] -= 1
                if closed == name:
                    break
            continue
        if name in _VOID or m[4].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") or name in _PARAGRAPHS:
            closes = ("p",) if name in _PARAGRAPHS else (name, "p")
            while len(stack) > 1 and stack[-1][0] in closes:
                open_[stack.pop()[0]] -= 1
        elif stack[-1][0] == "p":
            open_[stack.pop()[0]] -= 1
        bits, inside = stack[-1][1], stack[-1][1] & 2
        kind = _KINDS.get(name, 0)
        if kind and not (kind == 3 and inside):  # a header within the article is its heading
            bits |= 1 << kind
        if m[4]:
            for a in _ATTRIBUTE.finditer(m[4]):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key == "style":
                    if re.search(r"display\s*:\s*none", value):
                        bits |= 1 << 11
                    continue
                tokens = set(_WORD.findall(value))
                if tokens & _FURNITURE:
                    bits |= 1 << 9
                if tokens & _COMMENTS:
                    bits |= 1 << 10
                elif tokens & _BODYISH and not tokens & _FURNITURE:
                    bits |= 2
        numbers += 1
        elements.append((stack[-1][2], bits & ~stack[-1][1]))
        stack.append((name, bits, numbers))
        open_[name] += 1
    buffer.append(page[at:])
    flush()
    return out, elements


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    return parse(page)[0]


def features(own: list[Block]) -> np.ndarray:
    """A row for each block: what holds it, then its size, links, end, tag, place, and sentences that follow others."""
    n = len(own)
    x = np.zeros((n, 21))
    for i, b in enumerate(own):
        x[i, :11] = b.kinds
        words = b.text.count(" ") + 1
        x[i, 11] = min(np.log1p(words), 5) / 5
        x[i, 12] = b.linked / b.chars
        x[i, 13] = b.text[-1] in ".!?:;…\"”»"
        x[i, 14] = b.tag in _PARAGRAPHS
        x[i, 15] = b.tag == "li"
        x[i, 16] = b.tag in ("h1", "h2", "h3")
        x[i, 17] = i < 2
        x[i, 18] = i == n - 1
        x[i, 19] = 1
        x[i, 20] = min(len(_SENTENCE.findall(b.text)), 3) / 3
    return x


def labelled_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page built by rule, and whether each of its blocks is main text."""
    words = lambda a, b: " ".join("".join(rng.choices("aeioulnrstdm", k=rng.randint(2, 9))) for _ in range(rng.randint(a, b)))
    page, labels = [], []

    def put(markup: str, label: bool, n: int = 1) -> None:
        page.append(markup)
        labels.extend([label] * n)

    some = lambda p: rng.random() < p
    if some(0.08):  # nothing but the text
        holder, k = rng.choice(["div", "article", "section"]), rng.randint(1, 3)
        return f"<html><body><{holder}>" + "".join(f"<p>{words(3, 60)}.</p>" for _ in range(k)) + f"</{holder}></body></html>", [True] * k
    if some(0.1):  # one run of sentences, in no paragraph
        holder = rng.choice(["div", "section", "td", "body"])
        return f"<html><{holder}>" + " ".join(words(4, 20).capitalize() + "." for _ in range(rng.randint(2, 9))) + f"</{holder}></html>", [True]
    if some(0.7):
        put(f"<head><title>{words(2, 12)}</title></head>", False)
    if some(0.5):
        put(f"<header><div>{words(1, 6)}</div></header>", False)
    if some(0.9):
        k = rng.randint(2, 8)
        holder = rng.choice(["nav", 'div class="menu"', "nav", 'ul class="navigation"'])
        put(f"<{holder}>" + "".join(f'<li><a href="/x">{words(1, 2)}</a></li>' for _ in range(k)) + f"</{holder.split()[0]}>", False, k)
    for holder, p in (('div class="ad"', 0.6), ('div id="cookie-notice"', 0.3), ('div class="banner"', 0.2), ("form", 0.2), ("button", 0.1), ('div style="display:none"', 0.1), ("dialog", 0.1)):
        if some(p):
            put(f"<{holder}>{words(2, 30)}.</{holder.split()[0]}>", False)
    holder = rng.choice(["article", "article", "main", 'div class="content"', "div", 'div id="story"'])
    page.append(f"<{holder}>")
    put(f"<h1>{words(2, 12)}</h1>", True)
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        text = words(4, 90) + rng.choice([".", ".", ".", "", "!"])
        put(f"<li>{text}</li>" if kind < 0.06 else f"<h2>{words(1, 6)}</h2>" if kind < 0.12 else f"<blockquote>{text}</blockquote>" if kind < 0.15 else f"<p>{text}</p>", True)
        if some(0.08):
            put(f'<div class="{rng.choice(["ad", "promo", "related", "share", "newsletter"])}">{words(2, 25)}.</div>', False)
    page.append(f"</{holder.split()[0]}>")
    if some(0.35):
        k = rng.randint(1, 5)
        put('<div class="comments">' + "".join(f'<p class="comment">{words(3, 40)}.</p>' for _ in range(k)) + "</div>", False, k)
    if some(0.35):
        k = rng.randint(1, 4)
        put("<aside>" + "".join(f"<p>{words(2, 25)}.</p>" for _ in range(k)) + "</aside>", False, k)
    if some(0.9):
        put(f"<{rng.choice(['footer', 'footer'])}>&copy; {words(1, 30)}.</footer>", False)
    return "<html><body>" + "".join(page) + "</body></html>", labels


@lru_cache(maxsize=4)
def train(pages: int = 400, seed: int = 7, ridge: float = 0.0004, steps: int = 15) -> tuple[float, ...]:
    """Weights of the block classifier: ridge logistic regression by Newton's method on generated pages."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, labels = labelled_page(rng)
        xs.append(features(blocks(page)))
        ys.append(np.array(labels, float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) / len(y) + ridge * w)
    return tuple(w)


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut; undirected inner edges. Ties go to the sink side.

    What a node can send straight through is taken out first. A node whose terminal outweighs all its edges is on that
    side of every minimum cut; its edges then pull at its neighbours, some of which are settled by that. What is left
    undecided goes to Dinic's algorithm.
    """
    n = len(source)
    excess = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    around = [0.0] * n
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
        around[i] += c
        around[j] += c
    side: list[bool | None] = [None] * n
    settled = [i for i in range(n) if abs(excess[i]) > around[i] + 1e-9 or not near[i]]
    for i in settled:
        side[i] = excess[i] > 0
    while settled:
        i = settled.pop()
        for j, c in near[i]:
            if side[j] is None:
                excess[j] += c if side[i] else -c
                around[j] -= c
                if abs(excess[j]) > around[j] + 1e-9:
                    side[j] = excess[j] > 0
                    settled.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        at = {i: k for k, i in enumerate(left)}
        for i, x in zip(left, _max_flow([excess[i] for i in left], [(at[i], at[j], c) for i, j, c in edges if i in at and j in at]), strict=True):
            side[i] = x
    return side


def _max_flow(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of each node by Dinic's algorithm; a positive excess comes from the source, a negative one goes to the sink."""
    n = len(excess)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def link(i: int, j: int, a: float, b: float) -> None:
        head[i].append(len(to))
        to.append(j)
        cap.append(a)
        head[j].append(len(to))
        to.append(i)
        cap.append(b)

    for i, e in enumerate(excess):
        link(s, i, e, 0.0) if e > 0 else link(i, t, -e, 0.0)
    for i, j, c in edges:
        link(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for e in head[i]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                path.clear()
                i = s
            while place[i] < len(head[i]):
                e = head[i][place[i]]
                if cap[e] > 1e-9 and level[to[e]] == level[i] + 1:
                    break
                place[i] += 1
            if place[i] < len(head[i]):
                path.append(head[i][place[i]])
                i = to[path[-1]]
            elif path:
                e = path.pop()
                i = to[e ^ 1]
                place[i] += 1
            else:
                break


def graph(own: list[Block], elements: list[tuple[int, int]], weights: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Log-odds of the nodes (blocks, then elements that hold any) and the edges between them. An element that says nothing and holds one thing is left out: what it holds hangs on the one around."""
    logit = np.clip(features(own)[:, MARKUP:] @ weights[MARKUP:], -CLIP, CLIP)
    inside = [0] * len(elements)
    holds = [0] * len(elements)
    for b in own:
        inside[b.node] += 1
        holds[b.node] += 1
    for e in range(len(elements) - 1, 0, -1):  # an element has a greater number than the one around
        if inside[e]:
            inside[elements[e][0]] += inside[e]
            holds[elements[e][0]] += 1
    node: dict[int, int] = {}
    says = []
    for e, (_, bits) in enumerate(elements):
        if inside[e] and (bits or holds[e] > 1):
            node[e] = len(own) + len(says)
            says.append(inside[e] * sum(weights[k - 1] for k in range(1, 1 + MARKUP) if bits >> k & 1))
    edges = []

    def hang(i: int, e: int, c: float) -> None:
        while e >= 0 and e not in node:
            e = elements[e][0]
        if e >= 0:
            edges.append((i, node[e], c))

    for i, b in enumerate(own):
        hang(i, b.node, HOLDS)
        if i:
            edges.append((i - 1, i, NEXT_TO + SAME_PARENT * (own[i - 1].parent == b.parent)))
    for e, i in node.items():
        hang(i, elements[e][0], WITHIN)
    return np.concatenate((logit, np.array(says))), edges


def extract(page: str | None, weights: np.ndarray) -> tuple[str, int, int]:
    """Main text, number of blocks, number of blocks kept."""
    own, elements = parse(page) if page else ([], [])
    if not own:
        return "", 0, 0
    odds, edges = graph(own, elements, weights)
    side = min_cut(np.maximum(odds, 0).tolist(), np.maximum(-odds, 0).tolist(), edges)
    kept = [b.text for b, content in zip(own, side, strict=False) if content]
    return "\n\n".join(kept), len(own), len(kept)


def extract_pages(pages: DataFrame, name: str, markup: str = "html") -> DataFrame:
    """pages with a struct column: text, n_chars (code points), n_blocks, n_kept.

    Null and empty markup give the empty text. Repeated rows each get their result; other columns pass through.
    """
    weights = np.array(train())

    def make():
        def score(pages_: list[str | None]) -> dict:
            rows = [extract(p, weights) for p in pages_]
            return {"text": [r[0] for r in rows], "n_chars": [len(r[0]) for r in rows], "n_blocks": [r[1] for r in rows], "n_kept": [r[2] for r in rows]}

        return score

    return add_struct(pages, markup, name, FIELDS, make)
