"""Main text of web pages by a recurrent block labeller.

1. A page is read into blocks: the text between block-level tags, with the tags,
   classes and ids of its open elements.  Titles, scripts, styles, comments and
   embedded elements never become blocks.
2. A bidirectional LSTM (numpy) reads the blocks of a page in order.  Its input are
   hashed tag-path tokens, hashed words and a few numbers; its output is, for each
   block, whether it belongs to the main text.
3. Main blocks are joined in page order.

The labeller is trained on a bounded sample of the pages themselves, of large pages on
blocks spread over them.  Pages whose
markup tells article and surroundings apart give labels; more examples are laid out
anew from their texts with other containers, orders and class names, so that the
labeller does not hang on one template.

Defined cases: null html is empty; pages without main blocks give an empty text;
unclosed tags, comments and quotes end with the page or at the next tag; scripts and
styles without an end tag end with the page, of other elements without text the tag
alone is skipped; a head needs no end tag; repeated rows are judged alike; an empty table gives an empty table; a labeller
trained where no page has a block knows fixed texts only; other columns never matter.
"""

from __future__ import annotations

import html as htmllib
import random
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakelens.llm.common import small_batches, stored

SAMPLE_PAGES = 300  # bound of the training sample
SAMPLE_CHARS, SAMPLE_BLOCKS, BLOCK_CHARS = 100_000, 200, 2_000  # bounds of what one page gives to train
PATH_TOKENS = 500  # and of the innermost tokens of a block's path there
LAID_OUT = 1200
PATHS, WORDS, NUMBERS, HIDDEN = 4096, 128, 5, 12
INPUTS = PATHS + WORDS + NUMBERS
CELLS = 6000  # blocks labelled at once
PAGES = 256  # pages parsed at once

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template svg math iframe object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td textarea tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "button", "option", "optgroup"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}}

_TAG = re.compile(
    r"<!--(?:.*?-->|>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z",
    re.S,
)
_RAW = re.compile(
    r"<!--(?:.*?-->|>|.*\Z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>]|\Z)|\Z)"
    rf"|<(/?)({'|'.join(sorted(RAW - {'script', 'style', 'title'}))})(?=[\s/>]|\Z)([^>]*)>?",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@lru_cache(1 << 14)
def path_bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % PATHS


@lru_cache(1 << 16)
def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % WORDS


@lru_cache(1 << 13)
def _element(tag: str, attributes: str) -> tuple[str, ...]:
    """Tokens of an element: its tag, and its classes, ids and roles whole and in parts."""
    tokens = {f"<{tag}"}
    for _, value in _NAMED.findall(attributes):
        for name in value.strip("\"'").lower().split():
            tokens.add(name)
            tokens.update(p for p in _SPLIT.split(name) if len(p) > 1)
    if _HIDDEN.search(attributes):
        tokens.add("hidden")
    return tuple(sorted(tokens))


class Node:
    """An open element: what its path adds to that of the element around it."""

    __slots__ = ("parent", "tokens", "leaf", "inside", "outside")

    def __init__(self, parent: Node | None, tokens: tuple[str, ...], leaf: str):
        self.parent, self.tokens, self.leaf = parent, tokens, leaf
        self.inside = (parent is not None and parent.inside) or not _INSIDE.isdisjoint(tokens)
        self.outside = (parent is not None and parent.outside) or not _OUTSIDE.isdisjoint(tokens)


class Block:
    """A text block with its path: given as tokens, or by the innermost element around it."""

    __slots__ = ("text", "linked", "node", "_path")

    def __init__(self, text: str, path: tuple[str, ...] | None = None, linked: float = 0.0, node: Node | None = None):
        self.text, self.linked, self.node, self._path = text, linked, node, path

    @property
    def path(self) -> tuple[str, ...]:
        """All tokens, from the inside outwards."""
        if self._path is not None:
            return self._path
        return tuple(self.tokens())

    def tokens(self) -> Iterator[str]:
        yield f"leaf:{self.node.leaf}"
        node = self.node
        while node is not None:
            yield from node.tokens
            node = node.parent

    def sides(self) -> tuple[bool, bool]:
        """Does the path name an article, and something around one?"""
        if self.node is not None:
            return self.node.inside, self.node.outside
        return not _INSIDE.isdisjoint(self._path), not _OUTSIDE.isdisjoint(self._path)

    def features(self) -> tuple[list[int], list[float]]:
        words = self.text.split()
        numbers = [1.0, np.log1p(len(words)) / 4, self.linked, float(self.text[-1:] in ".!?"),
                   sum(w[:1].isupper() for w in words) / max(len(words), 1)]
        return [word_bucket(w) for w in words], numbers


def _raw_ends(page: str) -> dict[int, int]:
    """Where the elements without text that have an end tag begin and end."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _RAW.finditer(page):
        if not m[3]:
            continue
        begun = opened.setdefault(m[3].lower(), [])
        if not m[2]:
            if not m[4].endswith("/"):
                begun.append(m.start())
        elif begun:
            ends[begun.pop()] = m.end()
    return ends


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    root = Node(None, (), "")
    stack: list[tuple[str, Node]] = []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    closers: list[int] = []  # places of elements that a paragraph cannot hold, and of paragraphs
    held: set[str] = set()  # tokens of all open elements
    texts: list[str] = []
    links = [0, 0]
    node = root
    opened = [0]  # open links
    raw_ends: dict[int, int] | None = None

    def flush() -> None:
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(text, None, links[0] / max(links[1], 1), node))
            texts.clear()
            links[:] = [0, 0]

    def say(raw: str) -> None:
        nonlocal node
        text = htmllib.unescape(raw)
        if not texts:
            if not text.strip():
                return
            node = stack[-1][1] if stack else root
        texts.append(text)
        links[1] += len(text)
        links[0] += len(text) if opened[0] else 0

    def push(tag: str, attributes: str) -> None:
        around = stack[-1][1] if stack else root
        new = _element(tag, attributes)
        if not held.isdisjoint(new):
            new = tuple(t for t in new if t not in held)
        held.update(new)
        places.setdefault(tag, []).append(len(stack))
        if tag in CLOSES_P:
            closers.append(len(stack))
        stack.append((tag, Node(around, new, tag if tag in BLOCK else around.leaf)))
        opened[0] += tag == "a"

    def pop_to(i: int) -> None:
        for tag, gone in stack[i:]:
            opened[0] -= tag == "a"
            held.difference_update(gone.tokens)
        for tag, _ in reversed(stack[i:]):
            places[tag].pop()
        while closers and closers[-1] >= i:
            closers.pop()
        del stack[i:]

    def nearest(tags: Iterable[str]) -> int | None:
        """Place of the innermost open element of these tags."""
        return max((places[t][-1] for t in tags if places.get(t)), default=None)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
        if tag in BLOCK:
            flush()
        if closing:
            i = nearest((tag,))
            if i is not None:
                pop_to(i)
            continue
        if tag in RAW:
            if attributes.endswith("/"):
                continue
            if tag in ("script", "style", "title"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if end is None and tag == "title" and (following := _TAG.search(page, at)):
                    at = following.start()
                else:
                    at = end.end() if end else len(page)
                continue
            if raw_ends is None:
                raw_ends = _raw_ends(page)
            at = max(at, raw_ends.get(m.start(), at))
            continue
        if tag == "head":  # holds no text but that of other elements, and ends where it likes
            continue
        if tag in CLOSES_P:
            if closers and stack[closers[-1]][0] == "p":
                pop_to(closers[-1])
        if tag in SIBLINGS:
            i = nearest(SIBLINGS[tag] | {"ul", "ol", "dl", "table", "select"})
            if i is not None and stack[i][0] in SIBLINGS[tag]:
                pop_to(i)
        if tag not in VOID:
            push(tag, attributes)
    if at < len(page):
        say(page[at:])
    flush()
    return out


class Labeller:
    """A bidirectional LSTM over the blocks of a page, with a direct path from its input."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        g, h = 4 * HIDDEN, HIDDEN
        draw = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        # columns of W: gates of the forward pass, of the backward pass, direct path to the output
        self.p = {"W": draw(INPUTS, 2 * g + 1, by=0.1), "Uf": draw(h, g, by=0.2), "Ub": draw(h, g, by=0.2), "V": draw(2 * h, by=0.2)}
        self.p["W"][:, 2 * g] = 0
        for gates in (h, g + h):
            self.p["W"][PATHS + WORDS, gates : gates + h] += 1.0  # open forget gates

    def _pass(self, x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = True):
        b, t, _ = x.shape
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        hs, trace = np.zeros((b, t, HIDDEN), np.float32), []
        for k in range(t):
            z = x[:, k] + h @ u
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k : k + 1]
            new = f * c + i * g
            q = np.tanh(new)
            if keep:
                trace.append((h, c, i, f, o, g, q, m))
            c = m * new + (1 - m) * c
            h = m * (o * q) + (1 - m) * h
            hs[:, k] = h
        return hs, trace

    def _back(self, dhs: np.ndarray, u: np.ndarray, trace: list):
        b, t, _ = dhs.shape
        dz = np.zeros((b, t, 4 * HIDDEN), np.float32)
        du = np.zeros_like(u)
        dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        for k in range(t - 1, -1, -1):
            h, c, i, f, o, g, q, m = trace[k]
            dh = dh + dhs[:, k]
            inner = m * dh
            do = inner * q
            dn = m * dc + inner * o * (1 - q * q)
            d = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - g * g)], axis=1)
            dz[:, k] = d
            du += h.T @ d
            dh = d @ u.T + (1 - m) * dh
            dc = dn * f + (1 - m) * dc
        return dz, du

    def forward(self, paths: np.ndarray, at: np.ndarray, x: np.ndarray, mask: np.ndarray):
        """Path tokens of distinct paths, path of each block, its other inputs, and which blocks exist."""
        g = 4 * HIDDEN
        z = x @ self.p["W"][PATHS:] + (paths @ self.p["W"][:PATHS])[at]
        f, tf = self._pass(z[:, :, :g], self.p["Uf"], mask)
        r, tr = self._pass(z[:, ::-1, g : 2 * g], self.p["Ub"], mask[:, ::-1])
        h = np.concatenate([f, r[:, ::-1]], axis=2)
        return h @ self.p["V"] + z[:, :, 2 * g], (h, tf, tr)

    def step(self, paths: np.ndarray, at: np.ndarray, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        z, (h, tf, tr) = self.forward(paths, at, x, mask)
        dz = ((1 / (1 + np.exp(-z)) - y) * mask / mask.sum()).astype(np.float32)
        dh = dz[:, :, None] * self.p["V"]
        df, duf = self._back(dh[:, :, :HIDDEN], self.p["Uf"], tf)
        db, dub = self._back(dh[:, ::-1, HIDDEN:], self.p["Ub"], tr)
        d = np.concatenate([df, db[:, ::-1], dz[:, :, None]], axis=2).reshape(-1, 8 * HIDDEN + 1)
        by_path = np.zeros((len(paths), d.shape[1]), np.float32)
        np.add.at(by_path, at.reshape(-1), d)
        return {
            "W": np.concatenate([paths.T @ by_path, x.reshape(-1, x.shape[2]).T @ d]),
            "Uf": duf, "Ub": dub, "V": np.einsum("bt,bth->h", dz, h),
        }

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.02, batch: int = 32,
            seed: int = 2) -> Labeller:
        rnd = random.Random(seed)
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        n = 0
        for epoch in range(epochs):
            order = list(range(len(pages)))
            rnd.shuffle(order)
            order = [i for a in range(0, len(order), 16 * batch) for i in sorted(order[a : a + 16 * batch], key=lambda i: len(pages[i][0]))]
            for a in range(0, len(order), batch):
                some = [pages[i] for i in order[a : a + batch]]
                read = inputs([b for b, _ in some], drop=rnd)
                y = np.zeros_like(read[-1])
                for i, (_, labels) in enumerate(some):
                    y[i, : len(labels)] = labels
                n += 1
                speed = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)
                for k, d in self.step(*read, y).items():
                    one[k] = 0.9 * one[k] + 0.1 * d
                    two[k] = 0.999 * two[k] + 0.001 * d * d
                    self.p[k] = (self.p[k] - speed * one[k] / (np.sqrt(two[k]) + 1e-8)).astype(np.float32)
        return self

    def read(self, pages: list[list[Block]]) -> np.ndarray:
        """The outputs of ``forward``, in memory that follows the number of blocks.

        A path's share of the inputs is that of the path around it and of the tokens it
        adds, so paths are never laid out whole; words are laid out some blocks at a time.
        """
        w, g = self.p["W"], 4 * HIDDEN
        t = max(len(p) for p in pages)
        z = np.zeros((len(pages), t, w.shape[1]), np.float32)
        mask = np.zeros((len(pages), t), np.float32)
        for i, page in enumerate(pages):
            mask[i, : len(page)] = 1
        blocks = [block for page in pages for block in page]
        rows = z.reshape(-1, w.shape[1])
        at = np.flatnonzero(mask)
        for a in range(0, len(blocks), CELLS):
            some = blocks[a : a + CELLS]
            rows[at[a : a + len(some)]] = others(some) @ w[PATHS:]
        in_elements = [k for k, block in enumerate(blocks) if block.node is not None]
        if in_elements:
            share, place = _element_shares([blocks[k].node for k in in_elements], w)
            leaves = sorted({blocks[k].node.leaf for k in in_elements})
            leaf_of = {leaf: k for k, leaf in enumerate(leaves)}
            leaf = w[[path_bucket(f"leaf:{x}") for x in leaves]] * np.float32(0.5)
            which = np.array([leaf_of[blocks[k].node.leaf] for k in in_elements])
            here = at[in_elements]
            for a in range(0, len(here), CELLS):
                rows[here[a : a + CELLS]] += share[place[a : a + CELLS]] + leaf[which[a : a + CELLS]]
        for k, block in enumerate(blocks):
            if block.node is None:
                rows[at[k]] += w[[path_bucket(x) for x in block.path]].sum(axis=0, dtype=np.float32) * np.float32(0.5)
        f = self._pass(z[:, :, :g], self.p["Uf"], mask, keep=False)[0]
        r = self._pass(z[:, ::-1, g : 2 * g], self.p["Ub"], mask[:, ::-1], keep=False)[0]
        return np.concatenate([f, r[:, ::-1]], axis=2) @ self.p["V"] + z[:, :, 2 * g]

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which blocks are main; pages of similar length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            longest, some = 0, []
            while order and (not some or max(longest, len(pages[order[0]])) * (len(some) + 1) <= CELLS):
                some.append(order.pop(0))
                longest = len(pages[some[-1]])
            z = self.read([pages[i] for i in some])
            for k, i in enumerate(some):
                out[i] = z[k, : len(pages[i])] > 0
        return out


def _element_shares(nodes: list[Node], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the tokens of all elements down to each one add to the inputs, a row for each
    different element, and the row of each given one."""
    row: dict[int, int] = {}
    around: list[int] = []
    bucket: list[int] = []
    first: list[int] = []
    place = []
    for node in nodes:
        chain = []
        while node is not None and id(node) not in row:
            chain.append(node)
            node = node.parent
        for inner in reversed(chain):
            around.append(-1 if inner.parent is None else row[id(inner.parent)])
            row[id(inner)] = len(first)
            first.append(len(bucket))
            bucket += map(path_bucket, inner.tokens)
        place.append(row[id(chain[0] if chain else node)])
    share = np.zeros((len(first), w.shape[1]), np.float32)
    bounds = np.array([*first, len(bucket)])
    for a in range(0, len(first), CELLS):
        b = min(a + CELLS, len(first))
        some = a + np.flatnonzero(np.diff(bounds[a : b + 1]))
        if len(some):
            flat = w[bucket[bounds[a] : bounds[b]]]
            share[some] = np.add.reduceat(flat, bounds[some] - bounds[a], axis=0) * np.float32(0.5)
    for k, outer in enumerate(around):
        if outer >= 0:
            share[k] += share[outer]
    return share, np.array(place)


def others(blocks: list[Block]) -> np.ndarray:
    """Word shares and numbers of blocks, a row each: the inputs beside the path."""
    read = [block.features() for block in blocks]
    size = np.array([len(words) for words, _ in read])
    share = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
    bucket = np.array([w for words, _ in read for w in words], np.int64)
    index = bucket + np.repeat(np.arange(len(blocks)) * WORDS, size)
    x = np.bincount(index, share, len(blocks) * WORDS).reshape(len(blocks), WORDS)
    return np.concatenate([np.minimum(x, 3.0), [numbers for _, numbers in read]], axis=1).astype(np.float32)


def inputs(pages: list[list[Block]], drop: random.Random | None = None):
    """Arrays for ``Labeller.forward``; in training, ``drop`` hides some path tokens."""
    t = max(len(p) for p in pages)
    at = np.zeros((len(pages), t), np.int64)
    numbers = np.zeros((len(pages), t, NUMBERS), np.float32)
    mask = np.zeros((len(pages), t), np.float32)
    known: dict[tuple[str, ...], int] = {}
    cell, bucket, size = [], [], []
    for i, page in enumerate(pages):
        for j, block in enumerate(page):
            words, numbers[i, j] = block.features()
            mask[i, j] = 1
            at[i, j] = known.setdefault(block.path, len(known))
            cell.append(i * t + j)
            bucket += words
            size.append(len(words))
    paths = np.zeros((max(len(known), 1), PATHS), np.float32)
    for path, row in known.items():
        for token in path:
            if drop is None or drop.random() > 0.05:
                paths[row, path_bucket(token)] += 0.5
    share = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
    index = np.array(bucket, np.int64) + np.repeat(np.array(cell, np.int64) * WORDS, size)
    x = np.bincount(index, share, len(pages) * t * WORDS).astype(np.float32).reshape(len(pages), t, WORDS)
    return paths, at, np.concatenate([np.minimum(x, 3.0), numbers], axis=2), mask


# What weak labels and laid-out pages know about containers, as text.
MAIN = ("article main content post entry story body text article-body post-content entry-content main-content story-body "
        "blog-post page-content").split()
AROUND = {
    "header": ("header", "header site-header masthead top topbar page-header branding logo".split()),
    "menu": ("nav", "nav menu navbar navigation main-menu breadcrumb breadcrumbs site-nav toc pagination".split()),
    "notice": ("div", "notice cookie cookie-banner alert consent gdpr announcement popup modal warning banner cookie-notice message".split()),
    "advert": ("div", "ad ads advert advertisement sponsored promo sponsor ad-slot banner-ad adsbygoogle promotion".split()),
    "sidebar": ("aside", "sidebar widget rail related side right-rail related-posts recommended trending widget-area".split()),
    "form": ("form", "form search login newsletter subscribe contact signup search-form subscription".split()),
    "share": ("div", "share social sharing share-buttons social-links tags meta follow".split()),
    "comments": ("section", "comments comment comment-list discussion replies responses reader-comments respond disqus".split()),
    "footer": ("footer", "footer site-footer copyright legal bottom colophon page-footer credits".split()),
}
# What pages are laid out from where a table has no text.
SHORTS = (
    "Read more", "Home", "A short headline", "Accept all", "About us", "Subscribe to the letter", "All rights reserved",
    "Share this page", "Three answers", "Search", "News of the week", "Contact",
)
PARAGRAPHS = (
    "The town council met on Tuesday evening and, after some hours of talk, agreed to repair the old bridge before the winter begins.",
    "Bread needs little more than flour, water and salt; the rest is time, and a warm place where the dough can rise undisturbed.",
    "In the second half the visitors had more of the ball, but it was the home side that scored, late and from a long distance.",
    "We compared both machines for a month. The first was faster on paper, while the second did its work without a single failure.",
    "Thank you for this text, I have read it twice and passed it on to friends who have been asking about the matter for years.",
    "This site stores some data on your device so that pages load sooner; you can change what is stored at any time in the settings.",
)
_INSIDE = frozenset({"<article", "<main"})
_OUTSIDE = frozenset(
    {"<nav", "<footer", "<aside", "<form", "hidden"}
    | {name for _, names in AROUND.values() for name in names if name not in ("top", "side", "message", "text", "right", "bottom", "meta", "tags")}
)


def weak_labels(blocks: list[Block]) -> list[int] | None:
    """Labels where the markup tells article and surroundings apart, else None."""
    sides = [b.sides() for b in blocks]
    if not any(i for i, _ in sides) or all(i for i, _ in sides):
        return None
    return [int(inside and not outside) for inside, outside in sides]


def lay_out(rnd: random.Random, paragraphs: list[str], shorts: list[str],
            inner: tuple[str, str] | None = None) -> tuple[list[Block], list[int]]:
    """A page with a random layout, filled with given texts, and its labels.

    ``inner`` is a kind of container and its name that the article will hold.
    """
    page: list[tuple[Block, int]] = []
    noise = lambda: rnd.choice(["row", "col", "inner", "wrap", "wrapper", "container", "box", "grid", "mb-4", "clearfix", f"c{rnd.randrange(99)}"])
    shell = ["<html", "<body"]
    for _ in range(rnd.randrange(3)):
        shell += ["<div", *_SPLIT.split(noise())]

    def container(kind: str, name: str | None) -> list[str]:
        tag, names = AROUND[kind]
        if name:
            return [rnd.choice(["<div", "<section", f"<{tag}"]), name, *_SPLIT.split(name)]
        name = rnd.choice(names)
        named = [name, *_SPLIT.split(name)]
        semantic = tag not in ("div", "section")
        style = rnd.random()
        if semantic and style < 0.45:
            return [f"<{tag}", *(named if rnd.random() < 0.3 else [])]
        return [rnd.choice(["<div", "<section", "<ul", f"<{tag}"]), *named]

    def put(path: list[str], leaf: str, text: str, label: int, link: float = 0.0) -> None:
        tokens = {*path, f"<{leaf}", f"leaf:{leaf}", *(["<a"] if link else [])}
        if rnd.random() < 0.2:
            tokens |= {"<div", *_SPLIT.split(noise())}
        page.append((Block(text, tuple(sorted(tokens)), link), label))

    def around(kind: str, outer: list[str], name: str | None = None) -> None:
        path = [*outer, *container(kind, name)]
        prose = kind in ("comments", "sidebar", "notice") or rnd.random() < 0.3
        for _ in range(rnd.randint(1, 8 if kind in ("menu", "comments") else 4)):
            leaf = rnd.choice({"menu": ["li", "a", "li"], "form": ["label", "button", "p", "form"], "comments": ["p", "div", "li", "article"]}
                              .get(kind, ["p", "div", "li", "h3", "footer" if kind == "footer" else "div"]))
            text = rnd.choice(paragraphs if prose and rnd.random() < 0.7 else shorts)
            if kind == "menu":
                text = " ".join(text.split()[: rnd.randint(1, 3)])
            put(path, leaf, text, 0, 1.0 if kind == "menu" or rnd.random() < 0.1 else 0.0)

    def article() -> None:
        path = list(shell)
        style = rnd.random()
        if style < 0.5:
            path += [rnd.choice(["<article", "<main"])] + (["<div", *_SPLIT.split(rnd.choice(MAIN))] if rnd.random() < 0.4 else [])
        else:
            name = rnd.choice(MAIN)
            path += [rnd.choice(["<div", "<section", "<div"]), name, *_SPLIT.split(name)]
        if rnd.random() < 0.8:
            put([*path, *(["<header"] if rnd.random() < 0.1 else [])], rnd.choice(["h1", "h1", "h2"]), rnd.choice(shorts), 1)
        n = rnd.randint(1, 10)
        held = rnd.randint(0, n)
        for k in range(n):
            if inner and k == held:
                around(inner[0], path, inner[1])
            kind = rnd.random()
            if kind < 0.8:
                put(path, "p", rnd.choice(paragraphs if rnd.random() < 0.8 else shorts), 1)
            elif kind < 0.9:
                put([*path, "<ul"], rnd.choice(["li", "blockquote", "h2", "h3", "td"]), rnd.choice(shorts), 1)
            else:
                put(path, "div", rnd.choice(paragraphs), 1)
            if rnd.random() < 0.1:
                around(rnd.choice(["advert", "sidebar", "form", "share", "notice"]), path)
        if inner and held == n:
            around(inner[0], path, inner[1])
        if rnd.random() < 0.4:
            around(rnd.choice(["comments", "share", "form", "footer", "sidebar"]), path)

    for kind, chance in (("header", 0.6), ("menu", 0.7), ("notice", 0.4), ("form", 0.2), ("advert", 0.5), ("sidebar", 0.25)):
        if rnd.random() < chance:
            around(kind, shell)
    article()
    for kind, chance in (("advert", 0.3), ("share", 0.2), ("comments", 0.5), ("sidebar", 0.4), ("form", 0.25), ("menu", 0.15), ("footer", 0.8)):
        if rnd.random() < chance:
            around(kind, shell)
    return [b for b, _ in page], [label for _, label in page]


def sample_of(page: str | None) -> tuple[list[Block], list[int] | None]:
    """At most ``SAMPLE_BLOCKS`` blocks spread over a page, of bounded texts, and their weak labels."""
    blocks = blocks_of(page)
    labels = weak_labels(blocks)
    texts = [b.text[:BLOCK_CHARS] for b in blocks]
    n = min(len(blocks), SAMPLE_BLOCKS)
    chars = sum(map(len, texts)) * n // max(len(blocks), 1)
    if chars > SAMPLE_CHARS:
        n = max(1, n * SAMPLE_CHARS // chars)
    keep = range(len(blocks)) if n == len(blocks) else [i * len(blocks) // n for i in range(n)]
    paths = [tuple(islice(blocks[i].tokens(), PATH_TOKENS)) for i in keep]
    return [Block(texts[i], p, blocks[i].linked) for i, p in zip(keep, paths, strict=True)], labels and [labels[i] for i in keep]


def examples(pages: list[tuple[list[Block], list[int] | None]], seed: int = 3,
             laid_out: int = LAID_OUT) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages of the sample, and pages laid out from its texts; without any text, from fixed ones."""
    rnd = random.Random(seed)
    out, paragraphs, shorts = [], [], []
    for blocks, labels in pages:
        for b in blocks:
            (paragraphs if len(b.text) > 120 else shorts).append(b.text)
        if labels:
            out.append((blocks, labels))
    if not shorts and not paragraphs:
        paragraphs, shorts = list(PARAGRAPHS), list(SHORTS)
    paragraphs, shorts = paragraphs or shorts, shorts or paragraphs
    inner = [(kind, name) for kind, (_, names) in AROUND.items() for name in names if kind not in ("header", "menu")]
    return out + [lay_out(rnd, paragraphs, shorts, inner[i % len(inner)]) for i in range(laid_out)]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each different page with blocks: its key, texts, paths as text, shares of links, labels."""
    seen: set[int] = set()
    for batch in batches:
        for key, page in zip(batch.column("key"), batch.column("html"), strict=True):
            if (k := key.as_py()) in seen:
                continue
            seen.add(k)
            blocks, labels = sample_of(page.as_py())
            if blocks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([[b.text for b in blocks]], pa.list_(pa.string())),
                     pa.array([[" ".join(sorted(b.path)) for b in blocks]], pa.list_(pa.string())),
                     pa.array([[b.linked for b in blocks]], pa.list_(pa.float64())),
                     pa.array([labels], pa.list_(pa.int32()))],
                    names=["key", "texts", "paths", "linked", "labels"],
                )


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """A labeller from the ``sample_pages`` different pages with blocks whose hashes are smallest.

    Pages are read until there are so many, or no more: a table with any text gives a sample.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.xxhash64(html_col).bitwiseAND(F.lit((1 << 62) - 1)).alias("key"), F.col(html_col).alias("html")
    ).filter("html is not null")
    keys = stored(rows.select("key").distinct(), "page_keys")
    found, after, size = [], -1, sample_pages
    while len(found) < sample_pages:
        last = keys.filter(F.col("key") > after).orderBy("key").limit(size).agg(F.max("key")).first()[0]
        if last is None:
            break
        found += (
            rows.filter((F.col("key") > after) & (F.col("key") <= last))
            .mapInArrow(_samples, "key long, texts array<string>, paths array<string>, linked array<double>, labels array<int>")
            .dropDuplicates(["key"]).orderBy("key").limit(sample_pages - len(found)).collect()
        )
        after, size = last, 4 * size
    sample = [
        ([Block(t, tuple(map(sys.intern, p.split())), x) for t, p, x in zip(r.texts, r.paths, r.linked, strict=True)], r.labels)
        for r in found
    ]
    return Labeller().fit(examples(sample))


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            column = batch.column("html")
            for a in range(0, len(column), PAGES):
                pages = [blocks_of(p) for p in column[a : a + PAGES].to_pylist()]
                for blocks, main in zip(pages, shared.value.labels(pages), strict=True):
                    texts.append(" ".join(b.text for b, is_main in zip(blocks, main, strict=True) if is_main))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )
    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              labeller: Labeller | None = None) -> DataFrame:
    """Per page: id, url, the main text and its length in code points."""
    small_batches(pages.sparkSession)
    labeller = labeller or train(pages, html_col)
    shared = pages.sparkSession.sparkContext.broadcast(labeller)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_extract(shared), f"id {id_type}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
