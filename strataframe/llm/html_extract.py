"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded down the tree."""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataframe.llm.common import runs_of_texts

# HTML's elements that start a block, and those without content or with raw content.
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul button label"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style textarea title noscript template iframe svg math object canvas audio video".split()
#: Elements that an opening tag ends, when they are the innermost block or stand open above inline elements.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS |= {b: {"p"} for b in BLOCKS if b not in ENDS and b not in ("button", "label", "option", "select")}
# Words of class and id attributes, by what they tell.
TELLING = {
    "main": "article content post entry story body text main page blog news detail",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc links topbar toolbar",
    "head": "header head masthead banner logo top brand hero",
    "foot": "footer foot bottom copyright legal",
    "side": "sidebar aside side widget related recommended popular trending tags rail secondary complementary",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted banner adsense outbrain taboola",
    "notice": "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup paywall alert",
    "form": "form search login register contact input field",
    "talk": "comment comments commentlist reply replies discussion disqus respond thread feedback review reviews",
    "share": "share sharing social follow like buttons meta byline author date",
}
GROUPS = list(TELLING)
#: Groups of which an element isn't part of the main text.
ASIDE = sum(1 << k for k, g in enumerate(GROUPS) if g not in ("main", "head"))
WORD_GROUPS: dict[str, set[int]] = {}
for _k, _words in enumerate(TELLING.values()):
    for _w in _words.split():
        WORD_GROUPS.setdefault(_w, set()).add(_k)
KINDS = ["body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "p", "h1", "h2", "h3", "ul", "li", "table", "td", "form", "blockquote", "button", "label", "run", "other"]
KIND = {t: i for i, t in enumerate(KINDS)} | {t: KINDS.index("h3") for t in ("h4", "h5", "h6")} | {"ol": KINDS.index("ul"), "html": 0, "menu": KINDS.index("nav"), "th": KINDS.index("td")}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|data-main)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
SPLIT = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "parts", "attrs", "main", "links", "inputs", "tags", "order", "children", "spot")

    def __init__(self, tag: str, parent: int, depth: int, attrs: int, main: bool, order: int):
        self.tag, self.parent, self.depth, self.attrs, self.main, self.order = tag, parent, depth, attrs, main, order
        self.parts: list[tuple[int, str]] = []  # place in the page, text
        self.links = self.inputs = self.tags = self.children = self.spot = 0


@cache
def _telling(value: str) -> int:
    bits = 0
    for w in SPLIT.split(re.sub("([a-z])([A-Z])", r"\1 \2", value).lower()):
        for k in WORD_GROUPS.get(w, WORD_GROUPS.get(w[:-1], ()) if w.endswith("s") else ()):
            bits |= 1 << k
    return bits


def parse(page: str) -> list[Node]:
    """Block elements in page order; inline elements only lend their text, links and inputs to them.

    A run of text that no block holds is a leaf of its own below the body. The head ends at its end
    tag, the body's tag or the first content, whichever comes first. Unclosed and stray tags are taken as browsers do in
    the common cases: blocks end open paragraphs, items end items, and an end tag without its
    start is passed over. An unclosed raw element runs to the page's end, an unclosed tag too.
    """
    nodes = [Node("body", -1, 0, 0, False, 0)]
    stack = [0]
    at, place = 0, 0
    raw_end = None
    size = len(page)
    in_link = 0
    run = 0  # the body's open run of text, 0 if none
    in_head = run_main = False

    def holder() -> int:
        """The node that takes text and inline elements here."""
        return stack[-1] or run

    while at < size:
        if raw_end:
            m = re.compile(rf"</{raw_end}\b[^>]*>?", re.I).search(page, at)
            if in_head and (not m or raw_end == "title"):  # unclosed in a head: up to the head's end
                end = HEAD_END.search(page, at, m.start() if m else size)
                at, raw_end = (end.start() if end else m.end() if m else size), None
                continue
            at, raw_end = (m.end() if m else size), None
            continue
        m = TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            text = page[at:stop]
            if not holder() and text.strip():
                nodes[0].children += 1
                run, in_head = len(nodes), False
                nodes.append(Node("run", 0, 1, 0, run_main, run))
                nodes[run].spot = nodes[0].children
            node = nodes[holder()]
            place += 1
            node.parts.append((place, text))
            if in_link:
                node.links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in ("head", "body"):
            in_head = tag == "head" and not closing
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK_SET:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        del stack[k:]
                        in_link = 0
                        break
                place += 1
                nodes[holder()].parts.append((place, " "))
            elif tag == "span":
                run_main = False
            continue
        if tag in RAW_SET:
            if not SHUT.search(attrs) or (tag not in ("svg", "math") and re.compile(rf"</{tag}\b", re.I).search(page, at)):
                raw_end = tag
            continue
        if tag == "head":
            continue
        if tag == "hr" and not stack[-1]:
            run = 0
        node = nodes[holder()]
        if tag in VOID_SET or tag not in BLOCK_SET:
            node.tags += 1
            if tag == "a":
                in_link = 1
            elif tag == "input":
                node.inputs += 1
            elif tag in ("br", "hr", "img"):
                place += 1
                node.parts.append((place, " "))
            elif tag == "span":
                run_main = "data-main" in attrs
            continue
        if tag in ("html", "body"):
            continue
        ends = ENDS.get(tag, ())
        while len(stack) > 1 and nodes[stack[-1]].tag in ends:
            stack.pop()
        in_link = run = 0
        in_head = False
        bits, main = 0, False
        for name, a, b, c in ATTRIBUTE.findall(attrs) if attrs else ():
            if name.lower() == "data-main":
                main = True
            else:
                bits |= _telling(a or b or c)
        up = stack[-1]
        nodes[up].children += 1
        place += 1
        nodes[up].parts.append((place, " "))
        made = Node(tag, up, nodes[up].depth + 1, bits, main or nodes[up].main, len(nodes))
        made.spot = nodes[up].children
        nodes.append(made)
        stack.append(len(nodes) - 1)
    return nodes


#: A slash that closes its tag; one at the end of a value without quotes is the value's.
SHUT = re.compile(r"""(?:^|[\s"']|(?:^|\s)[^\s=]+)/\s*$""")
HEAD_END = re.compile(r"</head\b|<body\b", re.I)
BLOCK_SET, VOID_SET, RAW_SET = set(BLOCKS), set(VOID), set(RAW)


def features(nodes: list[Node]) -> np.ndarray:
    """Per node: its kind, attribute tokens (its own, its ancestors', its subtree's), depth, place
    among its siblings, and how dense text, links, inputs and paragraphs are in its subtree."""
    n = len(nodes)
    up = np.array([x.parent for x in nodes])
    own = np.array([[sum(len(t.strip()) for _, t in x.parts), x.links, x.tags, x.inputs, 1, x.tag == "p", x.tag == "li", x.tag[0] == "h" and x.tag[1:].isdigit(), sum(t.count(".") + t.count(",") for _, t in x.parts), sum(t.count("©") + t.count("&copy") for _, t in x.parts), x.tag == "h1"] for x in nodes], float)
    sub = own.copy()
    below = np.array([x.attrs for x in nodes])
    for i in range(n - 1, 0, -1):
        sub[up[i]] += sub[i]
        below[up[i]] |= below[i]
    # What holds most of the page's text and its title, or an article with a title, is no menu, form or
    # sidebar whatever it is called: a layout's wrapper has such names as well.
    lead = np.array([x.tag in ("article", "main") for x in nodes])
    most = sub[:, 0] >= 0.6 * max(1.0, sub[0, 0])
    spared = (most & (lead | (sub[:, 10] > 0))) | (lead & (sub[:, 10] > 0))
    above = np.zeros(n, np.int64)
    within = np.zeros(n, np.int64)  # kinds of ancestors
    attrs = np.where(spared, np.array([x.attrs for x in nodes]) & ~ASIDE, np.array([x.attrs for x in nodes]))
    kind = np.array([KIND.get(x.tag, len(KINDS) - 1) for x in nodes])
    kind[spared & np.isin(kind, [KINDS.index(t) for t in ("nav", "header", "footer", "aside", "form")])] = KINDS.index("div")
    for i in range(1, n):
        above[i] = above[up[i]] | attrs[up[i]]
        within[i] = within[up[i]] | 1 << int(kind[up[i]])
    parent = np.maximum(up, 0)
    text = sub[:, 0]
    page = max(1.0, text[0])
    has = lambda *tags: np.logical_or.reduce([(within >> KINDS.index(t)) & 1 for t in tags])
    cols = [
        kind, np.array([x.depth for x in nodes]), np.array([x.spot for x in nodes]),
        np.array([x.spot for x in nodes]) / np.maximum(1, np.array([nodes[p].children for p in parent])),
        np.array([nodes[p].children for p in parent]), np.array([x.children for x in nodes]),
        np.log1p(own[:, 0]), np.log1p(text), text / page, text / np.maximum(1, text[parent]),
        sub[:, 1] / np.maximum(1, text), text / (sub[:, 2] + sub[:, 4]), sub[:, 3], sub[:, 5], sub[:, 6], sub[:, 7],
        sub[:, 8] / np.maximum(1, text), sub[:, 9], kind[parent],
        has("article", "main"), has("nav", "header", "footer", "aside"), has("form"),
        np.isin(kind, [KINDS.index(t) for t in ("nav", "header", "footer", "aside")]), np.isin(kind, [KINDS.index(t) for t in ("form", "button", "label")]), np.isin(kind, [KINDS.index(t) for t in ("article", "main")]), np.arange(n) / n, sub[parent, 1] / np.maximum(1, text[parent]),
    ]
    path = attrs | above
    aside = ((path & ASIDE) > 0) | (cols[20] > 0) | (cols[21] > 0) | cols[22] | cols[23]  # something on the way here tells of no main text
    cols += [aside, ~aside & ((cols[19] > 0) | cols[24] | ((path & 1 << GROUPS.index("main")) > 0))]
    for bits in (attrs, above, below):
        cols += [(bits >> k) & 1 for k in range(len(GROUPS))]
    return np.stack([np.asarray(c, float) for c in cols], 1)


class Tree(NamedTuple):
    """A complete tree: features and thresholds by level order, and the leaves' values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


class Forest(NamedTuple):
    start: float
    trees: list[Tree]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(t.value)))):
                at = 2 * at + 1 + (x[rows, t.feature[at]] > t.threshold[at])
            out += t.value[at - len(t.feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 20, least: float = 4.0) -> Forest:
    """Gradient boosting of the log-odds with second-order leaf values over feature histograms."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = math.log(share / (1 - share))
    score, made = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        inner = (1 << depth) - 1
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            slot = (at - first) * (bins + 1)
            best = np.full(wide, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = slot + binned[:, f]
                gs = np.cumsum(np.bincount(key, g, minlength=wide * (bins + 1)).reshape(wide, -1), 1)
                hs = np.cumsum(np.bincount(key, h, minlength=wide * (bins + 1)).reshape(wide, -1), 1)
                gt, ht, gs, hs = gs[:, -1:], hs[:, -1:], gs[:, : len(e)], hs[:, : len(e)]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < least / 8) | (ht - hs < least / 8)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(wide), k]
                for node in np.flatnonzero(top > best):
                    best[node] = top[node]
                    feature[first + node], cut[first + node], threshold[first + node] = f, k[node], e[k[node]]
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + 1)
        score += value[leaf]
        made.append(Tree(feature, threshold, value))
    return Forest(start, made)


# ---- pages to learn from ----------------------------------------------------------------------


def sample_page(rng: random.Random) -> str:
    """An invented page whose main blocks are marked, in one of many common layouts."""
    word = lambda: "".join(rng.choice("aeiou" if k % 2 else "bcdfghlmnprst") for k in range(rng.randrange(2, 10)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 22))).capitalize() + "."
    prose = lambda most: " ".join(sentence() for _ in range(rng.randrange(1, most)))
    named = lambda *names: rng.choice(["", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} {word()}"'])
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randrange(1, 6)))}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, 12))) + "</ul>" if rng.random() < 0.7 else " | ".join(link() for _ in range(rng.randrange(2, 9)))

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.6:
            return f"<p>{prose(12)}</p>"
        if kind < 0.7:
            return f"<p><b>{prose(6)}<br>"
        if kind < 0.76:
            return f"<h2>{sentence()}</h2>"
        if kind < 0.82:
            return f"<p>{word()} {link()} {prose(5)}"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{prose(3)}</li>" for _ in range(rng.randrange(1, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{prose(4)}</blockquote>"
        return f"<div>{prose(8)}</div>" if kind < 0.97 else f"{prose(5)}<br>{prose(5)}"

    ad = lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "promo box", "sponsored", "banner-ad"])}">{prose(5) if rng.random() < 0.7 else link()}</div>'
    share = lambda: f'<div class="{rng.choice(["share", "social-buttons"])}">{links()}</div>'
    comment = lambda: f'<{(t := rng.choice(["div", "li", "article"]))} class="comment"><p>{word()}</p><p>{prose(7)}</p></{t}>'
    extra = {
        "header": lambda: rng.choice([f"<header><h1>{word()}</h1><p>{sentence()}</p>{links()}</header>", f"<div{named('header', 'masthead', 'top')}><h2>{link()}</h2>{links()}</div>"]),
        "nav": lambda: rng.choice([f"<nav>{links()}</nav>", f'<div class="{rng.choice(["menu", "navbar", "breadcrumb"])}">{links()}</div>']),
        "aside": lambda: rng.choice([f"<aside><h3>{word()}</h3>{prose(4)}{links()}</aside>", f'<div class="{rng.choice(["sidebar", "widget", "related"])}"><h3>{sentence()}</h3>{links() if rng.random() < 0.6 else f"<p>{prose(5)}</p>"}</div>']),
        "notice": lambda: f'<div class="{rng.choice(["cookie-notice", "consent", "newsletter", "popup", "notice", "subscribe-box"])}"><p>{prose(4)}</p>{rng.choice(["", f"<button>{word()}</button>"])}</div>',
        "form": lambda: f"<form{named('search', 'contact', 'login')}><label>{word()}</label><input name=x><p>{sentence()}</p><button>{word()}</button></form>",
        "ad": ad,
        "talk": lambda: f'<{(t := rng.choice(["section", "div"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "discussion", "replies"])}"><h3>{sentence()}</h3>' + "".join(comment() for _ in range(rng.randrange(1, 7))) + f"</{t}>",
        "footer": lambda: rng.choice([f"<footer>&copy; {word()} &middot; {prose(3)}</footer>", f"<div{named('footer', 'bottom', 'copyright')}>&copy; {word()} {sentence()}{links()}</div>"]),
    }
    heading = rng.choice(["", f"<h1>{sentence()}</h1>", f"<h1>{' '.join(word() for _ in range(9))}</h1>"])
    blocks = [heading, *[paragraph() for _ in range(rng.choice([1, 1, 1, 2, 4, 8, 16, 30]))]]
    # Marked by element: a wrapper without a name would be the only trace otherwise.
    body = "".join(b.replace(">", " data-main>", 1) if b.startswith("<") else f"<p data-main>{b}</p>" if b else "" for b in blocks[:2])
    for b in blocks[2:]:
        if rng.random() < 0.05:
            body += rng.choice([ad, share, extra["notice"], extra["aside"]])()
        body += b.replace(">", " data-main>", 1) if b.startswith("<") else f"<p data-main>{b}</p>"
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    article = f"<{tag}{named('content', 'post', 'entry-content', 'article-body', 'story', 'main')}>{body}</{tag}>"
    if rng.random() < 0.3:
        article = f"<{rng.choice(['main', 'div'])}{named('page', 'wrapper', 'container', 'content')}>{article}"
    before = [extra[k]() for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.45]
    after = [extra[k]() for k in ("ad", "aside", "talk", "form", "notice", "footer") if rng.random() < 0.45]
    if rng.random() < 0.25:  # text directly in the body, also behind an end tag too many
        bare = lambda: "<span data-main>" + "".join(rng.choice([f"{prose(8)}<br>", f"{prose(5)} <b>{word()}</b> ", f"{prose(3)} {link()} {prose(4)}<br><br>"]) for _ in range(rng.choice([1, 2, 4, 8]))) + "</span>"
        marked = heading.replace(">", " data-main>", 1)
        article = rng.choice([marked + bare(), f"{bare()}<p data-main>{prose(6)}</p>{bare()}", f"<{tag}{named('content', 'post')}>{body}</{tag}></{tag}>{bare()}"])
    if rng.random() < 0.25:
        other = lambda: rng.choice([f"&copy; {word()} {rng.randrange(1990, 2030)} {sentence()}", " | ".join(link() for _ in range(rng.randrange(1, 9))), f"{word()} {link()}"])
        (before if rng.random() < 0.5 else after).append(f"<hr>{other()}<hr>")
    return f"<html><head><title>{word()}</title>{rng.choice(['</head><body>', '<body>', '</head><body>'])}{''.join(before)}{article}{''.join(after)}"


@cache
def trained(pages: int = 600, seed: int = 5) -> Forest:
    """The model of invented pages: a node is positive where its subtree has main text."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = parse(sample_page(rng))
        y = np.array([x.main and any(t.strip() for _, t in x.parts) for x in nodes], float)
        for i in range(len(nodes) - 1, 0, -1):
            y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
        xs.append(features(nodes)[1:])
        ys.append(y[1:])
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which nodes are open: the likeliest choice in which no node is open below a closed one."""
    yes = -np.log1p(np.exp(-np.clip(odds, -30, 30)))
    no = -np.log1p(np.exp(np.clip(odds, -30, 30)))
    closed, opened = no.tolist(), yes.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        closed[up] += closed[i]
        opened[up] += max(opened[i], closed[i])
    out = [True] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].parent] and opened[i] > closed[i]
    return out


def main_text(nodes: list[Node], is_open: list[bool]) -> str:
    """Open blocks' and runs' own text in page order; without any block the whole page is main text."""
    lone = all(x.tag == "run" for x in nodes[1:])
    parts = sorted(p for x, ok in zip(nodes, is_open, strict=True) if ok or lone for p in x.parts)
    return " ".join(html.unescape("".join(t for _, t in parts)).split())


def extract(pages: list[str], model: Forest) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    odds = model.odds(np.concatenate([features(n) for n in parsed]))
    out, at = [], 0
    for nodes in parsed:
        out.append(main_text(nodes, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per input row: page_id, url, text and n_chars.

    Null and empty pages have the empty text; a page without any block element is all main text.
    Rows are independent, so repeated rows have equal texts. The model learns from invented
    pages alone, once on the driver, and its size is fixed.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x or "" for x in batch.column(2).to_pylist()]
            texts = [t for lo, hi in runs_of_texts(rows, 1_000_000) for t in extract(rows[lo:hi], model)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
