"""Main text of web pages by a tree-structured graphical model.

A page is read into a tree of elements and text blocks. Every node has a potential for being content, logistic in
its features (kind of tag, words in its class, id and role, share of text in links, length, share of the page), and every
parent and child a potential by their pair of labels. Sum-product messages pass from the leaves up and
from the root down; a text block whose marginal for content is over one half is part of the main text.

Both potentials are trained from labelled pages. The default ones are written by a seeded generator that lays out
articles among menus, headers, footers, sidebars, notices, adverts, forms and reader comments in many ways.

What a page shows is never dropped unseen: but for scripts, styles, comments, frames and the head, all elements, formulas and
fallback texts among them, are nodes or parts of texts that the model judges. Reading takes time linear in the page.

Defined results: null and empty html give an empty text; what cannot be read as markup is text; an unclosed
script, style or comment runs to the end of the page, of other unclosed elements only the tag is skipped; null page ids and urls are kept; repeated rows get
equal results; an empty table gives an empty result; extra columns are ignored. Whole pages are read.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of elements by what they do.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr picture source math mi mn mo ms mtext mrow msup msub mfrac msqrt semantics annotation svg g tspan noscript object canvas audio video map area ruby rt rp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe title head".split())
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th tbody thead".split())
SAME_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KINDS = ("article", "main", "section", "div", "p", "h", "list", "item", "nav", "header", "footer", "aside", "form", "button", "table", "quote", "pre", "figure", "address", "dialog", "text", "other")
_KIND = {"article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "li": "item", "dt": "item", "dd": "item", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "label": "form", "select": "form", "option": "form", "optgroup": "form", "datalist": "form", "textarea": "form", "legend": "form", "input": "form", "button": "button", "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "table", "th": "table", "caption": "table", "blockquote": "quote", "pre": "pre", "figure": "figure", "figcaption": "figure", "address": "address", "dialog": "dialog", "#text": "text", **{f"h{i}": "h" for i in range(1, 7)}}
#: Words of classes, ids and roles, by what they tell of.
WORDS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip".split(),
    "header": "header masthead banner branding logo".split(),
    "footer": "footer foot copyright colophon contentinfo legal imprint".split(),
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending complementary more teaser rail".split(),
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall message".split(),
    "form": "form login search searchbox register contact input".split(),
    "comment": "comment comments reply replies discussion disqus respond thread reader readers".split(),
    "share": "share sharing social tags tag meta byline author rating".split(),
    "body": "article content main post entry story body text page-content prose".split(),
}
_WORD_KIND = {w: i for i, words in enumerate(WORDS.values()) for w in words}

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>", re.S)
_PLAIN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
_LIKE_TAG = re.compile(r"</?[a-zA-Z!?]")
_ATTR = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("tag", "attrs", "kinds", "parent", "kids", "text", "size", "linked", "index")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.kinds = _kinds_of(attrs)
        self.text, self.size, self.linked, self.index = "", 0, 0, 0


def _kinds_of(attrs: str) -> list[int]:
    if not attrs:
        return []
    found = [next(filter(None, m.groups()), "") for m in _ATTR.finditer(attrs)]
    return sorted({_WORD_KIND[w] for value in found for w in map(str.lower, _SPLIT.findall(value)) if w in _WORD_KIND})


class _Open:
    """The open elements. What is open of each tag is known by its place, so that no search climbs the tree."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    @property
    def here(self) -> Node:
        return self.stack[-1]

    def add(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags; 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        """Closes the element at a place, and all in it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()


_P_STAYS = ("article", "section", "div", "td", "li", "body")
_LISTS = ("table", "ul", "ol")


def read(page: str) -> Node:
    """The tree of a page: elements that make blocks, and a #text leaf for each run of text between them.

    Every character is looked at a bounded number of times: a tag that does not end by its quotes is cut at the next ">",
    as are all that follow it, and an end tag without its element, or a missing one, costs no search.
    """
    root = Node("#root", "", None)
    opened = _Open(root)
    run, links, linked = [], 0, 0
    at, n, last_end, tags, missing = 0, len(page), page.rfind(">"), _TAG, set()

    def end_run():
        nonlocal linked
        if run:
            text = "".join(run)
            run.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                leaf = Node("#text", "", opened.here)
                leaf.text, leaf.size = text, len(text)
                leaf.linked = min(linked, len(text))
                opened.here.kids.append(leaf)
        linked = 0

    while at < n:
        spot = page.find("<", at)
        m = None
        while spot >= 0:
            m = tags.match(page, spot) if spot < last_end or page.startswith("<!--", spot) else None
            if m is None and tags is _TAG and spot < last_end and _LIKE_TAG.match(page, spot):
                tags = _PLAIN
                m = tags.match(page, spot)
            if m is not None or spot > last_end and "<!--" not in page[spot : spot + 4]:
                break
            spot = page.find("<", spot + 1)
        if m is None:
            spot = page.find("<!--", max(at, spot)) if spot >= 0 else -1
            m = tags.match(page, spot) if spot >= 0 else None
        upto = m.start() if m is not None else n
        if upto > at:
            run.append(page[at:upto])
            linked += (upto - at) if links else 0
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue  # a comment or a declaration
        tag, close = m[2].lower(), m[1]
        if tag in RAW and not close:
            end = None if tag in missing else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None:
                missing.add(tag)
                at = n if tag in ("script", "style") else at
            else:
                at = end.end()
            run.append(" ")
            continue
        kinds = _kinds_of(m[3]) if m[3] and not close else []
        if tag in INLINE and not kinds:
            if tag == "a":
                links = max(0, links + (-1 if close else 1))
            if tag in ("br", "img"):
                run.append(" ")
            if close and opened.here.tag == tag:  # an inline element with a telling class was made a block
                end_run()
                opened.close(len(opened.stack) - 1)
            continue
        end_run()
        if close:
            place = opened.last(HEADINGS if tag in HEADINGS else (tag,))
            if place:
                opened.close(place)
                links = 0
            continue
        if tag in ENDS_P and opened.last(("p",)) > opened.last(_P_STAYS):
            opened.close(opened.last(("p",)))
        if tag in SAME_ENDS and tag != "p" and opened.last((tag,)) > opened.last((*SAME_ENDS[tag], *_LISTS)):
            opened.close(opened.last((tag,)))
        new = Node(tag, m[3], opened.here)
        opened.here.kids.append(new)
        if tag not in VOID and not m[3].endswith("/"):
            opened.add(new)
        links = links if tag in INLINE else 0
    end_run()
    return root


def _flat(root: Node) -> list[Node]:
    """Nodes, parents first and in page order, with sums over the text below each."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.index = len(out)
        out.append(node)
        stack += reversed(node.kids)
    for node in reversed(out):
        if node.parent is not None:
            p = node.parent
            p.size, p.linked = p.size + node.size, p.linked + node.linked
    return out


_EXTRA = 8
_N_FEATURES = 1 + len(KINDS) + len(WORDS) + _EXTRA
_KIND_AT = {k: i + 1 for i, k in enumerate(KINDS)}


def _features(node: Node, total: int) -> tuple[list[int], list[float]]:
    """Indices and values of a node's features; total is the length of the page's text."""
    at = [0, _KIND_AT[_KIND.get(node.tag, "other")]]
    value = [1.0, 1.0]
    for k in node.kinds:
        at.append(1 + len(KINDS) + k)
        value.append(1.0)
    base = 1 + len(KINDS) + len(WORDS)
    size, leaf = max(node.size, 1), node.tag == "#text"
    long = min(math.log1p(node.size) / 6, 1.5)
    at += range(base, base + _EXTRA)
    value += [node.linked / size, long, float(node.size == 0), float(node.size < 40), node.size / max(total, 1), long * leaf, float(leaf and node.size < 40), float(node.parent is not None and node.parent.tag in ("body", "html", "#root"))]
    return at, value


def _pair_kind(node: Node) -> int:
    """Which pair potential binds a node to its parent: 0 for texts, 1 for elements with a telling name, 2 for others."""
    if node.tag == "#text":
        return 0
    return 1 if node.kinds or node.tag in ("nav", "header", "footer", "aside", "form", "dialog", "article", "main", "button") else 2


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """The probability of content of every node: sum-product up and down the tree, in log space."""
    n = len(nodes)
    weights, pairs = model["weights"], [[math.exp(x) for x in row] for row in model["pairs"]]
    total = nodes[0].size
    own = [0.0] * n  # log odds of content from the node itself
    bind = [pairs[0]] * n
    for i, node in enumerate(nodes):
        at, value = _features(node, total)
        own[i] = sum(weights[k] * v for k, v in zip(at, value, strict=True))
        bind[i] = pairs[_pair_kind(node)]
    up0, up1 = [0.0] * n, list(own)  # log messages of the subtree for label 0 and 1
    to_parent: list[tuple[float, float]] = [(0.0, 0.0)] * n
    log, exp = math.log, math.exp
    for i in range(n - 1, 0, -1):
        b0, b1, c0, c1 = bind[i]  # parent 0: child 0, 1; parent 1: child 0, 1
        top = max(up0[i], up1[i])
        x, y = exp(up0[i] - top), exp(up1[i] - top)
        m0, m1 = log(x * b0 + y * b1 + 1e-300), log(x * c0 + y * c1 + 1e-300)
        to_parent[i] = (m0, m1)
        p = nodes[i].parent.index
        up0[p] += m0 + top
        up1[p] += m1 + top
        to_parent[i] = (m0 + top, m1 + top)
    out = [0.0] * n
    down0, down1 = [0.0] * n, [0.0] * n
    for i, node in enumerate(nodes):
        if i:
            b0, b1, c0, c1 = bind[i]
            p = node.parent.index
            q0 = up0[p] + down0[p] - to_parent[i][0]
            q1 = up1[p] + down1[p] - to_parent[i][1]
            top = max(q0, q1)
            x, y = exp(q0 - top), exp(q1 - top)
            down0[i], down1[i] = log(x * b0 + y * c0 + 1e-300), log(x * b1 + y * c1 + 1e-300)
        d = (up0[i] + down0[i]) - (up1[i] + down1[i])
        out[i] = 1 / (1 + exp(min(max(d, -700), 700)))
    return out


def main_text(page: str | None, model: dict) -> str:
    if not page:
        return ""
    nodes = _flat(read(page))
    content = marginals(nodes, model)
    return "\n\n".join(node.text for node, p in zip(nodes, content, strict=True) if node.text and p > 0.5)


# --- training -----------------------------------------------------------------------------------------------


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choices(_pool(), k=rng.randint(low, high))).capitalize() + "."


@functools.cache
def _pool() -> list[str]:
    rng = random.Random(1)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) + rng.choice(["", "", "", "", "", "", "", ",", "."]) for _ in range(300)]


def sample_page(rng: random.Random) -> str:
    """A page in which elements of the main text carry the attribute data-content."""
    w = functools.partial(_words, rng)
    pick = rng.choice
    mark = " data-content"

    def link(n=2):
        return f'<a href="/{rng.random()}">{w(1, n)[:-1]}</a>'

    def menu():
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9)))
        return pick([f"<nav><ul>{items}</ul></nav>", f'<div class="{pick(["menu", "nav", "navbar", "breadcrumb", "top-menu"])}"><ul>{items}</ul></div>', f'<ul id="{pick(["nav", "menu", "navigation"])}">{items}</ul>', f'<nav role="navigation">{" | ".join(link() for _ in range(4))}</nav>'])

    def head():
        return pick([f"<header>{pick(['', f'<h1>{w(1, 4)}</h1>', f'<p>{w(2, 6)}</p>'])}{menu()}</header>", f'<div class="{pick(["header", "masthead", "banner", "site-header"])}"><p>{w(2, 8)}</p>{pick(["", menu()])}</div>', menu(), f"<header><p>{w(2, 8)}</p></header>"])

    def advert():
        name = pick(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner", "banner-ad"])
        return pick([f'<div class="{name}">{w(3, 25)}</div>', f'<div class="{name}"><p>{w(3, 25)}</p></div>', f'<aside class="{name}"><p>{w(3, 25)} {link()}</p></aside>', f'<div id="{name}"><h3>{w(2, 5)}</h3><p>{w(5, 30)}</p></div>', f'<p class="{name}">{w(4, 20)}</p>', f'<section class="{name}">{w(3, 20)}</section>'])

    def notice():
        name = pick(["notice", "cookie-notice", "cookies", "consent", "alert", "newsletter", "popup", "modal", "subscribe"])
        return pick([f'<div class="{name}"><p>{w(6, 30)}</p><button>{w(1, 2)}</button></div>', f'<div class="{name}">{w(6, 30)}</div>', f'<div role="alert">{w(5, 20)}</div>', f'<dialog><p>{w(6, 20)}</p></dialog>', f'<p class="{name}">{w(6, 20)}</p>', f'<section id="{name}"><p>{w(6, 40)}</p></section>'])

    def side():
        name = pick(["sidebar", "widget", "related", "popular", "side", "recommended"])
        inner = pick([f"<h3>{w(1, 3)}</h3><ul>{''.join(f'<li>{link(8)}</li>' for _ in range(4))}</ul>", f"<p>{w(5, 40)}</p>", f"<h4>{w(1, 4)}</h4><p>{w(5, 40)}</p><p>{w(5, 30)}</p>", w(4, 30)])
        return pick([f"<aside>{inner}</aside>", f'<div class="{name}">{inner}</div>', f'<aside class="{name}">{inner}</aside>', f'<section id="{name}">{inner}</section>'])

    def form():
        return pick([f"<form><label>{w(1, 3)}</label><input name=q><button>{w(1, 2)}</button></form>", f'<form class="{pick(["search", "login", "contact"])}"><p>{w(3, 12)}</p><input><select><option>{w(1, 1)}</option></select><button type="submit">{w(1, 2)}</button></form>', f'<div class="{pick(["search", "login", "signup"])}"><form><p>{w(3, 10)}</p><textarea></textarea></form></div>'])

    def comments():
        name = pick(["comments", "comment-list", "discussion", "replies", "reader-comments", "respond"])
        one = lambda: pick([f'<div class="comment"><p>{w(3, 60)}</p></div>', f'<li class="comment"><b>{w(1, 2)}</b><p>{w(3, 50)}</p></li>', f'<article class="comment"><p>{w(3, 60)}</p><p>{w(3, 40)}</p></article>', f"<p>{w(3, 60)}</p>", f"<div><p>{w(3, 60)}</p><a href=#>{w(1, 1)}</a></div>"])
        body = "".join(one() for _ in range(rng.randint(1, 5)))
        return pick([f'<div class="{name}"><h3>{w(1, 3)}</h3>{body}</div>', f'<section id="{name}">{body}</section>', f'<section class="{name}"><h2>{w(1, 2)}</h2><ol>{body}</ol></section>', f'<div id="{name}">{body}</div>'])

    def foot():
        inner = f"&copy; {w(2, 12)}"
        return pick([f"<footer>{inner}</footer>", f"<footer><p>{inner}</p>{pick(['', menu()])}</footer>", f'<div class="{pick(["footer", "site-footer", "copyright"])}">{inner}</div>', f'<div id="footer"><p>{w(2, 20)}</p></div>'])

    brief = rng.random() < 0.2  # an article of short lines

    def block():
        r = rng.random()
        if brief and r < 0.9:
            return f"<p{mark}>{w(1, 6)}{pick(['</p>', '</p>', ''])}"
        if r < 0.7:
            inner = pick([w(1, 8), w(8, 120), w(20, 90), f"{w(5, 40)} {link()} {w(5, 40)}", f"<b>{w(3, 20)}</b><br>{w(5, 30)}", f"<em>{w(2, 10)}</em> {w(5, 50)}"])
            return f"<p{mark}>{inner}{pick(['</p>', '</p>', ''])}"
        if r < 0.8:
            return f"<h2{mark}>{w(1, 9)}</h2>" if r < 0.76 else f"<h3{mark}>{w(1, 9)}</h3>"
        if r < 0.87:
            return f"<ul{mark}>{''.join(f'<li{mark}>{w(2, 25)}</li>' for _ in range(rng.randint(1, 5)))}</ul>"
        if r < 0.92:
            return f"<blockquote{mark}><p{mark}>{w(5, 50)}</p></blockquote>"
        if r < 0.95:
            return f"<table{mark}><tr{mark}><td{mark}>{w(1, 6)}</td><td{mark}>{w(1, 6)}</td></tr></table>"
        if r < 0.975:
            return f"<pre{mark}>{w(3, 20)}</pre>"
        return f"<div{mark}>{w(5, 60)}</div>"

    inside = [block() for _ in range(rng.choice([1, 1, 2, 2, 3, 3, 5, 5, 8, 8, 14, 40]) if rng.random() < 0.98 else 250)]
    for extra, often in ((advert, 0.25), (side, 0.1), (notice, 0.1), (form, 0.08)):
        if rng.random() < often:
            inside.insert(rng.randint(0, len(inside)), extra())
    title = pick([f"<h1{mark}>{w(2, 12)}</h1>", f"<h1{mark}>{w(2, 12)}</h1>", f"<header{mark}><h1{mark}>{w(2, 12)}</h1></header>", ""])
    if rng.random() < 0.12:
        inside.append(comments())
    body = title + "".join(inside)
    outer = pick(["article", "article", "main", "div", "section", "both"])
    name = pick(["content", "article", "post", "entry-content", "story", "main", "post-body", "page"])
    body = {"article": f"<article{mark}>{body}</article>", "main": f"<main{mark}>{body}</main>", "div": f'<div class="{name}"{mark}>{body}</div>', "section": f'<section id="{name}"{mark}>{body}</section>', "both": f'<main{mark}><article class="{name}"{mark}>{body}</article></main>'}[outer]
    before = [f() for f, often in ((head, 0.8), (menu, 0.5), (notice, 0.35), (advert, 0.5), (form, 0.2), (side, 0.15)) if rng.random() < often]
    after = [f() for f, often in ((comments, 0.4), (side, 0.4), (advert, 0.35), (form, 0.2), (notice, 0.2), (menu, 0.15), (foot, 0.85)) if rng.random() < often]
    rng.shuffle(before)
    whole = "".join(before) + body + "".join(after)
    if rng.random() < 0.4:
        whole = pick(["<div>{}</div>", '<div id="wrapper">{}</div>', '<div class="container">{}</div>']).format(whole)
    return f"<!DOCTYPE html><html><head><title>{w(2, 6)}</title><style>p{{}}</style></head><body>{whole}<script>x</script></body></html>"


def labels(nodes: list[Node]) -> list[bool]:
    """Content by the attribute data-content: marked elements, texts in them, and all that holds such elements."""
    out = ["data-content" in node.attrs or False for node in nodes]
    for i, node in enumerate(nodes):
        if node.tag == "#text":
            out[i] = out[node.parent.index]
    for i in range(len(nodes) - 1, 0, -1):
        if out[i]:
            out[nodes[i].parent.index] = True
    return out


def _pass(own: np.ndarray, pair: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of content of all nodes, and of the four label pairs of each node with its parent.

    pair: log potentials by node (n, parent label, child label); levels: nodes by depth, the root's level first.
    """
    up = np.stack([np.zeros(len(own)), own], 1)
    sent = np.zeros((len(own), 2))
    for level in levels[:0:-1]:
        sent[level] = np.logaddexp(up[level, None, 0] + pair[level, :, 0], up[level, None, 1] + pair[level, :, 1])
        for label in (0, 1):
            up[:, label] += np.bincount(parent[level], sent[level, label], len(own))
    down, both = np.zeros((len(own), 2)), np.zeros((len(own), 2, 2))
    for level in levels[1:]:
        rest = up[parent[level]] + down[parent[level]] - sent[level]
        joint = rest[:, :, None] + pair[level]
        down[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint = joint + up[level][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        both[level] = joint / joint.sum((1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip((up + down)[:, 0] - (up + down)[:, 1], -500, 500))), both


def train(pages: list[str], rounds: int = 120, rate: float = 0.5) -> dict:
    """Weights and pair potentials of most likelihood, by gradient steps on the marginals of all pages at once."""
    x, y, parent, depth, kind = [], [], [], [], []
    for page in pages:
        nodes, base = _flat(read(page)), len(y)
        for node in nodes:
            at, value = _features(node, nodes[0].size)
            row = np.zeros(_N_FEATURES)
            row[at] = value
            x.append(row)
            parent.append(base + (node.parent.index if node.parent is not None else 0))
            depth.append(depth[parent[-1]] + 1 if node.parent is not None else 0)
            kind.append(_pair_kind(node))
        y += labels(nodes)
    x, y, parent, depth, kind = np.array(x), np.array(y, int), np.array(parent), np.array(depth), np.array(kind)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    child = np.flatnonzero(depth > 0)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (kind[child], y[parent[child]], y[child]), 1)
    weights, pairs = np.zeros(_N_FEATURES), np.zeros((3, 2, 2))
    square_w, square_p = np.full(_N_FEATURES, 1e-8), np.full((3, 2, 2), 1e-8)
    for _ in range(rounds):
        content, both = _pass(x @ weights, pairs[kind], parent, levels)
        g = x.T @ (y - content) / len(pages) - 1e-3 * weights
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, kind[child], both[child])
        h = (seen - expected) / len(pages) - 1e-3 * pairs
        square_w, square_p = 0.9 * square_w + 0.1 * g * g, 0.9 * square_p + 0.1 * h * h
        weights += rate * 0.1 * g / np.sqrt(square_w)
        pairs += rate * 0.1 * h / np.sqrt(square_p)
        rate *= 0.993
    return {"weights": weights.tolist(), "pairs": pairs.reshape(3, 4).tolist()}


@functools.cache
def default_model(pages: int = 500, seed: int = 7) -> dict:
    """The model trained on generated pages: 500 by default, whatever the input."""
    rng = random.Random(seed)
    return train([sample_page(rng) for _ in range(pages)])


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url and the main text of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                texts = [main_text(x, held.value) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(run, f"page_id {kind}, url string, text string")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
