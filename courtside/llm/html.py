"""Main text of web pages: boosted trees over DOM nodes and a decoding that agrees along each path.

A page becomes a tree of block elements (inline elements belong to their block). Every node gets features: text and link
density of its subtree, tokens of its class, id and role, depth, siblings, place in the page. Boosted trees give the log
odds that its subtree holds main text. A node can only be kept if its parent is: the best such choice maximises
the summed log odds, found in one pass from the leaves and one from the root.

The training pages are made from the text of a bounded sample of the given pages: their blocks are set in page skeletons of many kinds (menus,
notices, sidebars, forms, comments, related links), so it is known which nodes hold the article.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm import boosting
from courtside.llm.shared import with_struct

SAMPLE = 300           # pages whose text the training pages are made of
MADE = 1500            # training pages
MATERIAL = 200_000     # characters of a sampled page's blocks that give material

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template iframe noembed noframes textarea select option svg canvas audio video".split())
IN_HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes style script template".split())
LOOSE = frozenset("option svg canvas audio video".split())   # end where their block ends for the next one
LEAVES_SVG = frozenset(("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s "
                        "small span strong strike sub sup table tt u ul var").split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover "
                   "mmultiscripts mprescripts none mtable mtr mtd maction semantics annotation").split())
CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                      "header hgroup hr main menu nav ol p pre search section summary table ul").split())
KINDS = ("p", "li", "ul ol menu", "div", "article main", "section", "nav", "aside", "header", "footer", "form fieldset button input",
         "h1", "h2 h3 h4 h5 h6", "table tbody tr td th", "blockquote pre", "figure figcaption", "dl dt dd", "body html")
_KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split()}
# Usual words in class, id and role attributes.
TOKENS = tuple(("nav menu header footer sidebar aside ad ads advert banner cookie notice consent popup modal promo sponsor related "
                "recommended share social comment comments reply disqus form login signup subscribe newsletter breadcrumb pagination "
                "tags widget meta copyright toolbar search alert more links article content main post entry body story text page wrapper "
                "container hidden").split())
_TOKEN = {t: k for k, t in enumerate(TOKENS)}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)", re.S)
_TELLING = re.compile("class|id|role|hidden|style", re.I).search
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    number: int                    # among its parent's block children
    tokens: int = 0                # bit k: TOKENS[k] is in class, id or role
    hidden: bool = False
    text: list[tuple[int, str]] = field(default_factory=list)  # (order in the page, raw text)
    chars: int = 0
    link_chars: int = 0
    children: int = 0
    fields: int = 0                # inputs, buttons, images and the like
    last: int = -1                 # number of the last node of the subtree
    order: int = 0


def _tokens(attrs: str) -> tuple[int, bool]:
    bits, hidden = 0, False
    if not _TELLING(attrs):
        return bits, hidden
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name in ("class", "id", "role"):
            for token in _SPLIT(value):
                k = _TOKEN.get(token.lower())
                if k is not None:
                    bits |= 1 << k
    return bits, hidden


def parse(page: str) -> tuple[list[Node], int]:
    """The block elements of a page in page order (node 0 is the root), and how many pieces of text it has.

    Closing tags without an opening one are passed over; paragraphs, list items and table cells end where the next begins.
    A hidden element without an end ends with its block or where HTML ends it: an option at the next one, a select at an input,
    an svg at a paragraph and the like, a head at the first text or element of the body. Formulae are text of their block. Inline
    elements that an attribute hides are hidden, too. In a tag, a quote counts only right after an equals sign; one that is not
    closed is an ordinary character.
    """
    nodes = [Node("html", -1, 0, 0)]
    stack = [0]                    # open blocks
    hidden: list[str] = []         # an open hidden element and the open elements within it
    inline: dict[str, int] = {}    # open inline elements of the block
    opened: dict[str, int] = {}    # open blocks by name
    links = 0
    at = order = 0
    size = len(page)

    def text(raw: str) -> None:
        nonlocal order
        node = nodes[stack[-1]]
        order += 1
        node.text.append((order, raw))
        n = len(raw) if not raw.isspace() else 0
        node.chars += n
        if links:
            node.link_chars += n

    def close(to: int) -> None:
        while len(stack) > to:
            node = nodes[stack.pop()]
            node.last = len(nodes) - 1
            if stack:
                opened[node.tag] -= 1
            inline.clear()

    def leave(tag: str) -> None:
        while hidden.pop() != tag:
            pass

    def head() -> bool:
        return hidden[:1] == ["head"] and all(t == "noscript" for t in hidden[1:])

    def ends_top(tag: str) -> bool:
        top = nodes[stack[-1]].tag
        return (tag in CLOSES_P and top == "p" or tag == top == "li" or tag in ("dt", "dd") and top in ("dt", "dd")
                or tag in ("td", "th", "tr") and top in ("td", "th") or tag == top == "tr")

    while at < size:
        m = _MARKUP.search(page, at)
        begin = m.start() if m else size
        if begin > at:
            if hidden and head() and not page[at:begin].isspace():
                hidden.clear()
            if not hidden:
                text(page[at:begin])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if hidden:
                if tag in hidden:
                    leave(tag)
                    continue
                if not inline.get(tag) and not opened.get(tag):
                    continue
                hidden.clear()     # what is around it ends
            if inline.get(tag):
                inline[tag] -= 1
            if tag == "a":
                links = max(0, links - 1)
            elif opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        close(k)
                        links = 0
                        break
            continue
        attrs = m[3]
        if hidden:
            if head() and tag not in IN_HEAD:
                hidden.clear()
            elif tag in ("input", "textarea", "select") and "select" in hidden:
                leave("select")
                if tag == "select":
                    continue
            elif tag in ("option", "optgroup") and hidden[-1] == "option":
                hidden.pop()
            elif tag in LEAVES_SVG and "svg" in hidden and "foreignobject" not in hidden and "desc" not in hidden:
                leave("svg")
            elif len(hidden) == 1 and hidden[0] in LOOSE and ends_top(tag):
                hidden.clear()
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at) if tag not in _ENDS else _ENDS[tag].search(page, at)
            at = end.end() if end else size
            if not hidden:
                nodes[stack[-1]].fields += tag == "textarea"
            continue
        if hidden and tag == "body" and hidden[0] == "head":
            hidden.clear()
        if hidden or tag in HIDDEN or (tag in INLINE and tag not in VOID and _tokens(attrs)[1]):
            if tag not in VOID and not attrs.endswith("/"):
                hidden.append(tag)
            continue
        if tag == "object" and attrs.endswith("/"):
            continue
        if tag in INLINE or tag in VOID:
            if tag not in VOID and not attrs.endswith("/"):
                inline[tag] = inline.get(tag, 0) + 1
            if tag == "a":
                links += 1
            elif tag in ("br", "hr", "mtd", "annotation"):
                text(" ")
            elif tag in ("img", "input", "embed"):
                nodes[stack[-1]].fields += 1
            continue
        if tag == "button":
            nodes[stack[-1]].fields += 1
        top = nodes[stack[-1]].tag
        if tag in CLOSES_P and top == "p" or tag == top and tag in ("li", "option") or tag in ("dt", "dd") and top in ("dt", "dd"):
            close(len(stack) - 1)
        elif tag in ("td", "th", "tr") and top in ("td", "th"):
            close(len(stack) - 1)
            if tag == "tr" and nodes[stack[-1]].tag == "tr":
                close(len(stack) - 1)
        elif tag == "tr" and top == "tr":
            close(len(stack) - 1)
        if tag == "html":
            continue
        parent = stack[-1]
        bits, unseen = _tokens(attrs) if attrs and not attrs.isspace() else (0, False)
        nodes.append(Node(tag, parent, len(stack), nodes[parent].children, bits, unseen, order=order))
        nodes[parent].children += 1
        stack.append(len(nodes) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    close(0)
    return nodes, order


_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def features(pages: list[tuple[list[Node], int]]) -> np.ndarray:
    """One row per node of all pages, page after page."""
    sizes = np.array([len(nodes) for nodes, _ in pages])
    every = [x for nodes, _ in pages for x in nodes]
    n = len(every)
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)          # each node's root
    raw = np.array([(x.parent, x.last, x.chars, x.link_chars, x.fields, x.depth, x.number, x.children, x.order, x.hidden,
                     _KIND.get(x.tag, len(KINDS))) for x in every], np.int64).reshape(n, 11)
    parent, last = raw[:, 0], raw[:, 1] + base
    chars, link, fields, depth, number, children, order, hidden = raw[:, 2:10].T.astype(float)
    kind, at, root = raw[:, 10], np.arange(n), parent < 0
    up = np.where(root, at, parent + base)

    def below(v):  # sums over subtrees, which are runs of numbers
        total = np.r_[0.0, np.cumsum(v)]
        return total[last + 1] - total[at]

    sub_chars, sub_link, sub_fields = below(chars), below(link), below(fields)
    size = last - at + 1.0
    # siblings: nodes sorted by parent are in page order
    line = np.argsort(np.where(root, -1, up), kind="stable")
    pair = (up[line[1:]] == up[line[:-1]]) & ~root[line[1:]] & ~root[line[:-1]]
    before, after = np.full(n, -1), np.full(n, -1)
    before[line[1:][pair]], after[line[:-1][pair]] = line[:-1][pair], line[1:][pair]
    chars_before, chars_after = np.where(before >= 0, sub_chars[before], 0), np.where(after >= 0, sub_chars[after], 0)
    same = ((before >= 0) & (kind[before] == kind)).astype(float) + ((after >= 0) & (kind[after] == kind))
    longest = np.zeros(n)
    np.maximum.at(longest, up[~root], sub_chars[~root])
    own, own_kind = [x.tokens for x in every], [1 << k for k in kind.tolist()]
    above, within = [0] * n, [0] * n
    for k, p in enumerate(up.tolist()):
        if p != k:
            above[k], within[k] = above[p] | own[p], within[p] | own_kind[p]

    def bits(v, width):
        return (np.array(v, np.int64)[:, None] >> np.arange(width)) & 1

    total = np.maximum(1.0, sub_chars[base])
    pieces = np.repeat([max(1, p) for _, p in pages], sizes)
    plain = np.column_stack([
        np.log1p(chars), np.log1p(sub_chars), link / np.maximum(chars, 1), sub_link / np.maximum(sub_chars, 1),
        np.log1p(sub_chars / size), np.log1p(size), depth, number, children, number / np.maximum(1, children[up] - 1),
        sub_chars / total, sub_chars / np.maximum(1, sub_chars[up]), longest / np.maximum(1, sub_chars),
        np.log1p(chars_before), np.log1p(chars_after), same, np.log1p(sub_fields), order / pieces, hidden,
        sub_link[up] / np.maximum(1, sub_chars[up])])
    kinds, width = len(KINDS) + 1, len(TOKENS)
    return np.column_stack([plain, bits(own_kind, kinds), bits(within, kinds), bits(own, width), bits(above, width)]).astype(np.float32)


def decode(nodes: list[Node], odds: list[float]) -> list[bool]:
    """Which nodes are kept: the choice with the largest summed log odds in which no kept node has a dropped parent."""
    drop, keep = [-o for o in odds], list(odds)
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent
        drop[p] += drop[k]
        keep[p] += max(keep[k], drop[k])
    kept = [True] * len(nodes)
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and keep[k] > drop[k] and not nodes[k].hidden
    return kept


# Characters HTML counts as white space, and the no-break space that references stand for.
_SPACE = re.compile(r"\s+")


def text_of(nodes: list[Node], kept: list[bool]) -> str:
    """The text of the kept nodes in page order, references decoded, white space runs as one space."""
    blocks: list[tuple[int, str]] = []
    for node, k in zip(nodes, kept):
        if k and node.text:
            run: list[str] = []
            first = previous = None
            for order, raw in node.text:
                if previous is not None and order != previous + 1:  # other blocks lie between
                    blocks.append((first, "".join(run)))
                    run, first = [], None
                first = order if first is None else first
                run.append(raw)
                previous = order
            blocks.append((first, "".join(run)))
    blocks.sort()
    done = (_SPACE.sub(" ", entities.unescape(raw)).strip() for _, raw in blocks)
    return " ".join(b for b in done if b)


# ---- training pages --------------------------------------------------------------------------------------

def blocks_of(page: str) -> list[str]:
    """Texts of a page's paragraph-like blocks, as raw material."""
    nodes, _ = parse(page)
    out = []
    for node in nodes:
        raw = _SPACE.sub(" ", "".join(t for _, t in node.text)).strip()
        if raw and not node.link_chars:
            out.append(raw)
    return out


class Maker:
    """Pages with a known article, in skeletons drawn at random."""

    MARK = "data-article"          # the training pages' own mark of what holds main text

    def __init__(self, material: list[list[str]], seed: int = 7):
        self.rng = random.Random(seed)
        self.material = [m for m in material if m]
        self.words = [w for m in self.material for b in m for w in b.split()[:40]] or ["text"]

    def some(self, low: int, high: int) -> str:
        n, at = self.rng.randint(low, high), self.rng.randrange(len(self.words))
        return " ".join((self.words[at:at + n] or self.words[:n]))

    def attr(self, *names: str) -> str:
        name = self.rng.choice(names)
        return self.rng.choice((f' class="{name}"', f' id="{name}"', f' class="{name} x{self.rng.randrange(9)}"', f' class="site-{name}"', f" class={name}"))

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.some(1, 5)}</a></li>' for i in range(self.rng.randint(low, high))) + "</ul>"

    def junk(self, kind: str) -> str:
        rng, some = self.rng, self.some
        if kind == "nav":
            return rng.choice((f"<nav>{self.links(3, 9)}</nav>", f"<div{self.attr('nav', 'menu', 'navbar-menu')}>{self.links(3, 9)}</div>",
                               f"<ul{self.attr('menu', 'breadcrumb')}>" + "".join(f'<li><a href="#">{some(1, 2)}</a></li>' for _ in range(4)) + "</ul>"))
        if kind == "header":
            return rng.choice((f"<header><div>{some(1, 4)}</div>{self.links(2, 5)}</header>", f"<div{self.attr('header', 'banner')}><h1>{some(1, 3)}</h1><p>{some(2, 9)}</p></div>"))
        if kind == "footer":
            return rng.choice((f"<footer>&copy; {some(1, 4)} &middot; {some(3, 14)}</footer>", f"<footer><p>{some(4, 20)}</p>{self.links(2, 5)}</footer>",
                               f"<div{self.attr('footer', 'copyright')}>{some(4, 30)}</div>"))
        if kind == "sidebar":
            inner = rng.choice((self.links(3, 8), f"<h3>{some(1, 4)}</h3><p>{some(8, 60)}</p>", f"<div{self.attr('widget')}><h4>{some(1, 3)}</h4>{self.links(2, 6)}</div>"))
            return rng.choice((f"<aside>{inner}</aside>", f"<div{self.attr('sidebar', 'aside', 'related', 'recommended')}>{inner}</div>"))
        if kind == "ad":
            return f"<div{self.attr('ad', 'ads', 'advert', 'promo', 'sponsor', 'banner')}>{rng.choice((some(3, 16), f'<p>{some(5, 40)}</p>', f'<a href=x>{some(2, 9)}</a>'))}</div>"
        if kind == "notice":
            return f"<div{self.attr('cookie', 'notice', 'consent', 'popup', 'modal', 'alert')}><p>{some(8, 40)}</p>{rng.choice(('', '<button>ok</button>'))}</div>"
        if kind == "form":
            return f"<form{self.attr('search', 'login', 'signup', 'newsletter', 'subscribe')}><label>{some(1, 4)}</label><input name=a>{rng.choice(('', f'<p>{some(4, 20)}</p>'))}<button>{some(1, 2)}</button></form>"
        if kind == "share":
            return f"<div{self.attr('share', 'social', 'tags', 'meta', 'toolbar', 'pagination')}>{rng.choice((self.links(2, 5), some(2, 8)))}</div>"
        comments = "".join(f"<{t}{self.attr('comment', 'reply')}><p><b>{some(1, 2)}</b></p><p>{some(6, 70)}</p></{t}>" for t in ("div", "li", "article")[:1] * rng.randint(1, 5))
        return f"<{rng.choice(('div', 'section'))}{self.attr('comments', 'disqus', 'comment-list')}><h3>{some(1, 3)}</h3>{comments}</div>"

    def article(self) -> str:
        rng, m = self.rng, f" {self.MARK}"
        blocks = list(rng.choice(self.material))
        if rng.random() < 0.25:    # a short one
            blocks = [self.some(1, rng.choice((2, 9))) for _ in range(rng.randint(1, 2))]
        parts = [f"<{rng.choice(('h1', 'h1', 'h2'))}{m}>{self.some(3, 14)}</h1>"] if rng.random() < 0.9 else []
        parts[:] = [re.sub(r"</h1>$", "</" + p[1:3] + ">", p) for p in parts]
        for block in blocks:
            if rng.random() < 0.2 and len(block) > 60:
                block = block[:rng.randint(3, 50)]
            kind = rng.random()
            if kind < 0.75:
                parts.append(rng.choice((f"<p{m}>{block}</p>", f"<p{m}>{block}", f"<p{m}><b>{block}<br>", f"<p{m}>{block[:30]}<a href=y>{block[30:50]}</a>{block[50:]}</p>")))
            elif kind < 0.82:
                parts.append(f"<ul{m}><li{m}>{block}</li><li{m}>{self.some(2, 20)}</li></ul>")
            elif kind < 0.9:
                parts.append(f"<h2{m}>{self.some(2, 8)}</h2><div{m}>{block}</div>")
            elif kind < 0.95:
                parts.append(f"<blockquote{m}><p{m}>{block}</p></blockquote>")
            else:
                parts.append(f"<table{m}><tr{m}><td{m}>{block}</td><td{m}>{self.some(1, 5)}</td></tr></table>")
            if rng.random() < 0.1:
                parts.append(self.junk(rng.choice(("ad", "share", "notice", "form"))))
        body = "".join(parts)
        return rng.choice((f"<article{m}>{body}</article>", f"<article{m}>{body}</article>", f"<main{m}><article{m}>{body}</article></main>",
                           f"<main{m}>{body}</main>", f"<div{m}{self.attr('content', 'post', 'entry', 'story', 'article-body', 'main-text')}>{body}</div>",
                           f"<section{m}><div{m}>{body}</div></section>", f"<div{m}>{body}</div>"))

    def page(self) -> str:
        rng = self.rng
        kinds = ("nav", "header", "sidebar", "ad", "notice", "form", "share")
        lead = "".join(self.junk(rng.choice(kinds)) for _ in range(rng.randint(0, 4)))
        tail = "".join(self.junk(rng.choice((*kinds, "comments", "comments", "footer"))) for _ in range(rng.randint(0, 4)))
        main = self.article()
        if rng.random() < 0.3:
            main = f"<div {self.MARK}{self.attr('wrapper', 'container', 'page')}>{self.junk(rng.choice(kinds))}{main}{self.junk('sidebar')}</div>"
        foot = self.junk("footer") if rng.random() < 0.8 else ""
        if rng.random() < 0.06:
            main = ""
        return f"<html><head><title>x</title></head><body {self.MARK}>{lead}{main}{tail}{foot}</body></html>"

    def rows(self, pages: int) -> tuple[np.ndarray, np.ndarray]:
        xs, ys = [], []
        for _ in range(pages):
            page = self.page()
            nodes, pieces = parse(page)
            # the mark is read from the page again, in the order in which the parser meets blocks
            opened = [m for m in _MARKUP.finditer(page) if m[2] and not m[1] and (t := m[2].lower()) not in INLINE and t not in VOID
                      and t not in HIDDEN and t not in RAW and t != "html"]
            y = np.array([1.0] + [float(self.MARK in m[3]) for m in opened])
            xs.append(features([(nodes, pieces)])[1:])
            ys.append(y[1:])
        return np.concatenate(xs), np.concatenate(ys)


# ---- on Spark --------------------------------------------------------------------------------------------

def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE, made: int = MADE) -> boosting.Trees:
    """Trees trained on ``made`` pages set from the text of at most ``sample`` of the given ones (first by a hash of the page).

    Copies of a page count once and pages without any text but white space not at all. The bound keeps training in one task; of a longer
    page some blocks of ``MATERIAL`` characters together are material. Without pages the skeletons are set with placeholder words.
    """
    told = pages.select(F.col(html).cast("string").alias("html")).where(F.col("html").rlike(r"\S")).withColumn("hash", F.xxhash64("html"))
    first = [r.hash for r in told.select("hash").distinct().orderBy("hash").limit(sample).collect()]
    chosen = told.where(F.col("hash").isin(first)).dropDuplicates(["hash"]).select("html")

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle
        material = [_some(blocks_of(page)) for batch in batches for page in sorted(batch["html"])]
        yield pd.DataFrame({"model": [pickle.dumps(_train(material, made))]})

    import pickle
    got = chosen.repartition(1).mapInPandas(train, "model binary").collect()
    return pickle.loads(got[0].model) if got else _train([], made)


def _some(blocks: list[str]) -> list[str]:
    """The blocks, or if they are long some from all over the page, in page order."""
    if sum(map(len, blocks)) <= MATERIAL:
        return blocks
    kept, room = [], MATERIAL
    for i in random.Random(len(blocks)).sample(range(len(blocks)), len(blocks)):
        if len(blocks[i]) <= room:
            kept.append(i)
            room -= len(blocks[i])
    return [blocks[i] for i in sorted(kept)]


def _train(material: list[list[str]], made: int) -> boosting.Trees:
    maker = Maker(material or [["some words of text"]])
    if not maker.material:
        maker.material = [["some words of text"]]
    return boosting.fit(*maker.rows(made))


def extract(pages: list[str | None], model: boosting.Trees) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p or "") for p in pages]
    odds = model.log_odds(features(parsed))
    parts = np.split(odds, np.cumsum([len(nodes) for nodes, _ in parsed])[:-1])
    return [text_of(nodes, decode(nodes, o.tolist())) for (nodes, _), o in zip(parsed, parts)]


def with_main_text(df: DataFrame, model: boosting.Trees, name: str = "main_text", html: str = "html") -> DataFrame:
    """Add the page's main text. A null or empty page, and one that is all boilerplate, gives the empty string."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in batches:
            out: list[str] = []
            for at in range(0, len(column), 200):
                out += extract(column.slice(at, 200).to_pylist(), model)
            yield pa.array(out, pa.string())

    return with_struct(df, name, work, "string", F.col(html))
