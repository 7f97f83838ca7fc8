"""The main text of web pages by a tree-structured graphical model.

The block elements of a page and its runs of text are the nodes of a tree, each content or not. A node's own evidence (tag, words
of its class, id and role, shape of its text) and parent-child potentials by the child's tag make a distribution over all
labellings; sum-product messages, one pass up and one down, give each node's marginal. Weights are trained by the exact gradient
of the likelihood on labelled pages.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm.common import in_batches, table

# Element names of HTML by their kind.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
NEVER_TEXT = set("audio button canvas datalist head iframe map math noscript object script select style svg template textarea title video".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INSIDE_TABLES = set("caption tbody tfoot thead tr".split())
#: What a new element ends if it is still open, and where the search for it stops.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), **{t: ({"thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")}}
_P_SCOPE = {"caption", "html", "table", "object", "template", "button"}
#: A tag that the page's end cuts.
_CUT_TAG = re.compile(r"<[A-Za-z/!][^<>]*\Z")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


@dataclass
class Page:
    """Nodes in page order, parents first; a text node has its text, an element none. `given`: labels found in the page, of elements."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    given: list[str | None] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: list[str], text: str | None = None, links: int = 0, given: str | None = None) -> int:
        for held, value in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.text, text), (self.links, links), (self.given, given)):
            held.append(value)
        return len(self.parent) - 1


class _Builder(HTMLParser):
    def __init__(self, label: str | None):
        super().__init__(convert_charrefs=True)
        self.page, self.label = Page(), label
        self.open: list[tuple[str, int]] = [("", self.page.add(-1, "", []))]  # tag, node of it or of what holds it
        self.count: Counter = Counter()
        self.silent = self.links = 0
        self.link_at: int | None = None
        self.held: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.page.add(self.open[-1][1], "#text", [], text, self.links)
        self.held, self.links = [], 0

    def pop(self) -> str:
        tag, _ = self.open.pop()
        self.count[tag] -= 1
        self.silent -= tag in NEVER_TEXT
        if self.link_at is not None and len(self.open) < self.link_at:
            self.link_at = None
        return tag

    def end_open(self, ends: set[str], stops: set[str]) -> None:
        """Ends the innermost of `ends`, with all inside it, unless one of `stops` is nearer."""
        if any(self.count[t] for t in ends):
            at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] in ends or self.open[i][0] in stops), 0)
            if self.open[at][0] in ends:
                while len(self.open) > at:
                    self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.link_at = len(self.open)
        elif tag in ("br", "td", "th"):
            self.held.append(" ")
        if tag not in BLOCKS and tag not in NEVER_TEXT:
            return
        if tag in BLOCKS:
            self.flush()
            if tag != "html":
                self.end_open({"head"}, set())
            if tag not in _INSIDE_TABLES:
                self.end_open({"p"}, _P_SCOPE)
            if tag in _ENDS:
                self.end_open(*_ENDS[tag])
        if tag in _VOID:
            return
        node = self.open[-1][1]
        if tag in BLOCKS and not self.silent:
            at = dict(attrs)
            names = [n.lower() for k in ("class", "id", "role") for n in _NAME.findall(at.get(k) or "")]
            node = self.page.add(node, tag, names, given=at.get(self.label) if self.label else None)
        self.open.append((tag, node))
        self.count[tag] += 1
        self.silent += tag in NEVER_TEXT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link_at = None
        if tag in BLOCKS:
            self.flush()
        if self.count[tag]:
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)
            if self.link_at is not None:
                self.links += len(data)


def parse(html: str | None, label: str | None = None) -> Page:
    """The tree of a page, whatever its mistakes. `label` names an attribute with an element's label; it's no evidence."""
    builder = _Builder(label)
    builder.feed(_CUT_TAG.sub("", html or ""))
    builder.close()
    builder.flush()
    return builder.page


def evidence(page: Page, i: int) -> list[str]:
    text = page.text[i]
    if text is None:
        return [f"tag {page.tag[i]}", *(f"name {n}" for n in set(page.names[i]))]
    size, share = min(10, len(text).bit_length()), round(4 * min(1.0, page.links[i] / len(text)))
    marks = min(3, sum(text.count(m) for m in ".!?。"))
    return ["text", f"in {page.tag[page.parent[i]]}", f"size {size}", f"links {share}", f"marks {marks}", f"size links {size} {share > 1}", f"sign {text[0] in '©®™'}"]


@dataclass
class Forest:
    """Pages side by side: evidence as (node, feature) pairs, nodes level by level."""

    parent: np.ndarray
    kind: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    levels: list[np.ndarray]


def forest(pages: list[Page], features: dict[str, int], kinds: dict[str, int], grow: bool = False) -> Forest:
    """`grow`: new features and kinds get numbers; else they are left out, or count as kind 0."""
    parent, kind, node, feature, depth = [], [], [], [], []
    for page in pages:
        first = len(parent)
        for i, p in enumerate(page.parent):
            parent.append(-1 if p < 0 else first + p)
            depth.append(0 if p < 0 else depth[first + p] + 1)
            kind.append(kinds.setdefault(page.tag[i], len(kinds)) if grow else kinds.get(page.tag[i], 0))
            for f in evidence(page, i):
                number = features.setdefault(f, len(features)) if grow else features.get(f)
                if number is not None:
                    node.append(first + i)
                    feature.append(number)
    depth = np.array(depth, np.int64)
    order = np.argsort(depth, kind="stable")
    return Forest(np.array(parent, np.int64), np.array(kind, np.int64), np.array(node, np.int64), np.array(feature, np.int64), np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else [])


def beliefs(trees: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Each node's probability of being content; each non-root's 2 x 2 probabilities of (parent's, own) label; the sum of the log partition functions.

    weights: by feature, for content against not; edges: by kind of the child, parent's label and its own.
    """
    n = len(trees.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(trees.node, weights[trees.feature], minlength=n)
    up = np.zeros((n, 2))
    for at in reversed(trees.levels[1:]):
        up[at] = np.logaddexp.reduce(edges[trees.kind[at]] + own[at][:, None, :], axis=2)
        np.add.at(own, trees.parent[at], up[at])
    whole = own.copy()  # with what comes from above
    pairs = np.zeros((n, 2, 2))
    for at in trees.levels[1:]:
        above = whole[trees.parent[at]] - up[at]
        pairs[at] = edges[trees.kind[at]] + above[:, :, None]
        whole[at] += np.logaddexp.reduce(pairs[at], axis=1)
        pairs[at] += own[at][:, None, :]
        pairs[at] -= np.logaddexp.reduce(pairs[at].reshape(-1, 4), axis=1)[:, None, None]
    logs = np.logaddexp.reduce(whole[trees.levels[0]], axis=1).sum() if n else 0.0
    return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -700, 700))), np.exp(pairs), float(logs)


def gradient(trees: Forest, labels: np.ndarray, weights: np.ndarray, edges: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood of the labels and its gradient: what is seen less what is expected."""
    content, pairs, logs = beliefs(trees, weights, edges)
    inner = np.flatnonzero(trees.parent >= 0)
    above, below = labels[trees.parent[inner]], labels[inner]
    score = (weights[trees.feature] * labels[trees.node]).sum() + edges[trees.kind[inner], above, below].sum()
    d_edges = np.zeros_like(edges)
    np.add.at(d_edges, (trees.kind[inner], above, below), 1.0)
    np.subtract.at(d_edges, trees.kind[inner], pairs[inner])
    return float(score - logs), np.bincount(trees.feature, (labels - content)[trees.node], minlength=len(weights)), d_edges


@dataclass
class Model:
    features: dict[str, int]
    kinds: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Of each page, every node's probability of being content."""
        found = beliefs(forest(pages, self.features, self.kinds), self.weights, self.edges)[0]
        return np.split(found, np.cumsum([len(p.parent) for p in pages])[:-1])

    def texts(self, pages: list[Page]) -> list[str]:
        return ["\n".join(t for t, m in zip(p.text, ms, strict=True) if t is not None and m >= 0.5) for p, ms in zip(pages, self.marginals(pages), strict=True)]


def labels_of(page: Page) -> list[int]:
    """An element's given label holds for all inside it until another one is given; above all: not content."""
    out: list[int] = []
    for p, g in zip(page.parent, page.given, strict=True):
        out.append(int(g) if g is not None else out[p] if p >= 0 else 0)
    return out


def train(pages: list[Page], labels: list[list[int]], steps: int = 200, rate: float = 0.1, decay: float = 0.02) -> Model:
    """Adam on the exact gradient, with a quadratic penalty, over all pages in every step."""
    features: dict[str, int] = {}
    kinds = {"?": 0}
    trees, y = forest(pages, features, kinds, grow=True), np.array([v for ls in labels for v in ls], np.int64)
    weights, edges = np.zeros(len(features)), np.zeros((len(kinds), 2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, edges)]
    for step in range(1, steps + 1):
        found = gradient(trees, y, weights, edges)[1:]
        for p, g, m in zip((weights, edges), found, moments, strict=True):
            g = g - decay * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    # An unseen tag behaves like the mean of the seen ones.
    edges[0] = edges[1:].mean(axis=0) if len(edges) > 1 else 0
    return Model(features, kinds, weights, edges)


_LABEL = "data-content"
_CONTENT = ["content", "main-content", "post", "post-body", "entry", "entry-content", "article", "article-body", "articleBody", "story", "story-body", "text", "page-content", "body-text", "blog-post", "main"]
_ASIDES = {
    "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "topnav", "tabs", "toc", "skip-links"],
    "header": ["header", "site-header", "masthead", "top-bar", "page-header", "branding", "logo"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon", "page-footer"],
    "aside": ["sidebar", "side", "widget", "related", "related-posts", "recommended", "more-stories", "trending", "popular", "tags", "author-box", "rail"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "banner", "sponsor", "sponsored", "promo", "promotion", "teaser"],
    "notice": ["notice", "cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "announcement", "paywall", "disclaimer"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "search-form", "contact-form", "share", "social", "sharing"],
    "comments": ["comments", "comment-list", "comment", "discussion", "replies", "reply", "responses", "disqus", "reader-comments", "user-comments", "respond"],
}
_TAGS = {"nav": "nav div ul", "header": "header div", "footer": "footer div", "aside": "aside div section", "ad": "div aside section p", "notice": "div dialog section p aside", "form": "form div", "comments": "section div ol ul"}
_ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "notice": "dialog", "form": "search"}


class _Dresser:
    """Labelled pages: texts in page layouts of many kinds. Noise and content draw from the same texts, so that only the structure tells them apart."""

    def __init__(self, texts: list[str], seed: int):
        self.r, self.texts = random.Random(seed), [t.split() for t in texts if t.split()] or [["some", "plain", "words", "of", "a", "page."]]

    def words(self, least: int, most: int) -> str:
        held, n = [], self.r.randint(least, most)
        while len(held) < n:
            source = self.r.choice(self.texts)
            at = self.r.randrange(len(source))
            held += source[at : at + n - len(held)]
        return escape(" ".join(held)) + self.r.choice([".", ".", ".", "!", "", "?"])

    def el(self, tag: str, inside: str, names: list[str] | None = None, label: int | None = None, role: str | None = None, named: float = 0.85) -> str:
        noise = ["row", "col", "wrap", "inner", "box", "clearfix", "container", "block", "js-item"]
        cls = ([self.r.choice(names)] if names and self.r.random() < named else []) + ([self.r.choice(noise)] if self.r.random() < 0.3 else [])
        at = f' {self.r.choice(["class", "class", "id"])}="{" ".join(cls)}"' if cls else ""
        at += f' role="{role}"' if role and self.r.random() < 0.2 else ""
        at += f' {_LABEL}="{label}"' if label is not None else ""
        return f"<{tag}{at}>{inside}</{tag}>"

    def link(self, least: int = 1, most: int = 4) -> str:
        return f'<a href="/x">{self.words(least, most)}</a>'

    def items(self, most: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, most))) + "</ul>"

    def noise(self, what: str) -> str:
        r = self.r
        tag = r.choice(_TAGS[what].split())
        if what == "nav":
            inside = self.items(9) if tag != "ul" else self.items(9)[4:-5]
        elif what == "comments":
            one = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "p"])
            inside = "".join(self.el(one, (f"<p>{self.words(4, 50)}</p>" if one != "p" else self.words(4, 50)), ["comment", "reply", "comment-body"]) for _ in range(r.randint(1, 5)))
            inside = (f"<h3>{self.words(1, 3)}</h3>" if one != "li" and r.random() < 0.5 else "") + inside
        elif what == "form":
            inside = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + (f"<p>{self.words(3, 12)}</p>" if r.random() < 0.5 else "")
        elif tag == "p":
            inside = self.words(3, 40)
        else:
            kinds = [lambda: self.words(3, 25), lambda: f"<p>{self.words(3, 50)}</p>", lambda: f"<h3>{self.words(1, 5)}</h3>{self.items(6)}", lambda: f"<p>{self.words(2, 9)} {self.link(2, 8)}</p>", lambda: f"<h4>{self.words(1, 4)}</h4><p>{self.words(5, 60)}</p>"]
            inside = r.choice(kinds)() if what != "footer" or r.random() < 0.6 else f"&copy; {self.words(2, 12)}"
        named = what in _TAGS and tag in ("nav", "header", "footer", "aside", "form", "dialog")
        out = self.el(tag, inside, _ASIDES[what] if not named or r.random() < 0.6 else None, 0, _ROLES.get(what))
        return out if named or re.match(r"<\w+ (class|id)=", out) or what == "nav" else self.noise(what)

    def body(self) -> str:
        r, parts = self.r, []
        title = f"<h1>{self.words(2, 12)}</h1>"
        parts.append(f"<header>{title}</header>" if r.random() < 0.2 else title if r.random() < 0.8 else f"<h2>{self.words(2, 9)}</h2>")
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.6:
                parts.append(f"<p>{'<b>' if r.random() < 0.2 else ''}{self.words(1 if r.random() < 0.15 else 5, 90)}" + r.choice(["</p>", "</p>", "</p>", "", "<br>"]))
            elif x < 0.67:
                parts.append(f"<p>{self.words(5, 30)} {self.link()} {self.words(5, 30)}</p>")
            elif x < 0.73:
                parts.append(f"<{(h := r.choice(['h2', 'h3']))}>{self.words(1, 8)}</{h}>")
            elif x < 0.79:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 20)}" + r.choice(["</li>", ""]) for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.83:
                parts.append(f"<blockquote><p>{self.words(5, 40)}</p></blockquote>")
            elif x < 0.87:
                parts.append(f"<figure><img src=x><figcaption>{self.words(2, 14)}</figcaption></figure>")
            elif x < 0.9:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.93:
                parts.append(f"<pre>{self.words(3, 30)}</pre>")
            else:
                parts.append(f"<div>{self.words(8, 80)}<br><br>{self.words(8, 80)}</div>")
        for what in ("ad", "aside", "form", "notice", "comments", "nav", "footer"):
            if r.random() < 0.12:
                parts.insert(r.randint(1, len(parts)) if what != "comments" else len(parts), self.noise(what))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        main = self.el(tag, self.body(), _CONTENT, 1, "main", 0.5 if tag in ("article", "main") else 0.85)
        before = [self.noise(w) for w in ("notice", "header", "nav", "ad", "nav", "form", "aside") if r.random() < 0.4]
        after = [self.noise(w) for w in ("comments", "aside", "ad", "aside", "form", "nav", "footer", "notice") if r.random() < 0.4]
        near = [self.noise(w) for w in ("nav", "ad", "comments", "aside") if r.random() < 0.2]
        wrapped = main if r.random() < 0.4 else self.el(r.choice(["div", "main", "section"]), "".join([main, *near]), ["page", "site", "layout", "wrapper", "container", "main"])
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body>{''.join(before)}{wrapped}{''.join(after)}</body></html>"


def fit(pages: DataFrame, sample: int = 300, dressed: int = 600, seed: int = 12) -> Model:
    """The model from labelled pages: `sample` pages of the table at most (those with the least hash of page_id and html), of which each
    with exactly one `article` that isn't inside another counts as labelled by it, and `dressed` pages that lay texts of the sample
    out in known layouts with menus, adverts, notices, forms, sidebars and comments. Both bounds are parameters; extraction covers every row."""
    drawn = pages.where(F.col("html").isNotNull()).select("html", F.xxhash64("page_id", "html").alias("_h")).orderBy("_h", "html").limit(sample).collect()
    trees, labels, texts = [], [], []
    for r in drawn:
        page = parse(r["html"])
        texts += [t for t in page.text if t is not None]
        if page.tag.count("article") == 1:
            inside: list[int] = []
            for tag, p in zip(page.tag, page.parent, strict=True):
                inside.append(int(tag == "article" or (p >= 0 and inside[p] == 1 and tag not in ("nav", "aside", "footer", "form"))))
            trees.append(page)
            labels.append(inside)
    made = _Dresser(texts, seed)
    for _ in range(dressed):
        trees.append(parse(made.page(), _LABEL))
        labels.append(labels_of(trees[-1]))
    return train(trees, labels)


def extract(pages: DataFrame, model: Model, slice_bytes: int = 4 << 20) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html), repeated rows and null ids too.

    The whole html is read; null or empty: an empty text. Character references are decoded, white space inside a block (cells
    of a table row are one block) is one space, blocks are joined in page order by a line feed. A page whose blocks are all
    improbable has an empty text. Other columns are not read; an empty table gives no rows. A worker holds the trees of about
    `slice_bytes` of html, or of one longer page.
    """

    def start():
        def run(b: pa.RecordBatch) -> dict:
            out, held, size = [], [], 0
            for h in b.column("html"):
                html = h.as_py() or ""
                held.append(parse(html))
                size += len(html)
                if size > slice_bytes:
                    out += model.texts(held)
                    held, size = [], 0
            out += model.texts(held) if held else []
            return {"text": out, "n_chars": [len(t) for t in out]}

        return run

    return in_batches(pages.select("page_id", "url", "html"), start, ("page_id", "url"), "text string, n_chars long")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all `pages`: see fit() and extract()."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
