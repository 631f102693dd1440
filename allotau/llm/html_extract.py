"""Main-text extraction: gradient-boosted trees over DOM nodes, and hierarchical decoding.

A page becomes a tree of block elements whose leaves are runs of text. Each node has
features: text, link and punctuation density of its subtree, tags for each character,
depth, place, sibling statistics, its tag, and whether its or its ancestors' attribute
tokens speak of content or of page furniture. Boosted trees give each node the log-odds
that it is article. Decoding picks the labelling of largest total log-odds in which
nothing below a dropped node is kept, so that ancestors and descendants never contradict
each other; the kept runs are the text.

The trees are fitted on two bounded sets: pages of the table that mark their article
(article or main), with what lies outside, or inside of it in furniture, as negatives;
and pages laid out at random by `skeleton`, which has layouts that a table may lack.

Pages are read in one pass whose time is in proportion to their length, whatever is broken
in them: open tags are counted and their places kept, so no tag looks through the open ones.

Defined results: a null or empty html, or one without text, gives an empty text; text without
any element is the article; broken
markup is read as browsers do in the main cases (unclosed and stray tags, a head without an
end); a quote counts after '=' only; if no '>' outside of quotes follows a tag, it and all later
ones end at their first '>'; what follows the last '>' is text; very long pages are read whole; repeated rows each give a row; extra
columns are ignored; an empty table gives an empty result. A null page_id or url stays
null, and ids of any size come out as they are.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from array import array
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.llm import _base as B

#: Pages of the table, and laid-out pages, that the trees are fitted on, at most.
FIT_PAGES, SKELETONS = 600, 500
#: Longest page that a fitting sample takes: the driver holds FIT_PAGES times that at most.
FIT_CHARS = 32_768
#: Characters of the pages that are read at once, unless one page has more; nodes that the trees see at once.
BATCH_CHARS, BATCH_NODES = 1 << 21, 1 << 16
TREES, DEPTH, RATE, BINS = 40, 4, 0.25, 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()) | {"br", "img", "wbr"}
#: Never shown.
SILENT = frozenset("script style noscript template head title iframe object svg math audio video canvas map".split())
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "iframe"))
#: A start tag of the key closes an open element of these, as far as the nearest of the stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
IN_HEAD = frozenset("base link meta title style script noscript template".split())
STOPS = frozenset("ul ol dl table select body html article section div td th".split())
TAGS = ("p", "h1", "h2", "h3", "li", "ul", "ol", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "body", "#run")
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
#: Attribute tokens; fixed values.
FURNITURE = frozenset("ad ads advert advertisement adbox banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer disqus feedback footer form header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related replies reply reviews search share sharing sidebar signup site skip social sponsor sponsored subscribe tags toolbar topbar widget".split())
CONTENT = frozenset("article articlebody body content entry main post story text".split())
NEGATIVE_TAGS = frozenset("nav footer aside form header menu dialog button select textarea fieldset".split())

#: A tag whose values may be in quotes, and one up to its first '>'; neither looks back.
QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)>""")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def tokens_of(attributes: str) -> tuple[int, int]:
    """Do the attribute tokens speak of furniture, of content?"""
    if "=" not in attributes:
        return 0, 0
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        words.update(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1]).lower().replace("-", " ").replace("_", " ").strip("\"'").split())
    return int(bool(words & FURNITURE)), int(bool(words & CONTENT))


@dataclass
class Page:
    """Nodes in document order; node i has its subtree in i to end[i]."""

    tag: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    parent: array = field(default_factory=lambda: array("q"))
    end: array = field(default_factory=lambda: array("q"))
    furniture: array = field(default_factory=lambda: array("b"))
    content: array = field(default_factory=lambda: array("b"))
    linked: array = field(default_factory=lambda: array("q"))
    inner: array = field(default_factory=lambda: array("q"))  # inline tags of a run

    def add(self, tag: str, parent: int, marks: tuple[int, int], text: str = "", linked: int = 0, inner: int = 0) -> int:
        self.tag.append(tag)
        self.text.append(text)
        self.parent.append(parent)
        self.end.append(len(self.tag))
        self.furniture.append(marks[0])
        self.content.append(marks[1])
        self.linked.append(linked)
        self.inner.append(inner)
        return len(self.tag) - 1


class Open:
    """The open elements: blocks, the inline elements open in each, and where each tag's blocks stand."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int]] = [("body", 0)]
        self.inline: list[list[str]] = [[]]
        self.counts: list[dict[str, int]] = [{}]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.stops = [0]
        self.links = self.silent = 0

    def start(self, tag: str, node: int) -> None:
        place = len(self.blocks)
        self.at[tag].append(place)
        if tag in STOPS:
            self.stops.append(place)
        self.silent += tag in SILENT
        self.blocks.append((tag, node))
        self.inline.append([])
        self.counts.append({})

    def last(self, tag: str) -> int:
        """Place of the innermost open block of this tag; -1 if none."""
        places = self.at.get(tag)
        return places[-1] if places else -1

    def start_inline(self, tag: str) -> None:
        self.inline[-1].append(tag)
        self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        self.links += tag == "a"

    def end_inline(self, tag: str) -> None:
        """Ends the innermost such element of the innermost block, and those within it."""
        counts = self.counts[-1]
        while counts.get(tag):
            t = self.inline[-1].pop()
            counts[t] -= 1
            self.links -= t == "a"
            if t == tag:
                return

    def end(self) -> tuple[str, int]:
        """Ends the innermost block."""
        tag, node = self.blocks.pop()
        self.at[tag].pop()
        if tag in STOPS:
            self.stops.pop()
        self.silent -= tag in SILENT
        self.links -= self.counts.pop().get("a", 0)
        self.inline.pop()
        return tag, node


def parse(html: str | None) -> Page:
    page, open_ = Page(), Open()
    page.add("body", -1, (0, 0))
    parts: list[str] = []
    linked = inner = 0
    html = html or ""
    at, n, last = 0, len(html), html.rfind(">") if html else -1
    tag_at = QUOTED

    def flush() -> None:
        nonlocal parts, linked, inner
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.add("#run", open_.blocks[-1][1], (0, 0), text, min(linked, len(text)), inner)
        parts, linked, inner = [], 0, 0

    def close(place: int) -> None:
        flush()
        while len(open_.blocks) > place:
            page.end[open_.end()[1]] = len(page.tag)

    def say(text: str) -> None:
        nonlocal linked
        if text and not open_.silent:
            parts.append(html_lib.unescape(text) if "&" in text else text)
            if open_.links:
                linked += len(parts[-1].strip())

    said = 0  # text up to here is said
    while at <= last:
        start = html.find("<", at)
        if start < 0 or start >= last:
            break
        after = html[start + 1]
        if after in "!?":
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                end = n if end < 0 else end + 3
            else:
                end = html.find(">", start) + 1
            say(html[said:start])
            at = said = end
            continue
        m = tag_at.match(html, start)
        if m is None and tag_at is QUOTED and PLAIN.match(html, start):
            tag_at = PLAIN  # no '>' outside of quotes
            m = tag_at.match(html, start)
        if m is None:
            at = start + 1
            continue
        say(html[said:start])
        at = said = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
            elif tag in INLINE:
                open_.end_inline(tag)
            elif (place := open_.last(tag)) > 0:
                close(place)
            elif tag == "p":
                flush()
            continue
        if tag in ("html", "body"):
            page.content[0] |= tokens_of(m[3])[1]
            if tag == "body":  # whatever head left open ends here
                close(1)
            continue
        if open_.blocks[-1][0] == "head" and tag not in IN_HEAD:
            close(len(open_.blocks) - 1)
        if tag == "hr":
            flush()
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:
            over = RAW_ENDS[tag].search(html, at)
            end = html.find(">", over.end()) if over else -1
            at = said = n if end < 0 else end + 1
            if tag not in SILENT:
                flush()
            continue
        if tag in INLINE:
            inner += 1
            open_.start_inline(tag)
            continue
        while True:  # implied ends
            place = max(open_.last(t) for t in ("p", *CLOSES.get(tag, ())))
            if place < max(1, open_.stops[-1] if tag in CLOSES else len(open_.blocks) - 1):
                break
            ended = open_.blocks[place][0]
            close(place)
            if ended != "p" and tag not in ("tr", "tbody", "tfoot"):
                break
        flush()
        open_.start(tag, page.add(tag, open_.blocks[-1][1], tokens_of(m[3])))
        if m[3].endswith("/") and tag in SILENT:
            close(len(open_.blocks) - 1)
    say(html[said:])
    close(1)
    flush()
    page.end[0] = len(page.tag)
    return page


def features(pages: list[Page]) -> list[np.ndarray]:
    """Columns; an entry for each node of each page in turn."""
    sizes = np.array([len(p.tag) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = int(sizes.sum())

    def joined(name: str) -> np.ndarray:
        return np.concatenate([np.asarray(getattr(p, name), np.int64) for p in pages])

    parent, end = joined("parent"), joined("end") + first
    root = parent < 0
    parent = np.where(root, first, parent + first)
    tag = np.fromiter((TAG_NUMBER.get(t, -1) for p in pages for t in p.tag), np.int64, total)
    chars = np.fromiter((len(t) for p in pages for t in p.text), np.int64, total)
    words = np.fromiter((t.count(" ") + 1 if t else 0 for p in pages for t in p.text), np.int64, total)
    points = np.fromiter((t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for p in pages for t in p.text), np.int64, total)
    shut_tag = np.fromiter((t in NEGATIVE_TAGS for p in pages for t in p.tag), np.int64, total)
    furniture, content, linked, inner = joined("furniture"), joined("content"), joined("linked"), joined("inner")
    place = np.arange(total)

    def below(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return c[end] - c[place]

    in_furniture, in_content, in_shut = furniture.copy(), content.copy(), shut_tag.copy()
    in_article = ((tag == TAG_NUMBER["article"]) | (tag == TAG_NUMBER["main"])).astype(np.int64)
    for x in (in_furniture, in_content, in_shut, in_article):  # marks of ancestors reach down: sums of range marks
        edges = np.bincount(place, x, total + 1) - np.bincount(end, x, total + 1)
        x[:] = np.cumsum(edges)[:total] > 0
    depth = np.cumsum(np.bincount(place, minlength=total + 1) - np.bincount(end, minlength=total + 1))[:total] - 1
    runs = (chars > 0).astype(np.int64)
    b_chars, b_words, b_points, b_links, b_runs = below(chars), below(words), below(points), below(linked), below(runs)
    b_tags = end - place + below(inner)
    page_chars = np.maximum(1, b_chars[first])
    so_far = np.cumsum(chars) - chars
    so_far = so_far - so_far[first]
    kids = np.bincount(parent[~root], minlength=total)
    peers = np.maximum(1, kids[parent])
    peer_chars = b_chars[parent] / peers
    alike, of, times = np.unique(np.where(root, -1 - place, parent * 32 + tag + 1), return_inverse=True, return_counts=True)  # children of one parent with one tag
    same = times[of.ravel()] - root
    del alike, of, times
    columns = [
        np.log1p(b_chars), np.log1p(b_words), b_links / np.maximum(1, b_chars), b_chars / np.maximum(1, b_tags), b_points / np.maximum(1, b_words),
        b_chars / np.maximum(1, b_runs), b_chars / page_chars, so_far / page_chars, depth, peers, np.log1p(peer_chars), same,
        b_links[parent] / np.maximum(1, b_chars[parent]), b_points[parent] / np.maximum(1, b_words[parent]), inner,
        furniture, content, furniture[parent], content[parent], in_furniture, in_content, in_shut, in_article, shut_tag, shut_tag[parent], tag, tag[parent],
    ]
    columns = [np.asarray(c, np.float32) for c in columns]
    columns += [(tag == TAG_NUMBER[t]) | (tag[parent] == TAG_NUMBER[t]) for t in ("p", "h1", "li", "nav", "header", "footer", "aside", "form", "div", "section")]
    return columns


def rows_of(columns: list[np.ndarray], a: int = 0, b: int | None = None) -> np.ndarray:
    return np.column_stack([np.asarray(c[a:b], np.float32) for c in columns])


@dataclass
class Boosted:
    start: float
    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by inner node: feature, cut; by leaf: value

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Boosted:
    """Logistic gradient boosting with complete trees of DEPTH over histograms."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(q, c) for q, c in zip(cuts, x.T, strict=True)])
    share = np.clip((weight * y).sum() / max(1e-9, weight.sum()), 0.01, 0.99)
    model = Boosted(float(np.log(share / (1 - share))), cuts, [])
    score, n_features = np.full(len(y), model.start), x.shape[1]
    flat = binned + np.arange(n_features) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            nodes = 2**level
            cell = ((at - nodes + 1)[:, None] * (n_features * BINS) + flat).ravel()
            hist = [np.bincount(cell, np.repeat(v, n_features), nodes * n_features * BINS).reshape(nodes, n_features, BINS).cumsum(axis=2) for v in (g, h)]
            all_g, all_h = hist[0][:, :1, -1:], hist[1][:, :1, -1:]
            gain = hist[0] ** 2 / (hist[1] + 1) + (all_g - hist[0]) ** 2 / (all_h - hist[1] + 1)
            for k, best in enumerate(gain.reshape(nodes, -1).argmax(axis=1)):
                f, b = divmod(int(best), BINS)
                i = nodes - 1 + k
                feature[i] = f
                cut[i] = cuts[f][b] if b < len(cuts[f]) else np.inf
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        score += value[leaf]
        model.trees.append((feature, cut, value))
    return model


def decode(page: Page, odds: np.ndarray) -> list[int]:
    """The runs kept by the labelling of largest total log-odds in which nothing below a dropped node is kept. The body is kept; of a page without any other element, all."""
    n = len(page.tag)
    if all(t == "#run" for t in page.tag[1:]):
        return [i for i in range(n) if page.text[i]]
    keep, drop = odds.tolist(), [0.0] * n
    for i in range(n - 1, 0, -1):
        keep[page.parent[i]] += max(keep[i], 0.0)
    kept = [True] + [False] * (n - 1)
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
    return [i for i in range(n) if kept[i] and page.text[i]]


def node_labels(page: Page) -> np.ndarray:
    """1 or 0 for each node of a page that marks its article, by what most text of its subtree is; -1 if it has no text, or the page no mark."""
    n = len(page.tag)
    inside, shut = [False] * n, [False] * n
    for i in range(n):
        p = page.parent[i]
        marked = page.tag[i] in ("article", "main")
        inside[i] = marked or (p >= 0 and inside[p])
        shut[i] = (page.tag[i] in NEGATIVE_TAGS and not (page.tag[i] == "header" and inside[i])) or (bool(page.furniture[i]) and not marked) or (p >= 0 and shut[p])
    good = np.cumsum([0] + [len(t) * (a and not s) for t, a, s in zip(page.text, inside, shut, strict=True)])
    chars = np.cumsum([0] + [len(t) for t in page.text])
    end, place = np.array(page.end), np.arange(n)
    g, c = good[end] - good[place], chars[end] - chars[place]
    out = np.where(c > 0, (2 * g >= c).astype(int), -1)
    return out if good[-1] > 0 else np.full(n, -1)


def skeleton(seed: int) -> str:
    """A page laid out at random, its article marked by data-main (which is no feature)."""
    r = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi xo zu".split()

    def words(a: int, b: int) -> str:
        out = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(a, b))]
        return " ".join(w + ("." if r.random() < 0.1 else "," if r.random() < 0.07 else "") for w in out).capitalize() + "."

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{words(1, 3)[:-1]}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

    def paragraphs(a: int, b: int) -> str:
        return "".join(f"<p>{words(1 if r.random() < 0.25 else 5, 90)}</p>" for _ in range(r.randint(a, b)))

    def boxed(tag: str, tokens: list[str], inside: str) -> str:
        name = r.choice(["class", "class", "id"])
        return f'<{tag} {name}="{r.choice(tokens)}">{inside}</{tag}>'

    div = ["div", "div", "section"]
    ad = lambda: boxed(r.choice(div), ["ad", "ads", "advert", "sponsored", "promo-box", "banner-ad"], r.choice([words(3, 30), f"<p>{words(3, 30)}</p>", f'<a href="#">{words(2, 8)}</a>']))
    share = lambda: boxed("div", ["share", "social-links", "related-posts", "tags"], links(2, 5))
    before = [
        lambda: r.choice([f"<nav>{links(3, 9)}</nav>", boxed("div", ["menu", "navbar", "main-nav"], links(3, 9)), f'<div role="navigation">{links(3, 9)}</div>']),
        lambda: r.choice([f"<header><p>{words(2, 8)}</p>{links(2, 6)}</header>", boxed("div", ["site-header", "header", "masthead"], f"<h1>{words(1, 4)}</h1><p>{words(3, 9)}</p>"), f"<header><h1>{words(1, 4)}</h1></header>"]),
        lambda: boxed("div", ["cookie-notice", "cookie-banner", "consent", "notice", "notification"], f"<p>{words(8, 40)}</p><button>{words(1, 2)}</button>"),
        lambda: boxed(r.choice(["div", "nav"]), ["breadcrumb", "breadcrumbs"], f'<a href="#">{words(1, 2)}</a> &gt; <a href="#">{words(1, 2)}</a>'),
        ad,
    ]
    after = [
        lambda: r.choice([f"<footer><p>&copy; {words(3, 20)}</p></footer>", f"<footer>&copy; {words(3, 20)}</footer>", boxed("div", ["footer", "site-footer"], f"<p>{words(3, 25)}</p>{links(1, 4)}")]),
        lambda: r.choice([f"<aside>{paragraphs(1, 3)}</aside>", boxed("div", ["sidebar", "right-sidebar", "widget"], f"<h3>{words(1, 3)}</h3>{r.choice([links(2, 6), paragraphs(1, 3)])}"), boxed("aside", ["sidebar"], f"<h3>{words(1, 3)}</h3>{links(2, 6)}")]),
        lambda: boxed(r.choice(div), ["comments", "comment-list", "reader-comments", "replies", "disqus"], f"<h3>{words(1, 3)}</h3>" + "".join(f'<div class="comment"><p>{words(4, 60)}</p></div>' for _ in range(r.randint(1, 5)))),
        lambda: f"<form><label>{words(1, 3)}</label><input><p>{words(3, 15)}</p><button>{words(1, 2)}</button></form>",
        lambda: boxed("div", ["newsletter", "subscribe", "signup", "disclaimer"], f"<p>{words(5, 30)}</p>"),
        lambda: f"<section><h3>{words(1, 3)}</h3>{links(3, 7)}</section>",
        ad,
    ]
    def shown() -> list[str]:
        code = "\n".join(words(1, 6) for _ in range(r.randint(1, 8)))
        defined = "".join(f"<dt>{words(1, 3)[:-1]}</dt><dd>{words(2, 25)}</dd>" for _ in range(r.randint(1, 5)))
        return [f"<pre>{r.choice([code, words(1, 1)[:3], f'<code>{code}</code>'])}</pre>", f"<dl>{defined}</dl>", f'<figure><img src="x"><figcaption>{words(2, 20)}</figcaption></figure>']

    body = f"<h1>{words(2, 10)}</h1>"
    for _ in range(r.randint(1, 5)):
        body += r.choice([paragraphs(1, 4), paragraphs(2, 6), f"<h2>{words(1, 6)}</h2>{paragraphs(1, 3)}", f"<ul>{''.join(f'<li>{words(2, 15)}</li>' for _ in range(r.randint(2, 6)))}</ul>", f"<blockquote><p>{words(4, 40)}</p></blockquote>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<p>{words(4, 30)} <a href='#'>{words(1, 4)}</a> {words(4, 30)}</p>", *shown()])
        if r.random() < 0.25:
            body += r.choice([ad, share])()
    wrap = r.choice(["article", "article", "main", "div", "div", "section"])
    tokens = r.choice(["", ' class="content"', ' id="main-content"', ' class="post-body"', ' class="entry"', ' class="article-text"', ' class="story"', ' id="x1"'])
    article = f"<{wrap}{tokens} data-main>{body}</{wrap}>"
    if r.random() < 0.3:
        article = f"<div>{article}</div>"
    head, tail = r.sample(before, r.randint(1, 4)), r.sample(after, r.randint(1, 5))
    return "<html><body>" + "".join(f() for f in head) + article + "".join(f() for f in tail) + "</body></html>"


def skeleton_page(seed: int) -> tuple[Page, np.ndarray]:
    """A laid-out page and its labels."""
    html = skeleton(seed)
    page = parse(re.sub(r"<(\w+)([^>]*) data-main>", r"<\1\2>", html))
    at = html.index(" data-main>")
    tag = re.search(r"<(\w+)[^<]*$", html[:at])[1]
    order = len(re.findall(rf"<{tag}\b", html[:at]))  # which of its tags the article is
    root = [i for i, t in enumerate(page.tag) if t == tag][order - 1]
    mark, page.tag[root] = page.tag[root], "main"
    labels = node_labels(page)
    page.tag[root] = mark
    return page, labels


def fit(sample: list[str]) -> Boosted:
    """sample: pages of the table, of bounded number and length."""
    made = [skeleton_page(s) for s in range(SKELETONS)]
    made += [(p, node_labels(p)) for p in map(parse, sample)]
    x, y = rows_of(features([p for p, _ in made])), np.concatenate([labels for _, labels in made])
    used = y >= 0
    return boost(x[used], y[used].astype(float), np.ones(int(used.sum())))


def texts_of(pages: list[str | None], model: Boosted) -> list[str]:
    if not pages:
        return []
    trees = [parse(h) for h in pages]
    columns = features(trees)
    total = len(columns[0])
    odds = np.concatenate([model.log_odds(rows_of(columns, a, a + BATCH_NODES)) for a in range(0, total, BATCH_NODES)])
    del columns
    odds = np.split(odds, np.cumsum([len(t.tag) for t in trees])[:-1])
    return ["\n\n".join(t.text[i] for i in decode(t, o)) for t, o in zip(trees, odds, strict=True)]


def extract(pages: DataFrame, model: Boosted) -> DataFrame:
    """pages with html -> its other columns, text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    return B.with_results(pages, "html", "text string", lambda: lambda texts: {"text": pa.array(texts_of(texts, shared.value), pa.string())}, BATCH_CHARS)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = B.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    known = pages.where((F.length("html") <= FIT_CHARS) & F.lower("html").rlike("<(article|main)[\\s>]"))
    sample = [r["html"] for r in B.sampled(known, F.col("page_id"), FIT_PAGES).select("html").orderBy("html").limit(FIT_PAGES).collect()]
    return extract(pages, fit(sample)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
