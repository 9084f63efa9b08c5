"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

Every element gets statistics of its subtree, its attribute tokens, its depth and its siblings;
boosted regression trees turn them into the odds that it belongs to the article if all of its
ancestors do. Decoding goes from the root down, so that no descendant of a dropped element is kept.
The trees are grown here, on pages made by a rule, whose article is known.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg".split())
#: Elements that start a new block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag of the key ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_LISTS = frozenset(("ul", "ol", "dl", "table", "div", "section", "article", "aside", "nav", "select", "body", "form", "blockquote"))
_CLOSE_P = BLOCK - {"caption", "tbody", "thead", "tfoot", "tr", "td", "th", "option", "legend", "html", "body", "head"}

#: Tokens of class, id and role that name what is not, or is, the article.
BOILERPLATE_TOKENS = tuple(
    "ad ads advert advertisement adverts affiliate alert author-box banner bar bottom breadcrumb breadcrumbs bio byline comment comments consent cookie cookies copyright disclaimer discussion disqus dialog footer form gdpr head header login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup print privacy promo promoted promotion rail reaction reactions recommend recommended related replies reply respond review reviews search share sharing sidebar sign-up signup skip skyscraper social sponsor sponsored subscribe subscription tag tags toc toolbar top topbar trending warning widget widgets complementary contentinfo banner".split()
)
CONTENT_TOKENS = tuple("article articlebody body content entry main page paragraph post postbody prose story text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-label|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+(?:-[a-z]+)?|[a-z]+")
#: White space as Unicode has it; characters of no width, like U+200B and U+FEFF, are none.
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    children: list = field(default_factory=list)  # numbers of elements, and texts


def parse(page: str) -> list[Node]:
    """Elements in page order, the first an unnamed root; ends what HTML ends by itself, forgives the rest."""
    nodes = [Node("", -1, 0)]
    open_ = [0]
    pos, n = 0, len(page)

    def add_text(s: str) -> None:
        if s:
            nodes[open_[-1]].children.append(html_lib.unescape(s) if "&" in s else s)

    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            add_text(page[pos:])
            break
        add_text(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                name = nodes[open_[k]].tag
                if name == tag:
                    del open_[k:]
                    break
                if name in ("td", "th", "table", "article", "body") and tag not in BLOCK:
                    break  # an inline end does not leave its container
            continue
        if tag in _CLOSE_P or tag in _ENDS:
            ended = _ENDS.get(tag, frozenset()) | ({"p"} if tag in _CLOSE_P else frozenset())
            for k in range(len(open_) - 1, 0, -1):
                name = nodes[open_[k]].tag
                if name in ended:
                    del open_[k:]
                    break
                if name in _LISTS:
                    break
        number = len(nodes)
        nodes.append(Node(tag, open_[-1], len(open_), m[3] or ""))
        nodes[open_[-1]].children.append(number)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]|</{re.escape(tag)}\Z", re.I).search(page, pos)
            if end:
                pos = page.find(">", end.start()) + 1 or n
            else:
                pos = n
            continue
        if not (m[3] or "").endswith("/") or tag in BLOCK:
            open_.append(number)
    return nodes


#: Tags that are features of their own; any other counts as "other".
TAGS = "a abbr address article aside b blockquote body br button caption code dd details div dl dt em figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html i img input label li main nav ol p pre section select span strong summary table td th tr ul".split()
_TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}
FEATURES = [
    "depth", "log_chars", "log_own_chars", "link_share", "tags_per_char", "child_count", "text_children", "stops_per_char", "mean_word", "control_count",
    "sibling_position", "sibling_count", "same_tag_siblings", "share_of_parent", "share_of_page", "prev_chars", "next_chars", "p_children", "li_children",
    "bad_token", "good_token", "up_bad", "up_good", "up_article", "up_boiler", "hidden", "seen_article", "year_or_copy", "heading", "parent_tag", "tag",
    "prose_share", "up_prose_share", "has_h1", "h1_before", "largest_up", "children_alike", "prose_of_parent", "own_boiler", "paragraph", "bad_children", "items_with_parts",
]
_BOILER_TAGS = frozenset("nav footer aside form header button select menu dialog label".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTROL = frozenset("input button select textarea option label".split())
_BAD, _GOOD = frozenset(BOILERPLATE_TOKENS), frozenset(CONTENT_TOKENS)
#: Long enough to mean the same inside a longer word, as in "commentlist".
_STEMS = tuple(t for t in BOILERPLATE_TOKENS if len(t) >= 6)


@functools.lru_cache(maxsize=4096)
def _tokens(attributes: str) -> tuple[frozenset[str], bool]:
    found, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif name != "style":
            value = re.sub(r"[_\d]+", "-", value)
            for word in value.split():
                found.add(word)
                found.update(word.split("-"))
                found.update("-".join(p) for p in zip(word.split("-"), word.split("-")[1:]))
                found.update(t for t in _STEMS if t in word)
    return frozenset(found), hidden


def features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES per element."""
    n = len(nodes)
    chars, own, link, tags, stops, words, control, prose, h1 = ([0] * n for _ in range(9))
    tokens = [_tokens(x.attributes) if x.attributes else (frozenset(), False) for x in nodes]
    texts = [[c for c in x.children if isinstance(c, str)] for x in nodes]
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        for c in texts[k]:
            own[k] += len(c) - c.count(" ") - c.count("\n")
            stops[k] += c.count(".") + c.count(",") + c.count("!") + c.count("?")
            words[k] += len(c.split())
        chars[k] += own[k]
        if stops[k] and own[k] >= 20:
            prose[k] += own[k]
        if node.tag == "a":
            link[k], prose[k] = chars[k], 0
        if node.tag == "h1":
            h1[k] = 1
        if node.tag in _CONTROL:
            control[k] += 1
        p = node.parent
        if p >= 0:
            for a in (chars, link, stops, words, control, prose, h1):
                a[p] += a[k]
            tags[p] += tags[k] + 1
    log_chars = np.log1p(chars).tolist()
    log_own = np.log1p(own).tolist()
    # of each element: place, siblings, siblings of its tag, size of the one before and after, p and li among them
    beside: list = [(0, 0, 0, 0.0, 0.0, 0, 0)] * n
    alike_below, bad_below, parts_below = [0] * n, [0] * n, [0] * n
    for k, node in enumerate(nodes):
        if len(node.children) > len(texts[k]):
            kids = [c for c in node.children if not isinstance(c, str)]
            kinds: dict[str, int] = {}
            for c in kids:
                kinds[nodes[c].tag] = kinds.get(nodes[c].tag, 0) + 1
            p_kids, li_kids = kinds.get("p", 0), kinds.get("li", 0)
            classes: dict[str, int] = {}
            for c in kids:
                if nodes[c].attributes and nodes[c].tag not in ("p", "td", "tr", "a"):
                    classes[nodes[c].attributes] = classes.get(nodes[c].attributes, 0) + 1
            alike_below[k] = max(classes.values(), default=0)
            bad_below[k] = sum(not _BAD.isdisjoint(tokens[c][0]) for c in kids)
            parts_below[k] = sum(sum(nodes[d].tag in BLOCK for d in nodes[c].children if not isinstance(d, str)) > 0 for c in kids if nodes[c].tag == "li")
            for i, c in enumerate(kids):
                beside[c] = (i, len(kids), kinds[nodes[c].tag], log_chars[kids[i - 1]] if i else 0.0, log_chars[kids[i + 1]] if i + 1 < len(kids) else 0.0, p_kids, li_kids)
    rows = []
    seen_article = False
    total = max(chars[0], 1)
    up: list[tuple[bool, bool, bool, bool]] = []
    every_prose, seen_h1 = max(prose[0], 1), 0
    largest_up: list[float] = []  # the greatest share of all prose that an element with a name or a tag of the article has, from here up
    for k, node in enumerate(nodes):
        p = node.parent
        got, hidden = tokens[k]
        bad, good = not _BAD.isdisjoint(got), not _GOOD.isdisjoint(got)
        above = up[p] if p >= 0 else (False, False, False, False)
        is_article = node.tag in ("article", "main")
        up.append((above[0] or bad, above[1] or good, above[2] or is_article, above[3] or node.tag in _BOILER_TAGS))
        seen_article = seen_article or is_article
        named = prose[k] / every_prose if is_article or bad or good or node.tag in ("section", "div", "td") else 0.0
        largest_up.append(max(named, largest_up[p]) if p >= 0 else 0.0)
        size = chars[k] or 1
        place, siblings, alike, before, after, p_kids, li_kids = beside[k]
        first = next((c for c in texts[k] if c and not c.isspace()), "")[:60].lower()
        rows.append((
            node.depth, log_chars[k], log_own[k], link[k] / size, tags[k] / size, len(node.children), len(texts[k]), stops[k] / size, chars[k] / (words[k] or 1), control[k],
            place, siblings, alike, chars[k] / (chars[p] or 1) if p >= 0 else 1, chars[k] / total, before, after, p_kids, li_kids,
            bad, good, above[0], above[1], above[2], above[3], hidden, seen_article, "©" in first or "(c)" in first or "all rights" in first,
            node.tag in _HEADINGS, _TAG_NUMBER.get(nodes[p].tag, -1) if p >= 0 else -1, _TAG_NUMBER.get(node.tag, -1),
            prose[k] / every_prose, prose[p] / every_prose if p >= 0 else 1, h1[k], seen_h1, largest_up[k], alike_below[k], prose[k] / (prose[p] or 1) if p >= 0 else 1,
            node.tag in _BOILER_TAGS, node.tag == "p", bad_below[k], parts_below[k],
        ))
        seen_h1 = seen_h1 or node.tag == "h1"
    return np.array(rows, float)


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth: feature, cut and leaf values as arrays."""

    feature: np.ndarray  # (tree, inner node)
    cut: np.ndarray
    leaf: np.ndarray  # (tree, leaf)
    base: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - (leaf.shape[0] - 1)]
        return total


def grow_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, least: float = 3.0, bins: int = 32, share: float = 0.3, seed: int = 5) -> BoostedTrees:
    """Gradient boosting with Newton leaves for the logistic loss, on quantile bins, each tree on a random share of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)], 1)  # bin b: above cuts[b - 1], up to cuts[b]
    width = bins + 1
    flat = binned + width * np.arange(x.shape[1])[None]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    total = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at, drawn = np.zeros(len(y), np.int64), rng.random(len(y)) < share
        for node in range(inner):
            here = np.flatnonzero(at == node)
            rows = here[drawn[here]]
            if len(rows):
                idx = flat[rows].ravel()
                gs = np.bincount(idx, np.repeat(g[rows], x.shape[1]), width * x.shape[1]).reshape(x.shape[1], width).cumsum(1)
                hs = np.bincount(idx, np.repeat(h[rows], x.shape[1]), width * x.shape[1]).reshape(x.shape[1], width).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                gain[(hs < least) | (ha - hs < least)] = 0
                f, b = divmod(int(np.argmax(gain)), width)
                if gain[f, b] > 1e-3 and b < len(cuts[f]):
                    feature[t, node], cut[t, node] = f, cuts[f][b]
            at[here] = 2 * node + 1 + (x[here, feature[t, node]] > cut[t, node])
        leaf = at - inner
        gl, hl = np.bincount(leaf[drawn], g[drawn], leaves), np.bincount(leaf[drawn], h[drawn], leaves)
        value[t] = rate * gl / (hl + 1)
        total += value[t][leaf]
    return BoostedTrees(feature, cut, value, base)


# --- pages made by a rule ---------------------------------------------------------------------


def _words(rng: random.Random, n: int) -> str:
    sylls = "ka lo mi ra ten su el do vir na pe ost in ga ru tha en ser".split()
    out = ["".join(rng.choice(sylls) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for k in range(len(out)):
        if rng.random() < 0.1:
            out[k] += ","
    return " ".join(out).capitalize() + rng.choice(["."] * 6 + ["", "!", "?"])


#: Names beside BOILERPLATE_TOKENS that made pages give to what is not the article.
_OTHER_NAMES = "site-top masthead-links global-nav util-bar fly-out tout teaser-rail jump-links legal fine-print colophon partner-box buy-box card-deck more-stories you-may-like read-next hot-topics signin opt-in thread user-notes feedback talkback guestbook pinned ticker strip stripe slot box7 mod-12 widget-x".split()


def made_page(seed: int) -> str:
    """A page whose article elements carry the attribute data-k=1 and all others data-k=0 or none.

    Names are no proof in these pages: some articles, their parts and their containers have names of
    boilerplate, and much boilerplate has names that say nothing, so that the trees have to weigh
    names against text, links and place.
    """
    rng = random.Random(seed)
    keep, drop = ' data-k="1"', ' data-k="0"'
    nonsense = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "-1", "__x", "-wrap"])
    misleading = lambda: rng.choice(BOILERPLATE_TOKENS) + rng.choice(["", "", "-body", "-page", "-text", " full"])
    attribute = lambda name: f" {rng.choice(['class', 'class', 'class', 'id'])}='{name}'"

    def token() -> str:
        kind = rng.random()
        if kind > 0.85:
            return rng.choice(CONTENT_TOKENS) + rng.choice(["__", "-", "_"]) + rng.choice(BOILERPLATE_TOKENS)
        return rng.choice(BOILERPLATE_TOKENS) if kind < 0.55 else rng.choice(_OTHER_NAMES) if kind < 0.75 else nonsense()

    def name_kept(often: float) -> str:
        """Some name, or mostly none, of an element of the article."""
        if rng.random() > often:
            return ""
        kind = rng.random()
        return attribute(nonsense() if kind < 0.4 else misleading() if kind < 0.8 else rng.choice(CONTENT_TOKENS))

    links = lambda n: "".join(f'<li{drop}><a{drop} href="/{k}">{_words(rng, rng.randint(1, 3)).rstrip(".")}</a></li>' for k in range(n))
    sentences = lambda low, high: " ".join(_words(rng, rng.randint(2, 30)) for _ in range(rng.randint(low, high)))

    def paragraph() -> str:
        body = sentences(1, 6) if rng.random() < 0.85 else _words(rng, rng.randint(1, 3))
        if rng.random() < 0.2:
            body = rng.choice([f"<b{keep}>{body}", f"<b{keep}>{body}</b>", f"<em{keep}>{body}</em> {_words(rng, 5)}", f"{body} <a{keep} href=x>{_words(rng, 2)}</a> {_words(rng, 8)}", f"{body} <math{keep}><mi{keep}>x</mi><mo{keep}>=</mo><mn{keep}>{rng.randint(1, 99)}</mn></math> {_words(rng, 4)}", f"<span{keep}>{body}</span>", f"{body}<sup{keep}>{rng.randint(1, 9)}</sup>"])
        if rng.random() < 0.1:
            body += f"<br{keep}>" + (_words(rng, 8) if rng.random() < 0.5 else "")
        kind, name = rng.random(), name_kept(0.15)
        if kind < 0.72:
            return f"<p{keep}{name}>{body}" + rng.choice(["</p>", "</p>", "</p>", ""])
        if kind < 0.76:
            return f"<div{keep}{name}>{body}</div>" if rng.random() < 0.5 else f"<div{keep}{name}><p{keep}>{body}</p><p{keep}>{sentences(1, 3)}</p></div>"
        if kind < 0.81:
            return f"<{(t := rng.choice(['ul', 'ul', 'ol']))}{keep}{name}>" + "".join(f"<li{keep}>{_words(rng, rng.randint(2, 20))}</li>" for _ in range(rng.randint(2, 6))) + f"</{t}>"
        if kind < 0.84:
            return f"<blockquote{keep}{name}><p{keep}>{body}</p></blockquote>"
        if kind < 0.86:
            return f"<pre{keep}{name}>{body}</pre>"
        if kind < 0.89:
            return f"<dl{keep}{name}>" + "".join(f"<dt{keep}>{_words(rng, rng.randint(1, 3))}</dt><dd{keep}>{_words(rng, rng.randint(3, 20))}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"
        if kind < 0.93:
            return f"<figure{keep}{name}><img{keep} src=x><figcaption{keep}{name_kept(0.2)}>{_words(rng, rng.randint(2, 15))}</figcaption></figure>"
        if kind < 0.96:
            return f"<table{keep}{name}>" + "".join(f"<tr{keep}>" + "".join(f"<{(t := rng.choice(['td', 'td', 'th']))}{keep}>{_words(rng, rng.randint(1, 5))}</{t}>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return f"<h{(k := rng.randint(2, 4))}{keep}{name}>{_words(rng, rng.randint(2, 8))}</h{k}>"

    def comments() -> str:
        name = rng.choice(["comments", "comment-list", "discussion", "responses", "replies", "reviews", "thread", "talkback", "guestbook", "disqus", "user-notes"])
        one = rng.choice(["comment", "reply", "response", "post", "item", "entry", nonsense()])
        kind = rng.choice([("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("section", "article")])
        each = "".join(f"<{kind[1]}{drop} class='{one}'><{(t := rng.choice(['p', 'div', 'b', 'span']))}{drop}>{_words(rng, rng.randint(1, 3))}</{t}><p{drop}>{sentences(1, 4)}</p></{kind[1]}>" for _ in range(rng.randint(1, 7)))
        return f"<{kind[0]}{drop}{attribute(name)}><h3{drop}>{_words(rng, rng.randint(1, 3))}</h3>{each}</{kind[0]}>"

    def boiler() -> str:
        kind = rng.randrange(14)
        text = " ".join(_words(rng, rng.randint(2, 14)) for _ in range(rng.randint(1, 3)))
        if kind == 0:
            return f"<nav{drop}><ul{drop}>{links(rng.randint(2, 9))}</ul></nav>"
        if kind == 1:
            return f"<header{drop}><a{drop} href='/'>{_words(rng, 2)}</a>{rng.choice(['', f'<p{drop}>{text}</p>', f'<h2{drop}>{_words(rng, 3)}</h2>', f'<nav{drop}><a{drop} href=x>{_words(rng, 1)}</a> <a{drop} href=y>{_words(rng, 1)}</a></nav>'])}</header>"
        if kind == 2:
            return f"<footer{drop}>{rng.choice(['&copy; ', 'Copyright 2024 ', '', ''])}{text}" + (f"<ul{drop}>{links(3)}</ul>" if rng.random() < 0.4 else "") + "</footer>"
        if kind == 3:
            return f"<aside{drop}><h3{drop}>{_words(rng, 2)}</h3><p{drop}>{text}</p><ul{drop}>{links(rng.randint(0, 6))}</ul></aside>"
        if kind == 4:
            return f"<form{drop} action=x><label{drop}>{_words(rng, 3)}</label><input{drop}><p{drop}>{text}</p><button{drop}>{_words(rng, 1)}</button></form>"
        if kind == 5:
            return comments()
        if kind == 6:
            return f"<{(t := rng.choice(['div', 'div', 'div', 'p', 'section', 'section']))}{drop} class='{rng.choice(['cookie-notice', 'notice', 'consent banner', 'alert', 'gdpr', 'cookie-banner', 'disclaimer', 'notification'])}'>{text}</{t}>"
        if kind == 7:
            return f"<div{drop} class='{token()}{rng.choice(['', '-box', '-wrap', '_2', ' large'])}'>{rng.choice([text, f'<p{drop}>{text}</p>', f'<p{drop}>{text}</p><p{drop}>{text}</p>', f'<ul{drop}>{links(4)}</ul>', f'<a{drop} href=x>{text}</a>'])}</div>"
        if kind == 8:
            return f"<ul{drop}{rng.choice(['', attribute(token())])}>{links(rng.randint(2, 8))}</ul>"
        if kind == 9:
            return f"<div{drop} role='{rng.choice(['navigation', 'complementary', 'contentinfo', 'banner', 'search', 'dialog'])}'>{text}</div>"
        if kind == 10:
            return f"<div{drop} class='{rng.choice(['ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot'])}'>{text}</div>"
        if kind == 11:
            return f"<div{drop}{rng.choice(['', attribute(token())])}>" + rng.choice([" | ", " ", ""]).join(f"<a{drop} href='/{k}'>{_words(rng, rng.randint(1, 2)).rstrip('.')}</a>" for k in range(rng.randint(2, 8))) + "</div>"
        if kind == 12:
            return f"<div{drop}{attribute(token())}><input{drop} name=q><button{drop}>{_words(rng, 1)}</button> {text}</div>"
        return f"<div{drop} {rng.choice(['id', 'class'])}='{rng.choice(['sidebar', 'related', 'newsletter', 'share', 'author-box', 'tags', 'breadcrumbs', 'popup', 'menu', 'footer', 'header'])}'><p{drop}>{text}</p></div>"

    head = f"<h1{keep}{name_kept(0.1)}>{_words(rng, rng.randint(2, 12))}</h1>"
    inside = []
    if rng.random() < 0.85:
        lead = f"<p{keep}>{_words(rng, rng.randint(6, 20))}</p>" if rng.random() < 0.5 else ""
        inside.append(f"<{(t := rng.choice(['header', 'header', 'hgroup', 'div']))}{keep}{name_kept(0.3)}>{head}{lead}</{t}>" if rng.random() < 0.25 else head)
    for _ in range(rng.choice([1, 2, 3, 5, 8, 15])):
        inside.append(paragraph())
        if rng.random() < 0.1:
            inside.append(boiler())
    if rng.random() < 0.02:  # a page without an article
        return f"<html><head><title>{_words(rng, 3)}</title></head><body>" + "".join(boiler() for _ in range(rng.randint(1, 5))) + "</body></html>"
    container = rng.choice(["article"] * 6 + ["main", "div class='content'", "div id='main'", "div class='post-body'", "div class='entry-content'", "section class='story'", "div"])
    tag, name = container.split()[0], name_kept(0.25) if " " not in container else ""
    body = "".join(inside)
    if rng.random() < 0.25 and len(inside) > 2:  # the article's text in a part of its own
        part, at = rng.choice(["section", "div"]), rng.choice([0, 1, 1, 1])
        body = "".join(inside[:at]) + f"<{part}{keep}{attribute(misleading()) if rng.random() < 0.5 else name_kept(0.4)}>" + "".join(inside[at:]) + f"</{part}>"
    elif rng.random() < 0.15 and len(inside) > 2:  # or in several parts
        part, name_of, cut = rng.choice(["section", "section", "div"]), name_kept(0.5), rng.randint(1, 3)
        parts = [f"<{part}{keep}{name_of}><h2{keep}>{_words(rng, rng.randint(1, 5))}</h2>{''.join(inside[a : a + cut])}</{part}>" for a in range(1, len(inside), cut)]
        body = inside[0] + "".join(parts)
    close = f"</{tag}>" if rng.random() < 0.95 else ""  # else what follows is inside of it
    article = f"<{container}{keep}{name}>{body}{close}"
    if tag != "main" and rng.random() < 0.25:
        article = f"<main{keep}{name_kept(0.2)}>{article}{rng.choice(['', boiler(), comments(), boiler() + comments()])}</main>"
    before, after = [boiler() for _ in range(rng.randint(0, 4))], [boiler() for _ in range(rng.randint(0, 4))]
    if rng.random() < 0.08:  # a layout table: a menu beside the article
        menu = rng.choice([f"<ul{drop}>{links(rng.randint(2, 6))}</ul>", " ".join(f"<a{drop} href='/{k}'>{_words(rng, 1).rstrip('.')}</a>" for k in range(rng.randint(2, 6))), " ".join(_words(rng, 1).rstrip(".") for _ in range(rng.randint(2, 5)))])
        cells = [f"<td{drop}>{menu}</td>", f"<td{keep}>{body if rng.random() < 0.5 else article}</td>"]
        if rng.random() < 0.25:
            cells.reverse()
        body = "".join(before) + f"<table{keep}><tr{keep}>{''.join(cells)}</tr></table>" + "".join(after)
    else:
        body = "".join(before) + article + "".join(after)
    if rng.random() < 0.3:
        body = f"<div{keep} class='{rng.choice(['wrapper', 'container', 'page', 'layout', 'site', nonsense(), misleading()])}'>{body}</div>"
    end = rng.choice(["</body></html>"] * 5 + [""])
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 5)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}{end}"


_MARK = re.compile(r'data-k="([01])"')


@functools.lru_cache(maxsize=4)
def trained(pages: int = 5000, seed: int = 11) -> BoostedTrees:
    """Trees grown on made pages: seconds of numpy, the same everywhere.

    Elements below dropped ones are left out: the odds are those of an element whose ancestors are
    all kept, which is where decoding asks for them.
    """
    xs, ys = [], []
    for k in range(pages):
        nodes = parse(made_page(seed * 100_000 + k))
        label: list[bool | None] = []
        open_ = []
        for node in nodes:
            m = _MARK.search(node.attributes)
            open_.append(node.parent < 0 or open_[node.parent] and label[node.parent] is not False)
            label.append(None if m is None else m[1] == "1")
        rows = [i for i, y in enumerate(label) if y is not None and open_[i]]
        xs.append(features(nodes)[rows])
        ys.append(np.array([label[i] for i in rows], float))
    return grow_trees(np.concatenate(xs), np.concatenate(ys), trees=80, depth=5)


# --- decoding ---------------------------------------------------------------------------------


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Labels in which no dropped element has a kept descendant: from the root down, each by its own odds.

    The odds are those of an element all of whose ancestors are kept, so that their product along a
    path is the chance that its last element is kept. Structure above the body is always passed through.
    """
    kept = np.zeros(len(nodes), bool)
    for k, node in enumerate(nodes):
        kept[k] = node.parent < 0 or kept[node.parent] and (odds[k] > 0 or node.tag in ("html", "body"))
    return kept


def blocks(nodes: list[Node], kept: np.ndarray) -> list[str]:
    """Texts of the kept blocks in page order: white space made one space, trimmed, none empty."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        k, at = stack.pop()
        node = nodes[k]
        block = node.tag in BLOCK
        if at == 0 and block:
            end()
        for i in range(at, len(node.children)):
            c = node.children[i]
            if isinstance(c, str):
                if node.tag not in ("", "html", "head", "body") or kept[k]:
                    run.append(c)
            elif kept[c] and nodes[c].tag != "head":
                if nodes[c].tag == "br":
                    run.append(" ")
                    continue
                stack += [(k, i + 1), (c, 0)]
                break
            elif nodes[c].tag in BLOCK:
                end()
        else:
            if block:
                end()
    end()
    return out


def extract(page: str, model: BoostedTrees | None = None) -> str:
    nodes = parse(page)
    if len(nodes) == 1 and not nodes[0].children:
        return ""
    odds = (model or trained()).odds(features(nodes))
    return "\n".join(blocks(nodes, decode(nodes, odds)))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row: the article's blocks, one per line.

    The whole html is read; null and empty html, and pages without an article, have empty text.
    Repeated rows, null ids and null urls pass through; an empty table gives no rows; other columns,
    whatever their names, are not read.
    """

    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(2)
            parsed = [parse(html[k].as_py() or "") for k in range(batch.num_rows)]
            texts = []
            for a in range(0, len(parsed), 64):
                part = parsed[a : a + 64]
                odds = model.odds(np.concatenate([features(p) for p in part]))
                at = 0
                for nodes in part:
                    texts.append("\n".join(blocks(nodes, decode(nodes, odds[at : at + len(nodes)]))))
                    at += len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
