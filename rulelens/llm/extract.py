"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf path of structural tags and classes. Text length and punctuation are summed per
path and divided by the path's number of nodes; both ratios are smoothed along the page by a Gaussian kernel
and fused into one score per path. Features of the path weigh its score: elements, roles and class words of
menus, headers, footers, sidebars, notices, adverts, forms and comments, links without other text,
and text outside of an article that the page marks as such. Paths above a share of the scores' standard deviation are
content; their lowest common ancestor is the region of the article. In it, every path whose weighed score
is not next to nothing belongs to the article, since short paragraphs, headings and lists do as well as long ones.

Class words are only a feature: an element that holds an article, the page's main heading or nearly all of its text is no
boilerplate, whatever its classes say (but for comments).

One map over all rows, whole pages, linear in their length. Null, empty and textless pages
give the empty text. Repeated rows give equal results; nodes keep the page's order, so there are no ties; an
empty table gives an empty result; only the named columns are read, so clashing names do not matter.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import column, map_arrow

# Element names, roles and class words, by their usual meaning in HTML.
TEXTLESS = frozenset("script style noscript template iframe svg math object head title select option datalist canvas audio video map".split())
BOILERPLATE = frozenset("nav header footer aside form button textarea dialog menu".split())
RAW = "script|style|textarea|title|noscript|iframe|template|svg"
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note status".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments commentlist discussion disqus reply replies respond cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup social share sharing related recommended recommendations widget popup modal overlay disclaimer copyright pagination pager login search toolbar skip".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus reply replies respond".split())
#: Words that a part of an article may have in its class next to a word of ARTICLE.
PARTS = frozenset("header banner promo notice".split())
ARTICLE = frozenset("article post entry story content main body text".split())
#: First words of classes that describe a layout.
LAYOUT = frozenset("with has no without is".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BLOCK_END = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
CLOSABLE = frozenset(["p", *BLOCK_END])
LISTS = frozenset("ul ol dl table tbody thead tfoot tr body html article section div main".split())
REGIONS = frozenset(["article", "main"])

_TOKEN = re.compile(rf"<!--(?P<note>.*?(?:-->|\Z))|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>?|<[!?][^>]*>?|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
#: Gaussian kernel over neighbouring nodes.
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
KERNEL = KERNEL / KERNEL.sum()
#: A path is content from this share of the standard deviation of the scores.
THRESHOLD = 0.5
#: Weights of features: boilerplate or bare links, text outside of a marked article, and text of a page that marks none.
SLIGHT, OUTSIDE, UNMARKED = 1e-9, 0.02, 0.99
#: In the region a path belongs to the article from this share of the largest score.
LEAST = 1e-6
#: An element with this share of the page's text is no boilerplate by its classes.
MOST = 0.8
#: Bare links: at least this share of a path's text in links, and fewer characters a node.
LINKED, SHORT = 0.8, 60


class _Element:
    __slots__ = ("name", "path", "parent", "textless", "flagged", "comments", "region", "near", "inner", "mass", "strong", "holds")

    def __init__(self, name: str, path: int, parent: "_Element | None"):
        self.name, self.path, self.parent = name, path, parent
        self.textless = bool(parent and parent.textless)
        self.flagged = self.comments = self.region = self.holds = False
        self.inner, self.mass, self.strong = 0, 0, 0
        # the nearest element that a block's start may close
        self.near = self if name in CLOSABLE or name in INLINE else None if parent is None or name in LISTS else parent.near


def _class_words(value: str) -> tuple[bool, bool]:
    """(boilerplate, comments) by the words of a class or id."""
    found = comments = False
    for token in value.split():
        words = [w.lower() for w in _SPLIT.split(token) if w]
        if not words or words[0] in LAYOUT:
            continue
        bad = WORDS.intersection(words)
        if bad and not (bad <= PARTS and ARTICLE.intersection(words)):
            found = True
            comments |= bool(COMMENTS.intersection(words))
    return found, comments


def _features(e: _Element, attrs: str) -> str:
    """Set what a start tag says about its element; the label of its path."""
    name = e.name
    e.region = name in REGIONS
    e.textless |= name in TEXTLESS
    e.flagged = name in BOILERPLATE
    label = name
    if attrs and attrs != "/":
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "role":
                e.flagged |= value.lower() in ROLES
                e.region |= value.lower() in ("main", "article")
            elif key == "itemprop":
                e.region |= value == "articleBody"
            elif key == "hidden":
                e.textless = True
            elif key == "aria-hidden":
                e.textless |= value.lower() == "true"
            elif key == "style":
                e.textless |= "display:none" in re.sub(r"\s", "", value.lower())
            else:
                label += f".{value}"
                if name not in ("body", "html", "main"):
                    flagged, comments = _class_words(value)
                    e.flagged |= flagged
                    e.comments |= comments
    e.region &= not e.comments
    return label


def nodes(page: str) -> tuple[list[tuple[int, _Element, str, bool]], list[_Element]]:
    """(block number, innermost element, decoded text, in a link) of each text node, and all elements in order."""
    root = _Element("", 0, None)
    here, block, out, elements = root, 0, [], [root]
    paths: dict[tuple[int, str], int] = {}
    opened: dict[str, int] = {}
    linked = False

    def enter(name: str, attrs: str) -> _Element:
        e = _Element(name, 0, here)
        label = _features(e, attrs)
        e.path = paths.setdefault((here.path, label), len(paths) + 1)
        elements.append(e)
        opened[name] = opened.get(name, 0) + 1
        return e

    def leave(to: _Element) -> _Element:
        e = here
        while e is not to:
            opened[e.name] -= 1
            e = e.parent
        return to

    for m in _TOKEN.finditer(page):
        if m.lastgroup == "text":
            if not here.textless:
                out.append((block, here, unescape(m["text"]), linked))
            continue
        if m["raw"] is not None or m["note"] is not None or m["tag"] is None:
            continue
        name = m["tag"].lower()
        if name in VOID:
            if name == "hr":
                block += 1
            elif name == "br" and not here.textless:
                out.append((block, here, "\n", linked))
            continue
        attrs = m["attrs"] or ""
        if name in INLINE:
            # formatting is transparent, unless it is boilerplate itself; elements of its name inside it end first
            if name == "a":
                linked = not m["end"]
            if here.name == name:
                if not m["end"]:
                    here.inner += 1
                elif here.inner:
                    here.inner -= 1
                else:
                    here = leave(here.parent)
            elif not m["end"] and attrs:
                e = _Element(name, 0, here)
                label = _features(e, attrs)
                if e.flagged or e.textless and not here.textless:
                    e.path = paths.setdefault((here.path, label), len(paths) + 1)
                    elements.append(e)
                    opened[name] = opened.get(name, 0) + 1
                    here = e
            continue
        block += 1
        linked = False
        if m["end"]:
            if opened.get(name):
                e = here
                while e.name != name:
                    e = e.parent
                here = leave(e.parent)
            continue
        # an open paragraph ends where a block begins; items end their like
        closes = BLOCK_END.get(name, frozenset())
        e, to = here.near, None
        while e is not None:
            if e.name == "p" or e.name in closes or e.name in INLINE:
                to = e.parent
            e = e.parent.near
        if to is not None:
            here = leave(to)
        if here.name in closes:
            here = leave(here.parent)
        here = enter(name, attrs)
    return out, elements


def _weights(items: list, elements: list[_Element]) -> dict[int, float]:
    """Weight of each element by its features and those of the elements around it."""
    for e in elements:
        e.mass, e.holds = 0, e.region and not e.flagged or e.name == "h1"
    for _, e, t, _ in items:
        e.mass += len(t.strip())
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.mass += e.mass
            e.parent.holds |= e.holds and not e.comments
    whole = max(1, elements[0].mass)
    marked = any(e.region and e.mass for e in elements)
    out, inside = {}, {}
    for e in elements:
        free = e.name not in BOILERPLATE and (e.region or e.holds or e.mass >= MOST * whole) and not e.comments
        up = out[id(e.parent)] if e.parent is not None else OUTSIDE if marked else UNMARKED
        inside[id(e)] = e.parent is not None and inside[id(e.parent)] or e.region
        bad = e.flagged and not free and not (e.name == "header" and inside[id(e)] and e.holds)
        out[id(e)] = SLIGHT if bad or up == SLIGHT else 1.0 if inside[id(e)] else up
    return out


def path_scores(items: list, weight: dict[int, float]) -> dict[int, float]:
    """Weighed, smoothed and fused score of each path."""
    sizes: dict[int, list[float]] = {}
    for _, e, t, linked in items:
        s = sizes.setdefault(e.path, [0, 0, 0, 0])
        n = len(t.strip())
        if n:
            s[0] += n
            s[1] += len(_PUNCTUATION.findall(t))
            s[2] += 1
            s[3] += n * linked
    own = {}
    for _, e, _, _ in items:
        n, _, k, links = sizes[e.path]
        bare = weight[id(e)] < 1 and n and links >= LINKED * n and n < SHORT * k
        own[e.path] = SLIGHT if bare else weight[id(e)]
    w = np.array([own[e.path] for _, e, _, _ in items])
    text = np.array([sizes[e.path][0] / max(1, sizes[e.path][2]) for _, e, _, _ in items]) * w
    marks = np.array([sizes[e.path][1] / max(1, sizes[e.path][2]) for _, e, _, _ in items]) * w
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), KERNEL, "valid")
    fused = smooth(text) * (1 + smooth(marks)) * w
    total: dict[int, list[float]] = {}
    for (_, e, _, _), v in zip(items, fused.tolist(), strict=True):
        t = total.setdefault(e.path, [0.0, 0.0])
        t[0] += v
        t[1] += 1
    return {p: a / b for p, (a, b) in total.items()}


def main_text(page: str | None) -> str:
    """The article of a page: white space inside a block is one space, blocks are joined by two newlines."""
    if not page:
        return ""
    items, elements = nodes(page)
    if not any(t.strip() for _, _, t, _ in items):
        return ""
    scores = path_scores(items, _weights(items, elements))
    values = list(scores.values())
    largest = max(values)
    if largest <= SLIGHT:  # nothing but boilerplate
        return ""
    level = min(THRESHOLD * float(np.std(values)), largest)
    # the lowest element that holds every content node
    for _, e, t, _ in items:
        e.strong += bool(t.strip()) and scores[e.path] >= level
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.strong += e.strong
    region = elements[0]
    for e in elements:
        if e.strong == elements[0].strong:
            region = e
    inside: dict[int, bool] = {}
    for e in elements:
        inside[id(e)] = e is region or e.parent is not None and inside[id(e.parent)]
    blocks: list[list[str]] = []
    last = None
    for block, e, t, _ in items:
        if inside[id(e)] and scores[e.path] >= LEAST * largest:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(t)
    return "\n\n".join(x for b in blocks if (x := " ".join("".join(b).split())))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars (code points) of each row."""

    def run(batches):
        for batch in batches:
            out = [main_text(h) for h in column(batch, "__html").to_pylist()]
            arrays = [column(batch, k) for k in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return map_arrow(pages.select(*[F.col(k) for k in keep], F.col(html).alias("__html")), run, f"{schema}, text string, n_chars long")
