"""HTML extraction: gradient-boosted trees over the nodes of the DOM, and hierarchical decoding.

Trees, fitted on made-up pages of many layouts (``html_pages``), give each element the log
odds that it belongs to the article, from the density of text, links and punctuation in its
subtree, its tag and attribute tokens and those of its ancestors, its depth and its siblings.
The decoding then takes the best consistent choice over the whole page by dynamic programming
from the leaves up: an element is dropped with all below it, or kept, and then parts of it
may be dropped, or it is mixed, and its children are free. So no element is kept below one
that is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_pages
from .common import table
from .trees import Boosted, boost

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never text of the page.
SILENT = frozenset("head script style noscript template iframe object svg canvas audio video select textarea button title datalist".split())
FOREIGN = frozenset(["svg", "math"])
#: What may stand in a head; anything else, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr option legend".split())
#: A start tag that ends an open element of these, unless one of the second is between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
GOOD = frozenset("article articlebody body content entry main post story text".split())
MENUS = frozenset("bottom breadcrumb breadcrumbs footer head header legal copyright masthead menu nav navbar navigation pager pagination sidebar top topnav links banner".split())
ADS = frozenset("ad ads advert advertisement advertising adverts banner dfp promo promoted recommend related share social sponsor sponsored teaser widget popular tags".split())
NOTICES = frozenset("alert consent cookie cookies disclaimer gdpr modal newsletter notice notification overlay paywall popup privacy subscribe login search signup".split())
REMARKS = frozenset("comment comments discussion disqus feedback replies reply respond responses".split())
GROUPS = (GOOD, MENUS, ADS, NOTICES, REMARKS)
PLAIN_FRAME = frozenset("nav header footer aside form dialog menu".split())
MAIN_FRAME = frozenset("article main".split())
TOKEN = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Dom(HTMLParser):
    """Elements in document order, with their parents, and the texts with the block they are in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.tokens, self.truth = ["#root"], [-1], [frozenset()], [""]
        self.texts: list[tuple[int, int, str]] = []
        self.open = [0]
        self.block = 0
        self.silent = 0

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            tag = self.tag[self.open.pop()]
            if tag in BLOCK:
                self.block += 1
            if tag in SILENT:
                self.silent -= 1

    def _end(self, tags: frozenset[str], walls: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[k]]
            if tag in tags:
                self._close(k)
                return
            if tag in walls:
                return

    def _end_head(self) -> None:
        """What can't stand in a head ends it; outside a body it begins one."""
        if self.tag[self.open[-1]] == "head":
            self._close(len(self.open) - 1)
        if self.tag[self.open[-1]] in ("#root", "html"):
            self.open.append(self._add("body", []))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self._end(frozenset(["head"]), frozenset(["body"]))
        elif tag not in IN_HEAD and tag != "frameset":
            self._end_head()
        if tag in CLOSES_P:
            self._end(frozenset(["p"]), frozenset(["table", "td", "th", "button", "body"]))
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in BLOCK:
            self.block += 1
        if tag == "br" and not self.silent:
            self.texts.append((self.open[-1], self.block, " "))
        if tag in VOID:
            if tag == "input":
                self._add(tag, attrs)
            return
        self.open.append(self._add(tag, attrs))
        if tag in SILENT:
            self.silent += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """The slash ends drawings and formulas, and what is inside them; elsewhere it says nothing."""
        foreign = tag in FOREIGN or any(self.tag[i] in FOREIGN for i in self.open)
        self.handle_starttag(tag, attrs)
        if foreign and tag not in VOID:
            self._close(len(self.open) - 1)

    def _add(self, tag: str, attrs: list) -> int:
        said, truth = "", ""
        for k, v in attrs:
            if v and k in ("class", "id", "role", "itemprop", "aria-label"):
                said += " " + v
            elif k == "data-truth":
                truth = v or ""
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.tokens.append(frozenset(TOKEN.findall(HUMP.sub(" ", said).lower())) if said else frozenset())
        self.truth.append(truth)
        return len(self.tag) - 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._end(frozenset([tag]), frozenset() if tag in BLOCK else frozenset(["td", "th", "body"]))

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._end_head()
        if not self.silent:
            self.texts.append((self.open[-1], self.block, data))


def parse(html: str) -> Dom:
    dom = Dom()
    dom.feed(html)
    dom.close()
    return dom


NAMES = ("depth", "kids", "place", "siblings", "alike", "words", "links", "density", "points", "stops", "paragraphs", "items", "fields", "before", "share",
         "is_p", "is_heading", "is_list", "is_a", "is_table", "is_inline", "is_container", "main_tag", "frame_tag", "in_main", "in_frame",
         *(f"own_{k}" for k in range(5)), *(f"above_{k}" for k in range(5)), "parent_links", "previous", "following", "twins", "twins_above", "short_first")


def node_features(dom: Dom) -> np.ndarray:
    """A row for each element; the first is the root."""
    n = len(dom.tag)
    parent = np.array(dom.parent)
    words, points, stops, links, before = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
    in_link = np.zeros(n, bool)
    for i, tag in enumerate(dom.tag):
        in_link[i] = tag == "a" or (i > 0 and in_link[parent[i]])
    seen = 0
    for i, _, data in dom.texts:
        w = len(data.split())
        if before[i] < 0:
            before[i] = seen
        words[i] += w
        seen += w
        points[i] += data.count(",") + data.count(";")
        stops[i] += data.count(".") + data.count("!") + data.count("?")
        if in_link[i]:
            links[i] += w
    tags, kids = np.ones(n), np.zeros(n)
    ps = np.array([t == "p" for t in dom.tag], float)
    items = np.array([t == "li" for t in dom.tag], float)
    fields = np.array([t in ("input", "label", "select", "textarea", "button") for t in dom.tag], float)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (words, points, stops, links, tags, ps, items, fields):
            a[p] += a[i]
        kids[p] += 1
        if before[i] >= 0 and (before[p] < 0 or before[i] < before[p]):
            before[p] = before[i]
    x = np.zeros((n, len(NAMES)))
    depth = np.zeros(n)
    order, alike, last = np.zeros(n), np.zeros(n), {}
    count: dict[tuple[int, str], int] = {}
    previous, following = np.zeros(n), np.zeros(n)
    main, frame = np.zeros(n), np.zeros(n)
    own, above = np.zeros((n, 5)), np.zeros((n, 5))
    for i in range(1, n):
        p, tag = parent[i], dom.tag[i]
        depth[i] = depth[p] + 1
        j = last.get(p)
        if j is not None:
            order[i] = order[j] + 1
            previous[i], following[j] = words[j], words[i]
        last[p] = i
        count[p, tag] = count.get((p, tag), 0) + 1
        main[i] = main[p] + (tag in MAIN_FRAME)
        frame[i] = frame[p] + (tag in PLAIN_FRAME)
        if dom.tokens[i]:
            own[i] = [len(dom.tokens[i] & g) for g in GROUPS]
        above[i] = above[p] + own[p]
    for i in range(1, n):
        alike[i] = count[parent[i], dom.tag[i]]
    twins, twins_above, short_first = _repeats(dom, words)
    some = np.maximum(words, 1)
    up = np.maximum(parent, 0)
    x[:, :15] = np.stack([np.minimum(depth, 40), kids, order / np.maximum(kids[up], 1), kids[up], alike, np.log1p(words), links / some, words / tags, points / some, stops / some, ps / tags, items / tags, fields / tags, np.maximum(before, 0) / max(seen, 1), words / max(seen, 1)], 1)
    for i, tag in enumerate(dom.tag):
        x[i, 15:24] = (tag == "p", tag[0] == "h" and tag[1:].isdigit(), tag in ("ul", "ol", "li", "dl", "menu"), tag == "a", tag in ("table", "tr", "td", "th", "tbody"), tag not in BLOCK, tag in ("div", "section", "body", "#root"), tag in MAIN_FRAME, tag in PLAIN_FRAME)
    x[:, 24], x[:, 25] = np.minimum(main, 3), np.minimum(frame, 3)
    x[:, 26:31], x[:, 31:36] = np.minimum(own, 3), np.minimum(above, 3)
    x[:, 36], x[:, 37], x[:, 38] = (links / some)[up], np.log1p(previous), np.log1p(following)
    x[:, 39], x[:, 40], x[:, 41] = np.minimum(twins, 9), np.minimum(twins_above, 9), short_first
    return x


def _repeats(dom: Dom, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How comments and teasers show whatever they are called: elements of several children that repeat the
    tags of a sibling (how many there are), the largest such number above, and whether a short child of
    another kind than text, such as a name or a date, stands first."""
    n = len(dom.tag)
    below: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        below[dom.parent[i]].append(i)
    shape = [(dom.tag[i], *sorted({dom.tag[k] for k in below[i]})) if len(below[i]) > 1 else None for i in range(n)]
    twins, above, first = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        seen: dict[tuple, int] = {}
        for k in below[i]:
            if shape[k]:
                seen[shape[k]] = seen.get(shape[k], 0) + 1
        for k in below[i]:
            twins[k] = seen.get(shape[k], 0) if shape[k] else 0
            above[k] = max(above[i], twins[k])
        if len(below[i]) > 1:
            k = below[i][0]
            first[i] = dom.tag[k] in ("a", "address", "b", "cite", "em", "i", "img", "small", "span", "strong", "time") and words[k] <= 4
    return twins, above, first


def truth(dom: Dom) -> np.ndarray:
    """1: all of the article, 0: nothing of it, -1: in part or without text."""
    n = len(dom.tag)
    mark = np.full(n, -1)
    for i in range(n):
        said = dom.truth[i]
        mark[i] = int(said) if said else (mark[dom.parent[i]] if i else -1)
    mark = np.where(mark < 0, 0, mark)
    good, bad = np.zeros(n), np.zeros(n)
    for i, _, data in dom.texts:
        (good if mark[i] else bad)[i] += len(data.split())
    for i in range(n - 1, 0, -1):
        good[dom.parent[i]] += good[i]
        bad[dom.parent[i]] += bad[i]
    return np.where((good > 0) & (bad == 0), 1, np.where((bad > 0) & (good == 0), 0, -1))


@lru_cache(maxsize=1)
def model(n: int = html_pages.PAGES) -> Boosted:
    """Fitted on ``n`` made-up pages; the same in every process."""
    xs, ys = [], []
    for html in html_pages.pages(n):
        dom = parse(html)
        y = truth(dom)
        xs.append(node_features(dom)[y >= 0])
        ys.append(y[y >= 0])
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float))


MIXED = 0.7  # what it costs to leave an element's children free


def states(dom: Dom, logit: np.ndarray) -> np.ndarray:
    """0 (dropped), 1 (kept) or 2 (mixed) for each element: the consistent choice of the largest score."""
    n = len(dom.tag)
    own = np.zeros(n)
    for i, _, data in dom.texts:
        own[i] += len(data.split())
    score = np.clip(logit, -6, 6) * (0.3 + np.log1p(own))
    keep, drop, mixed = score.copy(), -score, np.full(n, -MIXED) + np.where(own > 0, np.abs(score) - 1, 0)
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
        mixed[p] += max(keep[i], drop[i], mixed[i])
    state = np.zeros(n, np.int8)
    state[0] = 2
    for i in range(1, n):
        above = state[dom.parent[i]]
        if above == 2:
            state[i] = int(np.argmax((drop[i], keep[i], mixed[i])))
        elif above == 1:
            state[i] = int(keep[i] >= drop[i])
    return state


def _chosen(dom: Dom, logit: np.ndarray) -> np.ndarray:
    state = states(dom, logit)
    return (state == 1) | ((state == 2) & (logit > 0) & (np.arange(len(state)) > 0))


#: How sure of the best element the odds are made where none would be kept.
SURE = 1.0


def decode(dom: Dom, logit: np.ndarray) -> np.ndarray:
    """True for the elements whose own text is kept; that of mixed ones is by their own odds.

    If that leaves a page without text, as that of one short paragraph, the odds of all elements that are in
    no frame and no link are raised together until the best of them is kept, and the choice is made again.
    """
    kept = _chosen(dom, logit)
    own = np.zeros(len(dom.tag))
    for i, _, data in dom.texts:
        own[i] += len(data.split())
    if not own.any() or (own[kept] > 0).any():
        return kept
    shut = np.zeros(len(dom.tag), bool)
    for i in range(1, len(shut)):
        shut[i] = shut[dom.parent[i]] or dom.tag[i] in PLAIN_FRAME or dom.tag[i] == "a" or any(dom.tokens[i] & g for g in GROUPS[1:])
    able = (own > 0) & ~shut
    if not able.any():
        return kept
    raised = np.where(shut, -6.0, np.minimum(logit, logit[able].max()) + SURE - logit[able].max())
    best = able & (logit == logit[able].max())
    return _chosen(dom, raised) | best


def render(dom: Dom, kept: np.ndarray) -> str:
    """The kept texts: white space of a block as one space, blocks joined by an empty line."""
    blocks: list[str] = []
    now, parts = -1, []
    for i, block, data in [*dom.texts, (0, -2, "")]:
        if block != now:
            if text := " ".join("".join(parts).split()):
                blocks.append(text)
            now, parts = block, []
        if kept[i]:
            parts.append(data)
    return "\n\n".join(blocks)


def extract(pages: list[str], trees: Boosted) -> list[str]:
    """The main text of each page."""
    doms = [parse(p) for p in pages]
    xs = [node_features(d) for d in doms]
    z = trees.logit(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for d, x in zip(doms, xs, strict=True):
        out.append(render(d, decode(d, z[at : at + len(x)])))
        at += len(x)
    return out


def extract_pages(pages: DataFrame, html: str = "html", n_made: int = html_pages.PAGES) -> DataFrame:
    """``pages`` without ``html``, with text and n_chars of the main text.

    A null or empty page, or one that has nothing but menus, notices and other frames, gives an empty
    text; a page of one short paragraph gives that. A header inside the article that holds its headline is
    part of it, with what else stands there. Broken markup is read as browsers do in the main points: missing end tags are implied, that of the head
    included, and so is the body, so that a page of plain text has one; stray end tags are
    ignored. Formulas (math) count as text, with their annotations.
    Repeated rows give equal texts; an empty table stays empty; columns named text or n_chars
    are replaced. Pages go through Python in small groups, each page whole.
    """
    held = pages.sparkSession.sparkContext.broadcast(model(n_made))
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*rest, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 50):
                part = batch.slice(lo, 50)
                text = pa.array(extract([h or "" for h in part.column("_html").to_pylist()], held.value), pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], text], names=[*rest, "text"])

    got = pages.select(*rest, F.col(html).alias("_html")).mapInArrow(run, schema)
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
