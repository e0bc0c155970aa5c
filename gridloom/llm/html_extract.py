"""HTML extraction by minimum-cut labelling.

A page is read into elements and blocks of text in page order.  A logistic
classifier gives each block log odds of content from its length, links, last
character and element, from the sections it lies in, and from the words of class,
id and role of the elements around it, which count less with each level of distance.
Positive odds become the capacity from the source, negative ones the capacity to
the sink.  Neighbouring blocks, and successive blocks of one parent, are joined by
smoothness edges that weaken with the blocks' distance in the tree.  Maximum flow
(Dinic) splits the page: blocks on the source's side are the main text.

The classifier is trained on the pages themselves, on a bounded sample of SAMPLE pages
of up to SAMPLE_BYTES.  Labels are distant: blocks in an article or main element
speak for content; blocks outside it, under marks of boilerplate, or repeated on a
host's pages speak against it; on pages without such an element long blocks with few
links are content.  Each example is learnt with and without its article mark, so that
the rest is learnt too.  Weights start from a prior (prior()) and are drawn to it:
marks that no page of the sample bears keep it.  Marks of an element that holds all of
the page's articles, or without any article most of its words, say nothing.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one space.  Scripts, styles, comments,
form fields and other unseen elements hold no blocks.

Edge cases: null and empty html and pages without content give an empty text;
unclosed and stray tags, odd quotes and lone "<" are tolerated; pages of any length
and depth are read whole; repeated rows are judged alike; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import TEXT_ROWS, mapped, sampled, stored, table

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|aria-label|hidden|style)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[ \t\n\r\f\v\xa0]+")
#: HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr img".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
UNSEEN = frozenset("svg math select button object template datalist canvas audio video map head".split())
NO_BLOCKS = frozenset("button select".split())
AWAY_TAGS = frozenset("nav footer header aside form menu dialog fieldset".split())
HOME_TAGS = frozenset("article main".split())
#: Words of class, id and role that speak against or for content.
AWAY = frozenset(
    "nav navbar navigation menu footer header masthead aside sidebar side ad ads advert adverts advertisement banner promo promotion sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist reply replies respond disqus discussion reader readers related recommended "
    "share sharing social breadcrumb breadcrumbs subscribe subscription newsletter signup login search form widget toolbar copyright legal pagination pager tags complementary contentinfo".split()
)
HOME = frozenset("article main content post entry story body text".split())
#: Sections whose marks an element of most of the page's words is not believed.
DOUBTED = frozenset("header form dialog fieldset".split())

DECAY = 0.96
W_NEXT, W_SIBLING = 1.2, 0.8
SAMPLE, SAMPLE_BYTES = 1500, 200_000
EPOCHS, RATE, PULL = 150, 0.1, 2e-3


class Page:
    """Elements (tag, parent, depth, words of their marks) and blocks (text, element, characters in links,
    steps in the tree from the block before)."""

    def __init__(self, page: str):
        self.tags, self.parents, self.depths, self.marks = [""], [0], [0], [()]
        self.blocks: list[tuple[str, int, int, int]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, parts = [0], []
        unseen: list[int] = []  # open elements that are not shown
        in_link = links = low = last_depth = 0
        no_end: set[str] = set()
        folded = None

        def ends(tag: str, after: int) -> int:
            """Where the next end tag of that name is, -1 if there is none."""
            nonlocal folded
            if tag in no_end:
                return -1
            if folded is None:
                folded = page.translate(_FOLD)
            at = folded.find(f"</{tag}", after)
            if at < 0:
                no_end.add(tag)
            return at

        def text(a: int, b: int):
            nonlocal links
            if a < b and not unseen:
                parts.append(page[a:b])
                if in_link:
                    links += len(page[a:b].strip())

        def flush():
            nonlocal links, low, last_depth
            if parts:
                out = _GAP.sub(" ", entities.unescape("".join(parts))).strip()
                parts.clear()
                if out:
                    top = next((e for e in reversed(stack) if self.tags[e] not in INLINE), 0)
                    self.blocks.append((out, top, links, last_depth + len(stack) - 2 * low))
                    low = last_depth = len(stack)
            links = 0

        def pop(to: int):
            nonlocal in_link, low
            while len(stack) > to:
                e = stack.pop()
                in_link -= self.tags[e] == "a"
                if unseen and unseen[-1] == e:
                    unseen.pop()
            low = min(low, len(stack))

        def close(tag: str):
            for i in range(len(stack) - 1, 0, -1):
                name = self.tags[stack[i]]
                if name == tag:
                    return pop(i)
                if tag in INLINE and name not in INLINE:
                    return None
            return None

        at = 0
        while True:
            lt = page.find("<", at)
            if lt < 0:
                text(at, len(page))
                break
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                text(at, lt)
                end = page.find("-->", lt + 4)
                at = len(page) if end < 0 else end + 3
                continue
            if after in ("!", "?") or (after == "/" and not page[lt + 2 : lt + 3].isalpha()):
                end = page.find(">", lt)
                text(at, lt)
                at = len(page) if end < 0 else end + 1
                continue
            m = _TAG.match(page, lt)
            if not m:
                if after.isalpha() or after == "/":  # a tag that the page's end cuts off
                    text(at, lt)
                    break
                text(at, lt + 1)
                at = lt + 1
                continue
            text(at, lt)
            at = m.end()
            tag, attrs = m[2].lower(), m[3]
            if m[1]:
                if tag not in INLINE:
                    flush()
                close(tag)
                continue
            if tag in RAW and not attrs.endswith("/"):
                end = ends(tag, at)
                if end >= 0 or tag in ("script", "style"):
                    end = page.find(">", end) if end >= 0 else -1
                    at = len(page) if end < 0 else end + 1
                    if tag not in INLINE:
                        flush()
                continue
            if tag not in INLINE:
                flush()
                if tag not in VOID:  # a block ends an open paragraph, an item the item before it
                    if tag not in ("option", "optgroup"):
                        for name in NO_BLOCKS & {self.tags[e] for e in unseen}:
                            close(name)
                    for i in range(len(stack) - 1, 0, -1):
                        name = self.tags[stack[i]]
                        if name == "p" or (name == tag and tag in CLOSES_ITSELF):
                            pop(i)
                            break
                        if name not in INLINE:
                            break
            if tag in VOID or attrs.endswith("/") or (tag in UNSEEN and ends(tag, at) < 0):
                continue
            words, hidden = _marks(attrs)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.depths.append(len(stack))
            self.marks.append(words)
            stack.append(len(self.tags) - 1)
            in_link += tag == "a"
            if hidden or tag in UNSEEN:
                unseen.append(stack[-1])
        flush()

    def doubtful(self) -> list[bool]:
        """Elements whose marks say nothing: they hold all articles or, without any, most words."""
        n = len(self.tags)
        words, homes = [0] * n, [int(t in HOME_TAGS) for t in self.tags]
        for text, e, links, _ in self.blocks:
            words[e] += 0 if 2 * links > len(text) else text.count(" ") + 1
        for e in range(n - 1, 0, -1):
            words[self.parents[e]] += words[e]
            homes[self.parents[e]] += homes[e]
        if homes[0]:
            return [h == homes[0] for h in homes]
        return [w >= 50 and 2 * w > words[0] for w in words]

    def features(self) -> list[list[tuple[str, float]]]:
        """Of each block."""
        doubt, around, chains = self.doubtful(), [frozenset()], [None]
        for e in range(1, len(self.tags)):
            tag, above = self.tags[e], around[self.parents[e]]
            if tag in HOME_TAGS:
                above = above | {"in:article"}
            elif tag in AWAY_TAGS and not (tag in DOUBTED and doubt[e]):
                inner = tag in ("header", "footer") and "in:article" in above  # of the article, not the page
                above = above | {f"in:article {tag}" if inner else f"in:{tag}"}
            around.append(above)
            chain = chains[self.parents[e]]
            if self.marks[e] and not doubt[e] and tag not in ("html", "body"):
                chain = (self.depths[e], self.marks[e], chain)
            chains.append(chain)
        out = []
        for text, e, links, _ in self.blocks:
            words = text.count(" ") + 1
            f = [("bias", 1.0), ("length", min(1.0, words / 30)), ("links", min(1.0, links / len(text))), (f"own:{self.tags[e]}", 1.0), *[(x, 1.0) for x in around[e]]]
            if text[-1] in ".!?:;…\"»)":
                f.append(("stop", 1.0))
            chain, depth, seen = chains[e], self.depths[e], set()
            while chain:
                weight = DECAY ** (depth - chain[0])
                if weight < 0.01:
                    break
                for mark in chain[1]:
                    if mark not in seen:  # marks of one kind do not add up along a path
                        seen.add(mark)
                        f.append((mark, weight))
                chain = chain[2]
            out.append(f)
        return out


_FOLD = {i: i + 32 for i in range(65, 91)}


def _marks(attrs: str) -> tuple[tuple[str, ...], bool]:
    """Whole words ("c:") of class, id and role, parts of compound ones ("s:"), and whether the element is hidden."""
    words, hidden = set(), False
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden":
                hidden = True
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                for word in value.split():
                    parts = [x.lower() for x in _PART.findall(_HUMP.sub(" ", word))]
                    words.update([f"c:{parts[0]}"] if len(parts) == 1 else [f"s:{x}" for x in parts])
    return tuple(sorted(words)), hidden


def prior(feature: str) -> float:
    """What a feature weighs before pages are seen."""
    kind, _, name = feature.partition(":")
    if kind == "in":
        return 3.0 if name == "article" else 0.0 if name == "article header" else -9.0
    if kind in ("c", "s"):
        return (-9.0 if kind == "c" else -8.5) if name in AWAY else 0.7 if name in HOME else 0.0
    return {"bias": -1.0, "length": 2.5, "links": -3.0, "stop": 0.5, "own:p": 0.3, "own:h1": 0.5}.get(feature, 0.0)


class Classifier:
    """Logistic regression with a Gaussian prior around prior()."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def odds(self, features: list[tuple[str, float]]) -> float:
        w = self.weights
        for f, _ in features:
            if f not in w:
                w[f] = prior(f)
        return sum(w[f] * v for f, v in features)

    @classmethod
    def fit(cls, examples: list[tuple[list[tuple[str, float]], int]]) -> Classifier:
        names = sorted({f for x, _ in examples for f, _ in x})
        if not names or len({y for _, y in examples}) < 2:
            return cls()
        at = {f: i for i, f in enumerate(names)}
        row = np.repeat(np.arange(len(examples)), [len(x) for x, _ in examples])
        col = np.array([at[f] for x, _ in examples for f, _ in x])
        val = np.array([v for x, _ in examples for _, v in x])
        y = np.array([y for _, y in examples], float)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
        start = np.array([prior(f) for f in names])
        w, m, v = start.copy(), np.zeros(len(names)), np.zeros(len(names))
        for step in range(1, EPOCHS + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], len(y)), -30, 30)))
            g = np.bincount(col, ((p - y) * weight)[row] * val, len(names)) + PULL * (w - start)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(dict(zip(names, w.tolist(), strict=True)))


def examples(page: Page, repeated: set[str]) -> list[tuple[list[tuple[str, float]], int]]:
    """Blocks with their distant labels; those that nothing speaks for or against are left out."""
    out, features = [], page.features()
    has_home = any(t in HOME_TAGS for t in page.tags)
    for (text, *_), f in zip(page.blocks, features, strict=True):
        value = dict(f)
        away = any(x for x in value if x[:3] != "in:" and x[:2] in ("c:", "s:") and x[2:] in AWAY) or any(x[:3] == "in:" and prior(x) < 0 for x in value)
        if has_home:
            label = int("in:article" in value and not away)
        elif away or text in repeated or (value["links"] > 0.5 and value["length"] < 0.3):
            label = 0
        elif value["length"] > 0.6 and value["links"] < 0.3:
            label = 1
        else:
            continue
        out.append((f, label))
        if "in:article" in value:
            out.append(([x for x in f if x[0] != "in:article"], label))
    return out


def fit_pages(pages: DataFrame, url: str = "url", html: str = "html") -> Classifier:
    """Trains on a sample of SAMPLE pages at most, chosen by a hash of url and html, of SAMPLE_BYTES at most."""
    rows = pages.select(F.coalesce(F.regexp_extract(F.col(url).cast("string"), "://([^/?#]*)", 1), F.lit("")).alias("host"), F.col(html).cast("string").alias("html"))
    rows = rows.where(F.octet_length("html").between(1, SAMPLE_BYTES))
    some = rows.where(sampled(1.2 * SAMPLE / max(1, rows.count()), "host", "html")).orderBy(F.xxhash64("host", "html"), "host", "html").limit(SAMPLE)
    some = stored(some.select("host", F.md5(F.col("html").cast("binary")).alias("page"), "html"))

    def parse(batches):
        for b in batches:
            for host, page, h in zip(b["host"], b["page"], b["html"], strict=True):
                found = [t for t, *_ in Page(h).blocks]
                if found:
                    yield pd.DataFrame({"host": host, "page": page, "text": found})

    texts = stored(some.mapInPandas(parse, "host string, page string, text string"), TEXT_ROWS)
    size = some.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    often = texts.groupBy("host", "text").agg(F.count_distinct("page").alias("n")).join(size, "host").where("n >= 3 AND 10 * n >= 3 * pages")
    repeated: dict[str, set[str]] = {}
    for r in often.select("host", "text").collect():  # blocks of the sample
        repeated.setdefault(r["host"], set()).add(r["text"])

    def learn(batches):
        for b in batches:
            got = [e for host, h in zip(b["host"], b["html"], strict=True) for e in examples(Page(h), repeated.get(host, set()))]
            if got:
                yield pd.DataFrame({"names": [[f for f, _ in x] for x, _ in got], "values": [[v for _, v in x] for x, _ in got], "label": [y for _, y in got]})

    got = stored(some.select("host", "html").mapInPandas(learn, "names array<string>, values array<double>, label int"), TEXT_ROWS)
    same = got.groupBy("names", "values", "label").agg(F.count("*").alias("n")).orderBy("names", "values", "label").collect()  # of the sample
    return Classifier.fit([(list(zip(r["names"], r["values"], strict=True)), r["label"]) for r in same for _ in range(min(r["n"], 50))])


class Flow:
    """Dinic's maximum flow on a small graph."""

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []

    def edge(self, u: int, v: int, c: float, back: float = 0.0):
        self.head[u].append(len(self.to))
        self.to.append(v)
        self.cap.append(c)
        self.head[v].append(len(self.to))
        self.to.append(u)
        self.cap.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.head)
        level[s], queue = 0, [s]
        for u in queue:
            for e in self.head[u]:
                if self.cap[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while True:
            level = self.levels(s)
            if level[t] < 0:
                return [x >= 0 for x in level]
            it = [0] * len(self.head)
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    least = min(self.cap[e] for e in path)
                    first = 0
                    for i, e in enumerate(path):
                        self.cap[e] -= least
                        self.cap[e ^ 1] += least
                        if self.cap[e] <= 1e-9 and not first:
                            first = i + 1
                    u = self.to[path[first - 1] ^ 1]
                    del path[first - 1 :]
                    continue
                while it[u] < len(self.head[u]):
                    e = self.head[u][it[u]]
                    if self.cap[e] > 1e-9 and level[self.to[e]] == level[u] + 1:
                        break
                    it[u] += 1
                else:
                    if u == s:
                        break
                    level[u] = -1
                    u = self.to[path.pop() ^ 1]
                    continue
                path.append(e)
                u = self.to[e]


def content(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The blocks on the source's side of a least cut.

    A block whose odds outweigh all its edges lies on their side in every least cut; it is
    settled and its edges become odds of its neighbours.  The flow decides about the rest.
    """
    n = len(odds)
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        around[i].append((j, w))
        around[j].append((i, w))
    odds, side = list(odds), [None] * n
    loose = [sum(w for _, w in a) for a in around]
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if side[i] is None and abs(odds[i]) > loose[i]:
            side[i] = odds[i] > 0
            for j, w in around[i]:
                if side[j] is None:
                    odds[j] += w if side[i] else -w
                    loose[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        k = len(rest)
        flow = Flow(k + 2)
        for i in rest:
            if odds[i] > 0:
                flow.edge(k, number[i], odds[i])
            else:
                flow.edge(number[i], k + 1, -odds[i])
        for i, j, w in edges:
            if i in number and j in number:
                flow.edge(number[i], number[j], w, w)
        for i, s in zip(rest, flow.source_side(k, k + 1), strict=False):
            side[i] = s
    return side


def main_text(html: str | None, model: Classifier | None = None) -> str:
    page, model = Page(html or ""), model or Classifier()
    odds = [model.odds(f) for f in page.features()]
    edges, last = [], {}
    for i, (_, e, _, apart) in enumerate(page.blocks):
        if i:
            edges.append((i - 1, i, W_NEXT / (1 + apart)))
        above = page.parents[e]
        if above in last:
            edges.append((last[above], i, W_SIBLING / (1 if last[above] == i - 1 else 2)))
        last[above] = i
    return " ".join(b[0] for b, kept in zip(page.blocks, content(odds, edges), strict=True) if kept)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per page."""
    weights = fit_pages(pages, url, html).weights

    def work(batches):
        model = Classifier(dict(weights))
        for b in batches:
            texts = [main_text(h, model) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    return mapped(rows, work, "page_id long, url string, text string", ids=("page_id",)).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
