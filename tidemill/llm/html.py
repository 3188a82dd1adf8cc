"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into text blocks. A classifier says for each how likely it is content: its log odds are
the sum of a part for the block's own text, position and tags, which is fitted, and of a part for the
marks that the page itself sets around it (article, nav, class names and the like), which is a
written table. The log odds are the capacities to the two terminals. Neighbouring blocks, and
blocks under one parent, are tied by edges whose capacity falls with the distance in the document
tree, so blocks with weak odds of their own go with those around them. The maximum flow gives the
cheapest labelling, and the blocks on the content side are the main text.

No page is labelled by hand. The fitted part is a logistic model whose labels are the blocks that
pages themselves mark as article or as boilerplate; these marks are therefore no input of it. It is
trained on at most BLOCKS blocks by page of at most PAGES pages, taken by the order of a hash, and is
drawn to a written prior as if that were EVIDENCE blocks strong at least half, so that few or
one-sided pages do no harm.

Defined cases: null or empty html, and pages without content, give an empty text; repeated rows are
repeated; an empty table gives no rows; other columns are ignored, whatever their names. ``br`` is
white space inside a block. A very long page is cut in two passes over its tokens and its tree is kept as parents
alone. An advert inside a paragraph is a block of its own, and the paragraph goes on around it. A tag that is never closed hides nothing but where the standard says so (script, style,
comment); text in such an element, or in one that is not shown, is no text of the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import sliced, table

BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not shown, up to their own end tag if they have one.
SILENT = frozenset("noscript template iframe svg object canvas audio video select button textarea title".split())
#: Of these, elements that hold no blocks: one of the tags below ends them, so an unclosed one hides no article.
PHRASING = frozenset("svg select button textarea title".split())
BREAKOUT = frozenset("article aside blockquote body footer h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split())
#: Inline elements that may be set apart inside a block, and the words that set them apart.
INLINE = frozenset("a abbr b em font i ins label mark q s small span strong sub sup u".split())
INLINE_BAD = frozenset("ad ads advert adverts advertisement advertising banner newsletter outbrain promo promoted signup sponsor sponsored subscribe taboola".split())
#: What may stand in a head; any other start tag ends it.
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style)(?=[\s/>])(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^<>])*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^<>])*+)>|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ARTICLE_TAGS = frozenset(("article", "main"))
BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset legend search".split())
#: Words in a class, id or role.
BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus dialog disclaimer discussion discussions footer gdpr header legal links login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted related recommended reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar toc widget".split())
READER_NAMES = frozenset("comment comments commentlist discussion discussions disqus replies reply respond responses".split())
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())
#: Log odds for the page's own marks around a block; they are the training labels and are not fitted.
ARTICLE, BAD_TAG, BAD_NAME, GOOD_NAME = 3.0, -12.0, -12.0, 1.0
#: Features of a block's own text and the log odds they have before any page is seen.
PRIOR = {"bias": -1.0, "long": 2.0, "longer": 2.0, "linked": -4.0, "sentence": 0.5, "marks": 0.5, "heading": 0.5, "paragraph": 1.5, "item": -0.5, "cell": -0.5, "edge": -0.5}
#: Bounds of the training sample, and how many blocks at most speak against the prior.
PAGES, BLOCKS, EVIDENCE = 200, 64, 200
#: Capacity of a tie between neighbours in the page at distance 0, and between neighbours under one parent.
TIE, SIBLING = 3.0, 1.0
HEADINGS, PARAGRAPHS, ITEMS, CELLS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p blockquote pre".split()), frozenset("li dt dd option".split()), frozenset("td th caption".split())


@dataclass(slots=True)
class Node:
    """An open element: what holds of all that is inside it."""

    tag: str
    number: int
    parent: int
    article: bool = False
    bad: bool = False
    bad_name: bool = False
    good_name: bool = False
    silent: bool = False
    form: int = 0


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    node: Node
    depth: int
    #: depth of the element that holds this block and the one before
    joint: int


def _inside(up: Node, tag: str, attrs: str, number: int) -> Node:
    words = _attr_words(attrs) if attrs else ()
    article = up.article or tag in ARTICLE_TAGS
    bad_words = BAD_NAMES.intersection(words)
    good = bool(GOOD_NAMES.intersection(words))
    if tag in ("html", "body", "main"):
        bad_words = frozenset()
    elif tag == "article":
        bad_words &= READER_NAMES
    elif good and tag in PARAGRAPHS:
        bad_words &= INLINE_BAD
    elif article or good:
        bad_words -= {"header"}
    bad = tag in BAD_TAGS and tag != "form" and not (tag == "header" and article)
    form = number if tag == "form" else 0 if tag in ARTICLE_TAGS else up.form
    return Node(tag, number, up.number, article, up.bad or bad, up.bad_name or bool(bad_words), up.good_name or good, up.silent or tag in SILENT, form)


def _attr_words(attrs: str) -> set[str]:
    return {w for g in NAMES.findall(attrs) for w in re.split(r"[^a-z]+", "".join(g).lower())}


def _ends(tokens: list[re.Match], wanted: frozenset[str]) -> set[int]:
    """Numbers of the start tags that have an end tag of their own: an end tag belongs to the last start tag before it
    that has none. A self-closed svg is empty, and a block ends an open element that holds none."""
    open_: dict[str, list[int]] = {}
    out: set[int] = set()
    for i, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if tag in BREAKOUT:
            for t in PHRASING:
                open_.pop(t, None)
        elif tag in wanted:
            if m["close"]:
                if open_.get(tag):
                    out.add(open_[tag].pop())
            elif not (tag == "svg" and m["attrs"].endswith("/")):
                open_.setdefault(tag, []).append(i)
    return out


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. An element knows its parent and what holds inside it; an inline element that is set apart is
    a block of its own, behind the one that it stands in."""
    out: list[Block] = []
    aside: list[Block] = []
    stack = [Node("", 0, 0)]
    pieces: list[str] = []
    outer: list[tuple[list[str], int]] = []
    opened: dict[str, int] = {}
    number = linked = low = link = 0

    def flush() -> None:
        nonlocal linked, low
        while outer:  # a block ends what is set apart
            leave()
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, linked, stack[-1], len(stack), low))
                low = len(stack)
            pieces.clear()
            linked = 0
        for x in aside:
            x.joint = min(low, len(stack))
            out.append(x)
            low = len(stack)
        aside.clear()

    def leave() -> None:
        nonlocal pieces, linked
        node = stack.pop()
        opened[node.tag] -= 1
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            aside.append(Block(text, linked, node, len(stack) + 1, len(stack)))
        pieces, linked = outer.pop()

    def close(tag: str) -> None:
        nonlocal low, link
        while True:
            top = stack.pop()
            opened[top.tag] -= 1
            if top.tag == tag:
                break
        low, link = min(low, len(stack)), link if link <= len(stack) else 0

    tokens = list(TOKEN.finditer(page))
    closed = _ends(tokens, SILENT | INLINE)
    for i, m in enumerate(tokens):
        if (text := m["text"]) is not None:
            if not stack[-1].silent:
                pieces.append(text)
                linked += len(text.strip()) if link else 0
            continue
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "a":
                link = 0
            if outer and stack[-1].tag == tag:
                leave()
            elif tag not in INLINE and opened.get(tag):
                flush()
                close(tag)
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if opened.get("head") and tag not in HEAD_TAGS:
            close("head")
        if tag == "a":
            link = len(stack)
        if tag == "br":
            pieces.append(" ")
        elif tag in INLINE:
            if i in closed and not stack[-1].silent and not stack[-1].bad_name and m["attrs"] and INLINE_BAD.intersection(_attr_words(m["attrs"])):
                number += 1
                outer.append((pieces, linked))
                pieces, linked = [], 0
                stack.append(_inside(stack[-1], tag, m["attrs"], number))
                opened[tag] = opened.get(tag, 0) + 1
        elif tag == "head" or tag in SILENT:
            # without an end tag of its own it would hide the rest of the page
            if tag == "head" or i in closed:
                number += 1
                stack.append(Node(tag, number, stack[-1].number, silent=True))
                opened[tag] = opened.get(tag, 0) + 1
        elif tag in BLOCK_TAGS:
            flush()
            if tag not in VOID:
                top = stack[-1].tag
                if top == "p" or top == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(top)
                number += 1
                stack.append(_inside(stack[-1], tag, m["attrs"], number))
                opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row for each block in the order of PRIOR."""
    out = np.zeros((len(found), len(PRIOR)))
    for i, b in enumerate(found):
        n, tag = len(b.text), b.node.tag
        out[i] = (
            1.0, min(1.0, n / 60), min(1.0, n / 300), min(1.0, b.linked / n), b.text[-1] in ".!?\u2026\u3002", min(1.0, 20 * sum(map(b.text.count, ",.;:")) / n),
            tag in HEADINGS, tag in PARAGRAPHS, tag in ITEMS, tag in CELLS, abs(2 * (i + 0.5) / len(found) - 1),
        )
    return out


def _forms(found: list[Block]) -> set[int]:
    """Forms that hold less than half of the page's text; one around a whole page is no form to fill in."""
    size: dict[int, int] = {}
    for b in found:
        size[b.node.form] = size.get(b.node.form, 0) + len(b.text)
    total = sum(size.values())
    return {f for f, n in size.items() if f and 2 * n < total}


def marks(found: list[Block]) -> np.ndarray:
    """Log odds by the page's own marks."""
    forms = _forms(found)
    return np.array([ARTICLE * b.node.article + BAD_TAG * (b.node.bad or b.node.form in forms) + BAD_NAME * b.node.bad_name + GOOD_NAME * b.node.good_name for b in found])


def odds(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """Log odds of content, the capacities to the terminals."""
    return features(found) @ weights + marks(found)


def reduced(costs: list[float], ties: list[tuple[int, int, float]]) -> tuple[list[float], list[tuple[int, int, float]], list[bool | None]]:
    """Settles the nodes whose own odds outweigh all their ties: a cheapest labelling gives them their own
    sign, whatever the others have. A settled node's ties become odds of its neighbours, and so on."""
    costs, fixed = list(costs), [None] * len(costs)
    near: list[dict[int, float]] = [{} for _ in costs]
    for a, b, c in ties:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    weight = [sum(x.values()) for x in near]
    queue = deque(range(len(costs)))
    while queue:
        i = queue.popleft()
        if fixed[i] is not None or abs(costs[i]) <= weight[i] + 1e-9 and near[i]:
            continue
        fixed[i] = costs[i] > 0
        for j, c in near[i].items():
            del near[j][i]
            weight[j] -= c
            costs[j] += c if fixed[i] else -c
            queue.append(j)
        near[i] = {}
    return costs, [(a, b, c) for a, x in enumerate(near) for b, c in x.items() if a < b], fixed


def min_cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: True where a node stays on the source's side. Shortest augmenting paths in layers."""
    costs, ties, fixed = reduced(costs, ties)
    n = len(costs)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float = 0.0) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs):
        if fixed[i] is None:
            edge(s, i, c) if c > 0 else edge(i, t, -c)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 if f is None else f for i, f in enumerate(fixed)]
        at, path, x = [0] * (n + 2), [], s
        while True:  # a blocking flow, without recursion
            if x == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, x = [], s
            elif at[x] < len(out[x]):
                e = out[x][at[x]]
                if room[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                else:
                    at[x] += 1
            elif x == s:
                break
            else:
                x = to[path.pop() ^ 1]
                at[x] += 1


def labels(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    ties, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            ties.append((i - 1, i, TIE / (1 + a.depth + b.depth - 2 * b.joint)))
        parent = b.node.parent
        if (j := last.get(parent)) is not None:
            ties.append((j, i, SIBLING))
        last[parent] = i
    return min_cut(odds(found, weights).tolist(), ties)


def main_text(page: str, weights: np.ndarray | None = None) -> str:
    found = blocks(page)
    keep = labels(found, np.array(list(PRIOR.values())) if weights is None else weights) if found else []
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def trained(rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of the logistic model by Newton's method, both labels weighing alike."""
    prior = np.array(list(PRIOR.values()))
    if not 0 < label.sum() < len(label):
        return prior
    share = min(len(label), EVIDENCE) / 2
    weight, w = np.where(label == 1, share / (label == 1).sum(), share / (label == 0).sum()), prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (weight * (p - label)) + (w - prior)
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + np.eye(len(w)), grad)
        w -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit(pages: DataFrame) -> np.ndarray:
    """Weights from a sample of bounded size; its features alone reach the driver."""
    mark = F.xxhash64(F.col("page_id").cast("long"), F.col("url").cast("string"))
    picked = pages.select(mark.alias("mark")).orderBy("mark").limit(PAGES).agg(F.max("mark")).first()[0]
    if picked is None:
        return np.array(list(PRIOR.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(1):
                found = blocks(page.as_py() or "")
                said = marks(found)
                sure = np.flatnonzero((said >= ARTICLE) | (said < 0))
                sure = sure[:: -(-len(sure) // BLOCKS)] if len(sure) else sure
                rows = features(found)[sure]
                out += [[float(said[i] > 0), *map(float, x)] for i, x in zip(sure.tolist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], ["x"])

    sample = pages.select(mark.alias("mark"), "html").filter(F.col("mark") <= picked).orderBy("mark", F.xxhash64("html")).limit(PAGES)
    rows = sorted(tuple(r.x) for r in sample.mapInArrow(run, "x array<double>").collect())
    table_ = np.array(rows).reshape(len(rows), 1 + len(PRIOR))
    return trained(table_[:, 1:], table_[:, 0])


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one pass over the pages, no shuffle, after ``fit`` on their sample."""
    weights = fit(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [main_text(h.as_py() or "", weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
