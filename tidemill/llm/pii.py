r"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns find email, ip, card and phone spans, leftmost and without overlap, and drop those that fail their
check. A pattern that runs on into the next number fails as a whole, so a card before an address or two
cards in a row are lost to it. The field labels tokens instead (outside, or begin and inside of a kind). Its nodes are tokens with a
digit or an at sign; all other tokens are outside and cut the chain. Neighbouring nodes share a chain potential;
nodes of one document that repeat a token, or its digits, share a skip potential, each with the occurrence before it, so the edges
grow with the tokens. Loopy belief propagation runs over all documents of a batch at once; spans of the most likely labels that
pass the kind's check are added where no pattern's span lies.

The weights are fitted by pseudo-likelihood on at most SAMPLE_DOCS documents of up to SAMPLE_CHARS characters, chosen by a hash, with the
patterns' own spans as labels. Tokens of a failed match over several tokens have no label; a failed match within one token is outside.

Defined cases: null and empty texts have no spans; repeated rows are judged alike; an empty table gives no rows and a model
that labels nothing; other columns are ignored, whatever their names. A text of any length is scanned whole in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table, texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 20_000
#: 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
LABELS = 1 + 2 * len(KINDS)
BUCKETS = 1 << 13
CHAIN, SAME, SAME_DIGITS = range(3)
ROUNDS, DAMPING = 10, 0.3
#: Texts of a Python batch at once, so that long ones do not add up.
TEXTS_AT_ONCE = 500

_DIGITS = re.compile("[0-9]+")
_ACTIVE = re.compile("[0-9@]")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = _LOCAL | frozenset("@()")
_RUNS = re.compile("[0-9]+|[A-Za-z]+|.", re.S)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * x - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(_DIGITS.findall(x))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def valid(kind: int, x: str) -> bool:
    """Whether a whole string passes the check of its kind."""
    if kind == 0:
        local, _, rest = x.partition("@")
        return bool(local) and _LOCAL.issuperset(local) and _AFTER_AT.fullmatch(rest) is not None
    if kind == 1:
        return _IP.fullmatch(x) is not None and all(map(_octet, x.split(".")))
    n = len(d := _digits(x))
    return 16 <= n <= 19 and luhn(d) if kind == 2 else 8 <= n <= 15


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes) of the patterns' matches by kind, then start. Each pattern is tried only where its
    first character can stand, which gives the leftmost matches: a number's later digits lead to the same end."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _AFTER_AT.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end(), True))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    runs = [m.start() for m in _DIGITS.finditer(text)]
    for kind, pattern in ((1, _IP), (2, _CARD)):
        end = 0
        for s in runs:
            if s >= end and (m := pattern.match(text, s)):
                end = m.end()
                out.append((kind, s, end, valid(kind, m[0])))
    end, at = 0, text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            end = m.end()
            out.append((3, at, end, valid(3, m[0])))
        at = text.find("+", max(at + 1, end))
    return out


def nodes(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or an at sign."""
    out, end = [], 0
    hit = _ACTIVE.search(text)
    while hit:
        start, stop = hit.start(), hit.end()
        while start > end and text[start - 1] in _TOKEN:
            start -= 1
        while stop < len(text) and text[stop] in _TOKEN:
            stop += 1
        out.append((start, stop))
        end = stop
        hit = _ACTIVE.search(text, stop)
    return out


def _size(n: int) -> int:
    return n if n < 4 else 4 if n < 8 else 8 if n < 16 else 16 if n < 20 else 20


def features(token: str) -> list[int]:
    """Buckets of what a token looks like; its neighbours speak through the potentials."""
    d = _digits(token)
    runs = _RUNS.findall(token)
    shape = "".join(f"{min(len(r), 20)}d" if r[0].isdigit() else "a" if r[0].isalpha() else r for r in runs)
    coarse = "".join("9" if r[0].isdigit() else "a" if r[0].isalpha() else r for r in runs)
    number = "luhn" if 16 <= len(d) <= 19 and luhn(d) else str(_size(len(d)))
    quad = "quad" if valid(1, token.strip(".")) else "dots" if token.count(".") == 3 else ""
    letters = _size(sum(len(r) for r in runs if r[0].isalpha()))
    told = (
        "", f"shape {shape}", f"coarse {coarse}", f"number {number}", f"quad {quad}", f"at {valid(0, token.strip('.'))} {'@' in token}",
        f"first {coarse[0]}", f"last {coarse[-1]}", f"letters {letters}", f"{coarse} {number} {quad}", f"{letters} {number} {'@' in token}",
    )
    return [xxhash.xxh32_intdigest(f"{i}{t}") % BUCKETS for i, t in enumerate(told)]


N_FEATURES = 11


@dataclass
class Graph:
    """Nodes of many texts, with edges (from, to, kind) where from stands before to."""

    text: list[int] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)

    def add(self, number: int, text: str, matches: list | None = None) -> None:
        first, last = len(self.spans), {}
        for start, end in nodes(text):
            i, token = len(self.spans), text[start:end]
            if i > first and 0 < start - self.spans[-1][1] <= 2 and text[self.spans[-1][1] : start].isspace():
                self.edges.append((i - 1, i, CHAIN))
            digits = _digits(token)
            for kind, key in ((SAME, token), (SAME_DIGITS, digits if len(digits) > 3 else "")):
                if key and (j := last.get((kind, key))) is not None and not (kind == SAME_DIGITS and last.get((SAME, token)) == j):
                    self.edges.append((j, i, kind))
            last[SAME, token] = last[SAME_DIGITS, digits] = i
            self.text.append(number)
            self.spans.append((start, end))
            self.features.append(features(token))
        if matches is not None:
            self.labels += _gold(self.spans[first:], matches)


def _gold(spans: list[tuple[int, int]], matches: list) -> list[int]:
    """Labels of tokens by the patterns' matches; -1 where they do not tell."""
    out = [0] * len(spans)
    starts = np.array([s for s, _ in spans], np.int64)
    for failed in (True, False):
        for kind, a, b, ok in reversed(matches):
            if ok == failed:
                continue
            i = max(int(np.searchsorted(starts, a, "right")) - 1, 0)
            inside = []
            while i < len(spans) and spans[i][0] < b:
                if spans[i][1] > a:
                    inside.append(i)
                i += 1
            for k, i in enumerate(inside):
                if ok:
                    out[i] = 1 + 2 * kind + (k > 0)
                elif len(inside) > 1:
                    out[i] = -1
    return out


@dataclass
class Model:
    unary: np.ndarray
    #: potentials of the three kinds of edges, before x after; skip potentials are symmetric
    pair: np.ndarray


def fit_graph(g: Graph, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Pseudo-likelihood: each labelled token given its labelled neighbours, Adam over all of them."""
    model = Model(np.zeros((BUCKETS, LABELS)), np.zeros((3, LABELS, LABELS)))
    gold = np.array(g.labels, np.int64)
    known = np.flatnonzero(gold >= 0)
    if not len(known):
        return model
    feats = np.array(g.features, np.int64).reshape(len(gold), N_FEATURES)
    e = np.array(g.edges, np.int64).reshape(-1, 3)
    e = e[(gold[e[:, 0]] >= 0) & (gold[e[:, 1]] >= 0)]
    a, b, kind = e.T
    params = [model.unary, model.pair]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one_hot = np.eye(LABELS)[np.maximum(gold, 0)]
    for t in range(1, steps + 1):
        logits = model.unary[feats].sum(axis=1)
        np.add.at(logits, b, model.pair[kind, gold[a]])
        np.add.at(logits, a, model.pair[kind, :, gold[b]])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        err = p / p.sum(axis=1, keepdims=True) - one_hot
        err[gold < 0] = 0
        err /= len(known)
        grads = [np.zeros_like(p) for p in params]
        for k in range(N_FEATURES):
            np.add.at(grads[0], feats[:, k], err)
        np.add.at(grads[1], (kind, gold[a]), err[b])
        np.add.at(grads[1].transpose(0, 2, 1), (kind, gold[b]), err[a])
        skip = grads[1][1:]
        grads[1][1:] = (skip + skip.transpose(0, 2, 1)) / 2
        for p, grad, m, v in zip(params, grads, first, second):
            grad += decay * p
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def beliefs(g: Graph, model: Model, rounds: int = ROUNDS) -> np.ndarray:
    """Log beliefs of the nodes after loopy sum-product messages; exact where a document's graph is a tree of depth under ``rounds``."""
    unary = model.unary[np.array(g.features, np.int64).reshape(-1, N_FEATURES)].sum(axis=1)
    if not g.edges:
        return unary
    a, b, kind = np.array(g.edges, np.int64).T
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    potential = np.concatenate([model.pair[kind], model.pair[kind].transpose(0, 2, 1)])
    n, back = len(a), np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    messages = np.zeros((2 * n, LABELS))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, target, messages)
        new = _log_sum((total[source] - messages[back])[:, :, None] + potential, 1)
        new -= _log_sum(new, 1)[:, None]
        moved = np.abs(new - messages).max()
        messages = DAMPING * messages + (1 - DAMPING) * new
        if moved < 1e-6:
            break
    total = unary
    np.add.at(total, target, messages)
    return total


_TRIMMED = (".-_%+()", ".-_%+()@", "._%+()@-", " .-_%")


def added(g: Graph, model: Model, texts_of: list[str], bases: list[list]) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) for each text that the field adds to those of the patterns."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts_of]
    if not g.spans:
        return out
    labels = beliefs(g, model).argmax(axis=1).tolist()
    chained = {b for a, b, kind in g.edges if kind == CHAIN}
    runs: list[tuple[int, int, int, int]] = []
    for i, label in enumerate(labels):
        if not label:
            continue
        kind, goes_on = (label - 1) // 2, label % 2 == 0
        if goes_on and valid(kind, texts_of[g.text[i]][slice(*g.spans[i])].strip(_TRIMMED[kind])):
            goes_on = False  # whole by itself, as the second of two cards in a row
        if goes_on and runs and i in chained and labels[i - 1] and runs[-1][1] == kind and runs[-1][3] == g.spans[i - 1][1]:
            runs[-1] = (*runs[-1][:3], g.spans[i][1])
        else:
            runs.append((g.text[i], kind, *g.spans[i]))
    for number, kind, start, end in runs:
        token = texts_of[number][start:end]
        start += len(token) - len(token.lstrip(_TRIMMED[kind] if kind < 3 else " .-_%)"))
        token = texts_of[number][start:end].rstrip(_TRIMMED[kind] + ("+(" if kind == 3 else ""))
        end = start + len(token)
        if valid(kind, token) and not any(s < end and start < e for _, s, e, ok in bases[number] if ok):
            out[number].append((kind, start, end))
    return out


# ---- over tables ------------------------------------------------------------------------------------


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Weights from a bounded sample of the documents that have a digit or an at sign."""
    hit = texts(docs).filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= sample_chars)).select("text")
    # so many parts of the hash range that one holds about twice the sample, and tasks send little more than the driver keeps
    parts = max(1, hit.count() // (2 * sample_docs))
    some = hit.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).distinct()
    g = Graph()
    for i, r in enumerate(some.orderBy(F.xxhash64("text"), "text").limit(sample_docs).collect()):
        g.add(i, r.text, base_matches(r.text))
    return fit_graph(g)


FOUND = "doc_id long, found array<struct<kind: int, start: long, end: long, base: boolean>>"
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, found: all spans of a text by kind, then start; base tells those of the patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                b = whole.slice(at, TEXTS_AT_ONCE)
                held = [x.as_py() for x in b.column("text")]
                g, bases = Graph(), []
                for i, text in enumerate(held):
                    active = _ACTIVE.search(text)
                    bases.append(base_matches(text) if active else [])
                    if active:
                        g.add(i, text)
                more = added(g, model, held, bases)
                rows = [sorted([(k, s, e, True) for k, s, e, ok in base if ok] + [(*x, False) for x in new]) for base, new in zip(bases, more)]
                found = pa.array([[dict(zip(("kind", "start", "end", "base"), x)) for x in r] for r in rows], _FOUND)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), found], ["doc_id", "found"])

    return texts(docs).mapInArrow(run, FOUND)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = F.array(*map(F.lit, KINDS))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans(docs, fit(docs)).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
