"""Personal data: the patterns against Python's own matching, the field against exact sums, planted spans and defined cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidemill.llm import pii as P

PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _passes(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == 1:
        return all(int(p) <= 255 for p in x.split("."))
    if kind == 2:
        odd, even = [int(c) for c in d[-1::-2]], [int(c) for c in d[-2::-2]]
        return 16 <= len(d) <= 19 and (sum(odd) + sum(sum(map(int, str(2 * c))) for c in even)) % 10 == 0
    return kind == 0 or 8 <= len(d) <= 15


def _plain(text):
    return [(k, m.start(), m.end(), _passes(k, m[0])) for k, p in enumerate(PATTERNS) for m in p.finditer(text)]


def test_patterns_are_pythons():
    rng = random.Random(1)
    for _ in range(30_000):
        x = "".join(rng.choice("01+ -.@a()é%2") for _ in range(rng.randrange(30)))
        assert P.base_matches(x) == _plain(x), x


@pytest.mark.parametrize("text", ["1" * 300_000, "a@" * 100_000, "+1" * 100_000, "a" * 300_000 + "@", "1." * 100_000, "+1" + " " * 300_000, "+1 ." * 60_000])
def test_long_runs_stay_linear(text):
    g = P.Graph()
    g.add(0, text, P.base_matches(text))
    assert len(g.labels) == len(g.spans)


def _random_graph(rng, n, edges):
    g = P.Graph(text=[0] * n, spans=[(3 * i, 3 * i + 2) for i in range(n)], edges=edges)
    g.features = [[rng.randrange(P.BUCKETS) for _ in range(P.N_FEATURES)] for _ in range(n)]
    return g


def test_beliefs_on_a_tree_are_exact():
    rng, r = random.Random(2), np.random.default_rng(2)
    model = P.Model(r.normal(size=(P.BUCKETS, P.LABELS)) / 3, r.normal(size=(3, P.LABELS, P.LABELS)))
    g = _random_graph(rng, 4, [(0, 1, P.CHAIN), (1, 2, P.SAME), (1, 3, P.SAME_DIGITS)])
    unary = model.unary[np.array(g.features)].sum(axis=1)
    want = np.zeros((4, P.LABELS))
    for y in itertools.product(range(P.LABELS), repeat=4):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(model.pair[k, y[a], y[b]] for a, b, k in g.edges))
        for i in range(4):
            want[i, y[i]] += w
    got = np.exp(P.beliefs(g, model, 200))
    assert np.allclose(got / got.sum(axis=1, keepdims=True), want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_repeats_share_an_edge_each():
    g = P.Graph()
    g.add(0, "4111111111111111 x 4111111111111111 y 4111-1111-1111-1111 z " * 50)
    assert len(g.edges) < 3 * len(g.spans)
    assert {k for _, _, k in g.edges} == {P.SAME, P.SAME_DIGITS}


def _card(rng):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if P.luhn(d + c))


def _item(rng, kind):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return [
        lambda: f"u{n(2)}.{rng.choice('abcd')}@mail{n(1)}.example.com", lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        lambda: _card(rng), lambda: f"+1 ({n(3)}) 555-{n(4)}",
    ][kind]()


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(4), []
    for i in range(600):
        words = [rng.choice(["some", "plain", "words", "of", "text", "no.", "version 3.0", "in 2019,", "page 12"]) for _ in range(40)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(40)] = _item(rng, rng.randrange(4))
        rows.append((i, " ".join(words), "x"))
    df = spark.createDataFrame(rows, "doc_id int, text string, found string")
    return rows, df, P.fit(df)


def test_field_adds_what_patterns_lose(spark, corpus):
    _, _, model = corpus
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(200):
        a, b = rng.choice([(2, 2), (2, 1), (1, 2), (3, 1), (3, 2)])
        x, y = _item(rng, a), _item(rng, b)
        text = f"plain words {x} {y} of text"
        rows.append((i, text))
        want[i] = {(a, 12, 12 + len(x)), (b, 13 + len(x), 13 + len(x) + len(y))}
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.found} for r in P.spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    lost = sum(len(want[i] - {(k, s, e) for k, s, e, ok in _plain(t) if ok}) for i, t in rows)
    assert lost > 50
    assert sum(len(want[i] - got[i]) for i in want) <= lost * 0.05
    assert sum(len(got[i] - want[i] - {(k, s, e) for k, s, e, ok in _plain(t) if ok}) for i, t in rows) == 0


def test_clean_texts_stay_clean(spark, corpus):
    rows, df, model = corpus
    clean = spark.createDataFrame([(0, "version 3.0 of 2019, page 12, no. 7 a@b 1.2.3 +1 2 300.1.1.1 4111111111111112"), (1, None), (2, ""), (3, "é")], "doc_id long, text string")
    assert all(not r.found for r in P.spans(clean, model).collect())
    for r in P.spans(df, model).collect():
        assert [(s.kind, s.start, s.end) for s in r.found if s.base] == [m[:3] for m in _plain(rows[r.doc_id][1]) if m[3]]


def test_query_against_plain_matching(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = P.op11_pii(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = [f"{P.KINDS[k]}:{s}:{e}" for k, s, e, ok in _plain(docs[r.doc_id]) if ok]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in P.KINDS]


def test_empty_table_and_no_sample(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.spans(none, P.fit(none)).count() == 0
    one = spark.createDataFrame([(1, "4111111111111111 4111111111111111")], "doc_id long, text string")
    assert P.spans(one, P.fit(none)).collect()[0].found == []
