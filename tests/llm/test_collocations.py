"""Collocations against plain counting, over shards of any size, and the defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import collocations as C


def _plain(rows, least, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        if any(100 * b >= C.COVER_PERCENT * a for (m, q), b in candidates.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out.sort()
    ranked, at = [], Counter()
    for lang, score, a, p, left, right in out:
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], p.decode(), -a, left, right, total[lang], -score))
    return ranked


def _rows(n=120):
    rng = random.Random(3)
    words = ["Ab", "cd", "é", "Éf", "x\x01y", "ß", "zz", "q", "r", "日本"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(words) if rng.random() < 0.8 else rng.choice(["ab cd zz q", "cd zz q r", "é ß é ß é"]) for _ in range(rng.randrange(0, 30))]
        rows.append((rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", "\t", "  ", ", ", ".", "\n", "\x0b", " "]) for p in parts)))
    return rows + [("en", ""), ("en", None), (None, "?!"), ("fr", " .. "), ("en", "ab cd " * 3000)] + [("de", "one two three four five.")] * 9


@pytest.mark.parametrize("shard_words", [50, C.SHARD_WORDS])
def test_equals_plain_counting(spark, shard_words):
    rows = _rows()
    df = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, words int").repartition(5)
    got = sorted(tuple(r) for r in C.collocations(df, 40, 5, shard_words).collect())
    assert got == sorted(_plain(rows, 5, 40))


def test_intervals_count_every_phrase():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 50, 400):
        ids = np.array([rng.randrange(4) for _ in range(n)], np.int64)
        ahead = np.concatenate([ids[1:], [0]]) if n else ids
        pairs = (ids > 0) & (ahead > 0)
        for depths in ((2,), (3, 4), (2, 3, 4)):
            got = {}
            for k, at, count in C.intervals(ids, pairs, depths):
                got |= {tuple(ids[a : a + k].tolist()): c for a, c in zip(at, count)}
            want = Counter(tuple(ids[i : i + k].tolist()) for k in depths for i in range(n - k + 1) if 0 not in ids[i : i + k])
            assert got == want


def test_wrong_bits_change_nothing(spark, monkeypatch):
    """A bitmap that lets everything through gives the same rows."""
    rows = _rows(40)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = sorted(map(tuple, C.collocations(df, 40, 4).collect()))
    monkeypatch.setattr(C, "_bitmap", lambda keys: b"\xff" * (C.FILTER_BITS // 8))
    assert sorted(map(tuple, C.collocations(df, 40, 4).collect())) == want


def test_score_is_exact_past_64_bits(spark):
    big = 4_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 3), ("en", 2, "a b", big - 7)], "lang string, words int, phrase string, n long")
    (r,) = C.scored(counts).collect()
    assert (r.a, r.l, r.r, r.score) == (big - 7, big, big + 3, 2000000 * (big - 7) // (2 * big + 3))
    assert C.uncovered(C.scored(counts)).count() == 1


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0
