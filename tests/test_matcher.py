"""Phrase matches of whole batches against the walk over one list, and large lexicons."""

import random
import tracemalloc

import pyarrow as pa

from tidemill.operators import compliance
from tidemill.operators import matcher
from tidemill.operators.matcher import Batch, Phrases


def _both(phrases, rows):
    b = Batch(pa.array(rows, pa.list_(pa.string())))
    stops, size = b.match(Phrases(phrases))
    good, bad = (b.lists(b.texts(stops[of], size[of]), b.row[stops[of]]).to_pylist() for of in (size > 0, size == 0))
    return list(zip(good, bad)), [compliance.longest_match(r or [], phrases, 5) for r in rows]


def test_batches_match_as_single_lists():
    rng = random.Random(3)
    for _ in range(1500):
        phrases = frozenset(" ".join(rng.choice("ABCDé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(9)))
        rows = [None if rng.random() < 0.1 else [rng.choice("ABCDEé") for _ in range(rng.randrange(12))] for _ in range(rng.randrange(6))]
        got, want = _both(phrases, rows)
        assert got == want, (phrases, rows)


def test_slices_and_phrases_that_cross_rows():
    lists = pa.array([["X"], ["A", "B"], ["A"], ["B"]], pa.list_(pa.string())).slice(1)
    b = Batch(lists)
    stops, size = b.match(Phrases({"A B"}))
    assert size.tolist() == [2, 0, 0] and b.row[stops].tolist() == [0, 1, 2]


def test_large_lexicon():
    phrases = [f"W{i % 1000} V{i // 1000} U{i % 7}" for i in range(300_000)] + ["W1"]
    got, _ = _both(frozenset(phrases), [["W1", "V299", f"U{299001 % 7}", "W1", "V5", "x"]])
    assert got == [([f"W1 V299 U{299001 % 7}", "W1"], ["V5", "x"])]


def test_column_functions(spark):
    phrases = frozenset({"SET UP", "IT"})
    df = spark.createDataFrame([(["SET", "UP", "X", "IT"],), ([],), (None,)], "t array<string>")
    got = [tuple(r.m) for r in df.select(compliance.match(spark, phrases)("t").alias("m")).collect()]
    assert got == [(["SET UP", "IT"], ["X"]), ([], []), ([], [])]
    rate = compliance.naive(spark, phrases)
    terms = spark.createDataFrame([("b set up 12 a it b", ["a"]), ("b set up 12 a it b", ["b"]), ("a a", ["a"]), ("z y z", None)], "t string, terms array<string>")
    got = [(r.c.rate, r.c.words) for r in terms.select(rate(terms.t, terms.terms).alias("c")).collect()]
    assert got == [(3 / 5, ["B"]), (3 / 4, ["A"]), (None, []), (0.0, ["Y", "Z"])]


def test_slices_cover_all_rows():
    rng = random.Random(5)
    for n in (0, 1, 40):
        rows = [rng.choice([None, [], ["a"] * rng.randrange(30)]) for _ in range(n)]
        got = list(matcher.parts(pa.array(rows, pa.list_(pa.string())), 20))
        assert [i for at, k in got for i in range(at, at + k)] == list(range(n))
        assert all(k <= 1 or sum(len(r or []) for r in rows[at : at + k]) <= 20 for at, k in got)


def test_memory_does_not_grow_with_the_batch(spark):
    phrases = frozenset({"A B", "C"})
    rate, match = compliance.naive(spark, phrases), compliance.match(spark, phrases)
    run = next(c.cell_contents for c in rate.__closure__ if hasattr(c.cell_contents, "func"))
    terms = pa.array([["D"]], pa.list_(pa.string()))

    def peak(n):
        lists = pa.array([["A", "B", "C", "D", "E"] * 200], pa.list_(pa.string())).take(pa.array([0] * n))
        tracemalloc.start()
        (rated,), (found,) = run.func(iter([(lists, terms.take(pa.array([0] * n)))])), match.func(iter([lists]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rated.to_pylist() == [{"rate": 3 / 4, "words": ["E"]}] * n
        assert found.to_pylist() == [{"conforming": ["A B", "C"] * 200, "nonconforming": ["D", "E"] * 200}] * n
        return most

    assert peak(1600) < 1.5 * peak(400)
