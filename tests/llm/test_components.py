"""Connected components against a plain search, and the rows that are joined for them."""

from __future__ import annotations

import random

import pytest

from tidemill.llm import components

RNG = random.Random(51)
#: Of each id the links to many leaders, as the bands of a large group of near copies give them.
FAMILY = [(RNG.randrange(40) * 7, k) for k in range(300) for _ in range(20)]
#: Odd ids in a long path out of order, even ids in one where every second is a local minimum.
PATHS = [(a * 2 + k, b * 2 + k) for k, ids in enumerate((RNG.sample(range(64), 64), [x for p in zip(range(30), range(59, 29, -1), strict=True) for x in p])) for a, b in zip(ids, ids[1:])]
GRAPHS = {"family": FAMILY, "paths": PATHS, "sparse": [(RNG.randrange(200), RNG.randrange(200)) for _ in range(120)] + [(None, 3), (4, None), (5, 5)], "hub": [(1000, k) for k in range(50)] + [(2000, 1000)], "none": []}


def searched(edges):
    near = {}
    for a, b in edges:
        if None not in (a, b) and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for i in sorted(near):
        todo = [i] if i not in out else []
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = i
                todo += near[x]
    return out


@pytest.mark.parametrize("name", GRAPHS)
def test_components_equal_a_search(spark, name):
    got = components.components(spark.createDataFrame(GRAPHS[name], "a long, b long")).collect()
    assert len(got) == len({r.id for r in got}) and {r.id: r.component for r in got} == searched(GRAPHS[name])


def test_components_do_not_join_all_edges_in_each_round(spark, monkeypatch):
    """A group's links are joined once by each end at most while they are as many as at first, whatever the rounds."""
    rows, plain = [], components.by_key
    monkeypatch.setattr(components, "by_key", lambda left, *a: (rows.append(left.count()), plain(left, *a))[1])
    edges = {(min(x), max(x)) for x in FAMILY if x[0] != x[1]}
    components.components(spark.createDataFrame(FAMILY, "a long, b long"))
    ids = {x for e in edges for x in e}
    assert len(edges) > 10 * len(ids) and sum(n for n in rows if n > len(ids)) <= 2 * len(edges)
