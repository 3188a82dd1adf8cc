"""Each query with SQL gives DuckDB's rows; each other query runs."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def _rows(names, rows):
    def plain(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return "nan" if math.isnan(v) else f"{float(v):.5f}"
        return str(v)

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    got = _rows(df.columns, df.collect())
    if sql := registry.oracle_sql().get(name):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(sql)
        assert sorted(df.columns) == sorted(c[0] for c in want.description)
        assert got == _rows([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
