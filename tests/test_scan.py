"""Scans in blocks against windows, over one large key and many small ones."""

import random

from pyspark.sql import functions as F

from tidemill.operators import layout
from tidemill.operators.scan import Scan, Take, Windows

def _takes():
    return {
        "before": Take("lag", F.col("v")), "after": Take("lead", F.col("v")), "so_far": Take("sum", F.col("v")),
        "latest": Take("last", F.col("v")), "coming": Take("next", F.col("v")), "v": Take("last", F.col("v")),
    }


def _rows(n=900):
    rng = random.Random(8)
    keys = ["big"] * 6 + [None, "b", "c"]
    return [(rng.choice(keys), i, rng.choice([None, None, rng.randrange(50)]), "x") for i in rng.sample(range(10 * n), n)] + [("nulls", i, None, "y") for i in range(5)]


def test_blocks_give_the_rows_of_windows(spark):
    df = spark.createDataFrame(_rows(), "k string, at int, v int, block string").repartition(6)
    want = sorted(map(repr, Windows(df, ["k"], ["at"]).take(**_takes()).result().collect()))
    for blocks in (1, 2, 13, 200):
        scan = Scan(df, ["k"], ["at"], blocks)
        got = scan.take(**_takes()).result()
        assert sorted(map(repr, got.select(*Windows(df, ["k"], ["at"]).take(**_takes()).result().columns).collect())) == want
    sizes = [r.n for r in Scan(df, ["k"], ["at"], 13).rows.groupBy("block_").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2 * len(_rows()) / len(sizes)


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(i, i) for i in range(50)], "at int, v int")
    got = Scan(df, [], ["at"], 7).take(total=Take("sum", F.col("v"))).result()
    assert {r.at: r.total for r in got.collect()} == {i: i * (i + 1) // 2 for i in range(50)}
    assert Scan(df.filter("at < 0"), [], ["at"], 7).take(total=Take("sum", F.col("v"))).result().count() == 0


def test_next_value_reads_each_row_once(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 40_000 == 0, F.col("id")).alias("v"))
    for scan in (Windows(df, ["k"], ["at"]), Scan(df, ["k"], ["at"], 2)):
        got = scan.take(coming=Take("next", F.col("v"))).result()
        assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
        want = F.ceil(F.col("at") / 40_000) * 40_000
        assert got.filter(~F.col("coming").eqNullSafe(F.when(F.col("at") <= 160_000, want))).count() == 0 and got.count() == n


def test_layout_in_blocks(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([("p", float(y), rng.choice(["ab-", "cd", "1-", "x"])) for y in sorted(rng.sample(range(5000), 400))], "page string, y double, text string")
    for f in (lambda n: layout.gap_groups(rows, "page", F.col("y"), 9.0, ["y"], n), lambda n: layout.soft_hyphens(rows, "page", "y", n), lambda n: layout.carried(rows, "page", "y", "text", large=n)):
        assert sorted(map(repr, f(0).collect())) == sorted(map(repr, f(1000).collect()))
