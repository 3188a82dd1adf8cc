"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import by_key, frequent, stable


def _often(df: DataFrame, key: str) -> DataFrame:
    return frequent(df.groupBy(key).agg(F.count("*").alias("n")), key)


def _moved(df: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """df with the label in place of each key that has one."""
    to = labels.select(F.col("id").alias(key), F.col("component").alias("to"))
    return by_key(df, to, key, _often(df, key), "left").select(*[F.coalesce("to", c).alias(c) if c == key else c for c in df.columns])


def _rooted(labels: DataFrame) -> DataFrame:
    """labels (id, component), each smaller than its id or no id itself -> the same ids with the end of their chain.

    Each round takes the label of the label, so chains halve."""
    while True:
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        # a large component is one frequent label
        moved = stable(by_key(labels, jump, "component", _often(labels, "component"), "left"))
        changed = moved.filter("far IS NOT NULL").limit(1).count()
        labels = moved.select("id", F.coalesce("far", "component").alias("component"))
        if not changed:
            return labels


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component), the smallest id reachable, for every id that has an edge.

    In each round every id goes to its smallest neighbour, if that is smaller, and on to the end of that
    chain; the ids of a chain become one, and so do the edges between chains. An edge is joined twice at most
    in a round and goes once its ends are one, so the edges are not read again in every round: two rounds at least halve
    the ids that have edges. The smallest id of a component never moves, so it is the one that is left.
    Nothing but whether edges are left reaches the driver.
    """
    e = stable(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = e.select(F.col("a").alias("id")).union(e.select("b")).distinct().select("id", F.col("id").alias("component"))
    while e.limit(1).count():
        labels = _rooted(stable(e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))))
        # an edge from the end of a chain to that chain goes before the other side is joined
        e = stable(_moved(e, "b", labels).filter("a <> b").distinct())
        e = _moved(e, "a", labels).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        e = stable(e.filter("a <> b").distinct())
        found = stable(_moved(found, "component", labels))
    return found
