"""Ordered scans of keys of any size: what a row takes from the rows before or after it, in parallel within one key.

Rows are dealt by ranges of key and order, so a large key lies in many blocks. Each block is scanned on its own; a
summary, a row for each key and block, is scanned in turn; and each row takes what its block did not
hold from the summary. No task holds a whole key, only a block, or the summaries of one key, which are as many as
blocks at most.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Rows as they are, for good: a reliable checkpoint in the folder that spark.checkpoint.dir names. Only a
    session on one machine that names none gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemill-"))
    return df.checkpoint(eager=True)


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@dataclass(frozen=True)
class Take:
    """What a row takes: ``lag`` and ``lead`` the value of the row beside it, ``sum`` the sum up to and with it,
    ``last`` and ``next`` the nearest value that is not null, the row's own included."""

    kind: str
    value: Column


#: Rows of a key up to which one task takes it with a window; larger keys are scanned in blocks, with the same rows.
LARGE_KEY = 1_000_000

_WINDOWED = {
    "lag": lambda v, w: F.lag(v).over(w), "lead": lambda v, w: F.lead(v).over(w),
    "sum": lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    "last": lambda v, w: F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
}
#: From the last row back: a frame up to the last row would be read anew for each row.
_WINDOWED["next"] = _WINDOWED["last"]


class Windows:
    """``Scan`` for keys that a task can hold, without blocks."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str | Column]) -> None:
        self.rows, self.by, self.window = rows, by, Window.partitionBy(*by).orderBy(*order)

    def take(self, **wanted: Take) -> Windows:
        rows, (pos,) = self.rows, free(self.rows, "pos")
        if any(t.kind == "next" for t in wanted.values()):
            rows = rows.withColumn(pos, F.row_number().over(self.window))
        back = Window.partitionBy(*self.by).orderBy(F.desc(pos))
        self.rows = rows.withColumns({n: _WINDOWED[t.kind](t.value, back if t.kind == "next" else self.window) for n, t in wanted.items()}).drop(pos)
        return self

    def result(self) -> DataFrame:
        return self.rows


def ordered(rows: DataFrame, by: list[str], order: list[str | Column], large: int = LARGE_KEY) -> Scan | Windows:
    """A scan of rows by key and order, in blocks where the largest key has more than ``large`` rows."""
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return Scan(rows, by, order) if most > large else Windows(rows, by, order)


class Scan:
    """Rows in blocks, sorted by ``order`` within the keys ``by`` (nulls are a key of their own)."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str | Column], blocks: int | None = None) -> None:
        """``order`` should tell the rows of a key apart: rows that it does not are kept in one block, in any order."""
        self.by, self.columns = by, rows.columns
        self.block, self.pos = free(rows, "block", "pos")
        n = blocks or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
        self.rows = cut(dealt.withColumns({self.block: F.spark_partition_id(), self.pos: F.monotonically_increasing_id()}))

    def take(self, **wanted: Take) -> Scan:
        """The same rows with a column for each wanted one. Columns taken before can be used in those that follow."""
        by, block, pos = self.by, self.block, self.pos
        here = {k: Window.partitionBy(*by, block).orderBy(F.desc(pos) if k == "next" else F.asc(pos)) for k in _WINDOWED}
        # of a block's summary: its last, first, total, last and first value
        first, last = lambda v: F.min_by(v, F.col(pos)), lambda v: F.max_by(v, F.col(pos))
        held = {
            "lag": lambda v: last(F.struct(v.alias("v"))), "lead": lambda v: first(F.struct(v.alias("v"))), "sum": lambda v: F.struct(F.sum(v).alias("v")),
            "last": lambda v: F.struct(F.max_by(v, F.when(v.isNotNull(), F.col(pos))).alias("v")), "next": lambda v: F.struct(F.min_by(v, F.when(v.isNotNull(), F.col(pos))).alias("v")),
        }
        names = list(wanted)
        mine, more, at = free(self.rows, *[f"own_{i}" for i in range(len(names))]), free(self.rows, *[f"more_{i}" for i in range(len(names))]), free(self.rows, "k_block", "first_pos", "last_pos")
        keys = free(self.rows, *[f"k_{i}" for i in range(len(by))])
        rows = self.rows.withColumns({m: _WINDOWED[wanted[n].kind](wanted[n].value, here[wanted[n].kind]) for m, n in zip(mine, names)})
        blocks = self.rows.groupBy(*by, block).agg(*[held[wanted[n].kind](wanted[n].value).alias(m) for m, n in zip(more, names)], F.min(pos).alias(at[1]), F.max(pos).alias(at[2]))
        over = Window.partitionBy(*by).orderBy(block)
        before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (over, Window.partitionBy(*by).orderBy(F.desc(block))))
        beside = {
            "lag": lambda m: F.lag(f"{m}.v").over(over), "lead": lambda m: F.lead(f"{m}.v").over(over), "sum": lambda m: F.sum(f"{m}.v").over(before),
            "last": lambda m: F.last(f"{m}.v", True).over(before), "next": lambda m: F.last(f"{m}.v", True).over(after),
        }
        summary = blocks.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(block).alias(at[0]), at[1], at[2], *[beside[wanted[n].kind](m).alias(m) for m, n in zip(more, names)])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)], F.col(block) == F.col(at[0]))
        joined = rows.join(summary, same)
        ends = {"lag": F.col(pos) == F.col(at[1]), "lead": F.col(pos) == F.col(at[2])}

        def whole(kind: str, m: str, o: str) -> Column:
            if kind in ends:
                return F.when(ends[kind], F.col(o)).otherwise(F.col(m))
            if kind == "sum":
                return F.when(F.col(m).isNull(), F.col(o)).when(F.col(o).isNull(), F.col(m)).otherwise(F.col(m) + F.col(o))
            return F.coalesce(F.col(m), F.col(o))

        out = object.__new__(Scan)
        out.by, out.block, out.pos, out.columns = by, block, pos, [c for c in self.columns if c not in names] + names
        out.rows = joined.select(*[F.col(f"`{c}`") for c in self.rows.columns if c not in names], *[whole(wanted[n].kind, m, o).alias(n) for n, m, o in zip(names, mine, more)])
        return out

    def result(self) -> DataFrame:
        """The rows with the columns taken, without the scan's own."""
        return self.rows.select(*[F.col(f"`{c}`") for c in self.columns])
