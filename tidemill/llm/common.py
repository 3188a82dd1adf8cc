"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, in the folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset and the session runs on
    one machine (tests) a temporary folder takes its place.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemill-"))
    return df.checkpoint(eager=True)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as long and the text with null read as empty; other columns are left behind."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    spread = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    bare = F.trim(spread)
    return F.when(bare == "", F.lit(0)).otherwise(
        F.length(bare) - F.length(F.translate(bare, " ", "")) + 1
    ).cast("long")


#: Keys of a join that are treated apart: at most so many, the most frequent ones.
HOT_KEYS = 256


def frequent(counts: DataFrame, key: str, over: int = 1) -> DataFrame:
    """hot_key, n of the HOT_KEYS most frequent keys of counts (key, n) that stand more than ``over`` times: a table of
    HOT_KEYS rows at most whatever the input. None of the other keys holds more than 1 / HOT_KEYS of the rows."""
    most = counts.filter(F.col("n") > over).orderBy(F.desc("n"), key).limit(HOT_KEYS)
    return F.broadcast(stable(most.select(F.col(key).alias("hot_key"), F.col("n").alias("hot_n"))))


def by_key(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Inner or left join of left with right, whose ``key`` is unique, without a task that gathers a frequent key:
    those of hot, the ``frequent`` keys of left, are joined by broadcast, so rows of right are small."""
    is_hot = F.col(key) == F.col("hot_key")
    often = left.join(hot, is_hot, "left_semi").join(F.broadcast(right.join(hot, is_hot, "left_semi")), key, how)
    return often.unionByName(left.join(hot, is_hot, "left_anti").join(right, key, how))


def private(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Longest word that a worker's cache of words keeps, so that its entries bound its bytes.
CACHED_CHARS = 64


#: Rows of texts that go to a Python worker at once; a text may be long.
TEXTS_AT_ONCE = 1000


def fewer_rows(spark: SparkSession) -> str:
    """Lower the session's Arrow batches to TEXTS_AT_ONCE rows, so that a batch of long texts, of which the executor
    and its Python worker hold copies, stays small; what they were. A session that asks for fewer keeps its number. For operators whose
    jobs run after they have returned; a session has one number for all its jobs, so it stays lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= TEXTS_AT_ONCE:
        spark.conf.set(name, str(TEXTS_AT_ONCE))
    return before


@contextmanager
def few_at_once(spark: SparkSession) -> Iterator[None]:
    """``fewer_rows`` for the jobs that run inside; afterwards the session has its own number again."""
    before = fewer_rows(spark)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to TEXTS_AT_ONCE rows, for a function that runs after its plan is handed out."""
    for b in batches:
        for at in range(0, len(b), TEXTS_AT_ONCE):
            yield b.slice(at, TEXTS_AT_ONCE)
