"""Cleaning of the documents table in stages, each written and read again before the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import mixing, near_dedup, packing, suffix_dedup, toxicity
from tidemill.llm.common import private, stable, table

#: Similarity in percent from which documents are near duplicates of a stage; op9's query has its own.
NEAR_PERCENT = 80
#: Words that a worker remembers in a stage: workers live through all stages, so their caches add up.
CACHE_WORDS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it is trained on the labelled rows of this input.

    The score lies beside the columns of docs under names that none of them has, so columns that
    are called ``score`` or ``predicted`` come out as they were."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (hit,) = private(docs, "judged_toxic")
    return toxicity.flagged(docs, model, hit, cache_words=CACHE_WORDS).filter(~F.col(hit)).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that with the smallest id.

    Ids that repeat or are null do not tell rows apart: then each row has a number of its own, by
    which the groups are found, so unlike texts under one id all stay and like ones go."""
    (key,) = private(docs, "row_no")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    rows = stable(docs.withColumn(key, F.monotonically_increasing_id())) if repeated else docs.withColumn(key, F.col("doc_id").cast("long"))
    found = near_dedup.classes(rows.select(F.col(key).alias("doc_id"), "text"), NEAR_PERCENT)
    gone = stable(found.filter("NOT kept").select(F.col("doc_id").alias(key)))
    return rows.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, cache_words=CACHE_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each),
    ("suffix_dedup", without_repeats),
    ("mixing", to_weights),
    ("packing", packed),
]
#: No SQL form: the stages train a classifier, hash shingles and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written as Parquet in the shared folder and read again.

    The rows of a stage are removed once the next stage has written its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    docs, folder, last = table(spark, sf_dir, "documents"), f"{root}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{last}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        last = name
    return docs
