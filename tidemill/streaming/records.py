"""Records as a stream: a run that can be resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.checkers import exists


def laid_out(work: DataFrame, order: list[str], parts: int, folder: str) -> None:
    """Write down what a run has to do, a file for each part of it in the order; what is written is left as it is."""
    if not exists(work.sparkSession, f"{folder}/work/_SUCCESS"):
        dealt = work.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        dealt.write.mode("overwrite").parquet(f"{folder}/work")


def resumed(spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """Make the records of each part that is not done. A part is one batch of a stream over the work and has a folder of its
    own, which a batch overwrites: a run that ends between the write and the commit of a part makes that part again, in its place."""
    work = spark.read.parquet(f"{folder}/work")

    def save(batch: DataFrame, _: int) -> None:
        for (part,) in batch.select("part").distinct().collect():  # a file holds one part
            made = make(batch.filter(F.col("part") == part).drop("part"))
            made.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/records/part={part:06d}")

    stream = spark.readStream.schema(work.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/work")
    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
