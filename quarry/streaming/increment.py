"""Incremental forms: first-wins admission of arriving records, and staged tables by collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.dedup import raw_key

STAGES = ["raw", "cleaned", "final"]


def admit(spark: SparkSession, arrivals: str, schema, table: str, checkpoint: str, files_per_batch: int = 16) -> None:
    """Streams new files of arrivals into the Parquet table; of rows with one key, the first to arrive stays.

    The keyed state has no end, as a record may come again at any time; a batch that is replayed writes its own
    folder again. seq orders rows within a batch.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals).withColumn("__key", raw_key())

    def save(batch: DataFrame, epoch: int) -> None:
        batch.drop("__key").write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    first = stream.dropDuplicates(["__key"])
    first.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


def save_stage(docs: DataFrame, base: str, stage: str) -> None:
    """Writes one stage, a folder per collection (domain and source type); other collections stay as they are."""
    if stage not in STAGES:
        raise ValueError(stage)
    rows = docs.withColumn("collection", F.concat_ws("_", "domain", "source_type"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(f"{base}/{stage}")


def read_stage(spark: SparkSession, base: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{stage}")


def fill(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Existing rows, and fresh ones of keys that are not there yet."""
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti"))
