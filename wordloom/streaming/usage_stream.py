"""Usage events as a stream.

Arrivals come in micro-batches. Each batch is reduced to one row an id and written under its
batch number (a repeated batch overwrites itself, so nothing counts twice after a restart);
totals are taken from the written batches, in which a repeated id is met again. State that
must be kept between batches is thus files in the shared folder, not memory: late rows of any
age change their own day.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import shared_folder
from wordloom.sources.tables import AI_USAGE


def arrivals(spark: SparkSession, folder: str, files_a_batch: int = 4) -> DataFrame:
    """The usage table's files as a stream."""
    return spark.readStream.schema(AI_USAGE).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(f"{folder}/ai_usage.parquet*")


def reduced(batch: DataFrame) -> DataFrame:
    """One row an id of one batch; identical rows fold on the map side."""
    columns = ("id", "provider", "created_at", "input_tokens", "output_tokens")
    return batch.select(*columns).filter("created_at is not null").distinct()


def consume(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Every arrival there is now, written by batch."""

    def write(batch: DataFrame, number: int) -> None:
        reduced(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(provider, usage_day, calls, tokens) after all arrivals."""
    base = f"{shared_folder(spark)}/usage-{uuid.uuid4().hex}"
    consume(arrivals(spark, folder), f"{base}/out", f"{base}/log")
    rows = spark.read.parquet(f"{base}/out").drop("batch").distinct()
    return rows.groupBy("provider", F.date_format("created_at", "yyyy-MM-dd").alias("usage_day")).agg(
        F.count("*").alias("calls"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )
