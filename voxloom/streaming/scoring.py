"""Resumable scoring as a stream: new files of pairs are scored once, whatever interrupts the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus as C

PAIRS = "id long, speaker string, origin_text string, para_text string"


def pending_pairs(spark: SparkSession, folder: str, schema: str = PAIRS, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def scored(pairs: DataFrame, n: int = 3) -> DataFrame:
    """Pairs with their similarity; blank ones get null and are marked, so that no later run asks for them again."""
    s = C.pair_similarity(F.col("origin_text"), F.col("para_text"), n)
    return pairs.withColumn("similarity", s).withColumn("skipped", F.col("similarity").isNull())


def run_available(pairs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score what has arrived since the last run, append it as Parquet, and stop."""
    return scored(pairs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
