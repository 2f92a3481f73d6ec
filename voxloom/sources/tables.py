"""Reading and writing tables: JSON arrays, SQL databases, Parquet caches, CSV and text reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import before_parts, numbered

RECORD = "I string, S string, T string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of records I (id), S (speaker), T (text)."""
    return spark.read.schema(RECORD).option("multiLine", True).json(path)


def as_dialogues(records: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Records as new rows of the dialogue table; ids go up from 1 in the order of the file's records, or in ``order``.

    Spark reads one file's records in order, so numbers that grow within and over partitions keep it; they are then
    closed up by counts per partition. Several files are read by size, not by name, so they need an ``order``.
    """
    if order:
        rows = numbered(records, order, name="id").select("id", F.coalesce("S", F.lit("")).alias("speaker"), F.col("T").alias("origin_text"))
        return rows.select("*", F.lit(None).cast("string").alias("para_text"), F.lit(None).cast("double").alias("similarity"))
    rows = records.select(F.monotonically_increasing_id().alias("_at"), F.coalesce("S", F.lit("")).alias("speaker"), F.col("T").alias("origin_text"))
    placed = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    begins = before_parts(placed.groupBy("_part").agg(F.count("*").alias("n")))
    return placed.join(begins, "_part").select((F.col("_begin") + F.col("_row") + 1).alias("id"), "speaker", "origin_text", F.lit(None).cast("string").alias("para_text"), F.lit(None).cast("double").alias("similarity"))


def read_database(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 16) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric key; the JDBC driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete table was written there."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; written from ``make()`` first if it isn't complete. The path should name its content."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(rows: DataFrame) -> str:
    """A name for what a table holds: its columns, the number of its rows, and sums of two hashes of them, in any order."""
    both = [F.xxhash64(F.lit(i), *rows.columns) for i in (0, 1)]
    sums = [F.sum(F.shiftright(h, 20)) for h in both]
    got = rows.agg(F.count("*"), *sums, *[F.bit_xor(h) for h in both]).first()
    return hashlib.sha256(repr((rows.dtypes, tuple(got))).encode()).hexdigest()[:32]


def write_table(rows: DataFrame, path: str) -> None:
    """A table written anew in place of any older one; tasks that fail leave nothing of theirs, and _SUCCESS marks the whole."""
    rows.write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """One text column as lines of text, one a row: line ends within a text are written as \\n and \\r."""
    column = lines.columns[0]
    escaped = F.replace(F.replace(F.col(column), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    lines.select(escaped.alias(column)).write.mode("overwrite").text(path)


def write_speakers(rows: DataFrame, path: str) -> None:
    """A table laid out by speaker, so that one speaker's rows are found by pruning.

    Ranges go by speaker and then by a hash of the row, so a speaker with many rows is written by several tasks.
    """
    rows.repartitionByRange("speaker", F.xxhash64(*rows.columns)).write.mode("overwrite").partitionBy("speaker").parquet(path)
