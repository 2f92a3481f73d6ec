"""A query and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship


@dataclass(frozen=True)
class Query:
    """``operators``: which of the inventory's operators it applies; ``oracle``: DuckDB SQL for the same rows."""

    run: Callable[[SparkSession, str], DataFrame]
    operators: str
    oracle: str | None = None


CATALOG: dict[str, Query] = {}


def query(operators: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) under its own name."""

    def put(run):
        CATALOG[run.__name__] = Query(run, operators, oracle)
        return run

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dialogues(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(id, speaker, origin_text, para_text): conversation turns, with the next turn in place of a paraphrase.

    ``spread`` is for work whose time grows with the square of a text: the window's own shuffle then has
    spark.sql.shuffle.partitions parts, which adaptive execution doesn't merge by their few bytes.
    """
    turns = table(spark, sf_dir, "conversations")
    if spread:
        turns = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("role").alias("speaker"),
        F.col("text").alias("origin_text"),
        F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("para_text"),
    )


#: The same in SQL.
DIALOGUES = """dialogues AS (SELECT conv_id * 1000 + turn AS id, role AS speaker, text AS origin_text,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS para_text FROM conversations)"""
STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x1c-\x1f\x85]+|[\s\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')"


def sql_strip(x: str) -> str:
    return STRIP.format(x)


def micro(col: Column, name: str) -> Column:
    """A float rounded to six places, without negative zero."""
    return (F.round(col, 6) + 0.0).alias(name)
