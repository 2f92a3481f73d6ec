"""A training-corpus pipeline: five stages, each a Spark job over all that the stage before it kept.

Every stage's rows are written as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``; the last returns the pieces of packed token sequences.

In every stage a null text counts as an empty one, texts are read whole however long, repeated rows are judged each (only
near-dedup drops them), other columns pass through whatever their names, and an empty table gives no rows. Rows with
a null id are kept by line dedup, near-dedup and decontamination, and are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontam, line_dedup, near_copies, packing, quality
from voxloom.llm.common import Stage, table
from voxloom.session import own_stages, ship

#: Documents below this score of the quality classifier go.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, by a model learned from the labelled ones, is at least ``LEAST_QUALITY``.

    Without labelled documents every score is 0.5 and all stay; an empty text is scored by its zero counts.
    """
    model = quality.train_texts(docs, table(spark, sf_dir, "labels"))
    return docs.filter(model.score_text(F.col("text")) >= LEAST_QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share; one that loses all its lines stays, empty."""
    ship(spark)
    kept = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Of rows that repeat the survivor's id one stays; ties can't arise, as ids order the group.
    """
    ship(spark)
    return near_copies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; without items all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; an empty text is one piece, its end token."""
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage wrote on its way goes when it ends, and its rows when the next stage's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with own_stages(spark) as outside:
            kept = Stage(stage(spark, docs, sf_dir), outside)
        if before is not None:
            before.drop()
        docs, before = kept.df, kept
    return docs
