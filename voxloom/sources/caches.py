"""Caches as tables: token sequences by split with what describes them, and hidden states by layer and pooling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists, write_table

ROW = "id long, speaker string, label int, tokens array<int>, mask array<int>, split string"

#: The splits that a token cache holds; all_train is the first two together.
SPLITS = ("train", "val_acc", "val")


@dataclass(frozen=True)
class TokenCache:
    """``tokens``: (id, label, tokens, mask, split); ``speakers``: (label, speaker, split, n), one row for each label, speaker and split."""

    tokens: DataFrame
    speakers: DataFrame

    def split(self, name: str) -> DataFrame:
        """The rows of a split; all_train are train and val_acc, the rows of all speakers that are trained on."""
        if name not in (*SPLITS, "all_train"):
            raise KeyError(f"no split {name}")
        return self.tokens.filter(F.col("split").isin(*SPLITS[:2]) if name == "all_train" else F.col("split") == name)

    def train_speakers(self) -> DataFrame:
        """(train_speakers): how many labels the training rows have, as one row."""
        return self.speakers.filter(F.col("split").isin(*SPLITS[:2])).agg(F.countDistinct("label").alias("train_speakers"))


def save_tokens(rows: DataFrame, path: str) -> None:
    """Rows (id, speaker, label, tokens, mask, split) as a token cache in place of any older one.

    Tokens lie by split, so that a split reads its own files only. Rows with another split or none are an error: a cache
    that lost them would still look whole. The description is written last, so a cache that has it is complete.
    """
    known = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    checked = rows.withColumn("split", F.when(known, F.col("split")).otherwise(F.raise_error(F.concat(F.lit("unknown split "), F.coalesce("split", F.lit("null"))))))
    typed = [F.col(c).cast(t).alias(c) for c, t in (part.split(" ") for part in ROW.split(", "))]
    checked.select(typed).write.mode("overwrite").partitionBy("split").parquet(f"{path}/tokens")
    held = rows.sparkSession.read.schema(ROW).parquet(f"{path}/tokens")
    write_table(held.groupBy("label", "speaker", "split").agg(F.count("*").alias("n")), f"{path}/speakers")


def load_tokens(spark: SparkSession, path: str) -> TokenCache:
    """A token cache; FileNotFoundError names the part that isn't there or isn't complete."""
    for part in ("tokens", "speakers"):
        if not exists(spark, f"{path}/{part}"):
            raise FileNotFoundError(f"no cache {path}/{part}")
    return TokenCache(spark.read.schema(ROW).parquet(f"{path}/tokens").select("id", "label", "tokens", "mask", "split"), spark.read.parquet(f"{path}/speakers"))


def layer_count(cells: DataFrame, pool: str = "last") -> DataFrame:
    """(layers): how many layers a cache holds from layer 0 without a gap, by the cells (layer, pool) of one pooling; one row.

    Layers that come after a gap don't count; null layers and an empty cache count as none.
    """
    have = cells.filter(F.col("pool") == pool).select(F.col("layer").cast("long").alias("layer")).distinct()
    ends = have.select((F.col("layer") + 1).alias("layer")).unionByName(have.sparkSession.range(1).select(F.col("id").alias("layer"))).filter("layer >= 0")
    return ends.join(have, "layer", "left_anti").agg(F.min("layer").alias("layers"))


def cell_gaps(cells: DataFrame, pools: list[str]) -> DataFrame:
    """(layer, pool): what a cache lacks of ``pools`` in the layers that it has; complete if there is a layer and no row."""
    layers = layer_count(cells).select(F.explode(F.expr("case when layers > 0 then sequence(0, layers - 1) end")).alias("layer"))
    grid = layers.select("layer", F.explode(F.array(*map(F.lit, pools))).alias("pool"))
    return grid.join(cells.select(F.col("layer").cast("long").alias("layer"), "pool").distinct(), ["layer", "pool"], "left_anti")
