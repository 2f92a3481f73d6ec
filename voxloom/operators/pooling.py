"""Pooling of token vectors in long form: rows (sample_id, layer, pos, vec, attn, mask)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

METHODS = ("last", "attn", "comp", "inv")


def by_position(rows: DataFrame, weight: Column, keys: list[str], vector: str = "vec") -> DataFrame:
    """(keys, dim, wx, w): sums over positions of weight * vector, one row per dimension, and of the weights.

    Each batch of rows becomes one row of sums per key before anything is exploded or shuffled. Null vectors and
    weights add nothing; the vectors have one length.
    """
    lean = rows.select(F.xxhash64(*keys).alias("code"), F.struct(*keys).alias("keys"), F.coalesce(weight, F.lit(0.0)).cast("double").alias("w"), V.as_double(F.col(vector)).alias("v")).filter("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column(2).to_numpy(zero_copy_only=False)
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) * w[:, None]
            _, first, which, n = np.unique(b.column(0).to_numpy(), return_index=True, return_inverse=True, return_counts=True)
            order, cuts = np.argsort(which, kind="stable"), np.cumsum(n) - n
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32()), pa.array(np.add.reduceat(x[order], cuts, axis=0).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(first)), pa.array(np.add.reduceat(w[order], cuts)), sums], names=["keys", "w", "s"])

    kind = lean.schema["keys"].dataType.simpleString()
    cells = lean.mapInArrow(run, f"keys {kind}, w double, s array<double>").select("keys.*", "w", F.posexplode("s").alias("dim", "x"))
    return cells.groupBy(*keys, "dim").agg(F.sum("x").alias("wx"), F.sum("w").alias("w"))


def vectors(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, dim, value) back as arrays (keys, vec)."""
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("c")).select(*keys, F.col("c.value").alias("vec"))


def last_token(rows: DataFrame, keys: list[str], vector: str = "vec") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(V.as_double(F.col(vector)), "pos").alias("vec"))


def attention(rows: DataFrame, keys: list[str], method: str, layer: str = "layer") -> DataFrame:
    """Pooled vectors by attention weights normalised to sum to one ("attn"), by their complement 1 - w ("comp"), or their inverse 1 / (w + 1e-8) ("inv").

    In layer 0 there is no attention below: the last token's vector is taken.
    """
    if method == "last":
        return last_token(rows, keys)
    upper = rows.filter(F.col(layer) > 0)
    weight = F.col("attn")  # their sum divides at the end, so no totals have to meet the rows first
    if method != "attn":
        upper = upper.join(upper.groupBy(*keys).agg(F.sum("attn").alias("total")), keys)
        share = F.col("attn") / (F.col("total") + 1e-10)
        weight = {"comp": 1 - share, "inv": 1 / (share + 1e-8)}[method]
    value = F.col("wx") / (F.col("w") + 1e-10)
    pooled = vectors(by_position(upper, weight, keys).select(*keys, "dim", value.alias("value")), keys)
    return pooled.unionByName(last_token(rows.filter(F.col(layer) == 0), keys))


def masked_mean(rows: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    cells = by_position(rows, F.col(mask).cast("double"), keys)
    return vectors(cells.select(*keys, "dim", (F.col("wx") / F.greatest("w", F.lit(1e-9))).alias("value")), keys)


def query_pool(rows: DataFrame, keys: list[str], query: list[float], mask: str = "mask") -> DataFrame:
    """Softmax of scaled products with a learned query weighs the positions that aren't masked."""
    q = F.array(*[F.lit(float(x)) for x in query])
    seen = rows.filter(F.col(mask) == 1).withColumn("score", V.dot(F.col("vec"), q) / len(query) ** 0.5)
    top = seen.groupBy(*keys).agg(F.max("score").alias("top"))
    cells = by_position(seen.join(top, keys), F.exp(F.col("score") - F.col("top")), keys)
    return vectors(cells.select(*keys, "dim", (F.col("wx") / F.col("w")).alias("value")), keys)


def fused_layers(pooled: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over layers weighted by a softmax of ``weights`` (layer, weight); layers without a weight are left out."""
    top = weights.agg(F.max("weight").alias("top"))
    soft = weights.crossJoin(F.broadcast(top)).withColumn("e", F.exp(F.col("weight") - F.col("top"))).drop("top", "weight")
    share = soft.crossJoin(F.broadcast(soft.agg(F.sum("e").alias("all")))).select("layer", (F.col("e") / F.col("all")).alias("share"))
    cells = by_position(pooled.join(F.broadcast(share), "layer"), F.col("share"), keys)
    return vectors(cells.select(*keys, "dim", F.col("wx").alias("value")), keys)


def pad_tokens(ids: Column, pad: int, length: int = 128) -> tuple[Column, Column]:
    """Token ids cut or filled to ``length``, and the mask of real ones."""
    filled = F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)
    mask = F.slice(F.concat(F.array_repeat(F.lit(1), F.least(F.size(ids), F.lit(length))), F.array_repeat(F.lit(0), length)), 1, length)
    return filled, mask
