"""Metrics of labelled vectors in linear time: class sums stand in for all pairs of a class.

Each batch of rows becomes one row of sums per class before anything is shuffled, so a class of a third of all rows
costs no more. Rows then meet the class sums by a broadcast of blocks of classes; more classes than a block holds take
more passes over the rows, each in tasks of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import let
from ..session import materialised

#: Numbers of a block of class sums, at most.
BLOCK = 4_000_000
SILHOUETTE = "own double, own_n long, other double"


def batch_sums(rows: DataFrame, label: str, vector: Column) -> DataFrame:
    """(label, n, s, q): rows, sums and sums of squares by dimension of each class within each batch; classes may repeat."""
    lean = rows.select(F.xxhash64(label).alias("code"), F.col(label).alias("label"), vector.alias("v")).filter("v is not null")
    kind = lean.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            _, first, which, n = np.unique(b.column(0).to_numpy(), return_index=True, return_inverse=True, return_counts=True)
            order, cuts = np.argsort(which, kind="stable"), np.cumsum(n) - n
            ends = pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32())
            sums = [pa.ListArray.from_arrays(ends, pa.array(np.add.reduceat(y[order], cuts, axis=0).ravel())) for y in (x, x * x)]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(first)), pa.array(n), *sums], names=["label", "n", "s", "q"])

    return lean.mapInArrow(run, f"label {kind}, n long, s array<double>, q array<double>")


def cell_sums(rows: DataFrame, label: str, vector: Column) -> DataFrame:
    """(label, dim, n, s, q) over all rows: a few rows a batch and class are exploded, never those of the table."""
    cells = batch_sums(rows, label, vector).select("label", "n", F.posexplode(F.arrays_zip("s", "q")).alias("dim", "c"))
    return cells.groupBy(F.col("label").alias(label), "dim").agg(F.sum("n").alias("n"), F.sum("c.s").alias("s"), F.sum("c.q").alias("q"))


def class_sums(rows: DataFrame, label: str = "label", vector: str = "vec", normal: bool = True) -> DataFrame:
    """(label, n, sums, squares): rows, sum of unit vectors by dimension, and sum of their squared norms."""
    cells = cell_sums(rows, label, V.unit(F.col(vector)) if normal else V.as_double(F.col(vector)))
    return cells.groupBy(label).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("cells"), F.sum("q").alias("squares")).select(label, "n", F.col("cells.s").alias("sums"), "squares")


def consistency(rows: DataFrame, label: str = "label", vector: str = "vec") -> DataFrame:
    """(label, n, consistency): mean cosine over pairs of a class; null for classes of one row."""
    pairs = F.col("n") * (F.col("n") - 1)
    value = F.when(F.col("n") >= 2, (V.dot(F.col("sums"), F.col("sums")) - F.col("squares")) / F.greatest(pairs, F.lit(1)))
    return class_sums(rows, label, vector).select(label, "n", value.alias("consistency"))


def class_blocks(sums: DataFrame, label: str, block: int = BLOCK) -> Iterator[pd.DataFrame]:
    """Class sums in blocks of bounded size, one at a time."""
    width = sums.select(F.max(F.size("sums")).alias("d")).first()["d"] or 1
    per, part = max(1, block // width), []
    for r in sums.select(F.col(label).alias("label"), "n", "sums").toLocalIterator():
        part.append(r)
        if len(part) == per:
            yield pd.DataFrame(part, columns=["label", "n", "sums"])
            part = []
    if part:
        yield pd.DataFrame(part, columns=["label", "n", "sums"])


def by_blocks(rows: DataFrame, blocks: Iterator, scored: Callable[[DataFrame, Broadcast], DataFrame], row: str) -> list[DataFrame]:
    """``scored(rows, block)`` for each block, with rows numbered in ``row``, as several of them bring a row's parts together.

    One block is one lazy pass. Of several each is a pass of its own, written before the next block is sent, so that the
    driver and the executors hold one block at a time.
    """
    spark, first, second = rows.sparkSession, next(blocks, None), next(blocks, None)
    if first is None:
        return []
    numbered = rows.withColumn(row, F.monotonically_increasing_id())
    if second is None:
        return [scored(numbered, spark.sparkContext.broadcast(first))]
    kept, parts = materialised(numbered), []
    for block in chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(block)
        parts.append(materialised(scored(kept, shared)))
        shared.destroy()
    return parts


def block_column(vector: Column, label: Column, shared: Broadcast) -> Column:
    """Of one block of classes: similarity to and size of the own class (null if not in it), smallest mean distance to another."""

    @F.pandas_udf(SILHOUETTE)
    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names, n, sums = shared.value["label"].tolist(), shared.value["n"].to_numpy(float), np.stack(shared.value["sums"].to_list())
        at = {x: i for i, x in enumerate(names)}
        for v, y in batches:
            if not len(v):
                yield pd.DataFrame({"own": [], "own_n": [], "other": []})
                continue
            s = np.stack(v.to_list()) @ sums.T
            mean = 1 - s / n
            own = np.array([at.get(x, -1) for x in y])
            rows = np.flatnonzero(own >= 0)
            mean[rows, own[rows]] = np.inf
            low = mean.min(axis=1)
            out = pd.DataFrame({"own": np.nan, "own_n": 0, "other": np.where(np.isinf(low), np.nan, low)}, index=range(len(v)))
            out.loc[rows, "own"], out.loc[rows, "own_n"] = s[rows, own[rows]], n[own[rows]].astype(int)
            yield out.astype({"own": object, "other": object}).where(out.notna(), None)

    return compare(vector, label)


def silhouette(rows: DataFrame, key: str, label: str = "label", vector: str = "vec", block: int = BLOCK) -> DataFrame:
    """(key, label, silhouette) of each row by cosine distance: 0 for a class of one row, null if there is one class only.

    Keys may repeat: rows are told apart by a number of their own, however many blocks of classes there are.
    """
    unit = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), V.unit(F.col(vector)).alias("unit"))
    square = V.dot(F.col("unit"), F.col("unit")).alias("square")
    one = lambda part, shared: part.select("row", "key", "label", square, block_column(F.col("unit"), F.col("label"), shared).alias("p"))
    passes = by_blocks(unit, class_blocks(class_sums(rows, label, vector), label, block), one, "row")
    if not passes:
        return unit.select(F.col("key").alias(key), F.col("label").alias(label), F.lit(None).cast("double").alias("silhouette"))
    scored = reduce(DataFrame.unionByName, passes).select("row", "key", "label", "square", F.col("p.own").alias("own"), F.col("p.own_n").alias("n"), F.col("p.other").alias("b"))
    if len(passes) > 1:
        same = [F.first(c).alias(c) for c in ("key", "label", "square")]
        scored = scored.groupBy("row").agg(*same, F.max("own").alias("own"), F.max("n").alias("n"), F.min("b").alias("b"))
    a = ((F.col("n") - 1) - (F.col("own") - F.col("square"))) / F.greatest(F.col("n") - 1, F.lit(1))
    value = F.when(F.col("b").isNull(), None).when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(F.col("b"), a)), F.lit(0.0)))
    return scored.select(F.col("key").alias(key), F.col("label").alias(label), value.alias("silhouette"))


def group_silhouettes(rows: DataFrame, group: str, label: str = "label", vector: str = "vec") -> DataFrame:
    """(group, silhouette): the mean silhouette of each group's rows among its own classes, as ``silhouette`` has it; all groups in one pass.

    A row meets the class sums of its group, one array, so classes times dimensions must be few enough for a row.
    """
    unit = rows.select(F.col(group).alias("g"), F.col(label).alias("y"), V.unit(F.col(vector)).alias("u"))
    sums = class_sums(unit.withColumn("key", F.struct("g", "y")), "key", "u", normal=False)
    classes = sums.groupBy(F.col("key.g").alias("g2")).agg(F.collect_list(F.struct(F.col("key.y").alias("y"), "n", "sums")).alias("classes"))
    near = F.transform("classes", lambda c: F.struct((c["y"] == F.col("y")).alias("own"), c["n"].alias("n"), V.dot(F.col("u"), c["sums"]).alias("dot")))
    joined = unit.join(classes, F.col("g").eqNullSafe(F.col("g2"))).select("g", V.dot(F.col("u"), F.col("u")).alias("square"), near.alias("near"))
    other = F.array_min(F.transform(F.filter("near", lambda c: ~c["own"]), lambda c: 1 - c["dot"] / c["n"])).alias("b")
    flat = joined.select("g", "square", F.get(F.filter("near", lambda c: c["own"]), F.lit(0)).alias("own"), other)
    n = F.col("own.n")
    a = ((n - 1) - (F.col("own.dot") - F.col("square"))) / F.greatest(n - 1, F.lit(1))
    value = F.when(F.col("b").isNull(), None).when(n == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(F.col("b"), a)), F.lit(0.0)))
    return flat.groupBy(F.col("g").alias(group)).agg(F.avg(value).alias("silhouette"))


def centroids(rows: DataFrame, label: str = "label", vector: str = "vec") -> DataFrame:
    """(label, n, centroid): the normalised sum of a class's unit vectors."""
    return class_sums(rows, label, vector).select(label, "n", V.unit(F.col("sums")).alias("centroid"), "sums", "squares")


def nearest_in(cents: DataFrame, label: str, shared: Broadcast) -> DataFrame:
    """(label, nearest, distance) within one block of classes; a null distance if it has no other class. Ties go to the smaller label."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, c = shared.value["label"].tolist(), np.stack(shared.value["sums"].to_list())
        order = sorted(range(len(names)), key=lambda i: names[i])
        names = [names[i] for i in order]
        place = {x: i for i, x in enumerate(names)}
        for rows in batches:
            if not len(rows):
                continue
            d = 1 - np.stack(rows["centroid"].to_list()) @ c[order].T
            own = np.array([place.get(x, -1) for x in rows[label]])
            d[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
            at = np.round(d, 12).argmin(axis=1)
            low = d[np.arange(len(d)), at]
            none = np.isinf(low)
            yield pd.DataFrame({label: rows[label], "nearest": [None if x else str(names[i]) for x, i in zip(none, at, strict=True)], "distance": pd.Series(low, index=rows.index, dtype=object).where(~none, None)})

    kind = cents.schema[label].dataType.simpleString()
    return cents.select(label, "centroid").mapInPandas(compare, f"`{label}` {kind}, nearest string, distance double")


def nearest_centroids(cents: DataFrame, label: str = "label", block: int = BLOCK) -> DataFrame:
    """(label, nearest, distance): the other class with the nearest centroid, ties to the smaller label; null for a single class.

    Every class is compared with blocks of classes, by the same bounded broadcast as rows are.
    """
    sums = cents.select(label, "n", F.col("centroid").alias("sums"))
    passes = by_blocks(cents, class_blocks(sums, label, block), lambda part, shared: nearest_in(part, label, shared), "_row")
    if not passes:
        return cents.select(label, F.lit(None).cast("string").alias("nearest"), F.lit(None).cast("double").alias("distance"))
    found = reduce(DataFrame.unionByName, passes)
    if len(passes) == 1:
        return found
    first = F.row_number().over(W.partitionBy(label).orderBy(F.asc_nulls_last("distance"), "nearest"))
    return found.withColumn("_r", first).filter("_r = 1").drop("_r")


def separability(rows: DataFrame, label: str = "label", vector: str = "vec") -> DataFrame:
    """(label, n, intra_dist, nearest_dist, nearest, separability) per class."""
    c = centroids(rows, label, vector)
    near = nearest_centroids(c, label)
    n = F.col("n")
    intra = 1 - (V.dot(F.col("sums"), F.col("sums")) - n) / F.greatest(n * (n - 1), F.lit(1))
    joined = c.join(near, label).select(label, "n", F.when(n >= 2, intra).alias("intra_dist"), F.col("distance").alias("nearest_dist"), "nearest")
    return joined.withColumn("separability", F.col("nearest_dist") / (F.coalesce("intra_dist", F.lit(0.0)) + 1e-9))


def calinski_harabasz(rows: DataFrame, label: str = "label", vector: str = "vec") -> DataFrame:
    """One row (classes, rows, score); null with fewer than two classes or no scatter within them."""
    cells = cell_sums(rows, label, V.as_double(F.col(vector)))
    all_s, all_n = F.sum("s").over(W.partitionBy("dim")), F.sum("n").over(W.partitionBy("dim"))
    parts = cells.select(label, "dim", (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), (F.col("n") * F.pow(F.col("s") / F.col("n") - all_s / all_n, 2)).alias("between"), all_n.alias("rows"))
    out = parts.agg(F.count_distinct(label).alias("classes"), F.max("rows").alias("rows"), F.sum("within").alias("w"), F.sum("between").alias("b"))
    k, n = F.col("classes"), F.col("rows")
    return out.select("classes", "rows", F.try_divide(F.try_divide(F.col("b"), k - 1), F.try_divide(F.col("w"), n - k)).alias("score"))


def residuals(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with vec = a - b."""
    return pairs.withColumn("vec", V.subtract(F.col(a), F.col(b)))


def mean_vector(rows: DataFrame, vector: str = "vec") -> DataFrame:
    """One row (mean) of the mean by dimension."""
    cells = cell_sums(rows.withColumn("_all", F.lit(0)), "_all", V.as_double(F.col(vector))).select("dim", (F.col("s") / F.col("n")).alias("m"))
    return cells.agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("c")).select(F.col("c.m").alias("mean"))


def centred(rows: DataFrame, fitted_on: DataFrame, vector: str = "vec") -> DataFrame:
    """``rows`` less the mean of ``fitted_on``: one small row is broadcast."""
    return rows.crossJoin(F.broadcast(mean_vector(fitted_on, vector))).withColumn(vector, V.subtract(F.col(vector), F.col("mean"))).drop("mean")


def weight_blocks(weights: DataFrame, block: int) -> list[DataFrame]:
    """Weights (class, w) of unit length in blocks of about ``block`` numbers; classes are dealt by hash."""
    sides = weights.select("class", V.unit(F.col("w")).alias("w"))
    size = weights.select(F.max(F.size("w")).alias("d"), F.count("*").alias("n")).first()
    n = max(1, -(-(size["n"] or 0) * (size["d"] or 1) // block))
    return [sides.filter(F.pmod(F.xxhash64("class"), F.lit(n)) == at) for at in range(n)] if n > 1 else [sides]


def margin_logits(rows: DataFrame, weights: DataFrame, key: str, label: str = "label", vector: str = "vec", scale: float = 30.0, margin: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(key, label, class, logit) of each row and class of ``weights`` (class, w).

    Both sides are normalised once, before they meet. Weights are broadcast in blocks of classes of at most ``block``
    numbers; more classes take more passes over the rows.
    """
    units = rows.select(key, label, V.unit(F.col(vector)).alias("unit"))
    logit = V.margin_logit(V.dot(F.col("unit"), F.col("w")), F.col("class") == F.col(label), scale, margin).alias("logit")
    return reduce(DataFrame.unionByName, [units.crossJoin(F.broadcast(part)).select(key, label, "class", logit) for part in weight_blocks(weights, block)])


def row_logits(rows: DataFrame, weights: DataFrame, key: str, label: str = "label", vector: str = "vec", scale: float = 30.0, margin: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(key, label, logits) of each row: one array of (class, logit), for losses and predictions, without a row per class.

    Keys may repeat. Weights of several blocks take a pass each; the arrays of a row, which has a number of its own, are
    joined by one shuffle. An array holds all classes, so they must be few enough for a row.
    """
    blocks = weight_blocks(weights, block)
    units = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), V.unit(F.col(vector)).alias("unit"))
    if len(blocks) > 1:
        units = materialised(units.withColumn("row", F.monotonically_increasing_id()))
    one = lambda c: F.struct(c["class"].alias("class"), V.margin_logit(V.dot(F.col("unit"), c["w"]), c["class"] == F.col("label"), scale, margin).alias("logit"))
    sides = [part.agg(F.collect_list(F.struct("class", "w")).alias("classes")) for part in blocks]
    parts = [units.crossJoin(F.broadcast(s)).withColumn("logits", F.transform("classes", one)).drop("classes", "unit") for s in sides]
    joined = parts[0]
    if len(parts) > 1:
        logits = F.flatten(F.collect_list("logits")).alias("logits")
        joined = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.first("key").alias("key"), F.first("label").alias("label"), logits)
    return joined.select(F.col("key").alias(key), F.col("label").alias(label), "logits")


def cross_entropy(logits: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, loss) of rows (key, label, logits): log of the sum of exponentials, shifted by the largest, less the target's logit."""
    values = F.transform("logits", lambda x: x["logit"])
    target = F.get(F.filter("logits", lambda x: x["class"] == F.col(label)), F.lit(0))["logit"]

    def shifted(held: Column) -> Column:
        return held["top"] + F.log(F.aggregate(held["values"], F.lit(0.0), lambda s, x: s + F.exp(x - held["top"])))

    return logits.select(key, (let(F.struct(values.alias("values"), F.array_max(values).alias("top")), shifted) - target).alias("loss"))


def predicted_class(logits: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, label, predicted) of rows (key, label, logits): the class of the largest logit, ties to the smaller class."""
    ranked = F.array_max(F.transform("logits", lambda x: F.struct(x["logit"].alias("l"), (-x["class"]).alias("c"))))
    return logits.select(key, label, (-ranked["c"]).alias("predicted"))


def triplet_loss(rows: DataFrame, margin: float = 0.3) -> DataFrame:
    """Mean hinge of distances over rows (anchor, positive, negative)."""
    gap = V.distance(F.col("anchor"), F.col("positive")) - V.distance(F.col("anchor"), F.col("negative")) + margin
    return rows.agg(F.avg(F.greatest(F.lit(0.0), gap)).alias("loss"))
