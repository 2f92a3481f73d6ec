"""Projections: principal components, subspace removal, linear discriminants.

Second moments are sums over rows of a d x d matrix, built per partition by numpy, sent in stripes of ``STRIPE`` numbers
and added stripe by stripe in tasks; only the matrix itself (d squared numbers) is decomposed on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import materialised
from . import metrics as M

#: Numbers of a stripe.
STRIPE = 1 << 20
#: Rows of a batch that a task turns into other vectors at a time.
ROWS = 1024


def matrix_of(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def by_rows(vectors: pd.Series, out: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """What ``out`` gives for the rows of a batch, ``ROWS`` at a time, so that a task's memory doesn't grow with its batches."""
    done: list[np.ndarray] = []
    for at in range(0, len(vectors), ROWS):
        done.extend(out(matrix_of(vectors.iloc[at : at + ROWS])))
    return pd.Series(done, dtype=object)


def projected(vector: Column, basis: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """(vector - mean) times the columns of ``basis``, ``ROWS`` rows at a time."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return by_rows(v, lambda x: (x - mean if mean is not None else x) @ basis)

    return apply(vector)


def removed(rows: DataFrame, components: np.ndarray, vector: str = "vec") -> DataFrame:
    """``rows`` with their vectors less the part in the space of ``components`` (rows); they aren't centred.

    It is a pass over Arrow batches, ``ROWS`` rows at a time; other columns pass through, null vectors stay null.
    """
    at = rows.columns.index(vector)
    kept = rows.withColumn(vector, F.col(vector).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                v = part.column(at)
                x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, components.shape[1])
                ends = np.r_[0, np.cumsum(np.where(v.is_valid().to_numpy(zero_copy_only=False), x.shape[1], 0))].astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array((x - (x @ components.T) @ components).ravel()), mask=v.is_null())
                yield part.set_column(at, part.schema.names[at], out)

    return kept.mapInArrow(run, kept.schema)


def components_for(shares: np.ndarray, ratio: float) -> int:
    """How many components it takes to reach a ratio of the variance."""
    return int(np.searchsorted(np.cumsum(shares), ratio)) + 1


def principal_components(rows: DataFrame, k: int, vector: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, shares of variance) by Spark's PCA; signs are arbitrary."""
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(rows.select(array_to_vector(vector).alias("_x")))
    return model.pc.toArray().T, model.explainedVariance.toArray()


def without_space_of(rows: DataFrame, other: DataFrame, ratio: float, vector: str = "vec") -> tuple[DataFrame, int]:
    """``rows`` less their part in the components that explain ``ratio`` of the variance of ``other``, and their number.

    They are written: a task that also summed them up would hold two Python workers at a time.
    """
    d = other.select(F.size(vector).alias("d")).first()["d"]
    parts, shares = principal_components(other, d, vector)
    k = min(components_for(shares, ratio), len(parts))
    return materialised(removed(rows, parts[:k], vector)), k


def without_main_space(rows: DataFrame, ratio: float = 0.9, vector: str = "vec") -> tuple[DataFrame, int]:
    """``rows`` with the components that explain ``ratio`` of the variance projected out, and their number."""
    return without_space_of(rows, rows, ratio, vector)


@dataclass
class Discriminant:
    mean: np.ndarray
    scalings: np.ndarray  # columns
    ratios: np.ndarray


def stripes_added(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of flat matrices that tasks emit as rows (stripe, x) of ``width`` numbers in bytes.

    Stripes are added by tasks of a shuffle, one stripe at a time; the driver gets the sum alone.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(0)
        for b in batches:
            for stripe, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(x.as_buffer(), np.float64)
                if stripe != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held.tobytes()], pa.binary())], names=["stripe", "x"])
                    at, held = stripe, np.zeros(len(part))
                held = held + part
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held.tobytes()], pa.binary())], names=["stripe", "x"])

    summed = parts.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(add, "stripe long, x binary")
    return np.concatenate([np.zeros(0), *[np.frombuffer(bytes(r["x"]), np.float64) for r in sorted(summed.collect(), key=lambda r: r["stripe"])]])


def in_stripes(total: np.ndarray, width: int) -> pa.RecordBatch:
    cuts = [total[at : at + width].tobytes() for at in range(0, len(total), width)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), pa.array(cuts, pa.binary())], names=["stripe", "x"])


def moments(rows: DataFrame, vector: str, centre: np.ndarray | None = None) -> np.ndarray:
    """The sum of outer products of vectors, less those of a mean if given."""
    d = rows.select(F.size(vector).alias("d")).first()["d"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer = np.zeros((d, d))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x = x if centre is None else x - centre
            outer += x.T @ x
        yield in_stripes(outer.ravel(), STRIPE)

    got = stripes_added(rows.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null").mapInArrow(partial, "stripe long, x binary"), STRIPE)
    return got.reshape(d, d)


def numbers(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.float64)


def class_moments(rows: DataFrame, label: str, vector: str, stats: DataFrame, width: int = STRIPE) -> DataFrame:
    """(label, stripe, x): stripes of each class's sum of outer products about its mean, however many classes there are.

    Rows are range-partitioned by label and a hash, so that a task has few classes and a large class has many tasks; a task
    holds one matrix at a time. Stripes of a class meet by (label, stripe). ``stats`` has (label, n, sums).
    """
    kind = rows.schema[label].dataType.simpleString()
    lean = rows.select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).filter("label is not null and v is not null")
    centred = lean.join(stats.select("label", F.transform("sums", lambda s: s / F.col("n")).alias("mean")), "label").select("label", V.subtract(F.col("v"), F.col("mean")).alias("v"))
    dealt = centred.repartitionByRange("label", F.xxhash64("v")).sortWithinPartitions("label")

    def stripes(name, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at, start in enumerate(range(0, total.size, width)):
            yield pa.RecordBatch.from_arrays([name, pa.array([at]), pa.array([total.ravel()[start : start + width].tobytes()], pa.binary())], names=["label", "stripe", "x"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for b in batches:
            labels = b.column(0)
            codes = labels.dictionary_encode().indices.to_numpy(zero_copy_only=False) if b.num_rows else np.zeros(0, int)
            cuts = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)] if len(codes) else np.zeros(1, int)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x = b.column(1).slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                name = labels.slice(i, 1)
                if held is None or name[0] != held[0]:
                    if held is not None:
                        yield from stripes(held, total)
                    held, total = name, np.zeros((x.shape[1], x.shape[1]))
                total += x.T @ x
        if held is not None:
            yield from stripes(held, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for i in range(b.num_rows):
                key, x = (b.column(0).slice(i, 1), b.column(1)[i].as_py()), numbers(b.column(2)[i])
                if at is None or (key[0][0], key[1]) != (at[0][0], at[1]):
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([at[0], pa.array([at[1]]), pa.array([total.tobytes()], pa.binary())], names=["label", "stripe", "x"])
                    at, total = key, np.zeros(len(x))
                total = total + x
        if at is not None:
            yield pa.RecordBatch.from_arrays([at[0], pa.array([at[1]]), pa.array([total.tobytes()], pa.binary())], names=["label", "stripe", "x"])

    schema = f"label {kind}, stripe long, x binary"
    return dealt.mapInArrow(partial, schema).repartition("label", "stripe").sortWithinPartitions("label", "stripe").mapInArrow(add, schema)


def shrunk_within(rows: DataFrame, label: str, vector: str, stats: DataFrame, n: int, d: int, width: int = STRIPE) -> np.ndarray:
    """The covariance within classes, each shrunk on components of unit variance by Ledoit and Wolf's estimate, weighted by size.

    As many jobs for any number of classes: class matrices stay stripes in tasks, classes' rates are columns, and the driver
    gets the weighted sum alone. A class's target is its diagonal of variances, so only its rate needs its whole matrix.
    """
    kind = rows.schema[label].dataType.simpleString()
    mats = materialised(class_moments(rows, label, vector, stats, width))

    def diagonal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, start = numbers(b.column(2)[i]), b.column(1)[i].as_py() * width
                at = np.arange(-(-start // (d + 1)), -(-(start + len(x)) // (d + 1)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(at), pa.int64())), pa.array(at), pa.array(x[at * (d + 1) - start])], names=["label", "dim", "x"])

    cells = mats.mapInArrow(diagonal, f"label {kind}, dim long, x double").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c"))
    scale = lambda v, m: F.when(v / m > 0, F.sqrt(v / m)).otherwise(1.0)
    known = cells.select("label", F.col("c.x").alias("v")).join(stats, "label")
    known = materialised(known.select("label", F.col("n").cast("double").alias("m"), F.transform("sums", lambda s: s / F.col("n")).alias("mean"), F.transform("v", lambda v: scale(v, F.col("n"))).alias("scale"), F.size(F.filter("v", lambda v: v > 0)).alias("trace")))

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                x, s = numbers(b.column(2)[i]), b.column(3)[i].values.to_numpy()
                at = np.arange(len(x)) + b.column(1)[i].as_py() * width
                out.append(float(((x / (b.column(4)[i].as_py() * s[at // d] * s[at % d])) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["label", "squares"])

    fro = mats.join(known.select("label", "scale", "m"), "label").select("label", "stripe", "x", "scale", "m").mapInArrow(squared, f"label {kind}, squares double").groupBy("label").agg(F.sum("squares").alias("squares"))
    apart = rows.select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).join(known.select("label", "mean", "scale"), "label")
    unit = F.zip_with(V.subtract(F.col("v"), F.col("mean")), "scale", lambda x, y: x / y)
    fourth = apart.select("label", F.pow(V.dot(unit, unit), 2).alias("q")).groupBy("label").agg(F.sum("q").alias("q"))
    mean = F.col("trace") / d
    delta = (F.col("squares") - 2 * mean * F.col("trace") + mean * mean * d) / d
    beta = F.least((F.col("q") / F.col("m") - F.col("squares")) / (d * F.col("m")), delta)
    rates = known.join(fro, "label").join(fourth, "label").select("label", "m", "scale", mean.alias("mean"), F.when(delta > 0, beta / delta).otherwise(0.0).alias("rate"))

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                stripe, x, s = b.column(0)[i].as_py(), numbers(b.column(1)[i]), b.column(2)[i].values.to_numpy()
                m, mean, rate = (b.column(c)[i].as_py() for c in (3, 4, 5))
                x, start = (1 - rate) / n * x, stripe * width
                at = np.arange(-(-start // (d + 1)), -(-(start + len(x)) // (d + 1)))
                x[at * (d + 1) - start] += m / n * rate * mean * s[at] ** 2
                yield pa.RecordBatch.from_arrays([pa.array([stripe]), pa.array([x.tobytes()], pa.binary())], names=["stripe", "x"])

    parts = mats.join(rates, "label").select("stripe", "x", "scale", "m", "mean", "rate").mapInArrow(weighted, "stripe long, x binary")
    return stripes_added(parts, width).reshape(d, d)


def class_stats(rows: DataFrame, label: str, vector: str) -> tuple[DataFrame, int, int, np.ndarray, np.ndarray, int]:
    """(label, n, sums) by class; the numbers of rows and dimensions, the mean, the scatter of class means, and the number of classes."""
    found = M.class_sums(rows.filter(F.col(label).isNotNull()), label, vector, normal=False)
    stats = materialised(found.select(F.col(label).alias("label"), "n", "sums"))
    size = stats.agg(F.sum("n").alias("n"), F.max(F.size("sums")).alias("d"), F.count("*").alias("classes")).first()
    n, d, classes = size["n"] or 0, size["d"] or 0, size["classes"]
    total = stats.select(F.posexplode("sums").alias("dim", "s")).groupBy("dim").agg(F.sum("s").alias("s")).orderBy("dim").collect()
    mean = np.array([r["s"] for r in total]) / max(n, 1)
    spread = stats.select(F.transform("sums", lambda s: s / F.sqrt("n")).alias("v"), F.sqrt("n").alias("w"))
    # sum of n * (m - mean)(m - mean)' is that of the outer products of sqrt(n) * (m - mean)
    centred = spread.select(F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda x, m: x - F.col("w") * m).alias("v"))
    return stats, n, d, mean, moments(centred, "v") / max(n, 1), classes


def discriminant(rows: DataFrame, k: int, label: str = "label", vector: str = "vec", shrinkage: float | str = 0.0) -> Discriminant:
    """Linear discriminant analysis: directions that maximise scatter between classes over that within.

    ``shrinkage`` blends the covariance within classes with a multiple of the identity, which a singular one needs;
    "auto" takes Ledoit and Wolf's estimate for each class, on components scaled to unit variance, weighted by the class
    sizes. Sums by class come from ``metrics.class_sums``; second moments are d x d numbers a task, added in stripes. Jobs
    are as many for any number of classes. Where classes span less than the dimensions, ``svd_discriminant`` cuts instead.
    """
    stats, n, d, mean, between, classes = class_stats(rows, label, vector)
    if shrinkage == "auto":
        within = shrunk_within(rows, label, vector, stats, n, d) + 1e-10 * np.eye(d)
    else:
        outer = moments(rows.filter(F.col(label).isNotNull()), vector, mean)
        within = outer / n - between
        within = (1 - shrinkage) * within + (shrinkage * np.trace(within) / d + 1e-10) * np.eye(d)
    inverse = np.linalg.inv(np.linalg.cholesky(within))
    values, vectors = np.linalg.eigh(inverse @ between @ inverse.T)
    order = np.argsort(-values)[: min(k, classes - 1)]
    return Discriminant(mean, inverse.T @ vectors[:, order], values[order])


def triangle(rows: DataFrame, vector: str, d: int, fan_in: int = 8) -> np.ndarray:
    """R of the QR decomposition of the matrix of all vectors, by a tree: tasks reduce their rows to d x d, then ``fan_in`` of those.

    Unlike second moments it doesn't square the condition number, so small singular values keep their digits.
    """

    def reduced(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, d))
        for x in blocks:
            r = np.linalg.qr(np.vstack([r, x]), mode="r")
        return r

    def row(r: np.ndarray, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["part", "r"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reduced(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d) for b in batches if b.num_rows)
        if len(r):
            yield row(r, TaskContext.get().partitionId())

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        r = reduced(np.frombuffer(x.as_buffer(), np.float64).reshape(-1, d) for x in t.column("r"))
        return pa.Table.from_batches([row(r, key[0].as_py())])

    parts = materialised(rows.select(F.col(vector).cast("array<double>")).mapInArrow(leaves, "part long, r binary"))
    while (n := parts.count()) > fan_in:
        bundles = -(-n // fan_in)
        # numbers of parts may have gaps; a hash deals them about evenly
        dealt = parts.withColumn("part", F.pmod(F.xxhash64("part", F.lit(n)), F.lit(bundles)))
        parts = materialised(dealt.groupBy("part").applyInArrow(merged, "part long, r binary"))
    return reduced(np.frombuffer(bytes(r["r"]), np.float64).reshape(-1, d) for r in parts.orderBy("part").toLocalIterator())


def svd_discriminant(rows: DataFrame, k: int, label: str = "label", vector: str = "vec", tolerance: float = 1e-4) -> Discriminant:
    """Linear discriminant analysis by singular values, which needs no invertible covariance: directions in which classes don't
    vary within (singular value at most ``tolerance``) are cut, then those of the class means in the space that is left.

    The rows about their class means, scaled to unit variance within classes, are reduced to a d x d triangle; a constant
    component keeps its scale. Rows with a null label or vector take no part.
    """
    stats, n, d, mean, between, classes = class_stats(rows, label, vector)
    lean = rows.select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).filter("label is not null and v is not null")
    means = stats.select("label", F.transform("sums", lambda s: s / F.col("n")).alias("mean"))
    apart = materialised(lean.join(means, "label").select(V.subtract(F.col("v"), F.col("mean")).alias("v")))
    cells = M.cell_sums(apart.withColumn("_all", F.lit(0)), "_all", F.col("v")).orderBy("dim").collect()
    scale = np.sqrt(np.array([r["q"] / n for r in cells]))
    scale[scale == 0] = 1
    unit = apart.select(F.zip_with("v", F.array(*map(F.lit, scale.tolist())), lambda x, s: x / s).alias("v"))
    _, size, axes = np.linalg.svd(triangle(unit, "v", d) / max(n - classes, 1) ** 0.5)
    rank = int((size > tolerance).sum())
    whitened = (axes[:rank] / scale).T / size[:rank]
    # the class means' singular values in that space are roots of the eigenvalues of their scatter
    values, vectors = np.linalg.eigh(whitened.T @ (between * n / max(classes - 1, 1)) @ whitened)
    order = np.argsort(-values)[: min(k, classes - 1)]
    top = float(np.sqrt(max(values[order[0]], 0))) if len(order) else 0.0
    order = order[np.sqrt(np.maximum(values[order], 0)) > tolerance * top]
    return Discriminant(mean, whitened @ vectors[:, order], values[order])
