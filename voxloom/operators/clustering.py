"""Clusterings: k-means and mixtures of many cells in the same passes, Ward linkage of class centroids, density clusters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import materialised
from .reduction import STRIPE, in_stripes, stripes_added
from .sampling import numbered

#: Rows of a block in a task, and rows from which k-means draws its first centres.
BLOCK, SAMPLE = 2048, 4096

#: Rows and pairs that a task compares at a time, blocks that a table is cut into at least where they have so many rows, bytes of
#: a block's vectors, and tasks of a pass over blocks at most.
PIECE, PAIRS, SHARES, HELD, TASKS = 512, 1 << 20, 12, 1 << 24, 2000

#: Class centroids that Ward linkage takes: it needs the distances of all pairs, 8 bytes each, in one task.
WARD_ROWS = 5000


def sweep_range(rows: int) -> list[int]:
    """The numbers of clusters that are tried: 2 to 30, below the number of rows."""
    return list(range(2, min(31, rows)))


Cell = tuple[int, int]


def in_tasks(rows: DataFrame, vector: str, sums: Callable[[np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """The sum over all rows of what ``sums`` gives for a block of vectors, flat: tasks add blocks, then stripes of tasks meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.column(0).slice(at, BLOCK)
                flat = np.concatenate([np.ravel(x) for x in sums(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1))])
                total = flat if total is None else total + flat
        if total is not None:
            yield in_stripes(total, STRIPE)

    return stripes_added(rows.select(vector).mapInArrow(run, "stripe long, x binary"), STRIPE)


def by_cluster(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """(k, 1 + d): numbers and sums of the rows of each cluster."""
    one = np.zeros((len(x), k))
    one[np.arange(len(x)), label] = 1
    return np.concatenate([one.sum(axis=0)[:, None], one.T @ x], axis=1)


def squares_to(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over a sample: each next centre is drawn by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(sample)))]
    low = squares_to(sample, sample[at])[:, 0]
    while len(at) < k:
        total = low.sum()
        at.append(int(rng.choice(len(sample), p=low / total)) if total > 0 else int(rng.integers(len(sample))))
        low = np.minimum(low, squares_to(sample, sample[at[-1:]])[:, 0])
    return sample[at].copy()


def lloyd(rows: DataFrame, cells: list[Cell], key: str, vector: str = "vec", rounds: int = 300, tolerance: float = 1e-4, sample: int = SAMPLE) -> dict[Cell, np.ndarray]:
    """Centres of k-means for each cell (k, seed): all cells in the same passes, until each has settled.

    A round is one pass in which tasks assign their rows in every cell that still moves and add them by cluster; the
    driver has the centres only. First centres are drawn from ``sample`` rows, those of the smallest hashes of ``key``; all
    else takes all rows. A cell has settled when its centres move by at most ``tolerance`` of the mean variance, squared and
    summed. A cluster without rows keeps its centre. A table without rows has no centres.
    """
    spark = rows.sparkSession
    start = np.array([r[0] for r in rows.orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()], float)
    centres = {c: first_centres(start, c[0], c[1]) for c in cells} if len(start) else {}
    moving, spread = list(centres), 0.0
    for turn in range(rounds):
        if not moving:
            break
        shared = spark.sparkContext.broadcast([centres[c] for c in moving])

        def sums(x: np.ndarray, shared=shared) -> list[np.ndarray]:
            moments = [np.array([len(x)]), x.sum(axis=0), (x * x).sum(axis=0)]
            return moments + [by_cluster(x, squares_to(x, at).argmin(axis=1), len(at)) for at in shared.value]

        flat, d = in_tasks(rows, vector, sums), start.shape[1]
        shared.destroy()
        if not turn:
            spread = float((flat[1 + d : 1 + 2 * d] / flat[0] - (flat[1 : 1 + d] / flat[0]) ** 2).mean())
        at, still = 1 + 2 * d, []
        for c in moving:
            total = flat[at : at + c[0] * (1 + d)].reshape(c[0], 1 + d)
            at += total.size
            new = np.where(total[:, :1] > 0, total[:, 1:] / np.maximum(total[:, :1], 1), centres[c])
            if ((new - centres[c]) ** 2).sum() > tolerance * spread:
                still.append(c)
            centres[c] = new
        moving = still
    return centres


def inertias(rows: DataFrame, centres: dict[Cell, np.ndarray], vector: str = "vec") -> dict[Cell, float]:
    """The summed squared distances to the nearest centre, of all cells in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(list(centres.values()))
    flat = in_tasks(rows, vector, lambda x: [np.array([squares_to(x, c).min(axis=1).sum() for c in shared.value])])
    shared.destroy()
    return dict(zip(centres, flat.tolist(), strict=True))


def judged(rows: DataFrame, centres: list[np.ndarray], vector: str = "vec") -> list[tuple[float | None, float | None]]:
    """(mean silhouette by cosine distance, Calinski-Harabasz score) of the clusters about each set of centres, in two passes.

    Null with fewer than two clusters, as in ``metrics``; a cluster of one row counts 0.
    """
    spark = rows.sparkSession
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    shared = spark.sparkContext.broadcast(centres)

    def sums(x: np.ndarray) -> list[np.ndarray]:
        labels = [squares_to(x, c).argmin(axis=1) for c in shared.value]
        return [np.array([len(x), (x * x).sum()])] + [by_cluster(np.concatenate([x, unit(x)], axis=1), label, len(c)) for label, c in zip(labels, shared.value, strict=True)]

    flat, at, parts, scores = in_tasks(rows, vector, sums), 2, [], []
    if not len(flat):
        return [(None, None)] * len(centres)
    n, square, d = flat[0], flat[1], centres[0].shape[1]
    for c in centres:
        total = flat[at : at + len(c) * (1 + 2 * d)].reshape(len(c), 1 + 2 * d)
        at += total.size
        used = total[total[:, 0] > 0]
        means = used[:, 1 : 1 + d] / used[:, :1]
        within, between = square - (used[:, :1] * means**2).sum(), (used[:, :1] * (means - used[:, 1 : 1 + d].sum(axis=0) / n) ** 2).sum()
        k = len(used)
        scores.append(float(between / (k - 1) / (within / (n - k))) if 1 < k < n and within > 0 else None)
        parts.append((c, total[:, 0], total[:, 1 + d :]))
    shared.destroy()
    stats = spark.sparkContext.broadcast(parts)

    def silhouettes(x: np.ndarray) -> list[np.ndarray]:
        u, out, at = unit(x), [], np.arange(len(x))
        own_square = (u * u).sum(axis=1)
        for c, size, total in stats.value:
            label = squares_to(x, c).argmin(axis=1)
            near = u @ total.T
            far = np.where(size > 0, 1 - near / np.maximum(size, 1), np.inf)
            own = size[label]
            a = ((own - 1) - (near[at, label] - own_square)) / np.maximum(own - 1, 1)
            far[at, label] = np.inf
            b = far.min(axis=1)
            high = np.maximum(a, b)
            out.append(np.where((own > 1) & (high > 0) & np.isfinite(b), (b - a) / np.where(high > 0, high, 1), 0.0).sum())
        return [np.array(out)]

    got = in_tasks(rows, vector, silhouettes) / n
    stats.destroy()
    return [(float(s) if (p[1] > 0).sum() > 1 else None, ch) for s, p, ch in zip(got, parts, scores, strict=True)]


def kmeans_sweep(rows: DataFrame, ks: list[int] | None, key: str, vector: str = "vec", seeds: int = 10, seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette, calinski_harabasz, best_silhouette, best_ch) of the best of several seeded runs for each k.

    ``ks``: by default ``sweep_range`` of the rows. The last two columns mark the k with the largest value, ties to the
    smaller k. All runs share their passes: there are as many jobs as the slowest run has rounds, and three more passes.
    """
    x = materialised(rows.select(key, F.col(vector).cast("array<double>").alias(vector)).filter(F.col(vector).isNotNull()))
    ks = ks or sweep_range(x.count())
    centres = lloyd(x, [(k, seed + s) for k in ks for s in range(seeds)], key, vector)
    cost = inertias(x, centres, vector)
    best = [min((c for c in centres if c[0] == k), key=lambda c: (cost[c], c[1])) for k in ks if centres]
    marks = judged(x, [centres[c] for c in best], vector) if best else []
    out = [(c[0], cost[c], *m) for c, m in zip(best, marks, strict=True)]
    top = [max((r[i] for r in out if r[i] is not None), default=None) for i in (2, 3)]
    ends = [next((r[0] for r in out if r[i] == t and t is not None), None) for i, t in zip((2, 3), top, strict=True)]
    return rows.sparkSession.createDataFrame([(*r, r[0] == ends[0], r[0] == ends[1]) for r in out], "k int, inertia double, silhouette double, calinski_harabasz double, best_silhouette boolean, best_ch boolean")


@dataclass
class Mixture:
    """Weights (k), means (k, d), and covariances: variances (k, d), or whole (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    spread: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """(rows, k): log of weight times density."""
        d = x.shape[1]
        if self.spread.ndim == 2:
            away = [((x - m) ** 2 / v).sum(axis=1) + np.log(v).sum() for m, v in zip(self.means, self.spread, strict=True)]
        else:
            away = []
            for m, c in zip(self.means, self.spread, strict=True):
                factor = np.linalg.cholesky(c)
                away.append((np.linalg.solve(factor, (x - m).T) ** 2).sum(axis=0) + 2 * np.log(np.diag(factor)).sum())
        return np.log(self.weights) - 0.5 * (np.stack(away, axis=1) + d * np.log(2 * np.pi))


def weighted_moments(x: np.ndarray, share: np.ndarray, full: bool) -> list[np.ndarray]:
    """Sums by component of weights, vectors, and squares or outer products."""
    squares = np.stack([(x * s[:, None]).T @ x for s in share.T]) if full else share.T @ (x * x)
    return [share.sum(axis=0), share.T @ x, squares]


def fitted(flat: np.ndarray, k: int, d: int, full: bool, n: float, floor: float) -> Mixture:
    many = flat[:k] + 10 * np.finfo(float).eps
    means = flat[k : k + k * d].reshape(k, d) / many[:, None]
    if full:
        squares = flat[k + k * d :].reshape(k, d, d) / many[:, None, None]
        spread = squares - means[:, :, None] * means[:, None, :] + floor * np.eye(d)
    else:
        spread = np.maximum(flat[k + k * d :].reshape(k, d) / many[:, None] - means**2, 0) + floor
    return Mixture(many / n, means, spread)


def mixtures(rows: DataFrame, cells: list[tuple[int, bool]], key: str, vector: str = "vec", seed: int = 42, rounds: int = 100, tolerance: float = 1e-3, floor: float = 1e-6) -> dict[tuple[int, bool], float]:
    """The mean log likelihood per row of Gaussian mixtures (k, whole covariances) by EM from k-means clusters, all in the same passes.

    A pass adds weights, sums and squares per component for every cell that hasn't settled (its gain fell to
    ``tolerance``): k * (d + 1) numbers and as many squares, or k * d * d outer products, a task and cell.
    """
    spark, d = rows.sparkSession, rows.select(F.size(vector).alias("d")).first()["d"]
    centres = lloyd(rows, sorted({(k, seed) for k, _ in cells}), key, vector)
    size = lambda c: c[0] * (1 + d + (d * d if c[1] else d))
    shift = rows.limit(1).select(vector).first()[0]
    offset = np.array(shift, float)
    state: dict[tuple[int, bool], Mixture | None] = dict.fromkeys(cells)
    likely, moving = dict.fromkeys(cells, -np.inf), list(cells)
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast([(c, state[c]) for c in moving])

        def sums(x: np.ndarray, shared=shared) -> list[np.ndarray]:
            out = [np.array([len(x)])]
            for (k, full), mixture in shared.value:
                if mixture is None:  # the clusters themselves
                    share, norm = np.eye(k)[squares_to(x, centres[k, seed]).argmin(axis=1)], np.zeros(1)
                else:
                    logs = mixture.logs(x - offset)
                    high = logs.max(axis=1, keepdims=True)
                    norm = high[:, 0] + np.log(np.exp(logs - high).sum(axis=1))
                    share = np.exp(logs - norm[:, None])
                out += [np.array([norm.sum()]), *weighted_moments(x - offset, share, full)]
            return out

        flat, at, still = in_tasks(rows, vector, sums), 1, []
        shared.destroy()
        for c in moving:
            now, known = flat[at] / flat[0], state[c] is not None
            state[c] = fitted(flat[at + 1 : at + 1 + size(c)], c[0], d, c[1], flat[0], floor)
            at += 1 + size(c)
            if not known or abs(now - likely[c]) >= tolerance:
                still.append(c)
            likely[c] = now if known else -np.inf
        moving = still
        if not moving:
            break
    return {c: float(v) for c, v in likely.items()}


def diagonal_mixture(rows: DataFrame, k: int, vector: str = "vec", seed: int = 42, rounds: int = 100, tolerance: float = 1e-3, floor: float = 1e-6) -> float:
    """The mean log likelihood per row of a mixture with diagonal covariances."""
    return mixtures(rows.select(vector), [(k, False)], vector, vector, seed, rounds, tolerance, floor)[k, False]


def mixture_sweep(rows: DataFrame, ks: list[int] | None = None, vector: str = "vec", seed: int = 42) -> DataFrame:
    """(k, covariance, log_likelihood, bic, best) of Gaussian mixtures: full covariances where rows exceed k * (d + 1), else diagonal ones.

    All mixtures share their passes, so that there are as many jobs as the slowest has rounds.
    """
    x = materialised(rows.select(F.col(vector).cast("array<double>").alias(vector)).filter(F.col(vector).isNotNull()))
    n = x.count()
    d = x.select(F.size(vector).alias("d")).first()["d"] if n else 0
    cells = [(k, n > k * (d + 1)) for k in ks or sweep_range(n)]
    likely = mixtures(x, cells, vector, vector, seed) if n and cells else {}
    out = []
    for k, full in likely:
        parameters = k - 1 + k * d + k * (d * (d + 1) // 2 if full else d)
        ll = n * likely[k, full]
        out.append((k, "full" if full else "diag", ll, parameters * math.log(n) - 2 * ll))
    low = min((r[3] for r in out), default=None)
    first = next((r[0] for r in out if r[3] == low), None)
    return rows.sparkSession.createDataFrame([(*r, r[0] == first) for r in out], "k int, covariance string, log_likelihood double, bic double, best boolean")


def ward_merges(x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Ward linkage of rows: (cluster, cluster, distance, size) of each merge; merge i makes cluster n + i."""
    n = len(x)
    square = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    name, size, out = np.arange(n), np.ones(n), []
    for step in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        low = float(d[i, j])
        a, b = sorted((int(name[i]), int(name[j])))
        both = size[i] + size[j]
        alive = np.isfinite(d[i]) & np.isfinite(d[j])
        s = size[alive]
        new = np.sqrt(np.maximum(((size[i] + s) * d[i, alive] ** 2 + (size[j] + s) * d[j, alive] ** 2 - s * low**2) / (both + s), 0))
        d[j, :] = d[:, j] = np.inf
        d[i, alive] = d[alive, i] = new
        d[i, i] = np.inf
        name[i], size[i] = n + step, both
        out.append((a, b, low, int(both)))
    return out


def ward(rows: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """(merge, a, b, distance, size) of Ward linkage over class centroids, in the order of ``key``, as linkage matrices have it.

    Merging goes one pair at a time over all distances, so it is for class centroids, which are few: at most
    ``WARD_ROWS``, which is checked; one task does it.
    """
    n = rows.count()
    if n > WARD_ROWS:
        raise ValueError(f"{n} rows: Ward linkage is for up to {WARD_ROWS} class centroids")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = ward_merges(np.stack(pdf.sort_values("k")["v"].to_list()).astype(float)) if len(pdf) else []
        return pd.DataFrame([(i, *r) for i, r in enumerate(got)], columns=["merge", "a", "b", "distance", "size"])

    return rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.lit(1).alias("g")).groupBy("g").applyInPandas(merge, "merge int, a int, b int, distance double, size int")


def ward_elbow(merges: DataFrame, last: int = 30) -> DataFrame:
    """(k): the number of clusters where the last merges' distances bend most: last - argmax of their second differences."""
    total = merges.count()
    n = min(last, total)
    tail = merges.filter(F.col("merge") >= total - n)
    w = W.orderBy("merge")
    bend = tail.select("merge", (F.lead("distance", 2).over(w) - 2 * F.lead("distance", 1).over(w) + F.col("distance")).alias("bend")).filter("bend is not null")
    best = bend.agg(F.min_by("merge", F.struct((-F.col("bend")).alias("b"), "merge")).alias("m"))
    return best.select((F.lit(n) - (F.col("m") - (total - n))).cast("int").alias("k"))


def elbow(levels: DataFrame, order: str, value: str) -> DataFrame:
    """``levels`` with the second difference of a value, and whether it is the largest (ties to the first)."""
    w = W.orderBy(order)
    second = F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)
    out = levels.withColumn("second", second)
    top = W.partitionBy()
    best = F.min_by(F.col(order), F.struct((-F.coalesce("second", F.lit(float("-inf")))).alias("s"), F.col(order).alias("o"))).over(top)
    return out.withColumn("is_elbow", F.coalesce(F.col("second").isNotNull() & (F.col(order) == best), F.lit(False)))


def spanning(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges (i, j, distance) of a minimum spanning forest of unit rows by cosine distance, of at most ``limit``.

    For every smaller limit its edges up to that connect the same rows as all pairs do. Prim's way: a row at a time joins
    the tree, against all others at once.
    """
    n = len(x)
    near, parent, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        out[at] = False
        d = np.round(1 - x @ x[at], 9)
        closer = out & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.where(out, near, np.inf).argmin()) if out.any() else at
        if not np.isfinite(near[at]) or not out[at]:
            at = int(out.argmax())
            continue
        if near[at] <= limit:
            edges.append((int(parent[at]), at, float(near[at])))
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, d = zip(*edges, strict=True)
    return np.array(i), np.array(j), np.array(d)


def merged(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[int]:
    """Makes components u[i] and v[i] one in ``label``, in place, and gives the places i that joined two."""
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while c in up:
            up[c] = up.get(up[c], up[c])
            c = up[c]
        return c

    joined = []
    for at, (p, q) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        p, q = top(p), top(q)
        if p != q:
            up[max(p, q)] = min(p, q)
            joined.append(at)
    if up:
        to = np.arange(label.max() + 1)
        for c in up:
            to[c] = top(c)
        label[:] = to[label]
    return joined


def linked(s: np.ndarray, rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, levels: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of pairs with the cosines ``s`` that join components of a level, which ``labels`` (levels, rows) then has as one."""
    for k, limit in enumerate(levels):
        at = np.flatnonzero(s >= 1 - limit - 1e-8)
        i, j, d = rows[at // len(cols)], cols[at % len(cols)], np.round(1 - s.ravel()[at], 9)
        while True:
            apart = (d <= limit) & (labels[k, i] != labels[k, j])
            i, j, d = i[apart], j[apart], d[apart]
            if not len(i):
                break
            # one pair of each component on either side: few rounds, however many pairs
            u, v = labels[k, i], labels[k, j]
            few = np.unique(np.concatenate([np.unique(u, return_index=True)[1], np.unique(v, return_index=True)[1]]))
            few = few[merged(labels[k], u[few], v[few])]
            for m in range(k + 1, len(levels)):
                merged(labels[m], labels[m, i[few]], labels[m, j[few]])
            yield i[few], j[few], d[few]


def joined_block(x: np.ndarray, cell: np.ndarray, split: int, labels: np.ndarray, levels: list[float], near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The edges (i, j, distance) that join components between rows before ``split`` and from it on (0: all with all), and how many pairs were compared.

    Rows are unit vectors by cell on each side; ``near`` tells which cells can have neighbours in which. ``labels`` holds the
    components that are known at each level and is changed in place. Rows of one component at the smallest level are never
    compared with the largest one of the other side again, if they are in it: that could join nothing.
    """
    n, ends, out, compared = len(x), split or len(x), [], 0
    alone = near.mean() < 0.5
    cuts = np.flatnonzero(np.diff(cell[:ends])) + 1 if alone else np.zeros(0, np.int64)
    cuts = np.unique(np.r_[0, cuts, np.arange(0, ends, PIECE), ends])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        left, right = np.arange(lo, hi), np.arange(split or lo, n)
        if alone:
            right = right[near[np.unique(cell[lo:hi])].any(axis=0)[cell[right]]]
        if not len(right):
            continue
        large = np.bincount(labels[0, right]).argmax()
        inside = labels[0, left] == large
        for rows, others in ((left[~inside], right), (left[inside], right[labels[0, right] != large])):
            wide = max(1, PAIRS // max(len(rows), 1))
            for at in range(0, len(others) if len(rows) else 0, wide):
                cols = others[at : at + wide]
                compared += len(rows) * len(cols)
                out += linked(x[rows] @ x[cols].T, rows, cols, labels, levels)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), compared
    i, j, d = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, j, d, compared


def near_forest(rows: DataFrame, key: str, limit: float, vector: str = "vec", pivots: int | None = None, part: int | None = None, levels: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, distance): pairs within ``limit`` by cosine that connect what all such pairs connect, at each of ``levels`` (by default ``limit``); and (compared).

    A join of directions within a radius. Rows belong to the cell of their nearest pivot; for unit vectors a cosine distance
    of e is a length of sqrt(2 e), so the triangle inequality tells which cells can have neighbours in which, by their radii.
    Rows in the order of cells are cut into blocks of ``part`` rows. A block is first joined in itself, then each pair of
    blocks with cells that can meet, one task each, from the components that its blocks have by then: rows of one component
    needn't be compared, and only edges that join two are emitted, so neither a dense cluster nor many neighbours make
    quadratically many. What has no such structure is compared whole: all pairs at most once, a block pair held at a time.

    ``pivots``, by default one for 32 rows and at most 1024, are drawn far from each other out of ``SAMPLE`` rows; they only
    decide how much is compared. ``part`` is by default a share of ``SHARES``, and at most ``HELD`` bytes. ``compared`` is the number of pairs
    that were, one row a block or pair of blocks.
    """
    spark, levels = rows.sparkSession, sorted({limit, *(levels or [])})
    unit = materialised(rows.select(F.col(key).alias("k"), V.unit(F.col(vector)).alias("x")).filter("x is not null and k is not null"))
    n = unit.count()
    kind = unit.schema["k"].dataType.simpleString()
    sample = np.array([r[0] for r in unit.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).select("x").collect()])
    if not len(sample):
        return spark.createDataFrame([], f"a {kind}, b {kind}, distance double"), spark.createDataFrame([], "compared long")
    centres = np.unique(first_centres(sample, min(pivots or max(1, min(1024, n // 32)), len(sample)), 42), axis=0)
    reach = float(np.sqrt(2 * (limit + 1e-9))) + 1e-9
    part = part or min(max(PIECE, -(-n // SHARES)), max(PIECE, HELD // (8 * sample.shape[1])))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                held = b.slice(at, BLOCK)
                x = held.column(1).flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
                d = np.sqrt(squares_to(x, centres))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.array(cell, pa.int64()), pa.array(d[np.arange(len(x)), cell])], names=["k", "x", "cell", "d"])

    celled = numbered(unit.mapInArrow(own, f"k {kind}, x array<double>, cell long, d double"), [F.asc("cell"), F.xxhash64("k"), F.asc("k")])
    radius, size = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    for r in celled.groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect():
        radius[r["cell"]], size[r["cell"]] = r["d"], r["n"]
    # rounding of lengths is far below the slack
    near = np.sqrt(squares_to(centres, centres)) <= radius[:, None] + radius + reach + 2e-7
    blocks, end = -(-n // part), np.cumsum(size)
    begin = np.arange(blocks)[:, None] * part
    held = ((end - size < begin + part) & (end > begin) & (size > 0)).astype(float)
    pairs = [(i, j) for i, j in zip(*(a.tolist() for a in np.nonzero(held @ near @ held.T)), strict=True) if i < j]
    shared = spark.sparkContext.broadcast(near)

    def sides(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """A group's rows by block and cell, their vectors and cells."""
        t = t.sort_by([("block", "ascending"), ("cell", "ascending"), ("number", "ascending")]).combine_chunks()
        return t, t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1), t.column("cell").to_numpy()

    def edges(t: pa.Table, i: np.ndarray, j: np.ndarray, d: np.ndarray, compared: int) -> dict[str, pa.Array]:
        keys = t.column("k").combine_chunks()
        none = pa.nulls(1, keys.type)
        a, b = (pa.concat_arrays([keys.take(pa.array(at, pa.int64())), none]) for at in (i, j))
        return {"a": a, "b": b, "distance": pa.array([*d.tolist(), None], pa.float64()), "compared": pa.array([*[None] * len(d), compared], pa.int64())}

    found, members = f"a {kind}, b {kind}, distance double, compared long", f"k {kind}, x array<double>, cell long, number long, block long"

    def within(t: pa.Table) -> pa.Table:
        t, x, cell = sides(t)
        labels = np.tile(np.arange(t.num_rows), (len(levels), 1))
        got = edges(t, *joined_block(x, cell, 0, labels, levels, shared.value))
        kept = t.append_column("labels", pa.ListArray.from_arrays(np.arange(t.num_rows + 1, dtype=np.int32) * len(levels), pa.array(labels.T.ravel(), pa.int64())))
        # the rows with their labels, and the edges beside them
        return pa.concat_tables([kept.select(["k", "x", "cell", "number", "block", "labels"]), pa.table(got)], promote_options="default")

    def between(t: pa.Table) -> pa.Table:
        t, x, cell = sides(t)
        split = int((t.column("block").to_numpy() == t.column("lo").to_numpy()).sum())
        labels = t.column("labels").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).T.copy()
        labels[:, split:] += part
        return pa.table(edges(t, *joined_block(x, cell, split, labels, levels, shared.value)))

    # numbers of partitions are given, as adaptive execution would merge tasks by their few bytes
    dealt = celled.select("k", "x", "cell", "number", F.floor((F.col("number") - 1) / part).alias("block")).repartition(min(blocks, TASKS), "block")
    first = materialised(dealt.groupBy("block").applyInArrow(within, f"{members}, labels array<long>, {found}"))
    links = first.filter("k is null").select("a", "b", "distance", "compared")
    if pairs:
        tiles = spark.createDataFrame([(b, i, j) for i, j in pairs for b in (i, j)], "block long, lo long, hi long")
        met = first.filter("k is not null").select("k", "x", "cell", "number", "block", "labels").join(F.broadcast(tiles), "block").repartition(min(len(pairs), TASKS), "lo", "hi")
        links = links.unionByName(materialised(met.groupBy("lo", "hi").applyInArrow(between, found)))
    return links.filter("a is not null").select("a", "b", "distance"), links.filter("compared is not null").select("compared")


def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (eps, a, b) as others that connect the same: from each node straight to one of its component among ``PAIRS`` edges."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        n, kinds = t.num_rows, [t.column(c).combine_chunks() for c in ("a", "b")]
        keys, level = pa.concat_arrays(kinds).dictionary_encode(), t.column("eps").combine_chunks().dictionary_encode()
        known = len(keys.dictionary)
        node = keys.indices.to_numpy().astype(np.int64) + np.tile(level.indices.to_numpy().astype(np.int64), 2) * known
        label = np.arange(known * len(level.dictionary))
        merged(label, node[:n], node[n:])
        at = np.flatnonzero(label != np.arange(len(label)))
        columns = [level.dictionary.take(pa.array(at // known)), keys.dictionary.take(pa.array(at % known)), keys.dictionary.take(pa.array(label[at] % known))]
        return pa.RecordBatch.from_arrays(columns, names=["eps", "a", "b"])

    held, rows = [], 0
    for b in batches:
        held, rows = [*held, b], rows + b.num_rows
        if rows >= PAIRS:
            yield stars(held)
            held, rows = [], 0
    if rows:
        yield stars(held)


def smallest_reachable(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component): the smallest key reachable, by rounds of neighbours' minima, each written to the shared folder."""
    both = materialised(edges.union(edges.select("b", "a")).toDF("u", "v"))
    # nodes without an edge are settled from the start
    linked = both.select("u").distinct()
    state = materialised(linked.select("u", F.col("u").alias("component")))
    while True:
        low = both.join(state.select(F.col("u").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("low"))
        new = materialised(state.join(low, "u").select("u", F.least("component", "low").alias("component"), F.col("component").alias("was")))
        jumped = new.join(new.select(F.col("u").alias("component"), F.col("component").alias("next")), "component")
        done = materialised(jumped.select("u", F.col("next").alias("component"), "was"))
        state = done.select("u", "component")
        if done.filter("component <> was").isEmpty():
            return nodes.join(state.withColumnRenamed("u", key), key, "left").select(key, F.coalesce("component", key).alias("component"))


def density_clusters(rows: DataFrame, eps: list[float], key: str, vector: str = "vec") -> DataFrame:
    """(eps, key, cluster) with two points as a core: components of the graph of pairs within ``eps``; null is noise.

    All values of ``eps`` are one graph of nodes (eps, key), settled in the same rounds. Its edges are a spanning forest of
    the pairs within the largest, by ``near_forest``, made short by ``starred``, so that rounds are few; rows without a key or vector take no part.
    """
    each = F.explode(F.array(*[F.lit(float(e)) for e in eps])).alias("eps")
    known = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    nodes = known.select(each, F.col(key).alias("k")).select(F.struct("eps", "k").alias("node"))
    pairs = near_forest(known, key, max(eps), vector, levels=eps)[0].select("a", "b", "distance", each).filter("distance <= eps")
    kind = pairs.schema["a"].dataType.simpleString()
    dealt = pairs.select("eps", "a", "b").repartition(-(-pairs.count() // PAIRS) or 1, "a")
    short = dealt.mapInArrow(starred, f"eps double, a {kind}, b {kind}")
    edges = short.select(F.struct("eps", F.col("a").alias("k")).alias("a"), F.struct("eps", F.col("b").alias("k")).alias("b"))
    comp = smallest_reachable(nodes, edges, "node")
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    return comp.join(size, "component").select("node.eps", F.col("node.k").alias(key), F.when(F.col("n") >= 2, F.col("component.k")).alias("cluster"))
