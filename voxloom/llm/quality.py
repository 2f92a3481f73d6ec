"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

1. One pass over whole texts gives ``FEATURES`` per document (logs and roots of counts and shares, so that
   their classes look closer to normal). Ids, languages and sources are never among them.
2. Class moments (count, sum, products) over every labelled training row are native sums per moment, so
   only (1 + d + d(d+1)/2) numbers per class reach the driver whatever the number of rows.
3. Each class covariance is shrunk towards the pooled covariance, the more the fewer rows it has, and then
   towards the pooled diagonal; its Cholesky factor and that factor's inverse are computed once, kept in the model and
   shipped to the tasks. A score is the difference of the two log densities: Mahalanobis distances by one product with
   the cached inverse factor, plus the log determinants and log priors.
4. The difference is calibrated by a logistic curve fitted to a histogram of the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

FEATURES = ("length", "words", "upper", "stops", "shouts", "symbols", "digits", "distinct", "echo", "word_length", "lines", "repeated_lines", "other_bytes", "top_word", "bare")
#: Least shrinkage towards the pooled covariance, then towards its diagonal. Classes of few rows are shrunk more.
POOL, RIDGE = 0.1, 0.05
BINS = 400
REACH = 60.0
_CLASS = np.zeros(256, np.intp)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", ".,;:?'\"()-", "!", "|#$%&*+<=>@\\^_`{}~[]/", "0123456789", " \t\n\r\x0b\x0c"), 1):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_CLASS[128:] = 8


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text; null counts as empty, for which all counts are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = len(raw)
    kinds = np.zeros(9)
    np.add.at(kinds, _CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float))
    upper, lower, stops, shouts, symbols, digits, _, other = kinds[1:]
    words = raw.split()
    lines = raw.split(b"\n")
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False))
    at_least, letters = max(n, 1), max(upper + lower, 1.0)
    marks = stops + shouts + symbols
    share = lambda x, of: np.sqrt(x / of)
    return np.array([
        np.log1p(size),
        np.log1p(n),
        share(upper, letters),
        share(stops, at_least),
        share(shouts, at_least),
        share(symbols, at_least),
        share(digits, max(size, 1)),
        np.log((len(counts) + 1) / (n + 1)) / np.log(n + 3.0),
        share(echo, at_least),
        np.log1p(size / at_least),
        share(len(lines) - 1, at_least),
        share(len(lines) - len(set(lines)), len(lines)),
        share(other, max(size, 1)),
        share(max(counts.values(), default=0), at_least) - 1 / np.sqrt(at_least),
        share(max(n - marks, 0), at_least),
    ])


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return stats(text)


@dataclass
class Model:
    """Per class (0, 1): mean, Cholesky factor of the shrunk covariance, its half log determinant, log prior."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.whiten = np.stack([np.linalg.inv(f) for f in self.factors])

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included, for rows of statistics."""
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            logs.append(self.log_priors[c] - self.log_dets[c] - 0.5 * (z * z).sum(axis=1))
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        t = np.clip(self.slope * np.clip(self.difference(x), -REACH, REACH) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-t))

    def score_features(self, features: Column) -> Column:
        shared = self

        @F.pandas_udf("double")
        def score(f: pd.Series) -> pd.Series:
            return pd.Series(shared.score(np.stack(f.to_list())) if len(f) else [], dtype=float)

        return score(features)

    def score_text(self, text: Column) -> Column:
        shared = self

        @F.pandas_udf("double")
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for t in texts:
                yield pd.Series(shared.score(np.stack([statistics(x) for x in t])) if len(t) else [], dtype=float)

        return score(text)


def shrunk(cov: np.ndarray, pooled: np.ndarray, n: float, pool: float = POOL, ridge: float = RIDGE) -> np.ndarray:
    """The covariance of n rows, blended with the pooled one and its diagonal; by d / (n + d) at least."""
    pool = max(pool, len(cov) / (n + len(cov)))
    mixed = (1 - pool) * cov + pool * pooled
    return (1 - ridge) * mixed + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(cov))


def constant(p: float, d: int = len(FEATURES)) -> Model:
    """A model that gives every text the score p."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), np.zeros(2), 0.0, float(np.log(p / (1 - p))))


def fit(rows: DataFrame, features: str = "features", label: str = "label") -> Model:
    """A model from all rows with a label of 0 or 1 (others are skipped).

    With no labelled rows every score is 0.5; with one class only, the scores are that class's value. Classes
    of fewer rows than statistics rely on the pooled covariance through the shrinkage.
    """
    d = len(FEATURES)
    rows = rows.filter(F.col(label).isin(0, 1))
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + d + len(upper)))
        first, second = np.array(upper).T
        for b in batches:
            if len(b):
                x, y = np.stack(b["f"].to_list()), b["y"].to_numpy()
                full = np.concatenate([np.ones((len(x), 1)), x, x[:, first] * x[:, second]], axis=1)
                for c in (0, 1):
                    sums[c] += full[y == c].sum(axis=0)
        yield pd.DataFrame({"y": [0, 1], "m": list(sums)})

    partial = rows.select(F.col(features).alias("f"), F.col(label).cast("int").alias("y")).mapInPandas(moments, "y int, m array<double>")
    got = np.zeros((2, 1 + d + len(upper)))
    for r in partial.select("y", F.posexplode("m").alias("at", "v")).groupBy("y", "at").agg(F.sum("v").alias("v")).collect():
        got[r["y"], r["at"]] = r["v"]
    n = got[:, 0]
    if n.min() == 0:
        return constant(0.5 if n.max() == 0 else float(n[1] > 0))
    means = got[:, 1 : 1 + d] / n[:, None]
    covs = np.zeros((2, d, d))
    for c in (0, 1):
        for (i, j), v in zip(upper, got[c, 1 + d :], strict=True):
            covs[c, i, j] = covs[c, j, i] = v / n[c] - means[c, i] * means[c, j]
    pooled = (n[:, None, None] * covs).sum(axis=0) / n.sum()
    factors = np.stack([np.linalg.cholesky(shrunk(covs[c], pooled, n[c])) for c in (0, 1)])
    model = Model(means, factors, np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1), np.log(n / n.sum()))
    return calibrated(model, rows, features, label)


def calibrated(model: Model, rows: DataFrame, features: str, label: str) -> Model:
    """The model with a logistic curve fitted to a histogram of (difference, label) over the rows."""
    shared = model

    @F.pandas_udf("int")
    def bin_of(f: pd.Series) -> pd.Series:
        t = np.clip(shared.difference(np.stack(f.to_list())), -REACH, REACH) if len(f) else np.zeros(0)
        return pd.Series(np.minimum((t + REACH) / (2 * REACH) * BINS, BINS - 1).astype(int))

    got = rows.select(bin_of(features).alias("bin"), F.col(label).cast("int").alias("y")).groupBy("bin", "y").count().collect()
    t = np.array([(r["bin"] + 0.5) / BINS * 2 * REACH - REACH for r in got])
    y, w = np.array([float(r["y"]) for r in got]), np.array([float(r["count"]) for r in got])
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * t + b, -500, 500)))
        g = np.array([(w * (p - y) * t).sum() + 1e-3 * (a - 1), (w * (p - y)).sum() + 1e-3 * b])
        v = w * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * t * t).sum() + 1e-3, (v * t).sum()], [(v * t).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def extract(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) for each row. Null and empty texts have the statistics of zero counts.

    Very long texts are read whole; rows that repeat stay, each with its statistics; other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    return docs.select(F.col(doc_col).alias("doc_id"), feature_column(F.col(text_col)).alias("features"))


def training_labels(labels: DataFrame, label_col: str = "quality", folds: int = 5, held_out: int = 0) -> DataFrame:
    """(_id, label) outside the held-out fold (crc32 of the id's text modulo ``folds``).

    A label row that repeats counts once; a document with both labels counts for each; ids and labels that are
    null are skipped.
    """
    seen = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("label")).filter("_id is not null and label is not null").distinct()
    return seen.filter(F.crc32(F.col("_id").cast("string")) % folds != held_out)


def train(features: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held_out: int = 0) -> Model:
    """Fit on the statistics (doc_id, features) of labelled documents; labels of unknown documents are ignored."""
    seen = training_labels(labels, label_col, folds, held_out)
    # two passes follow, over no more than the labelled rows' statistics
    return fit(materialise(features.join(seen, F.col("doc_id") == F.col("_id")).select("features", "label")))


def train_texts(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **folds: int) -> Model:
    """``train`` on whole documents: only texts with a label are read into statistics."""
    seen = training_labels(labels, **folds)
    known = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")).join(seen.select("_id").distinct(), F.col("doc_id") == F.col("_id"), "left_semi")
    return train(extract(known, "doc_id", "text"), labels, **folds)
