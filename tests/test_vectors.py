import math

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.functions import vectors as V
from voxloom.operators import clustering as K
from voxloom.operators import metrics as M
from voxloom.operators import pooling as P
from voxloom.operators import reduction as R
from voxloom.operators import sampling as S
from voxloom.operators import training as T
from voxloom.plans.catalog import CATALOG
from voxloom.sources import artefacts


def frame(spark, rows):
    return spark.createDataFrame([(i, y, [float(x) for x in v]) for i, (y, v) in enumerate(rows)], "id long, label int, vec array<double>")


def values(df, key, col):
    return {r[key]: r[col] for r in df.collect()}


def test_consistency_edges(spark):
    df = frame(spark, [(0, (1, 0)), (0, (2, 0)), (1, (1, 0)), (1, (0, 1)), (2, (1, 0)), (3, (0, 0)), (3, (1, 0))])
    got = values(M.consistency(df), "label", "consistency")
    assert got[2] is None and [round(got[k], 9) for k in (0, 1, 3)] == [1.0, 0.0, 0.0]


def test_silhouette_edges(spark):
    one = frame(spark, [(0, (1, 0)), (0, (0, 1))])
    assert set(values(M.silhouette(one, "id"), "id", "silhouette").values()) == {None}
    alone = frame(spark, [(0, (1, 0)), (1, (0, 1)), (1, (0.1, 1))])
    got = values(M.silhouette(alone, "id"), "id", "silhouette")
    assert got[0] == 0 and round(sum(got.values()) / 3, 6) == 0.663175
    zero = frame(spark, [(0, (0, 0)), (0, (1, 0)), (1, (0, 1)), (1, (0.1, 1))])
    assert sum(values(M.silhouette(zero, "id"), "id", "silhouette").values()) / 4 == pytest.approx(0.485, abs=5e-3)


def test_silhouette_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((60, 5)), rng.integers(0, 6, 60)
    got = values(M.silhouette(frame(spark, list(zip(y.tolist(), x.tolist(), strict=True))), "id", block=10), "id", "silhouette")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    for i in range(60):
        own = (y == y[i]) & (np.arange(60) != i)
        a, b = d[i, own].mean(), min(d[i, y == c].mean() for c in set(y.tolist()) - {int(y[i])})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_weighted_sums_over_batches(spark):
    rng = np.random.default_rng(5)
    data = [(i % 3, "ab"[i % 2], None if i % 11 == 0 else float(w), None if i % 13 == 0 else v.tolist()) for i, (w, v) in enumerate(zip(rng.random(200), rng.standard_normal((200, 5)), strict=True))]
    df = spark.createDataFrame(data, "a int, b string, attn double, vec array<double>").repartition(3)
    want = {}
    for a, b, w, v in data:
        if v is not None:
            sums = want.setdefault((a, b), [np.zeros(5), 0.0])
            sums[0] += (w or 0) * np.array(v)
            sums[1] += w or 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = P.by_position(df, F.col("attn"), ["a", "b"]).collect()
        assert P.by_position(df.filter("a > 5"), F.col("attn"), ["a", "b"]).isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 6 * 5
    for r in got:
        x, w = want[r["a"], r["b"]]
        assert r["wx"] == pytest.approx(x[r["dim"]]) and r["w"] == pytest.approx(w)


def test_pooling_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, 0, [1.0, 0.0], 0.25), (1, 1, 1, [0.0, 1.0], 0.75), (1, 0, 0, [1.0, 0.0], 0.25), (1, 0, 1, [0.0, 1.0], 0.75)], "s int, layer int, pos int, vec array<double>, attn double")
    want = {"last": (0, 1), "attn": (0.25, 0.75), "comp": (0.75, 0.25), "inv": (0.75, 0.25)}
    for method, v in want.items():
        got = {r["layer"]: r["vec"] for r in P.attention(rows, ["s", "layer"], method).collect()}
        assert got[1] == pytest.approx(v, abs=1e-6) and got[0] == [0.0, 1.0]
    masked = spark.createDataFrame([(1, 0, [1.0, 0.0], 1), (1, 1, [0.0, 1.0], 1), (1, 2, [9.0, 9.0], 0)], "s int, pos int, vec array<double>, mask int")
    assert P.masked_mean(masked, ["s"]).first()["vec"] == pytest.approx([0.5, 0.5])


def test_margin_logit(spark):
    df = spark.createDataFrame([(1.0, True), (0.0, False)], "c double, t boolean")
    a, b = (r[0] for r in df.select(V.margin_logit(F.col("c"), F.col("t"))).collect())
    assert a == pytest.approx(30 * math.cos(0.5), abs=0.02) and b == pytest.approx(0, abs=1e-9)


def test_density_clusters_of_blobs(spark):
    angles = [0, 2, 4, 90, 92, 94, 180, 182, 270]
    df = spark.createDataFrame([(i, [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, a in enumerate(angles)], "id long, vec array<double>")
    got = K.density_clusters(df, [0.05, 0.4], "id").groupBy("eps").agg(F.count_distinct("cluster").alias("c"), F.count_if(F.col("cluster").isNull()).alias("z")).collect()
    assert sorted((r["eps"], r["c"], r["z"]) for r in got) == [(0.05, 3, 1), (0.4, 3, 1)]


def test_elbow(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 6, 5, 4.5, 4.2])], "k int, cost double")
    got = K.elbow(df, "k", "cost").orderBy("k").collect()
    assert [r["is_elbow"] for r in got] == [False, False, True, False, False]


def test_projection_removes_the_main_space(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 6)) * np.array([10, 5, 1, 0.1, 0.1, 0.1])
    out, k = R.without_main_space(frame(spark, [(0, v) for v in x.tolist()]), 0.9)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert k == int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9)) + 1
    want = x - x @ vt[:k].T @ vt[:k]
    got = np.array([r["vec"] for r in out.orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-8)


def test_discriminant_separates(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((50, 4)) + c for c in ([0, 0, 0, 0], [5, 0, 0, 0], [0, 5, 0, 0])])
    df = frame(spark, list(zip(np.repeat([0, 1, 2], 50).tolist(), x.tolist(), strict=True)))
    fitted = R.discriminant(df, 5)
    assert fitted.scalings.shape == (4, 2)
    z = (x - fitted.mean) @ fitted.scalings
    within = np.concatenate([z[i : i + 50] - z[i : i + 50].mean(axis=0) for i in (0, 50, 100)])
    assert np.allclose(within.T @ within / 150, np.eye(2), atol=1e-6)
    assert fitted.ratios[0] >= fitted.ratios[1] > 1


def test_margin_head_learns(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(3, 8) * 4
    y = rng.integers(0, 3, 90)
    df = frame(spark, list(zip(y.tolist(), (centres[y] + rng.standard_normal((90, 8)) * 0.3).tolist(), strict=True)))
    head = T.margin_head(df, 3, "linear", width=4, epochs=8, rate=0.05)
    assert head.losses[-1] < head.losses[0] * 0.7
    flat = T.Head([rng.standard_normal((8, 5)), rng.standard_normal((5, 4))], rng.standard_normal((3, 4)))
    x = rng.standard_normal((6, 8))
    loss, grads = flat.gradient(x, np.array([0, 1, 2, 0, 1, 2]))
    w = flat.layers[0]
    w[2, 3] += 1e-6
    assert (flat.gradient(x, np.array([0, 1, 2, 0, 1, 2]))[0] - loss) / 1e-6 == pytest.approx(grads[0][2, 3], rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("n,size", [(199, None), (200, 50), (999, 50), (1000, 150), (9999, 150), (10000, 1000)])
def test_tiers(spark, n, size):
    assert spark.range(1).select(S.tier_size(F.lit(n))).first()[0] == size


@pytest.mark.parametrize("n,train", [(1, 1), (5, 4), (10, 8)])
def test_split_within(spark, n, train):
    df = spark.range(n).withColumn("g", F.lit("a"))
    assert S.split_within(df, "g", "id", 0.8).filter("split = 'train'").count() == train


def test_triplets_are_valid(spark):
    df = spark.range(40).withColumn("g", F.col("id") % 4)
    got = S.triplets(df, "g", "id", 200).collect()
    assert len(got) == 200
    assert all(r["anchor"] % 4 == r["positive"] % 4 != r["negative"] % 4 and r["anchor"] != r["positive"] for r in got)


def test_ward_by_brute_force():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((14, 3))
    clusters, got = {i: [i] for i in range(14)}, K.ward_merges(x)
    for step, (a, b, distance, size) in enumerate(got):
        # the increase of the sum of squares, as a distance: sqrt(2 |A| |B| / (|A| + |B|)) times that of the means
        cost = {(i, j): np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(x[p].mean(axis=0) - x[q].mean(axis=0)) for i, p in clusters.items() for j, q in clusters.items() if i < j}
        low = min(cost.values())
        assert distance == pytest.approx(low) and cost[a, b] == pytest.approx(low)
        clusters[14 + step] = clusters.pop(a) + clusters.pop(b)
        assert size == len(clusters[14 + step])


def test_ward_elbow_of_blobs(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((5, 2)) * 0.1 + c for c in ([0, 0], [10, 0], [0, 10])])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "label int, vec array<double>")
    merges = K.ward(df, "label")
    assert merges.count() == 14
    last = [r["distance"] for r in merges.orderBy("merge").collect()]
    want = len(last) - int(np.argmax(np.diff(last, 2)))
    assert K.ward_elbow(merges).first()["k"] == want


def test_diagonal_mixture_by_numpy(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((60, 3)) * [1, 0.5, 2], rng.standard_normal((40, 3)) + [8, 8, 8]])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, vec array<double>")
    got = K.diagonal_mixture(df, 2, tolerance=1e-6)
    weight, parts = [0.6, 0.4], [x[:60], x[60:]]
    logs = np.stack([np.log(w) - 0.5 * (np.log(2 * np.pi * p.var(axis=0)).sum() + ((x - p.mean(axis=0)) ** 2 / p.var(axis=0)).sum(axis=1)) for w, p in zip(weight, parts, strict=True)])
    assert got == pytest.approx(np.logaddexp(*logs).mean(), abs=1e-4)
    sweep = {r["k"]: r for r in K.mixture_sweep(df, [2, 30]).collect()}
    assert sweep[2]["covariance"] == "full" and sweep[30]["covariance"] == "diag" and sweep[2]["best"]


def test_kmeans_sweep_finds_blobs(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((6, 3)) * 0.05 + c for c in np.eye(3) * 5])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, vec array<double>")
    got = {r["k"]: r for r in K.kmeans_sweep(df, [2, 3, 4], "id", seeds=3).collect()}
    assert got[3]["best_silhouette"] and got[3]["silhouette"] > 0.9 and not got[2]["best_silhouette"]
    assert K.sweep_range(10) == list(range(2, 10)) and K.sweep_range(100)[-1] == 30


def test_sweeps_take_as_many_jobs_for_many_cells(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.standard_normal((40, 3)) * 0.3 + c for c in np.eye(3) * 6])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, vec array<double>").repartition(3)
    few, many = (jobs(spark, lambda s=s, ks=ks: K.kmeans_sweep(df, ks, "id", seeds=s)) for s, ks in ((1, [3]), (10, list(range(2, 12)))))
    assert many <= few + 60  # rounds of the slowest cell, two jobs each; a hundred cells one after another take over 600
    sweep = K.kmeans_sweep(df, [2, 3, 4], "id").toPandas().set_index("k")
    assert sweep.loc[3, "best_silhouette"] and sweep.loc[3, "best_ch"]
    label = ((x[:, None] - np.stack([x[i : i + 40].mean(axis=0) for i in (0, 40, 80)])[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert sweep.loc[3, "inertia"] == pytest.approx(sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in range(3)))
    labelled = frame(spark, list(zip(label.tolist(), x.tolist(), strict=True)))
    assert sweep.loc[3, "silhouette"] == pytest.approx(M.silhouette(labelled, "id").agg(F.avg("silhouette")).first()[0])
    assert sweep.loc[3, "calinski_harabasz"] == pytest.approx(M.calinski_harabasz(labelled).first()["score"])
    assert K.kmeans_sweep(df.filter("id < 0"), None, "id").count() == 0 and K.mixture_sweep(df.filter("id < 0")).count() == 0


def test_whole_covariances_by_numpy(spark):
    rng = np.random.default_rng(12)
    parts = [rng.standard_normal((80, 2)) @ [[2, 0], [1.5, 0.5]] + 50, rng.standard_normal((60, 2)) @ [[0.4, 0.3], [0, 1]] + [70, 40]]
    x = np.concatenate(parts)
    df = spark.createDataFrame([(v,) for v in x.tolist()], "vec array<double>")
    logs = []
    for p in parts:
        cov, z = np.cov(p.T, bias=True), x - p.mean(axis=0)
        logs.append(np.log(len(p) / 140) - 0.5 * (np.log(np.linalg.det(2 * np.pi * cov)) + (z @ np.linalg.inv(cov) * z).sum(axis=1)))
    got = K.mixtures(df, [(2, True), (2, False), (1, True)], "vec", tolerance=1e-7)
    assert got[2, True] == pytest.approx(np.logaddexp(*logs).mean(), abs=1e-4)
    one = np.cov(x.T, bias=True)
    assert got[1, True] == pytest.approx(-0.5 * (np.log(np.linalg.det(2 * np.pi * one)) + 2), abs=1e-4) and got[2, False] < got[2, True]


def shrunk_by_numpy(x, y):
    """The within-class covariance with each class shrunk by Ledoit and Wolf's formula on scaled components."""
    n, d = x.shape
    out = np.zeros((d, d))
    for c in np.unique(y):
        z = x[y == c] - x[y == c].mean(axis=0)
        scale = z.std(axis=0)
        scale[scale == 0] = 1
        z = z / scale
        cov, m = z.T @ z / len(z), len(z)
        mu = np.trace(cov) / d
        delta = ((cov - mu * np.eye(d)) ** 2).sum() / d
        beta = min(sum(((np.outer(r, r) - cov) ** 2).sum() for r in z) / m / m / d, delta)
        rate = beta / delta if delta > 0 else 0.0
        out += m / n * scale[:, None] * ((1 - rate) * cov + rate * mu * np.eye(d)) * scale[None, :]
    return out


@pytest.mark.parametrize("width", [7, R.STRIPE])
def test_shrunk_covariance_of_classes(spark, width):
    rng = np.random.default_rng(8)
    y = np.r_[np.zeros(60, int), rng.integers(1, 9, 140)]
    x = rng.standard_normal((200, 6)) @ np.diag([1, 2, 3, 1, 1, 5.0]) + rng.standard_normal((9, 6))[y] * 4
    x[y == 3, 2] = 1.5
    df = frame(spark, list(zip(y.tolist(), x.tolist(), strict=True))).repartition(5)
    stats, n, d, mean, between, classes = R.class_stats(df, "label", "vec")
    means = np.stack([x[y == c].mean(axis=0) for c in range(9)])
    assert (n, d, classes) == (200, 6, 9) and np.allclose(mean, x.mean(axis=0))
    assert np.allclose(between, sum((y == c).sum() / 200 * np.outer(v - x.mean(axis=0), v - x.mean(axis=0)) for c, v in enumerate(means)))
    assert np.allclose(R.shrunk_within(df, "label", "vec", stats, n, d, width), shrunk_by_numpy(x, y))
    assert R.discriminant(df, 2, shrinkage="auto").scalings.shape == (6, 2)


def jobs(spark, run):
    group = f"count-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, "counted")
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return n


def test_shrinkage_takes_as_many_jobs_for_any_number_of_classes(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 4)).tolist()
    took = [jobs(spark, lambda k=k: R.discriminant(frame(spark, [(i % k, v) for i, v in enumerate(x)]), 2, shrinkage="auto")) for k in (3, 100)]
    assert took[0] > 0 and abs(took[1] - took[0]) <= 2


def svd_by_numpy(x, y, tolerance=1e-4):
    classes, n = np.unique(y), len(x)
    means = np.stack([x[y == c].mean(axis=0) for c in classes])
    p = np.array([(y == c).mean() for c in classes])
    z = np.concatenate([x[y == c] - m for c, m in zip(classes, means, strict=True)])
    scale = z.std(axis=0)
    scale[scale == 0] = 1
    _, s, v = np.linalg.svd(z / scale / (n - len(classes)) ** 0.5, full_matrices=False)
    rank = (s > tolerance).sum()
    w = (v[:rank] / scale).T / s[:rank]
    _, s, v = np.linalg.svd(np.sqrt(n * p / (len(classes) - 1))[:, None] * (means - p @ means) @ w, full_matrices=False)
    return w @ v.T[:, : (s > tolerance * s[0]).sum()], x.mean(axis=0)


@pytest.mark.parametrize(("rows", "d"), [(40, 60), (300, 5), (12, 30)])
def test_svd_discriminant_equals_numpy(spark, rows, d):
    """Also with fewer rows than dimensions, a dimension that is a copy of another, and a constant one."""
    rng = np.random.default_rng(d)
    y = rng.integers(0, 3, rows)
    x = rng.standard_normal((rows, d)) + 3 * rng.standard_normal((3, d))[y]
    x[:, 1], x[:, 2] = x[:, 0], 7.0
    df = frame(spark, list(zip(y.tolist(), x.tolist(), strict=True))).repartition(6)
    fitted = R.svd_discriminant(df, 5)
    want, mean = svd_by_numpy(x, y)
    assert fitted.scalings.shape == want.shape and np.allclose(fitted.mean, mean)
    got, full = (x - mean) @ fitted.scalings, (x - mean) @ want
    # equal up to signs
    assert np.allclose(np.abs(got), np.abs(full), atol=1e-6)


def test_triangle_by_a_tree(spark):
    x = np.random.default_rng(6).standard_normal((90, 7)) * np.logspace(0, -9, 7)
    df = frame(spark, [(0, v) for v in x.tolist()]).repartition(11)
    r = R.triangle(df, "vec", 7, fan_in=3)
    assert np.allclose(np.linalg.svd(r, compute_uv=False), np.linalg.svd(x, compute_uv=False), rtol=1e-7)



def test_unit_vectors_of_many_dimensions(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((50, 1024))
    got = np.array([r[0] for r in frame(spark, [(0, v) for v in x.tolist()]).select(V.unit(F.col("vec"))).collect()])
    assert np.allclose(got, x / np.linalg.norm(x, axis=1, keepdims=True))


def test_logits_in_blocks_equal_arrays(spark):
    rng = np.random.default_rng(12)
    df = frame(spark, [(i % 4, v) for i, v in enumerate(rng.standard_normal((20, 5)).tolist())])
    w = spark.createDataFrame([(c, v) for c, v in enumerate(rng.standard_normal((4, 5)).tolist())], "class int, w array<double>")
    one = {(r["id"], r["class"]): r["logit"] for r in M.row_logits(df, w, "id").select("id", F.inline("logits")).collect()}
    for got in (M.margin_logits(df, w, "id", block=10), M.row_logits(df, w, "id", block=10).select("id", F.inline("logits"))):
        assert {(r["id"], r["class"]): r["logit"] for r in got.collect()} == pytest.approx(one)


def test_triplet_head_learns(spark):
    rng = np.random.default_rng(13)
    y = np.repeat([0, 1, 2], 20)
    df = frame(spark, list(zip(y.tolist(), (np.eye(3, 8)[y] * 2 + rng.standard_normal((60, 8))).tolist(), strict=True)))
    head = T.triplet_head(df, "id", width=4, epochs=6, draws=128, rate=0.05)
    assert head.losses[-1] < head.losses[0] * 0.9
    flat = T.Head([rng.standard_normal((8, 5)), rng.standard_normal((5, 4))], np.zeros((1, 4)))
    x = [rng.standard_normal((6, 8)) for _ in range(3)]
    loss, grads = T.triplet_gradient(flat, x, 0.3)
    flat.layers[0][2, 3] += 1e-6
    assert (T.triplet_gradient(flat, x, 0.3)[0] - loss) / 1e-6 == pytest.approx(grads[0][2, 3], rel=1e-3, abs=1e-4)


def test_margin_head_in_minibatches(spark):
    rng = np.random.default_rng(14)
    y = rng.integers(0, 3, 120)
    df = frame(spark, list(zip(y.tolist(), (np.eye(3, 8)[y] * 4 + rng.standard_normal((120, 8)) * 0.3).tolist(), strict=True)))
    head = T.margin_head(df, 3, width=4, epochs=8, rate=0.05, key="id", batch=40, cosine=True)
    assert head.losses[-1] < head.losses[0] * 0.8


def test_nearest_centroids_in_blocks(spark):
    rng = np.random.default_rng(15)
    x = rng.standard_normal((9, 4))
    cents = M.centroids(frame(spark, list(enumerate(x.tolist()))))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T + np.diag([np.inf] * 9)
    for block in (M.BLOCK, 8):
        got = {r["label"]: r for r in M.nearest_centroids(cents, block=block).collect()}
        assert len(got) == 9 and all(got[i]["nearest"] == str(d[i].argmin()) and got[i]["distance"] == pytest.approx(d[i].min()) for i in range(9))


def test_blocks_of_classes_change_nothing_where_keys_repeat(spark):
    """Equal keys, labels and vectors are rows of their own, however many passes the classes take."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 7, 60).tolist()
    x = rng.standard_normal((60, 4)).tolist()
    rows = [(i % 5, y[i], x[i]) for i in range(60)] + [(1, y[0], x[0]), (1, y[0], x[0]), (None, y[0], x[0]), (None, y[1], x[1])]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    near = lambda d: sorted((str(r["id"]), r["label"], round(r["silhouette"], 9)) for r in d.collect())
    whole = near(M.silhouette(df, "id"))
    assert len(whole) == 64 and near(M.silhouette(df, "id", block=2)) == whole == near(M.silhouette(df, "id", block=8))
    w = spark.createDataFrame([(k, rng.standard_normal(4).tolist()) for k in range(7)], "class int, w array<double>")
    flat = lambda d: sorted((str(r["id"]), r["label"], *[round(v["logit"], 9) for v in sorted(r["logits"])]) for r in d.collect())
    whole = flat(M.row_logits(df, w, "id"))
    assert len(whole) == 64 and flat(M.row_logits(df, w, "id", block=2)) == whole == flat(M.row_logits(df, w, "id", block=8))
    cents = M.centroids(df, "label")
    places = lambda d: sorted((r["label"], r["nearest"], round(r["distance"], 9)) for r in d.collect())
    assert places(M.nearest_centroids(cents, block=2)) == places(M.nearest_centroids(cents))


def test_heads_of_a_grid_train_together_as_alone(spark):
    rng = np.random.default_rng(16)
    y = rng.integers(0, 3, 90)
    df = frame(spark, list(zip(y.tolist(), (np.eye(3, 8)[y] * 4 + rng.standard_normal((90, 8)) * 0.3).tolist(), strict=True)))
    cells = [("linear", 4), ("1h-256", 3), ("linear", 6)]
    how = {"epochs": 3, "rate": 0.01, "key": "id", "batch": 50, "cosine": True}
    both = T.margin_heads(df, 3, cells, **how)
    split = T.margin_heads(df, 3, cells, limit=100, **how)
    alone = T.margin_head(df, 3, "1h-256", 3, **how)
    for a, b in ((both.heads["1h-256", 3], alone), *zip(both.heads.values(), split.heads.values(), strict=True)):
        assert all(np.allclose(x, z) for x, z in zip([*a.layers, a.classes], [*b.layers, b.classes], strict=True)) and np.allclose(a.losses, b.losses)
    one, three = (jobs(spark, lambda c=c: T.margin_heads(df, 3, c, **how)) for c in (cells[:1], cells))
    assert one == three
    z = T.embedded_by(df, both.heads)
    assert z.count() == 270 and z.select("cell").distinct().count() == 3
    got = values(M.group_silhouettes(z, "cell"), "cell", "silhouette")
    for (arch, width), head in both.heads.items():
        own = df.withColumn("vec", head.embed(F.col("vec")))
        assert got[f"{arch}-{width}"] == pytest.approx(M.silhouette(own, "id").agg(F.avg("silhouette")).first()[0])


@pytest.mark.parametrize("n, batch", [(300, 40), (300, 1), (2200, 1500)])
def test_minibatches_train_as_by_hand(spark, monkeypatch, n, batch):
    """Heads taken through the minibatches of all epochs in tasks, or an epoch a job where they are large, equal steps one by one."""
    rng = np.random.default_rng(35)
    x, y = rng.standard_normal((n, 6)), rng.integers(0, 4, n)
    df = frame(spark, list(zip(y.tolist(), x.tolist(), strict=True))).repartition(3)
    cells, epochs = [("linear", 4), ("1h-256", 3), ("linear", 6)], 3 if batch > T.ROWS else 11
    monkeypatch.setattr(T, "HELD", 80)  # so that windows have several epochs or one, and batches end within them
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = T.margin_heads(df, 4, cells, epochs, 0.01, key="id", batch=batch, cosine=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    share = lambda e: F.shiftrightunsigned(F.xxhash64("id", F.lit(e), F.lit(42)), 11) / float(1 << 53)
    drawn = np.array([list(r) for r in df.orderBy("id").select(*[(share(e) < batch / n).alias(f"e{e}") for e in range(epochs)]).collect()])
    assert drawn.any() and (batch > 1 or not drawn.any(axis=0).all())
    for arch, width in cells:
        head = T.fresh_head(6, 4, arch, width, 42)
        adam = T.Adam([*head.layers, head.classes], 0.01, epochs)
        for rows in drawn.T:
            if rows.any():
                loss, grads = head.gradient(x[rows], y[rows])
                head.losses.append(loss / rows.sum())
                adam.step(np.concatenate([g.ravel() for g in grads]) / rows.sum())
        one = got.heads[arch, width]
        assert got.epoch == epochs and got.adams[arch, width].step_no == adam.step_no and np.allclose(one.losses, head.losses)
        for a, b in ((one.layers, head.layers), ([one.classes], [head.classes]), (got.adams[arch, width].first, adam.first), (got.adams[arch, width].second, adam.second)):
            assert all(np.allclose(v, w) for v, w in zip(a, b, strict=True))
    lean = T.margin_heads(df, 4, cells[:1], epochs, 0.01, key="id", batch=batch, cosine=True, moments=False)
    assert np.allclose(lean.heads[cells[0]].layers[0], got.heads[cells[0]].layers[0]) and np.allclose(lean.heads[cells[0]].losses, got.heads[cells[0]].losses)


def test_minibatches_take_as_many_jobs_for_any_number_of_epochs(spark):
    rng = np.random.default_rng(36)
    df = frame(spark, list(zip(rng.integers(0, 3, 60).tolist(), rng.standard_normal((60, 4)).tolist(), strict=True)))
    took = [jobs(spark, lambda n=n: T.margin_heads(df, 3, [("linear", 4)], n, key="id", batch=20)) for n in (3, 40)]
    assert took[0] == took[1]


@pytest.mark.parametrize("name", ["experiment_leaderboard", "mlp_arcface_grid"])
def test_grid_queries_train_all_epochs(spark, sf_dir, monkeypatch, name):
    """The operator's 500 epochs, each a minibatch of 512 rows; one head here, so that it is quick."""
    seen, train = [], T.margin_heads

    def watched(rows, classes, cells, *args, **how):
        out = train(rows, classes, cells[:1], *args, **how)
        seen.append((len(cells), how["batch"], out.epoch, *[len(h.losses) for h in out.heads.values()]))
        return out

    monkeypatch.setattr(T, "margin_heads", watched)
    assert CATALOG[name].run(spark, sf_dir).count() > 0 and seen == [(15, 512, 500, 500)]


def test_training_goes_on_from_an_artefact(spark, tmp_path):
    rng = np.random.default_rng(17)
    y = rng.integers(0, 4, 80)
    df = frame(spark, list(zip(y.tolist(), rng.standard_normal((80, 6)).tolist(), strict=True)))
    cells, how = [("linear", 4), ("1h-256", 5)], {"epochs": 6, "key": "id", "batch": 40, "cosine": True}
    whole = T.margin_heads(df, 4, cells, **how)
    path = f"{tmp_path}/heads"
    with pytest.raises(FileNotFoundError):
        artefacts.load(spark, path)
    artefacts.save(spark, T.margin_heads(df, 4, cells, until=3, **how), path)
    found = artefacts.load(spark, path)
    assert found.epoch == 3 and {len(h.classes) for h in found.heads.values()} == {4} and artefacts.versions(spark, path) == [3]
    done = T.margin_heads(df, 4, cells, after=found, **how)
    assert done.epoch == 6
    for c in cells:
        a, b = whole.heads[c], done.heads[c]
        assert all(np.allclose(x, z, rtol=1e-9) for x, z in zip([*a.layers, a.classes], [*b.layers, b.classes], strict=True)) and len(b.losses) == 6
    artefacts.save(spark, done, path)
    assert artefacts.versions(spark, path) == [3, 6] and artefacts.load(spark, path, 3).epoch == 3
    # a version that is there stays, and a writer that died beside it is not seen
    (tmp_path / "heads" / ".dead").mkdir()
    artefacts.save(spark, whole, path)
    assert artefacts.versions(spark, path) == [3, 6] and not [p for p in (tmp_path / "heads").iterdir() if p.name.startswith(".") and p.name not in (".dead",) and p.is_dir()]


def components_of(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_spanning_forest_by_brute_force():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 3))
    x[7] = x[3]
    x[9] = 0
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    d = np.round(1 - u @ u.T, 9)
    i, j, w = K.spanning(u, 0.2)
    assert np.allclose(w, d[i, j]) and len(w) < 60
    for eps in (0.0, 0.01, 0.05, 0.2):
        want = components_of([(a, b) for a in range(60) for b in range(a) if d[a, b] <= eps], range(60))
        assert components_of([(a, b) for a, b, v in zip(i.tolist(), j.tolist(), w, strict=True) if v <= eps], range(60)) == want
    assert [len(v) for v in K.spanning(u[:1], 0.2)] == [0, 0, 0] and [len(v) for v in K.spanning(u[:0], 0.2)] == [0, 0, 0]


@pytest.mark.parametrize(("n", "clusters", "pivots", "part"), [(20_000, 400, None, 512), (900, 5, 7, 32), (300, 1, 1, 40)])
def test_join_of_directions_within_a_radius(spark, n, clusters, pivots, part):
    """Components as by all pairs, with few pairs compared where vectors are clustered."""
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((clusters, 24))
    x = centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, 24)) * 0.12
    x[5] = x[6]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(None, x[0].tolist()), (n + 5, None)], "id long, vec array<double>").repartition(6)
    forest, compared = K.near_forest(df, "id", 0.02, pivots=pivots, part=part)
    got = [tuple(r) for r in forest.collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(round(1 - float(u[a] @ u[b]), 9) == pytest.approx(d, abs=2e-9) and d <= 0.02 for a, b, d in got)
    pairs = []
    for at in range(0, n, 2000):
        a, b = np.nonzero(np.round(1 - u[at : at + 2000] @ u.T, 9) <= 0.02)
        pairs += [(int(p) + at, int(q)) for p, q in zip(a, b, strict=True) if p + at < q]
    assert components_of([(a, b) for a, b, _ in got], range(n)) == components_of(pairs, range(n))
    if n == 20_000:
        assert compared.agg(F.sum("compared")).first()[0] < 0.1 * n * (n - 1) / 2


@pytest.mark.parametrize("copies", [False, True])
def test_rows_without_structure_are_compared_at_most_once(spark, copies):
    """Blocks of one table, at three levels: components as by all pairs, no pair of blocks compared twice, few edges whatever is near."""
    rng = np.random.default_rng(8)
    n, levels = 2400, [0.5, 0.55, 0.6]
    x = rng.standard_normal((n, 64))
    if copies:
        x[400:2000] = x[0]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vec array<double>").repartition(5)
    forest, compared = K.near_forest(df, "id", levels[-1], levels=levels)
    got, blocks = [tuple(r) for r in forest.collect()], compared.count()
    assert blocks == 15 and compared.agg(F.sum("compared")).first()[0] < n * (n + 5 * 512) / 2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    labels = {}
    for eps in levels:
        labels[eps] = components_of([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(d <= eps, 1)), strict=True)], range(n))
        assert components_of([(a, b) for a, b, v in got if v <= eps], range(n)) == labels[eps]
    assert len(got) < 3 * 5 * n
    if copies:
        found = {(r["eps"], r["id"]): r["cluster"] for r in K.density_clusters(df, levels, "id", "vec").collect()}
        assert all(found[eps, a] == (c if sum(v == c for v in labels[eps].values()) > 1 else None) for eps in levels for a, c in list(labels[eps].items())[::50])


def test_space_that_explains_half_of_another_table_is_removed(spark):
    rng = np.random.default_rng(31)
    x, other = rng.standard_normal((40, 5)), rng.standard_normal((60, 5)) @ np.diag([5, 4, 1, 1, 0.5])
    df, second = frame(spark, [(0, v) for v in x.tolist()]), frame(spark, [(0, v) for v in other.tolist()])
    out, k = R.without_space_of(df, second.select("vec"), 0.5)
    values_, axes = np.linalg.eigh(np.cov(other.T))
    axes, share = axes[:, ::-1].T, values_[::-1] / values_.sum()
    want = int(np.searchsorted(np.cumsum(share), 0.5)) + 1
    got = np.array([r["vec"] for r in out.orderBy("id").collect()])
    assert k == want and np.allclose(got, x - (x @ axes[:k].T) @ axes[:k])


def test_removed_space_is_written_and_nulls_stay(spark):
    """No Python pass is left for what follows; batches are cut, and the second of them begins with a null."""
    x = np.random.default_rng(33).standard_normal((2 * R.ROWS + 5, 4))
    df = spark.createDataFrame([(i, v if i != R.ROWS else None) for i, v in enumerate(x.tolist())], "id long, vec array<double>").coalesce(1)
    out, k = R.without_space_of(df, df.filter("vec is not null"), 0.3)
    assert not any(w in out._jdf.queryExecution().toString() for w in ("MapInArrow", "ArrowEvalPython"))
    got = {r["id"]: r["vec"] for r in out.collect()}
    axes = R.principal_components(df.filter("vec is not null"), 4)[0][:k]
    assert got.pop(R.ROWS) is None and all(np.allclose(v, x[i] - x[i] @ axes.T @ axes) for i, v in got.items()) and len(got) == len(x) - 1
    sizes = []
    assert np.allclose(np.stack(R.by_rows(pd.Series(list(x)), lambda v: (sizes.append(len(v)), 2 * v)[1]).to_list()), 2 * x)
    assert sizes == [R.ROWS, R.ROWS, 5]


def test_heads_see_a_few_rows_at_a_time(spark):
    """Gradients, and rows as all heads give them: large batches are cut before any head sees them."""
    n, least = 2 * T.ROWS + 7, T.ROWS
    x = np.random.default_rng(34).standard_normal((n, 3))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vec array<double>").coalesce(1)

    def gradient(b):
        assert len(b) <= least
        v = np.stack(b["vec"].to_list())
        return ((float(k * len(v)), [k * v.sum(axis=0), np.array([[float(k)]]) * len(v)]) for k in (1, 2))

    losses, flat = T.added(df, gradient, 2)
    assert np.allclose(losses, [1, 2]) and np.allclose(flat, [*x.mean(axis=0), 1, *(2 * x.mean(axis=0)), 2])
    heads = {("linear", 2): T.fresh_head(3, 2, "linear", 2, 1), ("1h-256", 4): T.fresh_head(3, 2, "1h-256", 4, 2)}
    z = T.embedded_by(df, heads)
    assert "ArrowEvalPython" not in z._jdf.queryExecution().toString()
    got = {(r["cell"], r["id"]): r["vec"] for r in z.collect()}
    assert len(got) == 2 * n and all(np.allclose(got[f"{a}-{w}", i][:w], h.units(x[i : i + 1])[0]) and len(got[f"{a}-{w}", i]) == 4 for (a, w), h in heads.items() for i in range(0, n, 50))


def test_a_head_projects_by_its_layers(spark):
    rng = np.random.default_rng(32)
    head = T.fresh_head(4, 3, "1h-256", 6, 5)
    assert [w.shape for w in head.layers] == [(4, 256), (256, 6)] and head.classes.shape == (3, 6)
    x = rng.standard_normal((7, 4))
    z = np.maximum(x @ head.layers[0], 0) @ head.layers[1]
    assert np.allclose(head.forward(x)[-1], z)
    got = np.array([r[0] for r in frame(spark, [(0, v) for v in x.tolist()]).orderBy("id").select(head.embed(F.col("vec"))).collect()])
    assert np.allclose(got, z / np.linalg.norm(z, axis=1, keepdims=True))
    assert [len(T.fresh_head(4, 2, arch, 8, 1).layers) for arch in T.ARCHS] == [1, 2, 2, 3, 2]
