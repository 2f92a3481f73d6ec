"""Trained heads as versioned artefacts: weights, optimiser and epoch, published whole or not at all."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import SparkSession

from ..operators.training import Adam, Head, Training

ROW = "cell string, kind string, at int, shape array<int>, x binary, about string"


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The epochs that are published at ``path``, ascending."""
    fs, p = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))


def save(spark: SparkSession, training: Training, path: str) -> str:
    """Publish a training's state as the version of its epoch, and return where.

    It is written beside and renamed, so a reader sees a version whole or not at all; one that is there already stays.
    """
    rows = []
    for (arch, width), head in training.heads.items():
        adam, cell = training.adams[arch, width], f"{arch}:{width}"
        about = {"scale": head.scale, "margin": head.margin, "losses": head.losses, "rate": adam.rate, "total": adam.total, "step": adam.step_no, "layers": len(head.layers), "epoch": training.epoch}
        rows.append((cell, "about", 0, [], b"", json.dumps(about)))
        for kind, parts in (("weights", adam.weights), ("first", adam.first), ("second", adam.second)):
            rows += [(cell, kind, i, list(w.shape), w.astype("<f8").tobytes(), None) for i, w in enumerate(parts)]
    end, beside = f"{path}/epoch={training.epoch:06d}", f"{path}/.{uuid.uuid4().hex}"
    spark.createDataFrame(rows, ROW).write.parquet(beside)
    fs, target = _folder(spark, end)
    source = _folder(spark, beside)[1]
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
    return end


def load(spark: SparkSession, path: str, epoch: int | None = None) -> Training:
    """The training of an epoch, by default the last that is published; classes are as many as the head has directions."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version at {path}")
    rows = spark.read.schema(ROW).parquet(f"{path}/epoch={epoch if epoch is not None else known[-1]:06d}").collect()
    out = Training({}, {})
    for r in sorted((r for r in rows if r["kind"] == "about"), key=lambda r: r["cell"]):
        about, arch, width = json.loads(r["about"]), *r["cell"].split(":")
        parts = {kind: [np.frombuffer(bytes(x["x"]), "<f8").reshape(x["shape"]).copy() for x in sorted(rows, key=lambda x: x["at"]) if (x["cell"], x["kind"]) == (r["cell"], kind)] for kind in ("weights", "first", "second")}
        weights = parts["weights"]
        head = Head(weights[: about["layers"]], weights[about["layers"]], about["scale"], about["margin"], about["losses"])
        adam = Adam([*head.layers, head.classes], about["rate"], about["total"])
        adam.first, adam.second, adam.step_no = parts["first"], parts["second"], about["step"]
        out.heads[arch, int(width)], out.adams[arch, int(width)], out.epoch = head, adam, about["epoch"]
    return out
