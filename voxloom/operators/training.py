"""Heads trained by gradient steps: tasks add gradients over their rows, the driver holds the weights only.

Weights have (dimensions * width + classes * width) numbers, whatever the number of rows. An epoch over all rows, or over a
large minibatch, is one Spark job for all heads of a grid together; a task sends its sums of gradients in stripes, which
tasks add in turn. Small minibatches of all epochs are drawn by hash in one pass over the rows, and a task takes a few
heads through them, one epoch after another. A training can stop after any epoch and go on from its artefact (sources/artefacts.py).
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import materialised
from .reduction import ROWS, STRIPE, by_rows, stripes_added
from .sampling import triplets

#: Weights of the heads that a task computes gradients of at a time.
WEIGHTS = 1 << 24
#: Rows of the minibatches that a task holds at a time, about; those of a minibatch are at most ``ROWS``, or an epoch is a job.
HELD = 8192

#: Backbones by name, and the widths of their hidden layers.
ARCHS = {"linear": (), "1h-256": (256,), "1h-512": (512,), "2h-1k": (1024, 512), "1h-2k": (2048,)}


@dataclass
class Head:
    """A ReLU network and class directions, scored with an angular margin."""

    layers: list[np.ndarray]
    classes: np.ndarray
    scale: float = 30.0
    margin: float = 0.5
    losses: list[float] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        outs = [x]
        for i, w in enumerate(self.layers):
            z = outs[-1] @ w
            outs.append(np.maximum(z, 0) if i < len(self.layers) - 1 else z)
        return outs

    def units(self, x: np.ndarray) -> np.ndarray:
        z = self.forward(x)[-1]
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-10)

    def embed(self, vector: Column) -> Column:
        head = self

        @F.pandas_udf("array<double>")
        def apply(v: pd.Series) -> pd.Series:
            return by_rows(v, head.units)

        return apply(vector)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Sum of the losses of some rows, and its gradient by layers and classes."""
        outs = self.forward(x)
        z, w = outs[-1], self.classes
        zn = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-10)
        wn = np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-10)
        u, v = z / zn, w / wn
        cos = np.clip(u @ v.T, -1 + 1e-7, 1 - 1e-7)
        rows = np.arange(len(y))
        angle = np.arccos(cos[rows, y])
        logits = self.scale * cos
        logits[rows, y] = self.scale * np.cos(angle + self.margin)
        shifted = logits - logits.max(axis=1, keepdims=True)
        p = np.exp(shifted)
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(np.maximum(p[rows, y], 1e-300)).sum())
        g = p
        g[rows, y] -= 1
        g *= self.scale
        g[rows, y] *= np.sin(angle + self.margin) / np.maximum(np.sin(angle), 1e-7)
        du, dv = g @ v, g.T @ u
        dw = (dv - v * (dv * v).sum(axis=1, keepdims=True)) / wn
        delta = (du - u * (du * u).sum(axis=1, keepdims=True)) / zn
        grads = []
        for i in range(len(self.layers) - 1, -1, -1):
            grads.append(outs[i].T @ delta)
            if i:
                delta = (delta @ self.layers[i].T) * (outs[i] > 0)
        return loss, [*grads[::-1], dw]


class Adam:
    """Adam over a list of arrays, changed in place; ``total`` epochs bend the rate to zero along a cosine."""

    def __init__(self, weights: list[np.ndarray], rate: float, total: int | None = None):
        self.weights, self.rate, self.total, self.step_no = weights, rate, total, 0
        self.first, self.second = ([np.zeros_like(w) for w in weights] for _ in range(2))

    def step(self, flat: np.ndarray) -> None:
        rate = self.rate if self.total is None else self.rate * 0.5 * (1 + np.cos(np.pi * self.step_no / self.total))
        self.step_no += 1
        at = 0
        for k, p in enumerate(self.weights):
            g = flat[at : at + p.size].reshape(p.shape)
            at += p.size
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            p -= rate * (self.first[k] / (1 - 0.9**self.step_no)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step_no)) + 1e-8)


def fresh_head(d: int, classes: int, arch: str, width: int, seed: int) -> Head:
    rng = np.random.default_rng(seed)
    dims = [d, *ARCHS[arch], width]
    return Head([rng.standard_normal((a, b)) * (2 / a) ** 0.5 for a, b in zip(dims, dims[1:], strict=False)], rng.standard_normal((classes, width)))


def added(rows: DataFrame, gradient: Callable[[pd.DataFrame], Iterable[tuple[float, list[np.ndarray]]]], heads: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(mean losses, mean gradients, flat) over rows; ``gradient`` gives the sums of a few rows, one head of so many after another.

    A task holds one sum of all heads' gradients, the gradient of one head over ``ROWS`` rows, and the sum's stripes as it sends them.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, losses, total = 0, np.zeros(heads), None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                first, n, held = total is None, n + part.num_rows, total or []
                for i, (loss, grads) in enumerate(gradient(part.to_pandas())):
                    losses[i] += loss
                    if first:
                        held.append(grads)
                    else:
                        for t, g in zip(held[i], grads, strict=True):
                            t += g
                total = held
        if total is not None:
            flat = np.concatenate([[n], losses, *[g.ravel() for grads in total for g in grads]])
            total = None
            for at in range(0, len(flat), STRIPE):
                yield pa.RecordBatch.from_arrays([pa.array([at // STRIPE]), pa.array([flat[at : at + STRIPE].tobytes()], pa.binary())], names=["stripe", "x"])

    got = stripes_added(rows.mapInArrow(partial, "stripe long, x binary"), STRIPE)
    if not len(got):
        return np.zeros(0), np.zeros(0)
    return got[1 : 1 + heads] / got[0], got[1 + heads :] / got[0]


Cell = tuple[str, int]


@dataclass
class Training:
    """Heads of a grid by (backbone, width), the optimiser of each, and how many epochs are done."""

    heads: dict[Cell, Head]
    adams: dict[Cell, Adam]
    epoch: int = 0


def grids(cells: list[Cell], sizes: dict[Cell, int], limit: int) -> list[list[Cell]]:
    """Cells in groups of at most ``limit`` weights (a larger one alone): a task holds a group's gradients at a time."""
    out, held = [], 0
    for c in cells:
        if not out or held + sizes[c] > limit:
            out.append([])
            held = 0
        out[-1].append(c)
        held += sizes[c]
    return out


def dealt(cells: list[Cell], sizes: dict[Cell, int], limit: int) -> list[list[Cell]]:
    """Cells in few groups of about equal work: no group has more weights than the largest cell, or ``limit``."""
    out: list[list[Cell]] = []
    most = min(limit, max(sizes.values(), default=0))
    for c in sorted(cells, key=lambda c: -sizes[c]):
        group = next((g for g in out if sum(sizes[x] for x in g) + sizes[c] <= most), None)
        if group is None:
            out.append([c])
        else:
            group.append(c)
    return out


def drawn_in(epoch: Column, share: float, seed: int) -> Column:
    """Whether the row of key ``k`` is in an epoch's minibatch."""
    return F.shiftrightunsigned(F.xxhash64("k", epoch, F.lit(seed)), 11) / float(1 << 53) < share


def advance(head: Head, adam: Adam, x: np.ndarray, y: np.ndarray) -> None:
    """One step by the mean gradient of a minibatch, ``ROWS`` rows at a time."""
    loss, total = 0.0, 0.0
    for at in range(0, len(y), ROWS):
        some, grads = head.gradient(x[at : at + ROWS], y[at : at + ROWS])
        loss, total = loss + some, total + np.concatenate([g.ravel() for g in grads])
    head.losses.append(loss / len(y))
    adam.step(total / len(y))


def state_of(head: Head, adam: Adam, moments: bool) -> np.ndarray:
    """Losses, weights and, if asked for, moments as one flat array, for ``set_state``."""
    return np.concatenate([[len(head.losses), adam.step_no], head.losses, *[w.ravel() for kind in (adam.weights, *([adam.first, adam.second] if moments else [])) for w in kind]])


def set_state(head: Head, adam: Adam | None, flat: np.ndarray) -> None:
    at = 2 + int(flat[0])
    head.losses[:] = flat[2:at].tolist()
    if adam:
        adam.step_no = int(flat[1])
    for w in (*head.layers, head.classes, *([*adam.first, *adam.second] if adam else [])):
        w[:] = flat[at : at + w.size].reshape(w.shape)
        at += w.size


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(group, rows) of each (group, first), of rows in that order, however they lie in batches."""
    at, held = None, []
    for b in batches:
        keys = np.stack([b.column("group").to_numpy(), b.column("first").to_numpy()], axis=1)
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else []
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and tuple(keys[start]) != at:
                yield at[0], pa.Table.from_batches(held)
                held = []
            at = tuple(keys[start])
            held.append(b.slice(start, end - start))
    if held:
        yield at[0], pa.Table.from_batches(held)


def in_minibatches(data: DataFrame, after: Training, cells: list[list[Cell]], start: int, end: int, share: float, batch: int, seed: int, begun: Callable[[Cell], tuple[Head, Adam]] | None = None) -> None:
    """Take the heads of ``after`` through the minibatches of epochs ``start`` to ``end`` (exclusive), drawn from rows (k, y, v).

    One pass over the rows draws for all epochs: a row is sent to each group of cells once for a window of epochs that
    has it, with those epochs. So what is sent, and what a task reads, is at most what is drawn, about ``batch`` rows an epoch
    however many rows there are, and a task holds one window. Tasks make heads that ``begun`` gives for themselves, so that
    only a training that goes on sends its state. The driver gets the weights at the end, and moments if ``after`` has them.
    """
    spark, wide, moments = data.sparkSession, max(1, HELD // batch), bool(after.adams)
    last = F.least(F.col("first") + wide, F.lit(end)) - 1
    drawn = data.withColumn("first", F.explode(F.sequence(F.lit(start), F.lit(end - 1), F.lit(wide))))
    drawn = drawn.withColumn("epochs", F.filter(F.sequence("first", last), lambda e: drawn_in(e, share, seed))).filter(F.size("epochs") > 0)
    drawn = drawn.withColumn("group", F.explode(F.array(*[F.lit(g) for g in range(len(cells))])))
    drawn = drawn.repartitionById(len(cells), "group").sortWithinPartitions("group", "first", "k").select("group", "first", "epochs", "y", "v")
    shared = [] if begun else [spark.sparkContext.broadcast([(after.heads[c], after.adams[c]) for c in group]) for group in cells]

    def states(group: int, heads: list[tuple[Head, Adam]]) -> Iterator[pa.RecordBatch]:
        for place, (head, adam) in enumerate(heads):
            flat = state_of(head, adam, moments)
            for at in range(0, len(flat), STRIPE):
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([place], pa.int32()), pa.array([at // STRIPE], pa.int32()), pa.array([flat[at : at + STRIPE].tobytes()], pa.binary())], names=["group", "place", "stripe", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = -1, []
        for group, rows in windows(batches):
            if group != now:
                yield from states(now, heads)
                # a copy: a worker keeps broadcasts for the tasks to come, and one may be this task again
                now, heads = int(group), [begun(c) for c in cells[group]] if begun else copy.deepcopy(shared[group].value)
            epochs, y = rows["epochs"].combine_chunks(), rows["y"].to_numpy()
            x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(heads[0][0].layers[0]))
            row, epoch = np.repeat(np.arange(len(y)), epochs.value_lengths().to_numpy()), epochs.flatten().to_numpy()
            for e in np.unique(epoch):
                mine = row[epoch == e]
                for head, adam in heads:
                    advance(head, adam, x[mine], y[mine])
        yield from states(now, heads)

    got: dict[tuple[int, int], list] = {}
    for r in drawn.mapInArrow(run, "group int, place int, stripe int, x binary").collect():
        got.setdefault((r["group"], r["place"]), []).append((r["stripe"], r["x"]))
    for (group, place), parts in got.items():
        c = cells[group][place]
        set_state(after.heads[c], after.adams.get(c), np.concatenate([np.frombuffer(bytes(x), np.float64) for _, x in sorted(parts)]))
    for s in shared:
        s.destroy()


def margin_heads(rows: DataFrame, classes: int, cells: list[Cell], epochs: int = 500, rate: float = 1e-3, label: str = "label", vector: str = "vec", seed: int = 42, key: str | None = None, batch: int | None = None, cosine: bool = False, after: Training | None = None, until: int | None = None, limit: int = WEIGHTS, moments: bool = True) -> Training:
    """Train a head for each cell by Adam; labels are 0 to classes - 1. All cells share the passes over the rows.

    An epoch's gradient is that of all rows, or with ``batch`` of a minibatch: about so many rows, drawn by a hash of
    ``key`` and the epoch. Minibatches of at most ``ROWS`` rows are drawn for all epochs in one pass (``in_minibatches``); else
    each epoch is a pass. ``cosine`` lets the rate fall to zero along a cosine over the epochs. ``after`` is a training to go on with,
    ``until`` the epoch to stop after: what is drawn depends on the epoch alone, so a training that stopped ends as one that didn't.
    Without ``moments`` a new training has heads alone, so none can go on with it, and the driver holds a third as much.
    """
    spark = rows.sparkSession
    sizes = rows.agg(F.max(F.size(vector)).alias("d"), F.count("*").alias("n")).first()
    share = batch / max(sizes["n"], 1) if batch and key else None
    small, begun = share is not None and batch <= ROWS, None
    if after is None:
        d = sizes["d"]

        def begun(c: Cell) -> tuple[Head, Adam]:
            head = fresh_head(d, classes, c[0], c[1], seed)
            return head, Adam([*head.layers, head.classes], rate, epochs if cosine else None)

        after = Training({}, {})
        for c in cells:
            after.heads[c], adam = begun(c)
            if moments or not small:
                after.adams[c] = adam
    data = rows.select(*([F.col(key).alias("k")] if key else []), F.col(label).cast("int").alias("y"), F.col(vector).alias("v"))
    weights, end = {c: sum(w.size for w in (*h.layers, h.classes)) for c, h in after.heads.items()}, min(epochs, until or epochs)
    if small:
        if after.epoch < end and after.heads:
            in_minibatches(data, after, dealt(list(after.heads), weights, limit), after.epoch, end, share, batch, seed, begun)
        after.epoch = max(after.epoch, end)
        return after
    data, groups = materialised(data), grids(list(after.heads), weights, limit)
    for epoch in range(after.epoch, end):
        drawn = data if share is None else data.filter(drawn_in(F.lit(epoch), share, seed))
        for group in groups:
            shared = spark.sparkContext.broadcast([after.heads[c] for c in group])

            def gradients(b: pd.DataFrame, shared=shared) -> Iterator[tuple[float, list[np.ndarray]]]:
                x, y = np.stack(b["v"].to_list()), b["y"].to_numpy()
                return (head.gradient(x, y) for head in shared.value)

            losses, flat = added(drawn, gradients, len(group))
            shared.destroy()
            at = 0
            for c, loss in zip(group if len(flat) else [], losses, strict=True):
                size = sum(w.size for w in after.adams[c].weights)
                after.heads[c].losses.append(float(loss))
                after.adams[c].step(flat[at : at + size])
                at += size
        after.epoch = epoch + 1
    return after


def margin_head(rows: DataFrame, classes: int, arch: str = "linear", width: int = 32, epochs: int = 10, rate: float = 1e-2, label: str = "label", vector: str = "vec", seed: int = 42, key: str | None = None, batch: int | None = None, cosine: bool = False) -> Head:
    """One head, trained as by ``margin_heads``."""
    return margin_heads(rows, classes, [(arch, width)], epochs, rate, label, vector, seed, key, batch, cosine).heads[arch, width]


def embedded_by(rows: DataFrame, heads: dict[Cell, Head], vector: str = "vec", name: str = "cell") -> DataFrame:
    """``rows`` once for each head, with its name (backbone-width) and the unit vector it gives, in one pass.

    Vectors of narrower heads are filled with zeros, which changes no dot product, so that all have one length. A task
    emits ``ROWS`` rows of one head at a time, however large its batches and however many heads there are.
    """
    wide = max((w for _, w in heads), default=0)
    kept = rows.select(*[c for c in rows.columns if c != vector], F.col(vector).cast("array<double>").alias(vector))
    shared = rows.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x, others = part.columns[-1].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part.columns[:-1]
                for (arch, w), head in shared.value.items():
                    z = np.zeros((len(x), wide))
                    z[:, :w] = head.units(x)
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * wide), pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([*others, pa.array([f"{arch}-{w}"] * len(x)), vectors], names=[*part.schema.names[:-1], name, vector])

    fields = [f for f in kept.schema.fields if f.name != vector]
    return kept.mapInArrow(run, StructType([*fields, StructField(name, StringType()), kept.schema[vector]]))


def triplet_gradient(head: Head, x: list[np.ndarray], margin: float) -> tuple[float, list[np.ndarray]]:
    """Sum of hinge losses of rows of anchors, positives and negatives, and its gradient by layers."""
    outs = [head.forward(v) for v in x]
    norms = [np.maximum(np.linalg.norm(o[-1], axis=1, keepdims=True), 1e-12) for o in outs]
    unit = [o[-1] / n for o, n in zip(outs, norms, strict=True)]
    near, far = unit[0] - unit[1] + 1e-6, unit[0] - unit[2] + 1e-6
    dp, dn = (np.linalg.norm(v, axis=1, keepdims=True) for v in (near, far))
    gap = dp - dn + margin
    on = (gap > 0).astype(float)
    toward, away = on * near / np.maximum(dp, 1e-12), on * far / np.maximum(dn, 1e-12)
    grads = [np.zeros_like(w) for w in head.layers]
    for o, n, u, g in zip(outs, norms, unit, (toward - away, -toward, away), strict=True):
        delta = (g - u * (g * u).sum(axis=1, keepdims=True)) / n
        for i in range(len(head.layers) - 1, -1, -1):
            grads[i] += o[i].T @ delta
            if i:
                delta = (delta @ head.layers[i].T) * (o[i] > 0)
    return float((gap * on).sum()), grads


def triplet_head(rows: DataFrame, key: str, arch: str = "linear", width: int = 32, epochs: int = 10, draws: int = 512, rate: float = 1e-3, margin: float = 0.3, label: str = "label", vector: str = "vec", seed: int = 42) -> Head:
    """Train a backbone on ``draws`` triplets an epoch: two rows of one label and one of another, drawn by ``sampling.triplets``.

    Rows are numbered once; all epochs' triplets are drawn and meet their vectors in one go, written by epoch.
    """
    d = rows.select(F.size(vector).alias("d")).first()["d"]
    head = fresh_head(d, 1, arch, width, seed)
    adam = Adam(head.layers, rate)
    vectors = materialised(rows.select(F.col(key).alias("row"), F.col(label).alias("class"), F.col(vector).alias("x")))
    drawn = triplets(vectors, "class", "row", draws * epochs, seed)
    for name, short in (("anchor", "a"), ("positive", "p"), ("negative", "n")):
        drawn = drawn.join(vectors.select(F.col("row").alias(name), F.col("x").alias(short)), name)
    drawn = materialised(drawn.select(F.floor(F.col("draw") / draws).alias("epoch"), "a", "p", "n"))
    for epoch in range(epochs):
        shared = rows.sparkSession.sparkContext.broadcast(head)
        losses, flat = added(drawn.filter(F.col("epoch") == epoch).select("a", "p", "n"), lambda b, shared=shared: [triplet_gradient(shared.value, [np.stack(b[c].to_list()) for c in "apn"], margin)])
        shared.destroy()
        if len(flat):
            head.losses.append(float(losses[0]))
            adam.step(flat)
    return head
