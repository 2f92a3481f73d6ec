"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

1. Equal vectors become one node, named by a hash (a partial aggregate); of a node's rows only as many as a result can
   show are kept, the smallest ids. Nodes carry their direction as 8-bit integers.
2. A seed graph from small blocks of at most 2 * ``LEAF`` nodes: ``TREES`` times, nodes are range-partitioned by the
   signs of random projections about their medians (medians of a sample of ``SAMPLE`` nodes) and then by one more
   projection, so that a crowd of almost equal vectors is split like any other; and once they are dealt at random,
   which ties the graph together whatever the partitions are. Each node keeps its ``DEGREE`` best.
3. NN-descent: each node gathers ``PICK`` new and ``PICK`` old neighbours and as many nodes it is a neighbour of, with
   their vectors, by a join; pairs with a new member are compared, and each member is sent those better than its worst
   neighbour. Rounds go on until at most ``SETTLED`` of all list entries are new, at every size.
4. Search: a query starts at its own node. Each round expands its best unexpanded nodes, joins the neighbours of
   those, scores them and keeps the best ``BEAM``; it ends when the best ``DEPTH`` of every query are expanded.
5. The best nodes are scored anew with the original vectors in double precision, then give way to their rows.

A node's list and a query's beam are arrays of one row; a round merges them with what was sent by one shuffle each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, lean, materialise

TREES, LEAF, PER_BLOCK, SAMPLE = 6, 128, 10, 8192
DEGREE, PICK, PER_JOIN, SETTLED = 40, 20, 8, 0.1
BEAM, DEPTH, EXPAND = 128, 96, 32
#: Rows that a task merges at a time, and bits of the counters by which it thins edges that go back.
ROWS, SLOT_BITS = 40_000, 20
NODE = "node long, code binary, nbrs array<long>, sims array<float>, fresh array<boolean>, worst float, asks array<struct<v:long,new:boolean,back:boolean>>"
SENT = "u long, vs array<long>, ss array<float>"
BEAMS = "q long, code binary, ids array<long>, sims array<float>, done array<boolean>, front array<long>"


def valid(vector: Column) -> Column:
    """Not null, not empty or zero, and only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Spark thins the rows of a key before the shuffle, so that no task meets a hot one."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = matrix(b.column(1))
            x = np.round(127 * (x / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "code"])


def directions(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Codes (none null) as rows of unit length."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    if not len(codes):
        return np.zeros((0, 1), np.float32)
    ends = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
    x = np.frombuffer(codes.buffers()[2], np.int8)[ends[0] : ends[-1]].reshape(len(codes), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal keys."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


def by_runs(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole runs of the first column, of about ``rows`` rows (more where one run has more)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            key = t.column(0).to_numpy()
            last = np.flatnonzero(key != key[-1])
            if len(last):
                yield t.slice(0, int(last[-1]) + 1)
                rest = t.slice(int(last[-1]) + 1)
                held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def best_of(sims: np.ndarray, m: int) -> np.ndarray:
    """Column numbers of the m largest entries of each row (any order)."""
    return np.argpartition(-sims, m - 1, axis=-1)[..., :m] if m < sims.shape[-1] else np.broadcast_to(np.arange(sims.shape[-1]), sims.shape)


def within_blocks(leaf: int, per_block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (group, node, code), sorted, in blocks of a group's consecutive nodes: each node's best others of its block."""

    def best(nodes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        s = x @ x.T
        np.fill_diagonal(s, -2)
        m = min(per_block, len(nodes) - 1)
        at = best_of(s, m)[:, :m]
        sizes = np.full(len(nodes), m)
        return pa.RecordBatch.from_arrays([pa.array(nodes), lists(nodes[at].ravel(), sizes, pa.int64()), lists(np.take_along_axis(s, at, 1).ravel(), sizes, pa.float32())], names=["u", "vs", "ss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), directions(b.column(2))]
            if b.num_rows:
                held = cols if held is None else [np.concatenate(c) for c in zip(held, cols, strict=True)]
            while held is not None and len(held[0]):
                n = int(np.searchsorted(held[0], held[0][0], side="right"))  # rows of the first group
                if n == len(held[0]) and n <= 2 * leaf:
                    break  # it may go on
                cut = n if n <= 2 * leaf else leaf
                if cut > 1:
                    yield best(held[1][:cut], held[2][:cut])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]) > 1:
            yield best(held[1], held[2])

    return run


def seeds(nodes: DataFrame, n: int, seed: int, trees: int, leaf: int, per_block: int, sample: int) -> DataFrame:
    """(u, vs, ss): neighbours of each node within blocks of projections and of a random dealing."""
    share = min(1.0, sample / max(n, 1))
    taken = nodes.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).limit(2 * sample).select("code").collect()
    bits = max(0, int(np.ceil(np.log2(max(1, n / leaf / 8)))))
    rng = np.random.default_rng(seed)
    known = directions(pa.array([bytes(r["code"]) for r in taken], pa.binary())) if taken else np.zeros((1, 1), np.float32)
    planes = rng.standard_normal((trees, bits + 1, known.shape[1])).astype(np.float32)
    middle = np.median(np.einsum("sd,tbd->stb", known, planes), axis=0).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = directions(b.column(1))
            for t in range(trees):
                p = x @ planes[t].T - middle[t]
                cell = ((p[:, :bits] > 0) * (1 << np.arange(bits))).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), b.column(0), b.column(1), pa.array(cell), pa.array(p[:, bits])], names=["tree", "node", "code", "cell", "along"])

    placed = nodes.select("node", "code").mapInArrow(place, "tree long, node long, code binary, cell long, along float")
    order = ["tree", "cell", "along", "node"]
    near = placed.repartitionByRange(max(1, -(-n * trees // (16 * leaf))), *order[:3]).sortWithinPartitions(*order).select("tree", "node", "code")
    mixed = nodes.select(F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.lit(max(1, n // leaf))).alias("bucket"), "node", "code")
    mixed = mixed.repartition("bucket").sortWithinPartitions("bucket", "node")
    blocks = within_blocks(leaf, per_block)
    return near.mapInArrow(lean(blocks), SENT).unionByName(mixed.mapInArrow(lean(blocks), SENT))


def merged(degree: int, pick: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (node, sent, code, nbrs, sims, fresh) sorted by the first two to a new row of each node: its list with what was sent.

    A node's own row (sent: 0) comes first. Entries of the old list that were gathered as new are old now.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent_back = np.zeros(1 << SLOT_BITS, np.uint16)
        for t in by_runs(batches):
            t = t.combine_chunks()
            node, sent = t.column("node").to_numpy(), t.column("sent").to_numpy()
            nbrs, sims = (t.column(c).combine_chunks() for c in ("nbrs", "sims"))
            size = np.diff(nbrs.offsets.to_numpy())
            u, v, s = np.repeat(node, size), nbrs.flatten().to_numpy(), sims.flatten().to_numpy()
            old = np.repeat(sent == 0, size)
            fresh = np.ones(len(u), bool)
            fresh[old] = t.column("fresh").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            fresh[old] &= ~gathered(np.repeat(np.arange(len(node)), size)[old], fresh[old], pick)
            # an old entry comes before the same neighbour sent again
            order = np.lexsort((~old, v, -s, u))
            u, v, s, fresh = u[order], v[order], s[order], fresh[order]
            first = np.zeros(len(u), bool)
            once = np.lexsort((np.arange(len(u)), v, u))
            first[once[np.r_[True, (u[once][1:] != u[once][:-1]) | (v[once][1:] != v[once][:-1])]] if len(u) else once] = True
            u, v, s, fresh = u[first], v[first], s[first], fresh[first]
            start, length = groups(u)
            top = np.arange(len(u)) - np.repeat(start, length) < degree
            u, v, s, fresh = u[top], v[top], s[top], fresh[top]
            own = np.flatnonzero(sent == 0)
            start, length = groups(u)
            at = np.searchsorted(node[own], u)
            sizes = np.bincount(at, minlength=len(own))
            worst = np.full(len(own), -2, np.float32)
            full = sizes >= degree
            worst[full] = s[(np.cumsum(sizes) - 1)[full]]
            asks = gathered(u, fresh, pick) | gathered(u, ~fresh, pick)
            back = counted(v[asks], fresh[asks], sent_back, 2 * pick)
            wanted = pa.StructArray.from_arrays([pa.array(v[asks]), pa.array(fresh[asks]), pa.array(back)], names=["v", "new", "back"])
            asked = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(at[asks], minlength=len(own)))], pa.int32()), wanted)
            cols = [pa.array(node[own]), t.column("code").combine_chunks().take(pa.array(own)), lists(v, sizes, pa.int64()), lists(s, sizes, pa.float32()), lists(fresh, sizes, pa.bool_()), pa.array(worst), asked]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in NODE.split(", ")])

    return run


def gathered(row: np.ndarray, fresh: np.ndarray, pick: int) -> np.ndarray:
    """Which list entries a row gathers of those in ``fresh``: the first ``pick``."""
    start, length = groups(row)
    before = np.cumsum(fresh) - fresh
    return fresh & (before - np.repeat(before[start], length) < pick)


def counted(v: np.ndarray, new: np.ndarray, seen: np.ndarray, limit: int) -> np.ndarray:
    """Which edges also go back from their end: of those to one node, new or old, about the first ``limit`` of a task.

    Without it a node that is everyone's neighbour would be sent to by all of them. ``seen`` counts edges by hashed ends, so
    memory is bounded; ends that share a slot share its limit, which only thins a sample.
    """
    mixed = (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + new.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    start, size = groups(slot[order])
    before = np.empty(len(slot), np.int64)
    before[order] = np.arange(len(slot)) - np.repeat(start, size)
    before += seen[slot]
    ends = slot[order][start]
    seen[ends] = np.minimum(seen[ends] + size, limit)
    return before < limit


def update(graph: DataFrame, sent: DataFrame, degree: int, pick: int) -> DataFrame:
    own = graph.select("node", F.lit(0).alias("sent"), "code", "nbrs", "sims", "fresh")
    new = sent.select(F.col("u").alias("node"), F.lit(1).alias("sent"), F.lit(None).cast("binary").alias("code"), F.col("vs").alias("nbrs"), F.col("ss").alias("sims"), F.lit(None).cast("array<boolean>").alias("fresh"))
    return own.unionByName(new).repartition("node").sortWithinPartitions("node", "sent").mapInArrow(lean(merged(degree, pick)), NODE)


def local_joins(pick: int, per_join: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (centre, back, turn, member, new, code, worst), sorted by the first three, to what each member is sent.

    Of a centre's rows that came back along an edge the first ``pick`` new and old ones count.
    """

    def compare(centre: np.ndarray, member: np.ndarray, new: np.ndarray, x: np.ndarray, worst: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, size = groups(centre)
        for at in range(0, len(start), 256):
            st, sz = start[at : at + 256], size[at : at + 256]
            w = int(sz.max())
            if w < 2:
                continue
            idx = np.minimum(st[:, None] + np.arange(w), len(centre) - 1)
            real = np.arange(w) < sz[:, None]
            y, who, fresh = x[idx], member[idx], new[idx] & real
            s = y @ y.transpose(0, 2, 1)
            s[~((fresh[:, :, None] | fresh[:, None, :]) & real[:, :, None] & real[:, None, :])] = -2
            s[:, np.arange(w), np.arange(w)] = -2
            good = (s > worst[idx][:, :, None]) & (s > -2)
            g, i = np.nonzero(good.sum(axis=2) > per_join)
            if len(g):  # too many for a member: only the best
                best = np.zeros((len(g), w), bool)
                np.put_along_axis(best, best_of(np.where(good[g, i], s[g, i], -2), per_join)[:, :per_join], True, 1)
                good[g, i] &= best
            g, i, j = np.nonzero(good)
            sizes = good.sum(axis=2).ravel()
            some = sizes > 0
            yield pa.RecordBatch.from_arrays([pa.array(who.ravel()[some]), lists(who[g, j], sizes[some], pa.int64()), lists(s[g, i, j], sizes[some], pa.float32())], names=["u", "vs", "ss"])

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops what a centre doesn't count as it streams by, so that a node that is everyone's neighbour isn't held."""
        open_centre, open_counts = None, {True: 0, False: 0}
        for b in batches:
            if not b.num_rows:
                continue
            centre, back, new = (b.column(c).to_numpy(zero_copy_only=False) for c in ("centre", "back", "new"))
            start, size = groups(centre)
            keep = back == 0
            for kind in (True, False):
                mine = (back == 1) & (new == kind)
                before = np.cumsum(mine) - mine
                rank = before - np.repeat(before[start], size)
                if centre[0] == open_centre:
                    rank[: size[0]] += open_counts[kind]
                keep |= mine & (rank < pick)
                open_counts[kind] = int(mine[start[-1] :].sum()) + (open_counts[kind] if centre[-1] == open_centre else 0)
            open_centre = centre[-1]
            yield b.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_runs(thinned(batches)):
            centre, member, new, worst = (t.column(c).to_numpy() for c in ("centre", "member", "new", "worst"))
            order = np.lexsort((~new, member, centre))
            c, m = centre[order], member[order]
            order = order[np.r_[True, (c[1:] != c[:-1]) | (m[1:] != m[:-1])]]
            yield from compare(centre[order], member[order], new[order], directions(t.column("code"))[order], worst[order])

    return run


def descended(graph: DataFrame, degree: int, pick: int, per_join: int, turn: int) -> DataFrame:
    """The graph after one round of NN-descent."""
    edges = graph.select(F.col("node").alias("u"), "code", "worst", F.inline("asks"))
    back = edges.filter("back").select(F.col("v").alias("centre"), F.lit(1).alias("back"), F.xxhash64("u", "v", F.lit(turn)).alias("turn"), F.col("u").alias("member"), "new", "code", "worst")
    known = graph.select(F.col("node").alias("v"), "code", "worst")
    ahead = edges.select("u", "v", "new").join(known, "v").select(F.col("u").alias("centre"), F.lit(0).alias("back"), F.lit(0).cast("long").alias("turn"), F.col("v").alias("member"), "new", "code", "worst")
    met = ahead.unionByName(back).repartition("centre").sortWithinPartitions("centre", "back", "turn")
    return update(graph, met.mapInArrow(lean(local_joins(pick, per_join)), SENT), degree, pick)


def neighbour_graph(nodes: DataFrame, seed: int = 7, trees: int = TREES, leaf: int = LEAF, degree: int = DEGREE, pick: int = PICK, per_join: int = PER_JOIN, settled: float = SETTLED) -> DataFrame:
    """(node, code, nbrs, sims, ...) of ``nodes`` (node, code): NN-descent from seeds until few entries are new."""
    none = lambda kind: F.array().cast(kind)
    bare = nodes.select("node", "code", none("array<long>").alias("nbrs"), none("array<float>").alias("sims"), none("array<boolean>").alias("fresh"))
    graph = Stage(update(bare, seeds(nodes, nodes.count(), seed, trees, leaf, PER_BLOCK, SAMPLE), degree, pick))
    new = F.sum(F.aggregate("fresh", F.lit(0), lambda n, x: n + x.cast("int")))
    for turn in count():
        # counted as the round is written
        seen = Observation()
        better = Stage(descended(graph.df, degree, pick, per_join, turn).observe(seen, F.coalesce(new, F.lit(0)).alias("new"), F.coalesce(F.sum(F.size("nbrs")), F.lit(0)).alias("all")))
        graph.drop()
        graph = better
        if seen.get["new"] <= settled * seen.get["all"]:
            return graph.df


def beams(beam: int, depth: int, expand: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (q, sent, code, ids, sims, done, v), sorted by the first two, to the next beams: a query's row, then nodes sent to it."""

    def step(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, done: np.ndarray, new: np.ndarray) -> tuple:
        """``x``: directions of the query and of the nodes sent to it (``new``)."""
        if len(new):
            new, first = np.unique(new, return_index=True)
            unseen = ~np.isin(new, ids)
            new, first = new[unseen], first[unseen]
        if len(new):
            ids = np.r_[ids, new]
            sims = np.r_[sims, x[1 + first] @ x[0]]
            done = np.r_[done, np.zeros(len(new), bool)]
        order = np.lexsort((ids, -sims))[:beam]
        ids, sims, done = ids[order], sims[order], done[order]
        front = np.flatnonzero(~done[:depth])[:expand]
        done = done.copy()
        done[front] = True
        return ids, sims, done, ids[front]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_runs(batches, ROWS // 4):
            t = t.combine_chunks()
            q, v, x = t.column("q").to_numpy(), pc.fill_null(t.column("v"), 0).to_numpy(), directions(t.column("code"))
            ids, sims, done = (t.column(c).combine_chunks() for c in ("ids", "sims", "done"))
            out = []
            start, size = groups(q)
            for a, n in zip(start.tolist(), size.tolist(), strict=True):
                mine = [ids[a].values.to_numpy(), sims[a].values.to_numpy(), done[a].values.to_numpy(zero_copy_only=False)]
                out.append(step(x[a : a + n], *mine, v[a + 1 : a + n]))
            kinds = (pa.int64(), pa.float32(), pa.bool_(), pa.int64())
            cols = [lists(np.concatenate([o[i] for o in out]), np.array([len(o[i]) for o in out]), k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(q[start]), t.column("code").take(pa.array(start)).combine_chunks(), *cols], names=["q", "code", "ids", "sims", "done", "front"])

    return run


def searched(starts: DataFrame, graph: DataFrame, beam: int = BEAM, depth: int = DEPTH, expand: int = EXPAND) -> DataFrame:
    """(q, ids, sims): the beam of each query node of ``starts`` (q), best first, after a greedy search from the node itself."""
    codes = graph.select(F.col("node").alias("v"), "code")
    origin = codes.join(starts.select(F.col("q").alias("v")), "v", "left_semi")
    state = Stage(origin.select(F.col("v").alias("q"), "code", F.array("v").alias("ids"), F.array(F.lit(1.0).cast("float")).alias("sims"), F.array(F.lit(True)).alias("done"), F.array("v").alias("front")))
    while True:
        asks = state.df.select("q", F.explode("front").alias("node"))
        if asks.isEmpty():
            return state.df.select("q", "ids", "sims")
        near = asks.join(graph.select("node", "nbrs"), "node").select("q", F.explode("nbrs").alias("v"))
        # once a query and node; the join below needs rows by node, too
        sent = near.repartition("v").dropDuplicates(["v", "q"]).join(codes, "v")
        own = state.df.select("q", F.lit(0).alias("sent"), "code", "ids", "sims", "done", F.lit(None).cast("long").alias("v"))
        new = sent.select("q", F.lit(1).alias("sent"), "code", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<float>").alias("sims"), F.lit(None).cast("array<boolean>").alias("done"), "v")
        after = Stage(own.unionByName(new).repartition("q").sortWithinPartitions("q", "sent").mapInArrow(lean(beams(beam, depth, expand)), BEAMS))
        state.drop()
        state = after


def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, v, a, b) to (q, v, score): the cosine of original vectors in double precision."""
    for b in batches:
        if b.num_rows:
            # powers of two change no digit of a cosine, and keep very large and small vectors finite
            x, y = (np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None]) for m in (matrix(b.column(2)), matrix(b.column(3))))
            s = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["q", "v", "score"])


def named(base: DataFrame) -> DataFrame:
    """``base``, written, with a column ``node``: a hash of its vector that differs for different vectors of the table."""
    for salt in count():
        hashed = Stage(base.withColumn("node", F.xxhash64(F.lit(salt), "vector")).withColumn("check", F.xxhash64(F.lit(~salt), "vector")))
        if hashed.df.groupBy("node").agg((F.min("check") != F.max("check")).alias("two")).filter("two").isEmpty():
            return hashed.df.drop("check")
        hashed.drop()


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7, trees: int = TREES, leaf: int = LEAF, degree: int = DEGREE, beam: int = BEAM, depth: int = DEPTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each row for which ``queries`` (a condition) holds.

    Nearness is the largest cosine, ties to the smaller id; a query's own row is no candidate. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part, nor do those of other than the most frequent
    length. Rows that repeat an id and vector count once; different vectors of one id are different rows, each with a
    result of its own where the id is a query's. Rows with a null id are skipped. With k or fewer candidates all are
    returned; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    ok = vectors.filter(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    lengths = ok.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    usual = lengths["d"] if lengths else 0
    rows = ok.filter(F.size(vector_col) == usual).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), queries.alias("is_query"))
    base = named(rows)
    heads = materialise(base.groupBy("node").agg(F.first("vector").alias("vector")))
    nodes = materialise(heads.mapInArrow(encode, "node long, code binary"))
    graph = neighbour_graph(nodes, seed, trees, leaf, max(degree, 4 * k + 4))
    asked = materialise(base.filter("is_query").select(F.col("id").alias("query_id"), F.col("node").alias("q")).distinct())
    found = searched(asked.select("q").distinct(), graph, beam, depth)
    pairs = found.select("q", F.explode(F.slice("ids", 1, 4 * k + 4)).alias("v"))
    exact = pairs.join(heads.select(F.col("node").alias("v"), F.col("vector").alias("b")), "v").join(heads.select(F.col("node").alias("q"), F.col("vector").alias("a")), "q")
    scored = exact.select("q", "v", "a", "b").mapInArrow(cosines, "q long, v long, score double")
    # a node's first k + 1 rows are all that a result can show, the query's own row included
    owners = first_rows(base.select("node", "id").distinct(), ["node"], [F.col("id")], k + 1).select(F.col("node").alias("v"), "id")
    ranked = first_rows(scored.join(owners, "v").select("q", "v", "id", "score"), ["q"], [F.desc("score"), F.col("id")], k + 1)
    own = (F.col("v") == F.col("q")) & (F.col("id") == F.col("query_id"))
    results = asked.join(ranked, "q").filter(~own)
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "id", "v"))
    return results.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
