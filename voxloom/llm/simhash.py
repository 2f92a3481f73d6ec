"""SimHash near-dedup by bit-sliced comparison.

1. A fingerprint per document, in one pass over the texts (the XXH64 of every word shingle votes per bit).
2. Equal fingerprints become one node, by a partial aggregate, so exact copies cost nothing later.
3. Two fingerprints within ``radius`` 2 agree on at least two of four 16-bit blocks: each node joins the
   six groups (mask, fingerprint & mask). A group over ``GROUP_CAP`` is refined instead of being read by
   one task: its free bits are cut into three parts, of which a linked pair agrees on at least one. Three
   levels leave at most 2^10 distinct fingerprints a group, however many documents there are.
4. Inside a group the fingerprints are stored as vertical bit planes, 64 members a word; distances to a
   whole word of members are counted at once by carry-save adders, and words whose members all exceed the
   radius are abandoned early. A task emits each linked node's smallest direct neighbour tree (at most one
   row per member), never all pairs.
5. Connected components over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Stage, connected_components, materialise

RADIUS = 2
GROUP_CAP = 1024
LEVELS = 3
#: Words of a text that are hashed at a time, so that very long texts need little memory.
CHUNK = 100_000
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 of each shingle of ``width`` words, a chunk at a time; fewer words are one shingle."""
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        buf = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths).tolist(), ends[width - 1 :].tolist(), strict=False)
        yield np.fromiter((digest(buf[a:b], seed) for a, b in spans), np.uint64, len(part) - width + 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def majority(chunks: Iterator[np.ndarray]) -> int:
    """The bits set in over half of the hashes."""
    n, votes = 0, np.zeros(64, np.int64)
    for h in chunks:
        n += len(h)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(votes * 2 > n).tolist()))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's ``width``-word shingles; 0 for a text without words."""
    words = words_of(text)
    return majority(shingle_hashes(words, width, seed)) if words else 0


def fingerprints(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc, fp) for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    kept = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "doc long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks() -> list[int]:
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    return [a | b for a, b in combinations(blocks, 2)]


def finer_masks(mask: int) -> list[int]:
    """The mask with each third of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    third = -(-len(free) // 3)
    return [mask | sum(1 << b for b in free[i : i + third]) for i in range(0, len(free), third)]


def near_groups(nodes: DataFrame, cap: int = GROUP_CAP) -> DataFrame:
    """(mask, value, fp, node): groups of bounded size that hold every pair of ``nodes`` within the radius."""
    spark, masks = nodes.sparkSession, first_masks()
    level = nodes.select("fp", "node", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    parts = []
    for _ in range(LEVELS):
        level = level.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        large = Stage(level.groupBy("mask", "value").count().filter(F.col("count") > cap).select("mask", "value", F.lit(True).alias("large")))
        n_large = large.df.count()
        if not n_large:
            parts.append(level.select("mask", "value", "fp", "node"))
            break
        side = F.broadcast(large.df) if n_large <= 100_000 else large.df
        parts.append(level.join(side.drop("large"), ["mask", "value"], "left_anti").select("mask", "value", "fp", "node"))
        finer = spark.createDataFrame([(signed(m), signed(f)) for m in masks for f in finer_masks(m)], "mask long, finer long")
        hot = level.join(side.drop("large"), ["mask", "value"], "left_semi").select("fp", "node", "mask")
        level = hot.join(F.broadcast(finer), "mask").select("fp", "node", F.col("finer").alias("mask"))
        masks = [f for m in masks for f in finer_masks(m)]
    else:
        parts.append(level.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "value", "fp", "node"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Fingerprints as vertical planes: [block, bit] holds that bit of 64 consecutive fingerprints."""
    blocks = -(-len(fps) // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64).reshape(blocks, 64)


def sliced_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS, leads: np.ndarray | None = None, slab: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the same group within the radius; ``group`` ascends. ``leads``: the rows that may be i.

    Each fingerprint is compared with the 64-member blocks that hold later members of its group. Planes are
    taken eight at a time; a comparison ends once no lane of its block can still be within the radius. Counters
    begin at such a value that they overflow where the distance first exceeds the radius.
    """
    n, width = len(fps), radius.bit_length()
    planes = bit_planes(fps)
    ends = np.searchsorted(group, group, side="right")
    index = np.arange(n)
    first, last = (index + 1) // 64, (ends - 1) // 64
    counts = np.where(ends > index + 1, last - first + 1, 0)
    if leads is not None:
        counts = np.where(leads, counts, 0)
    todo = np.flatnonzero(counts)
    cuts = np.searchsorted(np.cumsum(counts[todo]), np.arange(slab, counts.sum() + slab, slab)) + 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for rows in np.split(todo, cuts[cuts < len(todo)]):
        if not len(rows):
            continue
        i = np.repeat(rows, counts[rows])
        k = first[i] + (np.arange(len(i)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows]))
        low = np.clip(i + 1 - k * 64, 0, 63).astype(np.uint64)
        high = np.clip(ends[i] - k * 64, 1, 64).astype(np.uint64)
        alive = (full << low) & (full >> (np.uint64(64) - high))
        bias = (1 << width) - 1 - radius
        counters = [np.full(len(i), full if bias >> c & 1 else 0, np.uint64) for c in range(width)]
        for start in range(0, 64, 8):
            for b in range(start, start + 8):
                carry = planes[k, b] ^ (np.uint64(0) - ((fps[i] >> np.uint64(b)) & np.uint64(1)))
                for c in range(width):
                    counters[c], carry = counters[c] ^ carry, counters[c] & carry
                alive &= ~carry
            keep = alive != 0
            if not keep.all():
                i, k, alive, counters = i[keep], k[keep], alive[keep], [c[keep] for c in counters]
            if not len(i):
                break
        if len(i):
            at, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield i[at], k[at] * 64 + lane


def linked(batches: Iterator[pa.RecordBatch], rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, value) to links (a, b): each member of a local component with its smallest node."""

    def links(mask: np.ndarray, value: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        new = np.r_[False, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
        group = np.cumsum(new)
        label = node.copy()
        found = list(sliced_pairs(fp.view(np.uint64), group))
        changed = bool(found)
        while changed:
            old = label.copy()
            for i, j in found:
                low = np.minimum(label[i], label[j])
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
            changed = not np.array_equal(old, label)
        moved = label != node
        pairs = np.unique(np.stack([node[moved], label[moved]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [b.column(x).to_numpy(zero_copy_only=False) for x in range(4)]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(held[0]) < rows:
            continue
        mask, value = held[0], held[1]
        cut = int(np.flatnonzero((mask != mask[-1]) | (value != value[-1]))[-1]) + 1 if (mask[0], value[0]) != (mask[-1], value[-1]) else 0
        if cut:
            yield links(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield links(*held)


def components(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", width: int = 3, cap: int = GROUP_CAP) -> DataFrame:
    """(doc, fp, component) for each row of ``docs``: component is the smallest id reachable by links.

    Two rows are linked if their fingerprints differ in at most two bits. Null, empty and blank texts have
    fingerprint zero and are linked like any other. Rows that repeat an id stay, one result row each; a null
    id takes part as itself only in its row's fingerprint, and its component is that of its fingerprint (null
    if no row with an id is reachable). Very long texts are read whole, some words at a time. Other columns are ignored. An
    empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, doc_col, text_col, width))
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc").alias("node")).filter("node is not null"))
    groups = near_groups(nodes, cap).repartition("mask", "value").sortWithinPartitions("mask", "value", "node")
    links = groups.mapInArrow(linked, "a long, b long")
    comps = connected_components(links)
    of_fp = nodes.join(comps, "node", "left").select(F.col("fp").alias("fp2"), F.coalesce("component", "node").alias("component"))
    return fps.join(of_fp, fps.fp == of_fp.fp2, "left").select("doc", "fp", "component")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
