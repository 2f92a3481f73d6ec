"""Near copies by SimHash: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity fingerprints differ in about ten bits, too many to index by bits. So candidates come from keys of
minima, and the bit-sliced comparison thins them:

1. One pass over the texts gives a SimHash, the number of distinct shingles and ``BANDS`` keys, each of ``ROWS``
   minima of permuted shingle hashes. A pair at 0.8 shares one of 25 keys of four minima with a chance of 0.999998.
2. Texts with equal words become one node, by a partial aggregate.
3. First the smallest node of each key's group is its pivot. The bit-sliced comparison of simhash.py counts distances
   of pivots to members and abandons words beyond ``WIDE`` bits (five deviations beyond what 0.8 gives). The pairs left
   are verified exactly on the shingle sets, by built-in array functions; a pivot of very many members has a copy of
   its set for each ``SHARE`` of them, so that no task joins them all. This links most copies.
4. Groups whose members still have several labels get their members' sets, once a member and not once a pair. A group of
   up to ``PART`` members is compared whole, in one task; of a larger one pivots (about 64, 512, ... in turn) meet all
   others in parts. Candidates of the bit-sliced comparison are verified there at once, and only links leave the task.
   A pivot then leaves its group, as it has met all others; a member found similar to one stays, as it may link
   others, until it was a pivot itself or all that remain have one label: links merge labels, so that pairs that are
   already of one component are skipped.
5. Connected components over all links: the closure of all links between nodes that share a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, lean, materialise, windows
from .simhash import majority, shingle_hashes, sliced_pairs, words_of

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
WIDE = 24
#: Members of a group that are compared whole, and shingles for each of them that a task may hold.
PART, PART_SHINGLES = 1024, 2048
SHARE = 512
#: Expected pivots of a larger group at first, and their growth from turn to turn.
PIVOTS, GROWTH = 64, 8
#: Bytes of text sketched at a time.
WINDOW_BYTES = 2_000_000
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; none for a text without words."""
    words = words_of(text)
    return np.unique(np.concatenate(list(shingle_hashes(words, WIDTH)))) if words else np.zeros(0, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set: a hash of each band's number and minima."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        part = short[at : at + 2048]
        low = np.minimum(low, (part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(doc, t1, t2, w1, w2, fp, n, keys): hashes of text and words, SimHash and size of the shingle set, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in windows(batches, WINDOW_BYTES):
            ints, keys = np.zeros((4, b.num_rows), np.int64), np.zeros((b.num_rows, BANDS), np.int64)
            for i, t in enumerate(b.column(1)):
                text = t.as_py()
                s = shingle_set(text)
                fp = majority(iter([s])) if len(s) else 0
                ints[:, i] = np.array([*words_hash(text), fp, len(s)], np.uint64).view(np.int64)
                keys[i] = band_keys(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *map(pa.array, ints), lists], names=["doc", "t1", "t2", "w1", "w2", "fp", "n", "keys"])

    kept = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *text_hashes(text_col))
    return kept.mapInArrow(lean(run), "doc long, t1 long, t2 long, w1 long, w2 long, fp long, n long, keys array<long>")


def text_hashes(text_col: str) -> list[Column]:
    """What tells different texts of one id apart, (t1, t2)."""
    return [F.xxhash64(F.lit(seed), text_col).alias(name) for seed, name in enumerate(("t1", "t2"))]


def words_hash(text: str | None) -> tuple[int, int]:
    joined = b" ".join(words_of(text))
    return xxhash.xxh64_intdigest(joined, 0), xxhash.xxh64_intdigest(joined, 1)


def sets_of(docs: DataFrame, nodes: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, doc, t1, t2), each read from one row with its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in windows(batches, WINDOW_BYTES):
            sets = [shingle_set(t.as_py()).view(np.int64) for t in b.column(1)]
            ends = np.r_[0, np.cumsum([len(x) for x in sets])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    texts = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *text_hashes(text_col))
    once = texts.join(nodes.select("node", "doc", "t1", "t2"), ["doc", "t1", "t2"]).dropDuplicates(["doc", "t1", "t2"]).select("node", "text")
    return once.mapInArrow(lean(run), "node long, shingles array<long>")


def whole_runs(batches: Iterator[pa.RecordBatch], rows: int, numbers: int = 1 << 40) -> Iterator[pa.Table]:
    """Rows sorted by key and part in tables of whole runs of both, of about ``rows`` rows or ``numbers`` shingles."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= 8 * numbers:
            t = pa.Table.from_batches(held)
            key, part = t.column("key").to_numpy(), t.column("part").to_numpy()
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            if len(other):
                yield t.slice(0, int(other[-1]) + 1)
                held = t.slice(int(other[-1]) + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def candidates(t: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of a pivot and a member of its run with another label, near it and of a size that allows ``similarity``."""
    key, part, fp, lead, label, n = (t.column(c).to_numpy() for c in ("key", "part", "fp", "lead", "label", "n"))
    run = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    for i, j in sliced_pairs(np.ascontiguousarray(fp).view(np.uint64), run, WIDE, lead, 1 << 15):
        fit = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        yield i[fit], j[fit]


def pairs_of(t: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(a, b, la, lb), the smaller node first."""
    node, label = t.column("node").to_numpy(), t.column("label").to_numpy()
    i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], label[i], label[j])], names=["a", "b", "la", "lb"])


def near_pivots(similarity: float):
    """Rows sorted by (key, part, place) to the candidates of each run's pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, 1 << 15):
            for i, j in candidates(t, similarity):
                yield pairs_of(t, i, j)

    return run


def true_links(similarity: float, numbers: int):
    """Rows with shingles, sorted by (key, part, place), to verified links of each run's pivots."""

    def verified(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sets, label = t.column("shingles").combine_chunks(), t.column("label").to_numpy().tolist()
        begin = sets.offsets.to_numpy().astype(np.int64) - sets.offsets[0].as_py()
        distinct, number = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        size, mark = np.diff(begin), np.zeros(len(distinct), bool)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for i, j in candidates(t, similarity):
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            linked_i, linked_j = [], []
            for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
                if not len(at):
                    continue
                p, mine = int(i[at[0]]), top(label[i[at[0]]])
                others = np.array([x for x in j[at].tolist() if top(label[x]) != mine], np.int64)
                if not len(others):
                    continue
                mark[number[begin[p] : begin[p + 1]]] = True
                lengths = size[others]
                first = np.cumsum(lengths) - lengths
                shared = np.add.reduceat(mark[number[np.repeat(begin[others] - first, lengths) + np.arange(lengths.sum())]], first, dtype=np.int64)
                mark[number[begin[p] : begin[p + 1]]] = False
                for x in others[shared >= similarity * (size[p] + lengths - shared)].tolist():
                    low, high = sorted((top(label[p]), top(label[x])))
                    if low != high:
                        up[high] = low
                        linked_i.append(p)
                        linked_j.append(x)
            yield pairs_of(t, np.array(linked_i, np.int64), np.array(linked_j, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, 1 << 12, numbers):
            yield from verified(t)

    return run


def similar(a: Column, b: Column, similarity: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= similarity * (F.size(a) + F.size(b) - shared)


def with_sets(pairs: DataFrame, sets: DataFrame, side: str, name: str) -> DataFrame:
    """``pairs`` with the shingle sets of one side's nodes; a node of very many pairs has a copy for each ``SHARE`` of them."""
    other = "b" if side == "a" else "a"
    busy = pairs.groupBy(side).agg(F.ceil(F.count("*") / SHARE).alias("copies")).filter("copies > 1")
    slot = F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1)))
    dealt = pairs.join(busy, side, "left").withColumn("slot", slot).drop("copies")
    copied = sets.join(busy.withColumnRenamed(side, "node"), "node", "left")
    copied = copied.select(F.col("node").alias(side), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("slot"), F.col("shingles").alias(name))
    return dealt.join(copied, [side, "slot"]).drop("slot")


def chosen(members: DataFrame, pivots: int, turn: int, part: int) -> DataFrame:
    """``members`` of groups with several labels, whether they are pivots (``lead``), and the group's number of ``parts``.

    Labels of a group share its pivots evenly, so that small ones are soon through. A hash of node and turn decides, so
    nothing is ranked; a group of up to ``part`` members gives all of them. Parts and pivots of a group are so many that
    their shingles fit a task.
    """
    limit = part * PART_SHINGLES
    of_label = members.groupBy("key", "label").agg(F.count("*").alias("same"), F.sum("n").alias("weight"))
    of_key = of_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("same").alias("total"), F.sum("weight").alias("weight")).filter("labels > 1")
    small = ((F.col("total") <= part) & (F.col("weight") <= limit)) | (F.col("total") <= 4)
    wanted = F.greatest(F.lit(4.0), F.least(F.lit(float(min(pivots, part))), F.col("total") * (limit / 2) / F.col("weight")))
    share = F.shiftrightunsigned(F.xxhash64("node", F.lit(turn)), 11) / float(1 << 53)
    lead = small | (share * F.col("same") * F.col("labels") < wanted)
    parts = F.when(small, F.lit(1)).otherwise(F.ceil(F.col("weight") / limit)).cast("long")
    sized = of_label.drop("weight").join(of_key, "key")
    return members.join(sized, ["key", "label"]).select("key", "node", "fp", "n", "label", lead.alias("lead"), parts.alias("parts"))


def in_parts(ranked: DataFrame, *more: str) -> DataFrame:
    """Members in parts of their groups, pivots (place 0) in each; sorted for ``whole_runs``."""
    columns = [F.col(c) for c in ("node", "fp", "lead", "label", "n", *more)]
    leads = ranked.filter("lead").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"), *columns)
    rest = ranked.filter("not lead").select("key", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.lit(1).alias("place"), *columns)
    return leads.unionByName(rest).repartition("key", "part").sortWithinPartitions("key", "part", "place", "node")


def relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the labels that ``links`` (la, lb) merge replaced by the smallest of each group."""
    merged = materialise(connected_components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("component").alias("into")))
    return members.join(merged, "label", "left").select("key", "node", "fp", "n", F.coalesce("into", "label").alias("label"))


def linked(docs: DataFrame, nodes: DataFrame, doc_col: str, text_col: str, similarity: float, part: int) -> DataFrame:
    """(node, component) of those of nodes (node, doc, t1, t2, fp, n, keys) that have links, by verified links."""
    pair = "a long, b long, la long, lb long"
    keyed = nodes.filter("n > 0").select("node", "fp", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("total"), F.min("node").alias("low")).filter("total > 1")
    parts = F.ceil(F.col("total") / (8 * part)).alias("parts")
    ranked = materialise(keyed.join(shared, "key").select("key", "node", "fp", "n", F.col("node").alias("label"), (F.col("node") == F.col("low")).alias("lead"), parts))
    sets = materialise(sets_of(docs, nodes.join(ranked.select("node").distinct(), "node", "left_semi"), doc_col, text_col))
    near = materialise(in_parts(ranked).mapInArrow(lean(near_pivots(similarity)), pair).distinct())
    both = with_sets(with_sets(near, sets, "a", "sa"), sets, "b", "sb")
    links = [materialise(both.filter(similar(F.col("sa"), F.col("sb"), similarity)).select("a", "b", "la", "lb"))]
    pivots, turn = PIVOTS, 0
    while True:
        ranked = materialise(chosen(relabelled(ranked.filter("not lead"), links[-1]), pivots, turn, part))
        if ranked.isEmpty():
            return connected_components(reduce(DataFrame.unionByName, links).select("a", "b"))
        met = in_parts(ranked.join(sets, "node"), "shingles")
        links.append(materialise(met.mapInArrow(lean(true_links(similarity, part * PART_SHINGLES)), pair).distinct()))
        pivots, turn = pivots * GROWTH, turn + 1


def classes(docs: DataFrame, doc_col: str, text_col: str, similarity: float, part: int) -> tuple[DataFrame, DataFrame]:
    """The sketches (doc, t1, t2, w1, w2, ...) of all rows, and (w1, w2, doc, t1, t2, component) of each distinct sequence of words.

    Each sequence is a node with a number of its own, whatever ids hold it; (doc, t1, t2) is the smallest row that does.
    """
    seen = materialise(sketches(docs, doc_col, text_col))
    firsts = [F.first(c).alias(c) for c in ("fp", "n", "keys")]
    words = seen.filter("doc is not null").groupBy("w1", "w2").agg(F.min(F.struct("doc", "t1", "t2")).alias("low"), *firsts)
    nodes = materialise(words.select(F.monotonically_increasing_id().alias("node"), "w1", "w2", "low.*", "fp", "n", "keys"))
    comps = linked(docs, nodes, doc_col, text_col, similarity, part)
    return seen, nodes.join(comps, "node", "left").select("w1", "w2", "doc", "t1", "t2", F.coalesce("component", "node").alias("component"))


def lowest(of_words: DataFrame) -> DataFrame:
    """(component, low): the smallest row (doc, t1, t2) of each component."""
    return of_words.groupBy("component").agg(F.min(F.struct("doc", "t1", "t2")).alias("low"))


def components(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """(doc, component) for each row of ``docs``: component is the smallest id of its group of near copies.

    Words are as in simhash.py; a text of fewer than five words is one shingle, and texts without words are copies
    of each other. Very long texts are compared whole. Rows that repeat stay; different texts of one id are different
    documents. A null id takes no part: its row's component is that of an equal text, else null. Other columns are
    ignored; an empty table gives no rows.
    """
    seen, of_words = classes(docs, doc_col, text_col, similarity, part)
    named = of_words.join(lowest(of_words), "component").select("w1", "w2", F.col("low.doc").alias("component"))
    return seen.select("doc", "w1", "w2").join(named, ["w1", "w2"], "left").select("doc", "component")


def keep_one(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """``docs`` with one row for each group of near copies: one with the smallest id.

    An id may repeat with other texts, which are documents of their own: a survivor is a row's id and text. Of rows that
    repeat both one stays, and of two texts of the smallest id in one group one, by their hashes. Rows with a null id can't
    stand for a group; they all stay. Columns stay as they are, whatever their names. An empty table gives no rows.
    Only the survivors' ids and hashes are shuffled beside the texts, which meet them in one join.
    """
    names = {c: fresh(f"_{c}", docs.columns) for c in ("t1", "t2")}
    survivor = fresh("_survivor", [*docs.columns, *names.values()])
    _, of_words = classes(docs, doc_col, text_col, similarity, part)
    kept = lowest(of_words).select(F.struct("low.*").alias(survivor))
    hashed = docs.select("*", *[c.alias(name) for c, name in zip(text_hashes(text_col), names.values(), strict=True)])
    same = [F.col(doc_col).cast("long") == F.col(f"{survivor}.doc"), *[F.col(name) == F.col(f"{survivor}.{c}") for c, name in names.items()]]
    named = hashed.join(kept, reduce(Column.__and__, same), "left_semi").dropDuplicates([doc_col, *names.values()])
    return named.drop(*names.values()).unionByName(docs.filter(F.col(doc_col).isNull()))
