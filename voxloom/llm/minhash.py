"""Near copies by b-bit MinHash: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. One pass over the texts gives each shingle set's 128-bit name, its size, ``BANDS`` keys of a few minima each, and a
   signature: the low ``BITS`` bits of all ``HASHES`` minima, packed as planes of longs. A pair at 0.8 shares one of
   25 keys of four minima with a chance of 0.999998. Equal sets become one node, by a partial aggregate.
2. Stars: the smallest node of each key meets the key's others. The share of equal signature entries, corrected for those
   that low bits make equal by chance, estimates the similarity; pairs within ``SLACK`` deviations of the limit stay.
   That is a count of bits in the JVM, and its connected components are provisional.
3. Keys whose nodes are of several such components are compared in blocks of signatures, which yields the pairs that join
   components: at most one a node and block. Then every pair of nodes that may be alike lies in one component.
4. Shingle sets go to the components, once a node and part. Blocks compare signatures again and confirm links on full sets.
   A component of more than ``PART`` nodes meets a few of its own first (``PIVOTS``), so that most of it has one
   label; blocks then compare only nodes of different labels.
5. Connected components of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, lean, materialise, spread_join, windows
from .simhash import _LOWER

WIDTH, PERCENT = 2, 80
BANDS, MISSED = 25, 1e-5
#: Minima of a signature, and the low bits kept of each: PLANES longs for each bit.
HASHES, BITS = 256, 2
PLANES = HASHES // 64
#: Standard deviations by which an estimate may lie below the limit.
SLACK = 5
#: Nodes of a block, shingles for each of them that a task may hold, and first nodes that a large component meets.
PART, PART_SHINGLES, PIVOTS = 1024, 2048, 16
#: Bytes of text sketched at a time, and distinct words whose hash a task remembers.
WINDOW_BYTES, WORDS = 1 << 21, 1 << 19
SIGNATURE = [f"s{i}" for i in range(PLANES * BITS)]
_RANDOM = np.random.default_rng(13)
_FACTORS = _RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """The 64-bit hash of each word, remembered for frequent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers scrambled one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """The hashes of a text's words, in order, a window of bytes at a time."""
    data, at, out = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER), 0, [np.zeros(0, np.uint64)]
    while at < len(data):
        ends = [x for x in (data.find(c, at + WINDOW_BYTES) for c in (b" ", b"\n")) if x >= 0] if len(data) - at > WINDOW_BYTES else []
        end = min(ends, default=len(data))
        words = data[at:end].split()
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, known: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as ascending hashes; fewer words are one shingle, none are none."""
    words = word_hashes(text, known)
    if not len(words):
        return words
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = mixed(h * _ODD + words[i : len(words) - width + 1 + i])
    return np.unique(h)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each of ``HASHES`` permutations of a set's hashes."""
    low, short = np.full(HASHES, 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        low = np.minimum(low, (short[None, at : at + 1024] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return low


def band_rows(percent: int) -> int:
    """How many minima a key may have so that a pair at ``percent`` shares none with a chance of at most ``MISSED``."""
    each = 1 - MISSED ** (1 / BANDS)
    return max(1, min(HASHES // BANDS, int(np.log(each) / np.log(min(percent, 99) / 100))))


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(low[i * rows : (i + 1) * rows].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def signature(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima as planes of longs; minima are scrambled first, as their own low bits hang together."""
    bits = mixed(low.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))
    return np.concatenate([np.packbits(((bits >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64) for b in range(BITS)])


def least_equal(percent: int) -> int:
    """How many of ``HASHES`` entries must be equal for a pair to be compared in full."""
    p = 2.0**-BITS + (1 - 2.0**-BITS) * percent / 100
    return int(np.floor(HASHES * p - SLACK * (HASHES * p * (1 - p)) ** 0.5))


def estimate(equal):
    """The similarity that a number of equal entries stands for, corrected for low bits that are equal by chance."""
    return (equal / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)


def equal_entries(a: str, b: str) -> Column:
    """The number of equal entries of the signatures in columns named after ``a`` and ``b``, by counts of bits."""
    differ = [reduce(Column.bitwiseOR, [F.col(f"{a}{p + PLANES * k}").bitwiseXOR(F.col(f"{b}{p + PLANES * k}")) for k in range(BITS)]) for p in range(PLANES)]
    return F.lit(HASHES) - reduce(lambda x, y: x + y, [F.bit_count(d) for d in differ])


def sketches(docs: DataFrame, doc_col: str, text_col: str, width: int, rows: int) -> DataFrame:
    """(doc, name, n, keys, text_hash, s0, ...) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in windows(batches, WINDOW_BYTES):
            names, n, keys, signs = [], np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, BANDS), np.int64), np.zeros((b.num_rows, len(SIGNATURE)), np.int64)
            for i, t in enumerate(b.column(1)):
                s = shingle_set(t.as_py(), known, width)
                low = minima(s)
                names.append(xxhash.xxh128_digest(s.tobytes(), 1))
                n[i], keys[i], signs[i] = len(s), band_keys(low, rows), signature(low)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            columns = [b.column(0), pa.array(names, pa.binary()), pa.array(n), lists, b.column(2), *(pa.array(c) for c in signs.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "name", "n", "keys", "text_hash", *SIGNATURE])

    kept = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return kept.mapInArrow(lean(run), f"doc long, name binary, n long, keys array<long>, text_hash long, {', '.join(f'{c} long' for c in SIGNATURE)}")


def stars(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, node) of keys that several nodes share, and candidate pairs (a, b) of each key's smallest node."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("total"), F.min("node").alias("low")).filter("total > 1")
    members = materialise(spread_join(keyed, shared, "key", "total"))
    pairs = materialise(members.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    low = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), *[F.col(c).alias(f"a_{c}") for c in SIGNATURE])
    uses = pairs.groupBy("a").agg(F.count("*").alias("uses")).join(low, "a")
    own = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias(f"b_{c}") for c in SIGNATURE])
    both = spread_join(pairs, uses, "a", "uses").join(own, "b")
    near = (equal_entries("a_s", "b_s") >= least_equal(percent)) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return members.select("key", "node"), materialise(both.filter(near).select("a", "b"))


def labelled(pairs: DataFrame) -> DataFrame:
    """(node, label) of nodes that have links: their component."""
    return materialise(connected_components(pairs).select("node", F.col("component").alias("label")))


def in_blocks(members: DataFrame, part: int, weight: Column, columns: list[str], lead: Column | None = None) -> DataFrame:
    """Members (group, node, label, n, ...) in blocks (group, x, y), sorted, that hold each pair of a leader and another member.

    A block has one part of a group's leaders and one part of all members; parts are bounded in nodes and in shingles
    (``weight``). A small group is one block, in which a row is both. Without ``lead`` all but the members of the largest
    label lead, and groups of one label are left out.
    """
    members = members.withColumn("weight", weight).withColumn("lead", F.lit(None).cast("boolean") if lead is None else lead)
    sums = [F.sum(c).alias(c) for c in ("rows", "weight")]
    of_label = members.groupBy("group", "label").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"), F.count_if("lead").alias("leads"), F.sum(F.when(F.col("lead"), F.col("weight"))).alias("held"))
    of_group = of_label.groupBy("group").agg(F.count("*").alias("labels"), *sums, F.sum("leads").alias("leads"), F.sum("held").alias("held"), F.max(F.struct("rows", "weight", "label")).alias("main"))
    if lead is None:
        of_group = of_group.filter("labels > 1").withColumn("leads", F.col("rows") - F.col("main.rows")).withColumn("held", F.col("weight") - F.col("main.weight"))
    parts = lambda rows, size: F.greatest(F.lit(1), F.ceil(F.col(rows) / part), F.ceil(F.col(size) / (part * PART_SHINGLES))).cast("int")
    cut = of_group.filter("leads > 0").select("group", "rows", F.col("main.label").alias("main"), parts("leads", "held").alias("xs"), parts("rows", "weight").alias("ys"))
    dealt = spread_join(members, cut, "group", "rows").withColumn("lead", F.coalesce("lead", F.col("label") != F.col("main")))
    kept, one = [F.col(c) for c in ("node", "label", "n", *columns)], (F.col("xs") == 1) & (F.col("ys") == 1)
    at = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    both = dealt.filter(one).select("group", F.lit(0).alias("x"), F.lit(0).alias("y"), "lead", F.lit(True).alias("member"), *kept)
    leads = dealt.filter(~one & F.col("lead")).select("group", at("xs").alias("x"), every("ys").alias("y"), "lead", F.lit(False).alias("member"), *kept)
    # of two leaders the one with the smaller node leads: as a member a leader keeps its flag in ``leads``
    rest = dealt.filter(~one).select("group", every("xs").alias("x"), at("ys").alias("y"), F.col("lead"), F.lit(True).alias("member"), *kept)
    return both.unionByName(leads).unionByName(rest).repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "node")


def whole_blocks(batches: Iterator[pa.RecordBatch], held_bytes: int = 1 << 24) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole blocks, of about ``held_bytes`` (more where one block has more)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.nbytes for x in held) >= held_bytes:
            t = pa.Table.from_batches(held)
            keys = [t.column(c).to_numpy() for c in ("group", "x", "y")]
            other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            if len(other):
                yield t.slice(0, int(other[-1]) + 1)
                held = t.slice(int(other[-1]) + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two ascending arrays of distinct numbers."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def joining(percent: int, full: bool):
    """Blocks to pairs (a, b, la, lb) of different labels that are alike, each joining two labels that the block had not joined.

    Pairs are alike by their signatures, and with ``full`` by their shingle sets, exactly.
    """
    least = least_equal(percent)

    def block(t: pa.Table) -> list[tuple[int, int, int, int]]:
        node, label, n, lead, member = (t.column(c).to_numpy() for c in ("node", "label", "n", "lead", "member"))
        signs = np.stack([t.column(c).to_numpy() for c in SIGNATURE]).view(np.uint64)
        sets = t.column("shingles").combine_chunks() if full else None
        set_at = lambda i: sets[int(i)].values.to_numpy().view(np.uint64)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        out, tops, others = [], label.copy(), np.flatnonzero(member)
        # a block of parts has rows of its own for leaders, and members that lead elsewhere
        for i in np.flatnonzero(lead & (member if member.all() else ~member)):
            size = n[others]
            fit = (tops[others] != tops[i]) & (~lead[others] | (node[others] > node[i]))
            fit &= 100 * np.minimum(size, n[i]) >= percent * np.maximum(size, n[i])
            near = others[fit]
            if not len(near):
                continue
            differ = signs[:, near] ^ signs[:, i : i + 1]
            differ = reduce(np.bitwise_or, [differ[PLANES * k : PLANES * (k + 1)] for k in range(BITS)])
            near = near[HASHES - np.bitwise_count(differ).sum(axis=0, dtype=np.int64) >= least]
            mine = set_at(i) if full and len(near) else None
            for j in near.tolist():
                low, high = sorted((top(int(label[i])), top(int(label[j]))))
                if low == high:
                    continue
                if full:
                    other = set_at(j)
                    shared = shared_count(mine, other)
                    if 100 * shared < percent * (len(mine) + len(other) - shared):
                        continue
                up[high] = low
                tops[tops == high] = low
                out.append((int(node[i]), int(node[j]), int(label[i]), int(label[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches):
            keys = [t.column(c).to_numpy() for c in ("group", "x", "y")]
            starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            found = [p for at, end in zip(starts, np.r_[starts[1:], t.num_rows], strict=True) for p in block(t.slice(int(at), int(end - at)))]
            pairs = np.array(found, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T.copy()], names=["a", "b", "la", "lb"])

    return lean(run)


PAIR = "a long, b long, la long, lb long"


def sets_of(docs: DataFrame, nodes: DataFrame, doc_col: str, text_col: str, width: int) -> DataFrame:
    """``nodes`` (node, doc, text_hash, ...) with their ``shingles``, ascending."""
    kept = [c for c in nodes.columns if c not in ("doc", "text_hash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in windows(batches, WINDOW_BYTES, len(kept)):
            sets = [shingle_set(t.as_py(), known, width).view(np.int64) for t in b.column(len(kept))]
            ends = np.r_[0, np.cumsum([len(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=[*kept, "shingles"])

    texts = docs.select(F.col(doc_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    once = texts.join(nodes, ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash", "node"]).select(*kept, "text")
    return once.mapInArrow(lean(run), nodes.select(*kept).schema.add("shingles", T.ArrayType(T.LongType())))


def links(docs: DataFrame, nodes: DataFrame, doc_col: str, text_col: str, width: int, percent: int, part: int) -> DataFrame:
    """Confirmed links (a, b) whose components are those of all links between ``nodes``."""
    members, near = stars(nodes, percent)
    first = labelled(near)
    held = members.join(first, "node", "left").select(F.col("key").alias("group"), "node", F.coalesce("label", "node").alias("label"))
    signed = materialise(held.join(nodes.select("node", "n", *SIGNATURE), "node"))
    more = in_blocks(signed, part, F.lit(1).cast("long"), SIGNATURE).mapInArrow(joining(percent, False), PAIR).select("a", "b").distinct()
    candidates = labelled(near.union(materialise(more))).withColumnRenamed("label", "group")
    wanted = candidates.join(nodes.select("node", "doc", "text_hash", "n", *SIGNATURE), "node")
    full = materialise(sets_of(docs, wanted, doc_col, text_col, width))
    large = full.groupBy("group").agg(F.count("*").alias("rows")).filter(F.col("rows") > part)
    pivot = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("total")) < PIVOTS
    crowd = spread_join(full, large.withColumn("total", F.col("rows")), "group", "rows").withColumn("label", F.col("node"))
    star = materialise(in_blocks(crowd, part, F.col("n"), ["shingles", *SIGNATURE], pivot).mapInArrow(joining(percent, True), PAIR).select("a", "b"))
    named = full.join(labelled(star), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = in_blocks(named, part, F.col("n"), ["shingles", *SIGNATURE]).mapInArrow(joining(percent, True), PAIR).select("a", "b")
    return star.union(materialise(rest))


def components(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, part: int = PART) -> DataFrame:
    """(doc, n, component) for each row of ``docs``: its number of distinct shingles, and the smallest id reachable by links.

    Words are runs of all but ASCII white space, A-Z lower-cased. Two rows are linked if 100 times the intersection of
    their sets is at least ``percent`` times the union. A text of fewer than ``width`` words is one shingle; a null, empty or
    blank text has none, is linked with nothing and is its own component. Very long texts are read whole. Rows that repeat stay,
    and different texts of one id are different documents. A row with a null id names no component: its own
    is that of an equal set or of its copies, else null. Other columns are ignored; an empty table gives no rows.
    """
    seen = materialise(sketches(docs, doc_col, text_col, width, band_rows(percent)))
    firsts = [F.first(c).alias(c) for c in ("n", "keys", *SIGNATURE)]
    sets = seen.filter("n > 0 and doc is not null").groupBy("name").agg(F.min(F.struct("doc", "text_hash")).alias("low"), *firsts)
    nodes = materialise(sets.select(F.monotonically_increasing_id().alias("node"), "name", "low.doc", "low.text_hash", "n", "keys", *SIGNATURE))
    linked = labelled(links(docs, nodes, doc_col, text_col, width, percent, part))
    lowest = linked.join(nodes.select("node", "doc"), "node").groupBy("label").agg(F.min("doc").alias("component"), F.count("*").alias("rows"))
    of_node = spread_join(linked, lowest, "label", "rows").select("node", "component")
    of_name = nodes.select("node", "name", "doc").join(of_node, "node", "left").select("name", F.coalesce("component", "doc").alias("component"))
    rows = seen.groupBy("name").agg(F.count("*").alias("rows")).join(of_name, "name", "left")
    both = spread_join(seen.select("doc", "name", "n"), rows, "name", "rows")
    return both.select("doc", "n", F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component")).alias("component"))
