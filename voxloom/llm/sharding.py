"""Sharding by Karmarkar-Karp differencing.

A partial partition is a tuple of k slot sums. Differencing repeatedly takes the two partial partitions with
the largest spread and joins them oppositely ordered: the largest slot of one with the smallest of the other.
Groups of documents with equal texts are indivisible items.

1. Group sizes are a partial aggregate over 128-bit text hashes, so a group of very many copies is one row.
2. Groups above the mean shard size take a shard each (there are fewer than shards), and the mean of the rest
   is taken anew: nothing smaller could balance them.
3. Groups are dealt to buckets of a few thousand by hash. Differencing makes ``BUNDLES`` near-equal bundles of
   each bucket, in one task per bucket; buckets are joined pairwise oppositely ordered, ``FAN_IN`` at a time, until
   few are left. Groups larger than a share of a shard stay items of their own.
4. Differencing deals those bundles and large groups, a number bounded by parameters, to the shards.
5. Documents get a gapless slot by counts per (shard, part) and a row number within the part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

SHARDS = 40
ROW_BYTES = 16
#: Groups in a bucket (expected), bundles a bucket becomes, buckets joined at a time, items of the last step at most.
BUCKET, BUNDLES, FAN_IN, LAST = 2000, 64, 64, 20_000
#: A group over 1/LARGE of a shard is an item of the last step; there are at most SHARDS * LARGE of them.
LARGE = 200


def difference(tuples: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Join k-slot tuples into one. Returns the joined sums (descending) and, for each input and slot, the joined slot.

    Inputs are arrays of k sums in any order; a single item is [size, 0, 0, ...].
    """
    n = len(tuples)
    order = [np.argsort(-t, kind="stable") for t in tuples]
    sums = [t[o] for t, o in zip(tuples, order, strict=True)]
    heap = [(-float(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    children: list[tuple[int, int, np.ndarray]] = []  # node n + j: its two children and the sorting of their joined slots
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sums[a] + sums[b][::-1]
        sort = np.argsort(-joined, kind="stable")
        sums[a], sums[b] = None, None
        sums.append(joined[sort])
        children.append((a, b, sort))
        heapq.heappush(heap, (-float(joined[sort[0]] - joined[sort[-1]]), len(sums) - 1))
    place: list = [None] * len(sums)
    place[-1] = np.arange(k)
    for j in range(len(children) - 1, -1, -1):
        a, b, sort = children[j]
        mine = np.empty(k, np.int64)
        mine[sort] = place[n + j]  # joined slot before sorting -> final slot
        place[a], place[b] = mine, mine[::-1]
        place[n + j] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = place[i]
    return sums[-1], out


def deal(sizes: np.ndarray, k: int) -> np.ndarray:
    """The slot of each item when differencing deals items to k slots."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    rows = np.zeros((len(sizes), k), np.int64)
    rows[:, 0] = sizes
    return difference(list(rows), k)[1][:, 0]


def group_sizes(docs: DataFrame, text_col: str) -> list:
    """Columns of a document's size and of its group: equal texts; null texts are grouped with empty ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [(F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2")]


def assign(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET, bundles: int = BUNDLES, fan_in: int = FAN_IN, last: int = LAST) -> DataFrame:
    """(g1, g2, shard) of groups (g1, g2, bytes)."""
    spark = groups.sparkSession
    stats = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")).first()
    n, total = stats["n"], stats["total"]
    # groups above the mean take shards of their own; the mean of the others then falls, so look again
    giants, free = [], shards
    for r in groups.orderBy(F.desc("bytes"), "g1", "g2").limit(shards).collect():
        if free > 1 and r["bytes"] * free > total:
            giants.append((r["g1"], r["g2"], shards - free))
            total, free = total - r["bytes"], free - 1
        else:
            break
    base = shards - free
    fixed = spark.createDataFrame(giants, "g1 long, g2 long, shard int")
    rest = groups.join(F.broadcast(fixed.select("g1", "g2")), ["g1", "g2"], "left_anti") if giants else groups
    bar = max(1, total // max(1, free * LARGE))
    large = rest.filter(F.col("bytes") > bar)
    small = rest.filter(F.col("bytes") <= bar).withColumn("bucket", F.pmod(F.xxhash64("g2", "g1"), F.lit(max(1, -(-n // bucket)))))

    def bundle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g1", "g2"])
        return pd.DataFrame({"g1": pdf["g1"], "g2": pdf["g2"], "bytes": pdf["bytes"], "bucket": key[0], "slot": deal(pdf["bytes"].to_numpy(), bundles)})

    dealt = materialise(small.select("g1", "g2", "bytes", "bucket").groupBy("bucket").applyInPandas(bundle, "g1 long, g2 long, bytes long, bucket long, slot long"))
    # the bundles of a bucket are (node, slot, bytes); levels of joining map them to those of fewer nodes
    level = dealt.groupBy(F.col("bucket").alias("node"), "slot").agg(F.sum("bytes").alias("bytes"))
    place = dealt.select("g1", "g2", F.col("bucket").alias("node"), "slot")
    nodes = max(1, -(-n // bucket))

    def join_nodes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf["node"].to_numpy())
        sums = np.zeros((len(names), bundles), np.int64)
        sums[np.searchsorted(names, pdf["node"]), pdf["slot"]] = pdf["bytes"]
        _, to = difference(list(sums), bundles)
        return pd.DataFrame({"node": np.repeat(names, bundles), "slot": np.tile(np.arange(bundles), len(names)), "up": key[0], "up_slot": to.ravel(), "bytes": sums.ravel()})

    while nodes * bundles > last:
        nodes = -(-nodes // fan_in)
        up = level.groupBy(F.pmod(F.xxhash64("node"), F.lit(nodes)).alias("up")).applyInPandas(join_nodes, "node long, slot long, up long, up_slot long, bytes long")
        up = materialise(up)
        place = place.join(up.select("node", "slot", "up", "up_slot"), ["node", "slot"]).select("g1", "g2", F.col("up").alias("node"), F.col("up_slot").alias("slot"))
        level = up.groupBy(F.col("up").alias("node"), F.col("up_slot").alias("slot")).agg(F.sum("bytes").alias("bytes"))
    items = level.select(F.lit(False).alias("is_group"), F.col("node").alias("a"), F.col("slot").alias("b"), "bytes").unionByName(large.select(F.lit(True).alias("is_group"), F.col("g1").alias("a"), F.col("g2").alias("b"), "bytes"))

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_items = pd.concat(list(batches) or [pd.DataFrame({"is_group": [], "a": [], "b": [], "bytes": []})])
        all_items = all_items.sort_values(["is_group", "a", "b"])
        shard = deal(all_items["bytes"].to_numpy(np.int64), free) + base
        yield pd.DataFrame({"is_group": all_items["is_group"].astype(bool), "a": all_items["a"].astype(np.int64), "b": all_items["b"].astype(np.int64), "shard": shard.astype(np.int32)})

    # at most last + shards * LARGE items: bounded by parameters, whatever the number of documents
    # a shuffle to one task, so that the scan of all groups above it stays spread
    settled = materialise(items.repartition(1).mapInPandas(final, "is_group boolean, a long, b long, shard int"))
    bundled = place.join(F.broadcast(settled.filter("not is_group").select(F.col("a").alias("node"), F.col("b").alias("slot"), "shard")), ["node", "slot"]).select("g1", "g2", "shard")
    alone = settled.filter("is_group").select(F.col("a").alias("g1"), F.col("b").alias("g2"), "shard")
    return bundled.unionByName(alone).unionByName(fixed)


def sharded(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, **parameters: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    The law is "bytes": shards of nearly equal bytes, where documents with equal texts share a shard. A null text
    counts as empty, a null id is an id like any other, a very long text is one item that may fill a shard by itself. Rows
    that repeat stay, each with a slot of its own; other columns are ignored; an empty table gives no rows. ``parameters`` are those of ``assign``.
    """
    lean = materialise(docs.select(F.col(doc_col).cast("long").alias("doc_id"), *group_sizes(docs, text_col)))
    groups = materialise(lean.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")))
    placed = lean.join(assign(groups, shards, **parameters), ["g1", "g2"])
    parts = max(64, shuffle_partitions(docs.sparkSession))
    keyed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(parts)).alias("part")))
    sizes = keyed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    begins = sizes.select("shard", "part", F.coalesce(before, F.lit(0)).alias("begin"))
    row = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32"))
    numbered = keyed.withColumn("row", row).join(F.broadcast(begins), ["shard", "part"])  # shards * parts rows at most
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
