"""Helpers shared by the training-data operators: tables, materialised stages, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, stage_folder

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters, x20 and x09 to x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``: the fold that decides held-out rows."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string")) % modulus


class Stage:
    """A materialised intermediate result: Parquet in the shared checkpoint folder.

    It cuts lineage and survives lost executors, as every executor can read the folder. Within ``own_stages`` it goes with
    those, unless a ``folder`` outside is given.
    """

    def __init__(self, df: DataFrame, folder: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{folder or stage_folder(self.spark)}/stage-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    return Stage(df).df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of each node of an undirected graph, as (node, component): component is its smallest node.

    ``edges`` has columns a and b (long); rows with a = b or a null are dropped. Alternates the
    large-star and small-star steps of Kiveris et al. ("Connected Components in MapReduce and
    Beyond"), which keep the number of edges from growing and need O(log^2 n) rounds. Minima are
    partial aggregates and joins are plain equi-joins, so a node with very many links is handled by
    map-side combining and by adaptive skew-join splitting. Nodes without a link are not returned.
    """

    def signature(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return row["n"], row["x"]

    def with_min(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        return pairs.join(low, "u")

    stage = Stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = signature(stage.df)
    while True:
        e = stage.df
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = with_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        starred = Stage(large)
        near = with_min(starred.df)
        small = near.select(F.col("v").alias("a"), F.col("low").alias("b")).union(near.select(F.col("u").alias("a"), F.col("low").alias("b"))).filter("a <> b").distinct()
        nxt = Stage(small)
        starred.drop()
        stage.drop()
        stage = nxt
        after = signature(stage.df)
        if after == before:
            break
        before = after
    stars = stage.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stage.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, share: int = 1000) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each key of ``left`` (null too) and, in ``rows``, its number there.

    A key of more than one in ``share`` of all rows is hot. There are fewer than ``share`` of them at any size, so their rows
    of ``right`` are broadcast, and no task of the join that remains meets a hot key. Both sides are read twice.
    """
    right = materialise(right)
    total = right.agg(F.sum(rows)).first()[0] or 0
    other, number = fresh("_key", [*left.columns, *right.columns]), F.col(rows) * share
    named = right.withColumnRenamed(key, other)
    hot, same = F.broadcast(named.filter(number > total)), F.col(key).eqNullSafe(F.col(other))
    busy = left.join(hot, same).drop(other, rows)
    rest = left.join(hot.select(other), same, "left_anti").join(named.filter(number <= total), same).drop(other, rows)
    return busy.unionByName(rest)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of ``taken`` has, ignoring case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def windows(batches: Iterator[pa.RecordBatch], limit: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of text in ``column``; a longer text is a slice by itself."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and what it freed goes back to the system when its task ends: later stages use the same Python workers."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return trimmed


def strings(column: pa.Array) -> np.ndarray:
    """A column of strings as Python objects (null: None), faster than to_pylist."""
    return column.to_numpy(zero_copy_only=False)
