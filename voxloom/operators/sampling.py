"""Samples, splits, labels and batches per speaker, repeatable on any engine: order is md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sample_key
from ..session import materialised

#: Least row count of a tier and the sample it gets, largest first.
TIERS = ((10_000, 1000), (1000, 150), (200, 50))


def ordered(rows: DataFrame, by: str, key: str, seed: int, name: str = "turn") -> DataFrame:
    """``rows`` numbered from 1 within ``by`` in pseudo-random order.

    A group of a third of all rows isn't sorted by one task: rows are counted per group and leading three digits of
    their random key, and numbered within those parts from where the part begins.
    """
    keyed = rows.withColumn("_k", sample_key(seed, F.col(key))).withColumn("_b", F.substring("_k", 1, 3))
    sizes = keyed.groupBy(F.col(by).alias("_g"), F.col("_b").alias("_p")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    begins = sizes.select("_g", "_p", F.coalesce(before, F.lit(0)).alias("_begin"))
    within = F.row_number().over(W.partitionBy(by, "_b").orderBy("_k", key))
    placed = keyed.withColumn("_row", within).join(begins, keyed[by].eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_p")))
    return placed.withColumn(name, F.col("_begin") + F.col("_row")).drop("_k", "_b", "_g", "_p", "_begin", "_row")


def apart(rows: DataFrame) -> str:
    """A beginning of names that no column of ``rows`` has."""
    p = "_"
    while any(c.startswith(p) for c in rows.columns):
        p += "_"
    return p


def placed(rows: DataFrame, keys: list[Column], p: str) -> DataFrame:
    """``rows`` written in the order of ``keys``, with the range partition (part) and the place in it (row) of each, names after ``p``.

    Ranges come from a sample of the keys, so partitions are even whatever the keys are; only rows of equal keys share one.
    """
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = materialised(ranged.withColumn(f"{p}at", F.monotonically_increasing_id()))
    return kept.withColumn(f"{p}part", F.shiftright(f"{p}at", 33)).withColumn(f"{p}row", F.col(f"{p}at").bitwiseAND((1 << 33) - 1)).drop(f"{p}at")


def before_parts(sizes: DataFrame, p: str = "_") -> DataFrame:
    """(part, begin): the sum of ``n`` over the parts before each, of rows (part, n): as many as there are partitions."""
    total, out = 0, []
    for part, n in sorted(map(tuple, sizes.collect())):
        out.append((part, total))
        total += n
    return F.broadcast(sizes.sparkSession.createDataFrame(out, f"{p}part long, {p}begin long"))


def numbered(rows: DataFrame, order: list[Column], by: str | None = None, name: str = "number") -> DataFrame:
    """``rows`` numbered from 1 in the order of any columns, within ``by`` if given; other columns stay.

    Two passes: rows are range-partitioned by group and order and sorted there, and a number is the row's place in its
    partition plus the rows of its group in the partitions before. So neither a large group nor the whole table is sorted by one
    task; what meets is one count for each group and partition that holds some of it. Keys may be of any type and size, have
    gaps, be null and repeat (equal rows in any order). Each run writes the rows once, in the session's shared folder.
    """
    p = apart(rows)
    part, row, begin = f"{p}part", f"{p}row", f"{p}begin"
    if by is None:
        done = placed(rows, order, p)
        joined = done.join(before_parts(done.groupBy(part).agg(F.count("*").alias("n")), p), part)
    else:
        done, group, there = placed(rows, [F.col(by).asc(), *order], p), f"{p}group", f"{p}there"
        sizes = done.groupBy(F.col(by).alias(group), F.col(part).alias(there)).agg(F.count("*").alias("n"), F.min(row).alias("first"))
        before = F.sum("n").over(W.partitionBy(group).orderBy(there).rowsBetween(W.unboundedPreceding, -1))
        begins = sizes.select(group, there, (F.coalesce(before, F.lit(0)) - F.col("first")).alias(begin))
        joined = done.join(begins, F.col(by).eqNullSafe(F.col(group)) & (F.col(part) == F.col(there))).drop(group, there)
    return joined.withColumn(name, F.col(begin) + F.col(row) + 1).drop(part, row, begin)


def running_total(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of a whole-number column up to and with each row, in the order of ``order``: in parts, as ``numbered``."""
    p = apart(rows)
    done = placed(rows, order, p)
    begins = before_parts(done.groupBy(f"{p}part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("n")), p)
    within = F.sum(value).over(W.partitionBy(f"{p}part").orderBy(f"{p}row").rowsBetween(W.unboundedPreceding, 0))
    return done.join(begins, f"{p}part").withColumn(name, F.col(f"{p}begin") + F.coalesce(within, F.lit(0))).drop(f"{p}part", f"{p}row", f"{p}begin")


def sample(rows: DataFrame, by: str, key: str, n: int | Column, seed: int = 42) -> DataFrame:
    """``n`` rows of each group; with a fixed number Spark thins the groups before the shuffle."""
    if isinstance(n, int):
        turn = F.row_number().over(W.partitionBy(by).orderBy("_k", key))
        return rows.withColumn("_k", sample_key(seed, F.col(key))).withColumn("_turn", turn).filter(F.col("_turn") <= n).drop("_k", "_turn")
    return ordered(rows, by, key, seed).filter(F.col("turn") <= n).drop("turn")


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, rank): groups by descending count, ties by name; numbered in parts, however many groups there are."""
    return numbered(counts(rows, by), [F.desc("n"), F.asc(by)], name="rank")


def tier_size(n: Column) -> Column:
    """Sample size by row count; null below the smallest tier."""
    out = F.when(n >= TIERS[0][0], TIERS[0][1])
    for least, size in TIERS[1:]:
        out = out.when(n >= least, size)
    return out


def labels(groups: DataFrame, order: list[Column]) -> DataFrame:
    """Dense labels from 0 for a roster of groups."""
    return numbered(groups, order, name="label").withColumn("label", (F.col("label") - 1).cast("int"))


def split_groups(groups: DataFrame, order: list[Column], ratio: float) -> DataFrame:
    """The first floor(ratio * groups) groups are train, the others val: whole groups by rank."""
    ranks = numbered(groups, order, name="_rank")
    cut = groups.agg(F.floor(F.count("*") * ratio).alias("_cut"))
    return ranks.crossJoin(F.broadcast(cut)).withColumn("split", F.when(F.col("_rank") <= F.col("_cut"), "train").otherwise("val")).drop("_rank", "_cut")


def split_within(rows: DataFrame, by: str, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """max(1, floor(ratio * n)) rows of each group are train, the others val."""
    sizes = counts(rows, by).select(F.col(by).alias("_g"), F.col("n").alias("_n"))
    turned = ordered(rows, by, key, seed)
    turned = turned.join(sizes, turned[by].eqNullSafe(F.col("_g"))).drop("_g")
    return turned.withColumn("split", F.when(F.col("turn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)), "train").otherwise("val")).drop("_n", "turn")


def split_all(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """floor(ratio * all) rows are train, whatever their group: one group of all rows, numbered in parts."""
    turned = ordered(rows.withColumn("_all", F.lit(1)), "_all", key, seed)
    total = rows.agg(F.floor(F.count("*") * ratio).alias("_cut"))
    return turned.crossJoin(F.broadcast(total)).withColumn("split", F.when(F.col("turn") <= F.col("_cut"), "train").otherwise("val")).drop("_all", "_cut", "turn")


def split_fixed(rows: DataFrame, by: str, key: str, train: int, val: int, seed: int = 42) -> DataFrame:
    """The first ``train`` rows of each group, then ``val`` rows; the rest is left out."""
    return ordered(rows, by, key, seed).filter(F.col("turn") <= train + val).withColumn("split", F.when(F.col("turn") <= train, "train").otherwise("val")).drop("turn")


def pk_batches(rows: DataFrame, by: str, key: str, p: int, k: int, seed: int = 42) -> DataFrame:
    """(batch, group, item, key): groups shuffled, ``p`` per batch (an incomplete last batch is left out), ``k`` items each, cycling."""
    sizes = materialised(counts(rows, by))
    groups = numbered(sizes, [sample_key(seed, F.col(by)), F.asc(by)], name="_r").withColumn("_r", F.col("_r") - 1)
    whole = groups.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("_all")))).filter(F.col("_r") < F.floor(F.col("_all") / p) * p)
    wanted = whole.select(by, F.floor(F.col("_r") / p).alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("item"), "n")
    turned = ordered(rows, by, key, seed).select(by, F.col(key), F.col("turn"))
    return wanted.withColumn("turn", (F.pmod("item", "n") + 1)).join(turned, [by, "turn"]).select("batch", by, "item", key)


def triplets(rows: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, anchor, positive, negative): uniform group, two of its rows, and a row of another group, by hashing the draw."""
    turned = ordered(rows, by, key, seed).select(F.col(by).alias("g"), F.col(key).alias("k"), "turn")
    groups = materialised(numbered(counts(rows, by).filter("n >= 2"), [F.asc(by)], name="at").select(F.col(by).alias("g"), "n", (F.col("at") - 1).alias("at")))
    pick = lambda salt, m: F.pmod(F.xxhash64("draw", F.lit(salt), F.lit(seed)), m)
    total = groups.agg(F.count("*").alias("total"))
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).filter("total > 1")
    draws = draws.withColumn("at", pick(1, F.col("total"))).withColumn("other", F.pmod(F.col("at") + 1 + pick(2, F.col("total") - 1), F.col("total")))
    own = groups.select("at", F.col("g").alias("own"), F.col("n").alias("own_n"))
    away = groups.select(F.col("at").alias("other"), F.col("g").alias("away"), F.col("n").alias("away_n"))
    drawn = draws.join(own, "at").join(away, "other")
    drawn = drawn.withColumn("a", pick(3, F.col("own_n")) + 1).withColumn("p", F.pmod(F.col("a") + pick(4, F.col("own_n") - 1), F.col("own_n")) + 1).withColumn("m", pick(5, F.col("away_n")) + 1)
    for col, group, name in (("a", "own", "anchor"), ("p", "own", "positive"), ("m", "away", "negative")):
        drawn = drawn.join(turned.select(F.col("g").alias(group), F.col("turn").cast("long").alias(col), F.col("k").alias(name)), [group, col])
    return drawn.select("draw", "anchor", "positive", "negative")
