"""Numbering, ranks and running totals in parts, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import sampling as S


def numbers(df, *cols):
    return {tuple(r[c] for c in cols): r["number"] for r in df.collect()}


@pytest.fixture(scope="module")
def rows(spark):
    """Random 63-bit keys, half of all rows in one group, more than one range partition each."""
    rng = random.Random(5)
    keys = list({rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)}) + [(1 << 53) + i for i in range(300)] + [(1 << 62) + i for i in range(200)]
    rng.shuffle(keys)
    groups = [rng.choice(["hot", "hot", "hot", *"abc", None, f"g{i % 97}"]) for i, _ in enumerate(keys)]
    return spark.createDataFrame(list(zip(keys, groups, strict=True)), "k long, g string").repartition(6).cache()


def test_numbers_of_random_keys(spark, rows):
    held = [tuple(r) for r in rows.collect()]
    got = numbers(S.numbered(rows, [F.asc("k")]), "k")
    assert got == {(k,): i + 1 for i, k in enumerate(sorted(k for k, _ in held))}
    got = numbers(S.numbered(rows, [F.desc("k")], "g"), "k", "g")
    by = {}
    for k, g in sorted(held, key=lambda x: -x[0]):
        by.setdefault(g, []).append(k)
    assert got == {(k, g): i + 1 for g, ks in by.items() for i, k in enumerate(ks)}


def test_numbers_of_equal_keys_texts_and_no_rows(spark):
    df = spark.createDataFrame([(None, "x"), (2, "b"), (2, "a"), (2, "a"), (1, "z")], "k long, _part string")
    got = S.numbered(df.withColumnRenamed("_part", "t"), [F.asc("k"), F.asc("t")])
    assert sorted((r["number"], r["k"], r["t"]) for r in got.collect()) == [(1, None, "x"), (2, 1, "z"), (3, 2, "a"), (4, 2, "a"), (5, 2, "b")]
    none = S.numbered(df.filter("k > 9"), [F.asc("k")])
    assert none.columns == ["k", "_part", "number"] and none.count() == 0
    assert S.numbered(df.filter("k > 9"), [F.asc("k")], "_part").count() == 0


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_task_meets_all_rows_or_groups(spark, rows):
    groups = S.counts(rows, "g")
    for df in (S.numbered(rows, [F.asc("k")]), S.numbered(rows, [F.asc("k")], "g"), S.ranked(rows, "g"), S.labels(groups, [F.asc("g")]), S.running_total(groups, [F.asc("g")], "n", "past")):
        assert "SinglePartition" not in plan(df)
    # counts of all groups meet as one row
    for df in (S.split_groups(groups, [F.asc("g")], 0.8), S.pk_batches(rows, "g", "k", 4, 3)):
        assert "Window" not in plan(df).split("SinglePartition")[0].split("Physical Plan")[-1] or plan(df).count("SinglePartition") <= 2


def test_ranks_totals_and_batches(spark, rows):
    sizes = {r["g"]: r["n"] for r in S.counts(rows, "g").collect()}
    order = sorted(sizes, key=lambda g: (-sizes[g], g is not None, g or ""))
    assert [r["g"] for r in S.ranked(rows, "g").orderBy("rank").collect()] == order
    past = {r["g"]: r["past"] for r in S.running_total(S.counts(rows, "g"), [F.asc("g")], "n", "past").collect()}
    total = 0
    for g in sorted(sizes, key=lambda g: (g is not None, g or "")):
        total += sizes[g]
        assert past[g] == total
    batches = S.pk_batches(rows.filter("g is not null"), "g", "k", 4, 3).toPandas()
    per = batches.groupby("batch").agg(groups=("g", "nunique"), rows=("k", "size"))
    assert len(per) == (len(sizes) - 1) // 4 and (per["groups"] == 4).all() and (per["rows"] == 12).all()
