"""Vector codes against exact integers and SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import common, queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def by_hand(rows, parts, entries, rounds):
    """(rows with code and error, codebooks) by Python integers; rows are (id, vector)."""
    vectors = [[math.floor(vector_codes.SCALE * x) for x in v] for _, v in rows]
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    first = sorted({i for i, _ in rows if i is not None})[:entries]
    starts = [min(v for (i, _), v in zip(rows, vectors, strict=True) if i == f) for f in first]
    books = [[s[p * width : (p + 1) * width] for s in starts] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(b)), key=lambda k: (dist(c[p], b[k]), k)) for p, b in enumerate(books)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for k in range(len(first)):
                own = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(dist(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes, strict=True)]
    return ["".join(f"{k:02x}" for k in code) for code in codes], errors


@pytest.mark.parametrize("size", [1, 3, 100, 10**6, 2**27])
def test_nearest_is_exact(size):
    rng = np.random.default_rng(size)
    for width in (1, 2, 8, 33):
        x, c = rng.integers(-size, size + 1, (400, width)), rng.integers(-size, size + 1, (17, width))
        c[9], c[3] = c[2], x[0]
        exact = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert vector_codes.nearest(x, c).tolist() == [min(range(17), key=lambda k, r=r: (r[k], k)) for r in exact]


def test_close_entries_need_the_second_look():
    # distances differ by one part in 10^12, which float32 can't tell
    x = np.full((3, 8), 2**20) + np.array([[0], [1], [2]])
    c = np.stack([x[2] + 1, x[1], x[0] - 1, x[1]])
    assert vector_codes.nearest(x, c).tolist() == [1, 1, 0]
    assert vector_codes.nearest(x, np.full((5, 8), 2**20)).tolist() == [0, 0, 0]


def test_query_equals_sql(spark, sf_dir):
    got = queries.op11_vector_codes(spark, sf_dir).toPandas().sort_values("vec_id", ignore_index=True)
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = duck.execute(vector_codes.ORACLE_SQL).fetchdf().sort_values("vec_id", ignore_index=True)
    assert len(got) and got.equals(want[got.columns])


def test_awkward_rows_against_integers(spark):
    rng = np.random.default_rng(5)
    good = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 1, 8)]) for i in rng.permutation(40)]
    good += [good[3], good[3], (good[4][0], good[5][1]), (None, good[6][1]), (None, [0.5] * 8), (90, [0.0] * 8), (91, [-0.0] * 8), (92, [-1e-9] * 8)]
    labels = [None if k % 7 == 0 else k % 3 for k in range(len(good))]
    bad = [(-1, None), (-2, [None] + [0.0] * 7), (-3, [float("nan")] + [0.0] * 7), (-4, [float("-inf")] * 8), (500, []), (501, [1.0] * 16)]
    rows = [(i, v, g, "x", "y") for (i, v), g in zip(good, labels, strict=True)] + [(i, v, 1, "x", "y") for i, v in bad]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = vector_codes.compressed(df, parts=4, entries=7, rounds=3).collect()
    codes, errors = by_hand(good, 4, 7, 3)
    of_label = {g: sum(e for e, h in zip(errors, labels, strict=True) if h == g) for g in set(labels)}
    want = sorted(str((i, c, e, of_label[g])) for (i, _), c, e, g in zip(good, codes, errors, labels, strict=True))
    assert sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"])) for r in got) == want
    assert len({r["codebooks_sha256"] for r in got}) == 1


def test_empty_tables_and_bad_shapes(spark):
    assert vector_codes.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    nameless = spark.createDataFrame([(None, [1.0] * 8, 1, "x", "y")], SCHEMA)
    assert vector_codes.compressed(nameless).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(spark.createDataFrame([(1, [1.0] * 6, 1, "x", "y")], SCHEMA))


def test_codes_give_back_vectors_with_the_stated_error(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vector_codes.fit(df, rounds=2)
    got = vector_codes.encoded(df, books).toPandas()
    codes = np.array([list(bytes.fromhex(c)) for c in got["code"]])
    x = np.floor(vector_codes.SCALE * np.array(df.toPandas().set_index("vec_id")["embedding"].loc[got["vec_id"]].tolist(), np.float64)).astype(np.int64)
    assert (((x - books.decoded(codes)) ** 2).sum(axis=1) == got["error"]).all()
    rough = vector_codes.encoded(df, vector_codes.fit(df, rounds=0)).agg(F.sum("error")).first()[0]
    assert got["error"].sum() < rough


def test_spread_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, i) for i in range(3000)], "k long, i long")
    right = left.groupBy("k").agg(F.sum("i").alias("s"), F.count("*").alias("n"))
    got = {(r["k"], r["i"], r["s"]) for r in common.spread_join(left, right, "k", "n").collect()}
    sums = {r["k"]: r["s"] for r in right.collect()}
    assert got == {(r["k"], r["i"], sums[r["k"]]) for r in left.collect()} and len(got) == 3000
    assert common.spread_join(left.limit(0), right.limit(0), "k", "n").count() == 0
