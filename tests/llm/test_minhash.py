"""b-bit MinHash against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import minhash, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=2):
    words = (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def by_pairs(rows, width=2, percent=80):
    """(doc, n, component) of each row, by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted(((doc, len(sets[i]), low.get(top(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def found(df, **how):
    return sorted(map(tuple, minhash.components(df, **how).collect()), key=str)


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def families(seed):
    """Copies with few and many edits, chains of edits, short texts, texts that share most of a passage."""
    rng, texts = random.Random(seed), []
    vocabulary = [f"v{i}" for i in range(3000)]
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 200]))
        texts += [edited(base, rng, rng.randrange(0, 1 + len(base) // 8)) for _ in range(12)]
        step = base
        for _ in range(8):
            step = edited(step, rng, max(1, len(step) // 25))
            texts.append(step)
    passage = rng.choices(vocabulary, k=90)
    texts += [passage + rng.choices(vocabulary, k=rng.choice([10, 20, 40])) for _ in range(40)]
    texts += [rng.choices(["a", "b", "C"], k=rng.randrange(0, 5)) for _ in range(40)]
    ids = rng.sample(range(10**6), len(texts))
    return [(i, rng.choice([" ", "\t", "\n "]).join(t)) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("part", [minhash.PART, 7])
def test_equals_all_pairs(spark, part):
    rows = families(part)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, part=part) == by_pairs(rows)


def test_other_widths_and_limits(spark):
    rows = families(3)[:120]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, width=5, percent=60) == by_pairs(rows, 5, 60)


def test_a_large_group_of_copies_and_its_outer_ones(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(edited(base, rng, rng.choice([0, 1, 4, 6, 9, 12])))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df, part=50) == by_pairs(rows)


def test_awkward_rows(spark, awkward, empty):
    assert found(awkward) == by_pairs([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert minhash.components(empty).count() == 0
    same = "one two three four five six"
    rows = [(7, same), (3, same.upper()), (7, "other words stand here now"), (9, "other words stand here now"), (None, same), (None, "alone it is"), (None, None), (5, None), (5, ""), (8, same), (8, same)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == by_pairs(rows)


def test_query(spark, sf_dir):
    got = queries.op13_minhash(spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in got.collect()]
    assert sorted((r[:3] for r in rows), key=str) == by_pairs([tuple(r) for r in docs])
    assert all(r[3] == (r[0] == r[2]) for r in rows)


def test_estimate_is_corrected_for_collisions(spark):
    rng = np.random.default_rng(2)
    got = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        a, b = np.sort(x[:900]), np.sort(x[100:])
        pair = [minhash.signature(minhash.minima(s)) for s in (a, b)]
        got.append((pair[0].tolist(), pair[1].tolist(), minhash.shared_count(a, b)))
    assert {g[2] for g in got} == {800}
    names = [f"{side}{i}" for side in "ab" for i in range(len(minhash.SIGNATURE))]
    df = spark.createDataFrame([(*a, *b) for a, b, _ in got], ", ".join(f"{c} long" for c in names))
    equal = np.array([r[0] for r in df.select(minhash.equal_entries("a", "b")).collect()])
    assert [sum(bin(~(u | v) & (1 << 64) - 1).count("1") for u, v in zip(x[:4], x[4:], strict=True)) for x in ([(p ^ q) & (1 << 64) - 1 for p, q in zip(a, b, strict=True)] for a, b, _ in got)] == equal.tolist()
    assert abs(minhash.estimate(equal).mean() - 0.8) < 0.01 and (equal >= minhash.least_equal(80)).all()


def test_signatures_thin_candidates():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = np.sort(x[:700]), np.sort(x[300:])  # similarity 0.4
    differ = minhash.signature(minhash.minima(a)) ^ minhash.signature(minhash.minima(b))
    equal = minhash.HASHES - int(np.bitwise_count((differ[:4] | differ[4:]).view(np.uint64)).sum())
    assert equal < minhash.least_equal(80)


def test_keys_fit_the_limit():
    assert minhash.band_rows(80) == 4 and minhash.band_rows(100) <= minhash.HASHES // minhash.BANDS and minhash.band_rows(10) == 1
    for percent in (60, 70, 80, 90, 99):
        rows = minhash.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** minhash.BANDS <= 1e-5


def test_texts_longer_than_a_window(spark, monkeypatch):
    known = minhash.WordHashes()
    text = " ".join(f"w{i}" for i in range(500))
    whole = minhash.shingle_set(text, known)
    monkeypatch.setattr(minhash, "WINDOW_BYTES", 10)
    assert (minhash.shingle_set(text, known) == whole).all() and len(whole) == 499
    df = spark.createDataFrame([(1, text * 200), (2, text * 200 + " more")], "doc_id long, text string")
    assert minhash.components(df).filter(F.col("component") == 1).count() == 2
