"""Phrase collocations against SQL and a count of every phrase."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_count(rows, max_words, min_count, cover, top):
    """What ``phrases.mined`` returns, from all phrases of (lang, text) rows."""
    found, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts = found.setdefault(lang, Counter())
            for m in range(1, max_words + 1):
                counts.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in found.items():
        kept = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        for p, a in candidates.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= cover * a and inside(q) for q, b in candidates.items()):
                continue
            s, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def some_texts(n, seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "dé", "日本", "x\x00y", "\x1c", "e'e", "A"]
    return [(rng.choice(["en", "en", "en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\r\n", "\x0b", ":"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("size", "max_words", "min_count", "cover", "top"), [(phrases.CHUNK, 3, 3, 50, 2000), (7, 3, 3, 50, 20), (1, 4, 2, 80, 9), (40, 2, 5, 50, 2000), (30, 5, 2, 50, 5000)])
def test_equals_a_count_of_all_phrases(spark, size, max_words, min_count, cover, top):
    rows = some_texts(60, size) + [(None, None), ("en", ""), ("fr", " \t\n.,"), ("en", "b c " * 40)] + [("en", "A b, c dé")] * 6
    df = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = phrases.mined(df, max_words=max_words, min_count=min_count, cover=cover, top=top, size=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == by_count(rows, max_words, min_count, cover, top)


def test_query_equals_sql(spark, sf_dir):
    got = queries.op12_phrases(spark, sf_dir).toPandas().sort_values(["lang", "rank"], ignore_index=True)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = duck.execute(phrases.ORACLE_SQL).fetchdf().sort_values(["lang", "rank"], ignore_index=True)
    assert len(got) and got.equals(want[got.columns])


def test_long_texts_without_pieces(spark, monkeypatch):
    text = "one two three four " * 30_000
    df = spark.createDataFrame([("en", text), ("en", text)], "lang string, text string")
    got = {r["phrase"]: (r["a"], r["n"]) for r in phrases.mined(df, size=1000).collect()}
    assert got == {"one two three": (60_000, 240_000), "two three four": (60_000, 240_000), "three four one": (59_998, 240_000), "four one two": (59_998, 240_000)}


def test_windows_cut_between_words():
    text = "aa bb,cc\tdd\nEE  ff" * 20 + "x" * 50
    whole = next(phrases.words_in_windows(text.encode(), 10**6))
    for limit in (1, 3, 7, 50):
        assert [w for part in phrases.words_in_windows(text.encode(), limit) for w in part] == whole
    assert list(phrases.words_in_windows(b"", 5)) == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10**12, 4 * 10**12 + 1, 5 * 10**12 + 7
    df = spark.createDataFrame([(a, left, right), (10**15, 10**15, 10**15)], "a long, l long, r long")
    got = [r[0] for r in df.select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (left * right), 10**6]


def test_pairs_need_both_ids():
    codes = np.array([1, 2, 1, 2, 3, 0, 1, 2], np.int32)
    out, a, b, n = phrases.pair_codes(codes, 6, np.array([-1, 10, 20, -1]))
    assert list(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)) == [(10, 20, 2), (20, 10, 1)]
    assert out.tolist() == [1, 2, 1, 0, 0, 0, 1]


def test_empty_table_and_no_phrases(spark, empty):
    assert phrases.mined(empty).count() == 0
    assert phrases.mined(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0
    for wrong in ({"max_words": 1}, {"size": 0}, {"size": phrases.CHUNK + 1}):
        with pytest.raises(ValueError, match="two words"):
            phrases.mined(empty, **wrong)
