"""Operators over whole texts against brute force and the libraries themselves."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxloom.llm import decontam, line_dedup, near_copies, packing, queries, simhash, token_counts
from voxloom.llm.token_counts import Counter
from voxloom.llm.tokenizer_ids import WordIds

WILD = [
    "", "  ", "Hello world!! it's we're don't", "a<|endoftext|>b <|ENDOFTEXT|> x.<|endoftext|>. ok", "éÉ ÀB ΣΑΣ. İx ǅ", "日本 語。テスト 123abc", "a\x1cb\x85c\xa0d\u3000e", "e\u0301 \u0301x", "...!!! ## 'tis 's 'S y's.", "x's!! A'LL. é's. é.. ñ!",
    "ﬁ ½ ² Ⅷ a_b __", "😀 😀x. <|x .<|", "W\u030a T\u0308 ẘ", "\x00a \x07. \x7f", " lead\n\ntrail \t", "▁x y", "    def foo():\n        return 1", "<s> hi</s> <unk>", "a\n b", "a \nb", "\n\n\n", "hahaha" * 300, "0" * 3000, "======-----=====", "a  b", None,
]


def wild_texts():
    random.seed(5)
    return WILD + ["".join(random.choice("abehtio n\n.é▁ 's!") for _ in range(random.randint(0, 60))) for _ in range(800)]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_word_ids_equal_the_library():
    w = WordIds(packing.TOKENIZER)
    texts = wild_texts()
    for _ in range(2):  # cold, then from the cache
        ids, at = w.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in w.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


def test_token_counts_equal_the_library():
    c = Counter(token_counts.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    texts = wild_texts()
    want = [len(x) for x in sp.encode([t or "" for t in texts], num_threads=1)]
    assert c.texts(pa.array(texts, pa.string())).tolist() == want
    assert c.texts(pa.array(texts, pa.string())).tolist() == want
    c.can_split = False
    assert c.texts(pa.array(texts, pa.string())).tolist() == want


def test_token_counts_of_awkward_rows(awkward, empty):
    got = token_counts.counts(awkward).collect()
    assert len(got) == 9 and token_counts.counts(empty).count() == 0
    by = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got}
    assert by[2] == by[3] == (0, 0, False) and by[5][2]


@pytest.mark.parametrize("texts", [wild_texts()])
def test_packing_round_trip(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = packing.packed(docs_of(spark, texts).coalesce(2), with_ids=True).toPandas()
    for doc, pieces in got.sort_values("start").groupby("doc_id"):
        want = library.encode(texts[doc] or "", add_special_tokens=False).ids + [packing.END_ID]
        assert np.concatenate(pieces["ids"].to_list()).tolist() == want
        assert (pieces["start"] == pieces["length"].cumsum() - pieces["length"]).all() and (pieces["doc_tokens"] == len(want)).all()
        for p in pieces.itertuples():
            assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
    assert set(got["doc_id"]) == set(range(len(texts)))
    seqs = got.sort_values("offset").groupby("sequence_id")
    assert all((s["offset"] == s["length"].cumsum() - s["length"]).all() for _, s in seqs)
    short = sum(int(s["length"].sum() != s["tier"].iloc[0]) for _, s in seqs)
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048 and short <= 2  # one a partition


def test_packing_awkward_rows(awkward, empty):
    got = packing.packed(awkward).toPandas()
    assert packing.packed(empty).count() == 0
    assert got[got["doc_id"] == 2]["doc_tokens"].tolist() == [1] and len(got[(got["doc_id"] == 1) & (got["start"] == 0)]) == 2


def test_packing_fills_every_gap():
    random.seed(1)
    pieces = [(i, 0, random.randint(1, 5000)) for i in range(400)]
    done, left = packing.pack(pieces)
    assert all(sum(p[2] for p in seq) == tier for tier, seq in done) and sum(p[2] for p in left) < 2048
    cover = defaultdict(list)
    for seq in [*[s for _, s in done], left]:
        for i, start, n in seq:
            cover[i].append((start, n))
    for i, _, n in pieces:
        at = 0
        for start, length in sorted(cover[i]):
            assert start == at
            at += length
        assert at == n


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, fps):
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)), key=lambda k: ids[k])
                up[b] = a
    return {ids[i]: ids[top(i)] for i in range(len(ids))}


def test_fingerprints_equal_brute_force(awkward):
    texts = wild_texts()[:200] + [r["text"] for r in awkward.filter("doc_id <> 5").collect()]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    long = " ".join(random.choice("abcdefg") for _ in range(250_000))
    whole = simhash.fingerprint(long)
    chunk, simhash.CHUNK = simhash.CHUNK, 10_000_000
    try:
        assert whole == simhash.fingerprint(long)
    finally:
        simhash.CHUNK = chunk


def test_bit_slices_find_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(6)]])
    group = np.sort(rng.integers(0, 3, len(fps)))
    got = {(int(i), int(j)) for a, b in simhash.sliced_pairs(fps, group, slab=50) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("cap", [1024, 4])
def test_components_equal_brute_force(spark, monkeypatch, cap):
    """Chains of near fingerprints, with groups refined (small cap) or not."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    for _ in range(240):
        f = fps[int(rng.integers(0, len(fps)))]
        for _ in range(int(rng.integers(0, 4))):
            f ^= 1 << int(rng.integers(0, 64))
        fps.append(f)
    ids = [int(x) for x in rng.permutation(len(fps))]
    frame = spark.createDataFrame([(i, simhash.signed(f)) for i, f in zip(ids, fps, strict=True)], "doc long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: frame)
    got = {r["doc"]: r["component"] for r in simhash.components(frame, cap=cap).collect()}
    assert got == brute_components(ids, fps)


def test_simhash_awkward_rows(awkward, empty):
    got = simhash.components(awkward).collect()
    by = {r["doc"]: r["component"] for r in got}
    assert len(got) == 9 and by[2] == by[3] == by[4] == 2 and by[6] == by[1] == 1
    assert simhash.components(empty).count() == 0
    kept = near_copies.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 7, 8]
    nameless = awkward.withColumn("doc_id", F.when(F.col("doc_id") < 5, F.col("doc_id")))
    assert simhash.components(nameless).count() == 9
    assert sorted(str(r["doc_id"]) for r in near_copies.keep_one(nameless).collect()) == ["1", "2", *["None"] * 4]


def brute_lines(docs, mode, least):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders, seen, out = defaultdict(set), set(), {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = []
        for x in lines:
            k = key(x)
            gone = len(holders[k]) >= least if mode == "all" else k in seen
            keep.append(not (k and gone))
            seen.add(k)
        out[d] = (len(lines), keep.count(False), "\n".join(x for x, y in zip(lines, keep, strict=True) if y))
    return out


@pytest.mark.parametrize("mode", ["all", "first"])
def test_line_dedup_equals_brute_force(spark, mode):
    random.seed(6)
    texts = ["\n".join(random.choice(["Top", " top ", "É", "é", "x y", "", "\t", f"u{i}", "b\r"]) for _ in range(random.randint(0, 12))) for i in range(60)]
    docs = docs_of(spark, texts)
    got = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs, mode, min_docs=7)).collect()
    want = brute_lines(list(enumerate(texts)), mode, 7)
    if mode == "all":
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got} == want
    else:  # documents are ordered by (id, hash), which is their order here
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got} == want
    for r in got:
        runs = [i for f, n in r["keep_runs"] for i in range(f, f + n)]
        assert len(runs) == r["n_lines"] - r["n_dropped"]


def test_line_dedup_awkward_rows(awkward, empty):
    out = line_dedup.apply(awkward, line_dedup.keep_bitmaps(awkward, "all", min_docs=2))
    rows = out.collect()
    assert len(rows) == 9 and set(out.columns) >= {"doc_id", "text", "lang", "score", "keep_runs"}
    assert {r["doc_id"]: r["text"] for r in rows}[6] == "" and {r["doc_id"]: r["n_lines"] for r in rows}[2] == 1
    assert line_dedup.apply(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_line_dedup_query_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(c.execute(line_dedup.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op10_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == want and hashlib.sha256(b"").hexdigest()


def test_line_dedup_of_null_texts_equals_sql(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "one\ntwo"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.execute(line_dedup.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op10_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == want


def brute_distance(pattern, words):
    """Least edits of the pattern to any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != w)))
        row = new
    return min(row)


def test_myers_equals_brute_force():
    random.seed(7)
    for _ in range(200):
        p = [random.choice("abcd") for _ in range(random.randint(1, 70))]
        t = [random.choice("abcd") for _ in range(random.randint(0, 90))]
        got = min(decontam.myers(decontam.positions(p), len(p), t), default=len(p))
        assert min(got, len(p)) == brute_distance(p, t)


def test_decontamination_equals_brute_force(spark):
    random.seed(8)
    vocab = [f"w{i}" for i in range(30)]
    items = [" ".join(random.choice(vocab) for _ in range(random.randint(1, 40))) for _ in range(12)]
    texts = []
    for i in range(60):
        words = [random.choice(vocab) for _ in range(random.randint(0, 50))]
        if i % 2:
            part = items[i % 12].split()
            for _ in range(random.randint(0, max(1, len(part) // 4))):
                at = random.randrange(len(part))
                part[at : at + 1] = random.choice([[], ["new"], [part[at], "more"]])
                part = part or ["gone"]
            words[len(words) // 2 : len(words) // 2] = [w.upper() + "," for w in part]
        texts.append("\n".join(words))
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (90, None), (91, " .. ")], "item_id long, text string")
    docs = docs_of(spark, texts)
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if brute_distance(decontam.words_of(x), decontam.words_of(t)) <= decontam.budget(len(x.split()))}
    for limit in (decontam.BLOCK_CHARS, 200):
        got = decontam.hits(docs, bench, limit=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    for r in got:
        words = decontam.words_of(texts[r["doc_id"]])[r["first_word"] : r["first_word"] + r["n_words"]]
        assert brute_distance(decontam.words_of(items[r["item_id"]]), words) == r["edits"]


def test_decontamination_awkward_rows(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "ALPHA, beta gamma delta")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.hits(awkward, bench).collect()) == [1, 1, 6]
    kept = decontam.clean(awkward, bench)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 7, 8]
    assert decontam.hits(empty, bench).count() == 0 and decontam.clean(awkward, bench.filter("item_id < 0")).count() == 9
    assert kept.filter(F.col("n_chars").isNull()).count() == 1


def test_near_copies_against_brute_force(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = random.choices(vocabulary, k=random.randint(3, 400))
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 6)):
            near = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                near[random.randrange(len(near))] = random.choice(vocabulary)
            texts.append(random.choice(("\n", "  ")).join(near).upper())
    hot = random.choices(vocabulary, k=300)
    for i in range(60):  # a group of near copies that takes several parts
        texts.append(" ".join([*hot[:i], f"u{i}", *hot[i + 1 :]]))
    texts += [None, "", " \t", "one two", "one  two"]
    random.shuffle(texts)
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    n = len(texts)
    near = {(i, j) for i in range(n) for j in range(i + 1, n) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    closure = list(range(n))
    for _ in range(n):
        before = list(closure)
        for i, j in near:
            closure[i] = closure[j] = min(closure[i], closure[j])
        if closure == before:
            break
    for part in (near_copies.PART, 8):
        got = {r["doc"]: r["component"] for r in near_copies.components(docs_of(spark, texts), part=part).collect()}
        assert len(got) == n and all(closure[i] == closure[c] for i, c in got.items())
        kept = [i for i, c in got.items() if i == c]
        assert not [p for p in near if p[0] in kept and p[1] in kept]
        assert set(got.values()) == set(kept)


def test_near_copies_of_a_star_are_the_closure(spark):
    """Copies similar to the original only: some are pivots before it, and the links through it must still be found."""
    random.seed(8)
    texts = []
    for star in range(4):
        base = [f"s{star}w{random.randrange(3000)}" for _ in range(300)]
        texts.append(" ".join(base))
        for copy in range(40):
            edited = list(base)
            for at in random.sample(range(5, 295, 10), 5):
                edited[at] = f"c{copy}x{at}"
            texts.append(" ".join(edited))
    random.shuffle(texts)
    n = len(texts)
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    near = [(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    closure = list(range(n))
    while True:
        before = list(closure)
        for i, j in near:
            closure[i] = closure[j] = min(closure[i], closure[j])
        if closure == before:
            break
    assert len(set(closure)) == 4
    for part in (near_copies.PART, 8):
        got = {r["doc"]: r["component"] for r in near_copies.components(docs_of(spark, texts), part=part).collect()}
        assert got == dict(enumerate(closure))


def brute_near_copies(ids, texts):
    """The smallest id of each document's group, from all pairs of shingle sets."""
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(ids[a]), top(ids[b])))
                up[y] = x
    return {i: top(i) for i in ids}


def test_near_copies_just_above_the_similarity_are_found(spark):
    """Pairs of exactly 0.80 to 0.85, and as many just below: all of the first are linked, none of the others."""
    random.seed(11)
    texts, want = [], []
    for pair in range(300):
        n, edits = 400, 0
        base = [f"p{pair}w{i}" for i in range(n)]
        near = list(base)
        while True:
            a, b = (set(near_copies.shingle_set(" ".join(t)).tolist()) for t in (base, near))
            j = len(a & b) / len(a | b)
            if j <= 0.85 - 0.07 * (pair % 2):
                break
            near[3 + 11 * edits] = f"e{pair}x{edits}"
            edits += 1
        texts += [" ".join(base), " ".join(near)]
        want.append(j >= 0.8)
    assert 100 < sum(want) < 200
    got = {r["doc"]: r["component"] for r in near_copies.components(docs_of(spark, texts)).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(300)] == want


def test_line_dedup_counts_ids(spark, tmp_path):
    """Ten rows of one id share a line with another id: two documents, so nothing goes; and rows without an id are one."""
    rows = [(1, f"shared\nown {i}") for i in range(10)] + [(2, "shared")] + [(i, "often") for i in range(3, 12)] + [(None, "often"), (None, "often\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    order = lambda x: sorted(x, key=str)
    want = order(c.execute(line_dedup.ORACLE_SQL).fetchall())
    got = order(tuple(r) for r in queries.op10_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == want and sum(r[2] for r in got) == 11


def test_decontamination_of_many_occurrences():
    import time

    item = "alpha beta gamma delta epsilon zeta"
    m = decontam.Matcher([(1, item)])
    began = time.time()
    (hit,) = m.hits(" ".join([item, "x y z u v w"] * 20_000))
    assert hit == (1, 0, 0, 6, 20_000) and time.time() - began < 6


def brute_hits(texts, items):
    """Whether any item lies in a text within its budget of edits, by a whole table of distances for each pair."""
    out = []
    for text in texts:
        words = np.array(decontam.words_of(text), object)
        steps = np.arange(len(words) + 1)
        hit = False
        for item in items:
            pattern = decontam.words_of(item)
            row = np.zeros(len(words) + 1, np.int64)
            for i, w in enumerate(pattern):
                best = np.minimum(row[:-1] + (words != w), row[1:] + 1) if len(words) else np.zeros(0, np.int64)
                row = np.minimum.accumulate(np.r_[i + 1, best] - steps) + steps
            hit |= bool(pattern) and bool(row.min() <= decontam.budget(len(pattern)))
        out.append(hit)
    return out


def library_ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [[*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]


def test_brute_hits_equal_brute_distance():
    random.seed(4)
    items = [" ".join(random.choices("abc", k=random.randint(3, 8))) for _ in range(9)]
    texts = [" ".join(random.choices("abcd", k=random.randint(0, 20))) for _ in range(40)]
    want = [any(brute_distance(decontam.words_of(x), decontam.words_of(t)) <= decontam.budget(len(x.split())) for x in items) for t in texts]
    assert brute_hits(texts, items) == want and any(want) and not all(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_one_where_ids_repeat_with_other_texts(spark, seed):
    """No text is lost that has no copy among the kept rows, and no two kept rows are copies."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(40)]
    a, b, c = (" ".join(rng.choices(base, k=60)) for _ in range(3))
    near = lambda t, i: " ".join([*t.split()[:i], "other", *t.split()[i + 1 :]])
    rows = [(3, a), (7, a), (7, b), (9, c), (9, near(c, 20)), (5, near(b, 0)), (7, b), (3, c.upper()), (11, "short text"), (11, None), (12, ""), (11, "Short  text"), (None, a), (None, a)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, t1 string").repartition(4)
    got = [tuple(r)[:2] for r in near_copies.keep_one(df).collect()]
    named = [r for r in rows if r[0] is not None]
    sets = [set(near_copies.shingle_set(t).tolist()) for _, t in named]
    comp = list(range(len(named)))
    for _ in comp:
        for i in comp:
            for j, s in enumerate(sets):
                if sets[i] == s or len(sets[i] & s) >= 0.8 * len(sets[i] | s):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    groups = {}
    for i, r in zip(comp, named, strict=True):
        groups.setdefault(i, []).append(r)
    kept = [r for r in got if r[0] is not None]
    assert len(kept) == len(groups) and all(sum(r in g for r in kept) == 1 for g in groups.values())
    assert all(any(r in g and r[0] == min(x[0] for x in g) for r in kept) for g in groups.values())
    assert sorted(r[1] for r in got if r[0] is None) == [a, a]
    by_row = {tuple(r) for r in near_copies.components(df).filter("doc is not null").distinct().collect()}
    assert by_row == {(r[0], min(x[0] for x in g)) for g in groups.values() for r in g}


def test_clean_in_blocks(spark):
    bench = spark.createDataFrame([(i, f"item{i} of the long benchmark number{i}") for i in range(6)], "item_id long, text string")
    docs = docs_of(spark, [f"say item{i} of the long benchmark number{i} now" for i in range(6)] + ["clean text", None])
    for limit in (decontam.BLOCK_CHARS, 60):
        assert sorted(r["doc_id"] for r in decontam.clean(docs, bench, limit=limit).collect()) == [6, 7]


def test_windows_bound_the_bytes():
    from voxloom.llm.common import windows

    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 10, None, "b" * 95, "c" * 300, "", "d" * 60, "e" * 60])], names=["i", "t"])
    got = [w.column(0).to_pylist() for w in windows(iter([b]), 110)]
    assert got == [[0, 1, 2], [3], [4, 5], [6]]
