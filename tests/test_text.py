import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import corpus as C

PAIRS = [
    ("abc", "abc", 2, 1.0, 1.0, 1.0),
    ("我喜欢吃苹果", "我爱吃苹果", 3, 0.166667, 0.666667, 0.416667),
    ("kitten", "sitting", 3, 0.125, 0.571429, 0.348214),
    ("ab", "cd", 3, 1.0, 0.0, 0.5),
    ("", "", 3, 1.0, 1.0, 1.0),
    ("", "abc", 3, 0.0, 0.0, 0.0),
    ("", "ab", 3, 1.0, 0.0, 0.5),
    ("😀a", "b", 1, 0.0, 0.0, 0.0),
    ("aaaa", "aaa", 2, 1.0, 0.75, 0.875),
]


@pytest.mark.parametrize("a,b,n,jaccard,edit,mean", PAIRS)
def test_pair_similarity(spark, a, b, n, jaccard, edit, mean):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = F.col("a"), F.col("b")
    got = df.select(X.jaccard(x, y, n), X.edit_similarity(x, y), X.pair_similarity(x, y, n)).first()
    assert [round(v, 6) for v in got] == [jaccard, edit, mean]
    assert [round(v, 6) for v in df.select(C.pair_scores(x, y, n).alias("s")).select("s.*").first()] == [jaccard, edit]


def test_bitwise_edit_distance_equals_the_table():
    draw = random.Random(7)
    for size in (0, 1, 5, 63, 64, 65, 130):
        for _ in range(12):
            a, b = ("".join(draw.choices("ab我😀 ", k=draw.randint(0, size))) for _ in "ab")
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row = list(accumulate(range(len(b)), lambda left, j, row=row, x=x: min(left + 1, row[j + 1] + 1, row[j] + (x != b[j])), initial=i))
            assert C.edit_distance(a, b) == row[-1] == C.edit_distance(b, a)


def test_scored_once_and_blank_pairs_are_null(spark, capsys):
    rows = [("abcd", "abce"), ("abcd", " \u3000"), (None, "abcd"), ("", "abcd"), ("我" * 3000, "我" * 2999 + "你")]
    df = spark.createDataFrame(rows, "a string, b string").select(C.pair_similarity(F.col("a"), F.col("b")).alias("s"))
    assert [r["s"] if r["s"] is None else round(r["s"], 4) for r in df.collect()] == [round((1 / 3 + 3 / 4) / 2, 4), None, None, None, round((1 / 2 + 2999 / 3000) / 2, 4)]
    df.filter("s > 0.5").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_white_space_is_pythons(spark):
    assert sorted(X.SPACES) == [c for c in map(chr, range(0x110000)) if c.isspace()]
    df = spark.createDataFrame([(f"{c}a{c}b{c}{c}",) for c in X.SPACES], "t string")
    assert {tuple(r) for r in df.select(F.substring(X.strip(F.col("t")), 3, 9), F.char_length(X.strip(F.col("t"))), X.drop_spaces(F.col("t"))).collect()} == {("b", 3, "ab")}


def test_multiset_jaccard(spark):
    df = spark.createDataFrame([(1, "aaaa", "aaa"), (2, "ab", "cd"), (3, "", "abc")], "id long, a string, b string")
    assert {r["id"]: round(r["score"], 6) for r in C.multiset_jaccard(df, 2).collect()} == {1: 0.666667, 2: 0.0, 3: 0.0}


def test_ngrams_of_short_and_null_texts(spark):
    df = spark.createDataFrame([("ab",), ("",), (None,), ("abcd",)], "t string")
    assert [r[0] for r in df.select(X.char_ngrams(F.col("t"), 3)).collect()] == [[], [], None, ["abc", "bcd"]]


@pytest.mark.parametrize(
    "text,reason",
    [(None, "empty"), ("", "empty"), ("　\t", "empty"), ("……", "pure_ellipsis"), (" …… ", "pure_ellipsis"), ("——", "pure_emdash"), ("abc", "too_short"), ("abcd", None), ("  abc  ", "too_short"), ("😀😀😀", "too_short"), ("………", "too_short"), ("……。。", None)],
)
def test_removal_reason(spark, text, reason):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.removal_reason(F.col("t"))).first()[0] == reason


@pytest.mark.parametrize(
    "response,status,texts",
    [("A：x\n\nB：y", "ok", ["x", "y"]), ("A：x", "count_mismatch", None), ("A：x\nC：y", "speaker_mismatch", None), ("A:x\nB：y", "speaker_mismatch", None), ("A：x\nB：  ", "empty_text", None)],
)
def test_parsed_responses(spark, response, status, texts):
    df = spark.createDataFrame([(["A", "B"], response)], "speakers array<string>, response string")
    row = C.parsed_responses(df).first()
    assert (row["status"], row["texts"]) == (status, texts)
    assert C.client_lines(response, ["A", "B"]) == (status, texts or [])


def test_responses_are_judged_alike_in_plans_and_tasks(spark):
    rng = random.Random(3)
    speakers = [[rng.choice(["A", "B", "旅：者"]) for _ in range(rng.randint(1, 4))] for _ in range(300)]
    ends = ["x", " y ", "", "  ", "：z"]
    answers = ["\n".join(rng.choice([who, who, who, "C"]) + rng.choice(["：", "：", "：", ":"]) + rng.choice(ends) for who in row) + rng.choice(["", "", "\n\n", "\nA：more"]) for row in speakers]
    df = spark.createDataFrame(list(zip(range(300), speakers, answers, strict=True)), "id int, speakers array<string>, response string")
    got = {r["id"]: (r["status"], r["texts"] or []) for r in C.parsed_responses(df).collect()}
    assert got == {i: C.client_lines(a, s) for i, (s, a) in enumerate(zip(speakers, answers, strict=True))}
    assert {s for s, _ in got.values()} == {"ok", "count_mismatch", "speaker_mismatch", "empty_text"}


@pytest.mark.parametrize(("text", "n"), [('"好"', 1), ("“好”", 3), ("  a b　", 2), ("，。！？；：（）【】《》、·…—", 0), ("a-b", 3), (None, 0), ("", 0)])
def test_meaningful_length(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(X.meaningful_length(F.col("t"))).first()[0] == n


def test_prompt_line_needs_a_speaker(spark):
    df = spark.createDataFrame([(" A ", "x\r\ny "), ("  ", "x"), ("A", None)], "s string, t string")
    assert [r[0] for r in df.select(X.prompt_line(F.col("s"), F.col("t"))).collect()] == ["A：x y", None, None]


def test_paraphrase_retries_and_dead_letters(spark):
    from voxloom.sources.services import EchoClient

    df = spark.createDataFrame([(1, "A", "one"), (2, "", "two"), (3, "B", None), (4, "B", "four"), (5, "C", "five")], "id long, speaker string, origin_text string")
    got = {r["id"]: (r["status"], r["attempts"], r["text"]) for r in C.paraphrased(df, EchoClient(), 100).collect()}
    assert got == {1: ("ok", 2, "one"), 2: ("unusable", 0, None), 3: ("unusable", 0, None), 4: ("ok", 2, "four"), 5: ("ok", 2, "five")}


def test_pairs_beyond_ascii_are_scored(spark, tmp_path):
    """Similarity queries over Chinese, accented and astral text, against brute force over code points."""
    from voxloom.plans.catalog import CATALOG

    said = ["你好，旅行者！", "你好啊，旅行者", "Café au lait", "Cafe au lait", "😀 fine day", "😀😀 fine days", " ", "end"]
    turns = [(1, i, "ab"[i % 2], t) for i, t in enumerate(said)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def score(a, b):
        ga, gb = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
        return (len(ga & gb) / len(ga | gb) + 1 - distance(a, b) / max(len(a), len(b))) / 2

    want = {1000 + i: score(a, b) for i, (a, b) in enumerate(zip(said, said[1:], strict=False)) if a.strip() and b.strip()}
    assert len(want) == 5
    got = {r["id"]: r["similarity"] for r in CATALOG["pair_similarity"].run(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    updated = {r["id"]: r for r in CATALOG["update_similarity"].run(spark, str(tmp_path)).collect()}
    assert {i for i, r in updated.items() if not r["still_pending"]} == set(want) and len(updated) == len(said)
    stats = {r["speaker"]: r for r in CATALOG["similarity_stats_by_speaker"].run(spark, str(tmp_path)).collect()}
    for who, odd in (("a", 0), ("b", 1)):
        part = [v for i, v in want.items() if i % 2 == odd]
        assert stats[who]["n"] == len(part) and [stats[who][c] for c in ("mean", "low", "high")] == pytest.approx([sum(part) / len(part), min(part), max(part)], abs=1e-6)
