import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import corpus, pooling, sampling
from voxloom.plans.catalog import CATALOG
from voxloom.sources import services, tables
from voxloom.streaming import scoring


def test_json_records(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text(json.dumps([{"I": 1, "S": "A", "T": "x"}, {"S": "B"}, {"I": "3", "T": "z\n"}]))
    got = {(r["I"], r["S"], r["T"]) for r in tables.read_records(spark, str(path)).collect()}
    assert got == {("1", "A", "x"), (None, "B", None), ("3", None, "z\n")}
    rows = tables.as_dialogues(tables.read_records(spark, str(path)))
    assert [(r["id"], r["speaker"]) for r in rows.orderBy("id").collect()] == [(1, "A"), (2, "B"), (3, "")]
    assert rows.filter("para_text is null and similarity is null").count() == 3


def test_imported_ids_follow_turns_over_files(spark, tmp_path):
    """Spark reads larger files first, whatever their names."""
    turns = [(c, t, "user", f"{c}.{t}" * (1 if c < 4 else 9000)) for c in range(6) for t in range(3)]
    for c in (0, 1, 2, 3, 4, 5):
        part = spark.createDataFrame([t for t in turns if t[0] == c], "conv_id long, turn int, role string, text string")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "conversations.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "256m")
    try:
        got = CATALOG["imported_table"].run(spark, str(tmp_path)).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["id"], r["origin_text"]) for r in got] == [(i + 1, t[3]) for i, t in enumerate(turns)]


def test_cache_is_written_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert tables.cached(spark, path, make).count() == tables.cached(spark, path, make).count() == 3
    assert len(calls) == 1


def test_reports(spark, tmp_path):
    tables.write_csv(spark.range(2), str(tmp_path / "c"))
    tables.write_report(spark.range(2).select(F.col("id").cast("string")), str(tmp_path / "t"))
    tables.write_speakers(spark.createDataFrame([("A", 1), ("B", 2)], "speaker string, x int"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id"]
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    assert spark.read.parquet(str(tmp_path / "s")).filter("speaker = 'A'").count() == 1


def test_embedder_batches_and_nulls(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "text string")
    got = [r["vector"] for r in services.embedded(df, services.HashEmbedder(4), batch=2).collect()]
    assert got[1] is None and got[0] == got[3] != got[2] and len(got[0]) == 4


def test_cache_keys_follow_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id long, text string")
    again = a.repartition(3).orderBy(F.desc("id"))
    assert tables.content_key(a) == tables.content_key(again)
    others = [a.distinct(), a.withColumnRenamed("text", "t"), a.filter("id < 0"), a.withColumn("text", F.lit("x"))]
    assert len({tables.content_key(x) for x in [a, *others]}) == 5


TEXTS = [(1, "one three fiveee"), (2, ""), (3, None), (4, "word"), (5, " ".join("ab" * (i % 4) for i in range(300)))]


def test_states_pooled_in_tasks_equal_pooled_rows(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    rows = services.hidden_states(df, services.WordStates(), "id", "text")
    assert rows.filter("layer = 0 and attn is not null").isEmpty() and rows.filter("id = 5").count() == 900
    got = {(r["id"], r["layer"], r["pool"]): r["vec"] for r in services.pooled_states(df, services.WordStates(), "id", "text").collect()}
    assert {k[0] for k in got} == {1, 2, 4, 5} and len(got) == 4 * 3 * 4
    for method in pooling.METHODS:
        for r in pooling.attention(rows, ["id", "layer"], method).collect():
            assert np.allclose(r["vec"], got[r["id"], r["layer"], method], atol=1e-5)
    assert services.pooled_states(df.filter("id < 0"), services.WordStates(), "id", "text").isEmpty()


def test_encoder_batches(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    rows = services.tokenized(df, services.WordLengths())
    one, many = (services.encoded(rows, services.SumEncoder(8), batch=n).orderBy("id").collect() for n in (1, 256))
    assert one == many and [sum(r["mask"]) for r in one] == [3, 1, 0, 1, 128] and {len(r["ids"]) for r in one} == {128}
    assert one[0]["vector"][:2] == pytest.approx([(3 + 5 * 2 + 6 * 3) % 101 / 101, (3 + 10 + 18 + 3) % 101 / 101])


def test_stream_scores_each_file_once(spark, tmp_path):
    folder, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    first = spark.createDataFrame([(1, "A", "hello there", "hello here"), (2, "A", "x", " ")], scoring.PAIRS)
    first.write.parquet(folder)
    scoring.run_available(scoring.pending_pairs(spark, folder), out, marks).awaitTermination()
    spark.createDataFrame([(3, "B", "abc", "abc")], scoring.PAIRS).write.mode("append").parquet(folder)
    scoring.run_available(scoring.pending_pairs(spark, folder), out, marks).awaitTermination()
    got = {r["id"]: (r["similarity"], r["skipped"]) for r in spark.read.parquet(out).collect()}
    assert set(got) == {1, 2, 3} and got[2] == (None, True) and got[3] == (1.0, False) and 0 < got[1][0] < 1


class Flaky:
    """Asks to slow down, then fails, then answers wrongly, then rightly."""

    def __init__(self, folder):
        self.folder = folder

    def paraphrase(self, lines, strict):
        import pathlib

        marks = pathlib.Path(self.folder)
        n = len(list(marks.iterdir()))
        (marks / str(n)).touch()
        if n == 0:
            raise corpus.RateLimited
        if n == 1:
            raise OSError
        return "\n".join(lines if strict else lines[1:])


def test_paraphrase_retries(spark, tmp_path):
    rows = [(i * 1000, "A", f"text {i}") for i in range(1, 6)] + [(1, " ", "x"), (2, "B", None)]
    df = spark.createDataFrame(rows, "id long, speaker string, origin_text string").coalesce(1)
    (tmp_path / "a").mkdir()
    got = {r["id"]: r for r in corpus.paraphrased(df, Flaky(str(tmp_path / "a")), batch_size=75, retries=5).collect()}
    assert {got[i]["status"] for i in (1, 2)} == {"unusable"} and got[1]["attempts"] == 0
    good = [got[i * 1000] for i in range(1, 6)]
    assert {(r["status"], r["attempts"], r["batch"]) for r in good} == {("ok", 4, 0)} and good[2]["text"] == "text 3"
    assert len(good[0]["errors"]) == 1 and good[0]["errors"][0].startswith("3: count_mismatch: ")
    (tmp_path / "b").mkdir()
    out = corpus.paraphrased(df, Flaky(str(tmp_path / "b")), batch_size=75, retries=2).filter("id >= 1000").collect()
    assert {(r["status"], r["attempts"], r["text"]) for r in out} == {("error: OSError", 2, None)}


def test_batches_are_full_whatever_the_ids(spark):
    df = spark.createDataFrame([(i * i * 100_000, "A", f"t{i}") for i in range(1, 11)], "id long, speaker string, origin_text string")
    got = corpus.paraphrased(df, services.EchoClient(), batch_size=4).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in got) == [2, 4, 4]


def test_numbered_rows(spark):
    ids = [5, 5_000_000, 7, 9000, 12, None, 8192]
    df = spark.createDataFrame([(i, "ab"[n % 2]) for n, i in enumerate(ids)], "id long, g string")
    got = {r["id"]: r["number"] for r in sampling.numbered(df, [F.asc("id")]).collect()}
    known = sorted(i for i in ids if i is not None)
    assert [got[i] - got[known[0]] for i in known] == list(range(6)) and sorted(got.values()) == list(range(1, 8))
    by = {r["id"]: r["number"] for r in sampling.numbered(df, [F.asc("id")], "g").collect()}
    assert [by[i] for i in (5, 7, 12, 8192)] == [1, 2, 3, 4]


def test_pilot_report_by_hand(spark):
    runs = [(True, 2, 10, 20, 1.0, ["abcd", "efgh"], ["abcd", "ef"]), (False, 2, 99, 99, 9.0, ["x", "y"], None)]
    df = spark.createDataFrame(runs, "success boolean, lines int, prompt_tokens int, completion_tokens int, elapsed double, origins array<string>, paras array<string>")
    r = corpus.pilot_report(df, corpus_rows=100, batch_size=30, system_words=2).first()
    assert (r["success_rate"], r["length_change"], r["cache_rate"]) == (0.5, -25.0, 20.0)
    assert (r["input_tokens_for_all"], r["output_tokens_for_all"], r["seconds_for_all"]) == (500, 1000, 4.0)
    assert r["mean_similarity"] == round((1 + (0 + 0.5) / 2) / 2, 6)


def test_settings_have_defaults_and_required_keys():
    given = {"api": {"base_url": "u", "api_key": "k-1", "model": "m", "more": 1}, "prompt": {"system": "s"}}
    got = services.read_settings(json.dumps(given))
    assert (got.api.temperature, got.api.max_tokens, got.prompt.user_template, got.processing) == (0.7, 4096, "{lines}", services.Processing(50, 3, 5, 3))
    assert services.read_settings(json.dumps(given | {"processing": {"batch_size": 75}})).processing.batch_size == 75
    for key, error in (("", ValueError), ("  ", ValueError)):
        with pytest.raises(error):
            services.read_settings(json.dumps(given | {"api": given["api"] | {"api_key": key}}))
    with pytest.raises(KeyError, match="prompt.system"):
        services.read_settings(json.dumps(given | {"prompt": {}}))


def test_concurrency_bounds_the_tasks(spark):
    rows = spark.range(40).select("id", F.lit("A").alias("speaker"), F.lit("abcd").alias("origin_text"))
    out = corpus.paraphrased(rows, services.EchoClient(), batch_size=5, concurrency=3)
    assert out.rdd.getNumPartitions() == 3 and out.filter("status = 'ok'").count() == 40
