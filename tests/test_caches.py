import pytest
from pyspark.sql import functions as F

from voxloom.sources import caches

ROW = "id long, speaker string, label int, tokens array<int>, mask array<int>, split string"
ROWS = [
    (1, "A", 0, [5, 6], [1, 1], "train"),
    (2, "A", 0, [7, 0], [1, 0], "val_acc"),
    (3, "B", 1, [], [], "val"),
    (4, None, 2, None, None, "train"),
    (4, None, 2, None, None, "train"),
]


def test_token_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    caches.save_tokens(spark.createDataFrame(ROWS, ROW), path)
    got = caches.load_tokens(spark, path)
    ids = {s: sorted(r["id"] for r in got.split(s).collect()) for s in ("train", "val_acc", "val", "all_train")}
    assert ids == {"train": [1, 4, 4], "val_acc": [2], "val": [3], "all_train": [1, 2, 4, 4]}
    assert got.train_speakers().first()[0] == 2
    assert {tuple(r) for r in got.speakers.collect()} == {(0, "A", "train", 1), (0, "A", "val_acc", 1), (1, "B", "val", 1), (2, None, "train", 2)}
    assert {(r["id"], tuple(r["tokens"] or ()), tuple(r["mask"] or ())) for r in got.tokens.collect()} == {(1, (5, 6), (1, 1)), (2, (7, 0), (1, 0)), (3, (), ()), (4, (), ())}
    plan = got.split("val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(KeyError):
        got.split("test")


def test_token_cache_that_is_missing_empty_or_odd(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="tokens"):
        caches.load_tokens(spark, str(tmp_path / "no"))
    for odd in ("test", None):
        with pytest.raises(Exception, match="unknown split"):
            caches.save_tokens(spark.createDataFrame([(*ROWS[0][:5], odd)], ROW), str(tmp_path / "odd"))
    empty = str(tmp_path / "empty")
    caches.save_tokens(spark.createDataFrame([], ROW), empty)
    assert caches.load_tokens(spark, empty).split("all_train").count() == 0
    assert caches.load_tokens(spark, empty).train_speakers().first()[0] == 0
    path = str(tmp_path / "half")
    caches.save_tokens(spark.createDataFrame(ROWS, ROW), path)
    (tmp_path / "half" / "speakers" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError, match="speakers"):
        caches.load_tokens(spark, path)


@pytest.mark.parametrize(
    ("cells", "layers", "gaps"),
    [
        ([], 0, set()),
        ([(1, "last"), (None, "last"), (0, "attn")], 0, set()),
        ([(0, "last"), (1, "last"), (1, "last"), (3, "last"), (0, "attn"), (7, None)], 2, {(1, "attn")}),
        ([(0, "last"), (0, "attn")], 1, set()),
    ],
)
def test_layers_up_to_the_first_gap(spark, cells, layers, gaps):
    df = spark.createDataFrame(cells, "layer int, pool string").withColumn("other", F.lit(1))
    assert caches.layer_count(df).collect() == [(layers,)]
    assert {tuple(r) for r in caches.cell_gaps(df, ["last", "attn"]).collect()} == gaps
