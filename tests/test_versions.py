import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voxloom.sources import versions


def table(spark, path, n=1000, slices=8, buckets=4):
    rows = spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("double").alias("similarity"))
    versions.create(rows, path, "id", slices, buckets)
    return rows


def files(spark, path):
    v = versions.version(spark, path)
    return {s: sorted(f.name for f in Path(x.removeprefix("file:")).glob("*.parquet")) for s, x in v.folders.items()}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_update_rewrites_touched_slices_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path)
    before = files(spark, path)
    assert len(before) == 8 and all(len(f) == 4 for f in before.values())
    changes = spark.createDataFrame([(3, 0.5), (5, 0.25), (5, 0.75), (1 << 60, 1.0), (None, 1.0)], "id long, similarity double")
    assert versions.updated(spark, path, changes).number == 2
    after = files(spark, path)
    assert [s for s in before if before[s] != after[s]] == ["0", "7"]
    got = {r["id"]: r["similarity"] for r in versions.opened(spark, path).collect()}
    assert len(got) == 1000 and {i: s for i, s in got.items() if s is not None} == {3: 0.5, 5: 0.75}
    assert versions.opened(spark, path, 1).filter("similarity is not null").count() == 0
    assert all(len(f) == 4 for f in after.values())


def test_update_to_null_and_delete(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path)
    versions.updated(spark, path, spark.createDataFrame([(7, None)], "id long, text string"))
    ids = spark.range(0, 200).union(spark.createDataFrame([(999,), (None,), (999,)], "id long"))
    v = versions.deleted(spark, path, ids)
    assert v.number == 3 and "0" not in v.folders
    assert sorted(r["id"] for r in versions.opened(spark, path).collect()) == list(range(200, 999))
    assert versions.opened(spark, path, 2).filter("text is null").select("id").collect()[0][0] == 7
    with pytest.raises(FileNotFoundError):
        versions.opened(spark, path, 9)


def test_table_side_has_no_exchange(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path)
    v = versions.version(spark, path)
    held = versions._registered(spark, path, v)
    changes = spark.createDataFrame([(3, 0.5)], "id long, similarity double")
    for plan in (versions.update_plan(held, v, changes), versions.delete_plan(held, v, changes)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        scan = next(i for i, line in enumerate(text.split("\n")) if "FileScan parquet" in line)
        above = text.split("\n")[:scan]
        depth = text.split("\n")[scan].index("FileScan")
        ancestors, at = [], depth
        for line in reversed(above):
            indent = len(line) - len(line.lstrip(" :+-*|"))
            if indent < at:
                ancestors, at = [*ancestors, line], indent
        assert "SortMergeJoin" in text and not any("Exchange" in line for line in ancestors), text
        assert "SelectedBucketsCount: 4 out of 4" in text and text.count("Exchange hashpartitioning") == 1


def test_odd_tables(spark, tmp_path):
    empty = str(tmp_path / "empty")
    table(spark, empty, 0)
    assert versions.opened(spark, empty).count() == 0
    assert versions.updated(spark, empty, spark.createDataFrame([(3, "x")], "id long, text string")).number == 2
    assert versions.opened(spark, empty).columns == ["id", "text", "similarity"]
    odd = spark.createDataFrame([(None, "a", 1), (4, None, 2), (4, "é" * 10_000, 3), ((1 << 62) + 1, "", 4)], "id long, _slice string, `a b` int")
    path = str(tmp_path / "odd")
    versions.create(odd, path, "id", 3, 2)
    assert rows_of(versions.opened(spark, path)) == rows_of(odd)
    versions.updated(spark, path, spark.createDataFrame([(4, 9), (None, 9)], "id long, `a b` int"))
    got = {(r[0], r[2]) for r in versions.opened(spark, path).collect()}
    assert got == {(None, 1), (4, 9), ((1 << 62) + 1, 4)} and versions.opened(spark, path).count() == 4
    with pytest.raises(versions.VersionConflict):
        versions.create(odd, path, "id", 3, 2)
    with pytest.raises(ValueError, match="columns of the table"):
        versions.updated(spark, path, spark.createDataFrame([(4, 9)], "id long, other int"))


def test_one_of_two_writers_publishes(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, 100, 2, 2)
    v = versions.version(spark, path)
    results = []

    def write():
        try:
            results.append(versions._publish(spark, path, versions.Version(2, v.key, v.slice, v.buckets, v.cuts, v.schema, v.folders)).number)
        except versions.VersionConflict:
            results.append("conflict")

    writers = [threading.Thread(target=write) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(map(str, results)) == ["2", "conflict"] and versions.versions(spark, path) == [1, 2]


def test_forget_keeps_what_versions_name(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = table(spark, path)
    versions.updated(spark, path, spark.createDataFrame([(3, 0.5)], "id long, similarity double"))
    versions.updated(spark, path, spark.createDataFrame([(3, None)], "id long, similarity double"))
    want = files(spark, path)
    versions.forget(spark, path)
    assert versions.versions(spark, path) == [3] and files(spark, path) == want
    assert rows_of(versions.opened(spark, path)) == rows_of(rows)
    assert len([p for p in tmp_path.glob("t/rows-*")]) == 2
