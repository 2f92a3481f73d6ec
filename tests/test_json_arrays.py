"""Splittable JSON arrays against json.load, at small and large byte ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from voxloom.sources import json_arrays as J

HARD = [
    {"I": 1, "S": "A", "T": "plain"}, {"T": 'quote " brace } and { \\ end\\'}, {"T": "}}}{{{"}, {"T": '"}"{"'}, {}, {"a": {"b": {"c": "}"}}, "d": [{"e": 1}, {"f": "{"}]}, {"T": "line\nend\r\n\t"},
    {"T": "日本語 “”😀"}, {"T": "\\"}, {"T": '\\"'}, {"T": '\\\\"}'}, {"T": "", "S": None}, {"T": "x" * 300}, {"T": "],[{"}, {"T": " \x7f"},
]


def load(spark, path):
    got = J.array_records(spark, path).orderBy("file", "block", "place").collect()
    return [json.loads(r["value"]) for r in got]


@pytest.mark.parametrize("size", [7, 8, 13, 29, 64, 1000, 128 << 20])
@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_equals_json_load(spark, tmp_path, size, style):
    path = tmp_path / "array.json"
    rng = random.Random(size)
    items = rng.sample(HARD, len(HARD)) + [{"I": i, "T": "".join(rng.choices('a"{}\\[],: \n', k=rng.randint(0, 12)))} for i in range(20)]
    path.write_text(json.dumps(items, **style), encoding="utf-8")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        assert load(spark, str(path)) == items
        if size == 7:
            assert J.fragments(spark, str(path)).rdd.getNumPartitions() > 20
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)


def test_odd_files(spark, tmp_path):
    for name, text in (("a.json", ""), ("b.json", "[]"), ("c.json", '[1, "}", null, {"x": 1}, [2]]'), ("d.json", '{"x": 2}'), ("e.json", '{"x": 3}\n{"x": 4}\n'), ("f.json", '[{"x": 5}, {"x": ')):
        (tmp_path / name).write_text(text)
    whole = J.array_records(spark, str(tmp_path)).select(F.get_json_object("value", "$.x").alias("x")).collect()
    assert sorted(int(r["x"]) for r in whole if r["x"]) == [1, 2, 3, 4, 5]


def test_round_trip_of_written_arrays(spark, tmp_path):
    df = spark.createDataFrame([(i, 'A"{', f"t}} {i}\n") for i in range(50)], "I long, S string, T string").repartitionByRange(4, "I").sortWithinPartitions("I")
    J.write_arrays(df, str(tmp_path / "out"))
    assert load(spark, str(tmp_path / "out")) == [r.asDict() for r in df.orderBy("I").collect()]
    for f in (tmp_path / "out").glob("part-*"):
        json.loads(f.read_text())
