"""Runs of a paraphrase service that stop in the middle: what is asked for, what is kept."""

import os

import pytest
from pyspark.sql import functions as F

from voxloom.operators.corpus import RateLimited
from voxloom.sources import service_runs as R
from voxloom.sources.services import Processing

HOW = Processing(batch_size=4, max_retries=3, retry_delay=0, concurrency=2)


class Counted:
    """Answers in capitals and writes each call to a folder; ``dies`` once, at the call of a batch that has this line."""

    def __init__(self, folder, dies=None, wrong=(), limited=()):
        self.folder, self.dies, self.wrong, self.limited = str(folder), dies, wrong, limited

    def paraphrase(self, lines, strict):
        with open(f"{self.folder}/{os.getpid()}-{len(os.listdir(self.folder))}", "w") as f:
            f.write("\n".join(lines))
        if self.dies in lines:
            mark = f"{self.folder}-died"
            if not os.path.exists(mark):
                open(mark, "w").close()
                os._exit(1)
        if any(w in lines for w in self.limited):
            raise RateLimited
        if any(w in lines for w in self.wrong) and not strict:
            return "B：nothing"
        return "\n".join(f"{x.partition('：')[0]}：{x.partition('：')[2].upper()}" for x in lines)


def calls(folder):
    return ["".join(open(f"{folder}/{n}").read()).split("\n") for n in os.listdir(folder)]


@pytest.fixture
def rows(spark):
    data = [(i * i * 1000, "A", f"text {i}", None) for i in range(30)] + [(-1, " ", "no speaker", None), (-2, "A", None, None), (None, "A", "no id", None), (0, "A", "text 0", None)]
    return spark.createDataFrame(data, "id long, speaker string, origin_text string, para_text string")


def test_a_task_that_dies_costs_one_batch(spark, rows, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    client, store = Counted(asked, dies="A：text 17"), f"{tmp_path}/run"
    with pytest.raises(Exception, match="crashed|exited|EOF|Python worker"):
        R.run(rows, client, store, HOW)
    kept = {r["id"] for r in R.finished(spark, store).collect()}
    assert 0 < len(kept) < 30 and 17 * 17 * 1000 not in kept
    before = calls(asked)
    done = R.run(rows, client, store, HOW)
    again = [c for c in calls(asked) if c not in before or before.remove(c)]
    assert done["failed"] == 0 and done["records"] == 30 - len(kept)
    # no line of a finished batch was sent again
    assert sum(map(len, again)) == 30 - len(kept)
    texts = {r["id"]: r["text"] for r in R.finished(spark, store).collect()}
    assert texts == {i * i * 1000: f"TEXT {i}" for i in range(30)} and R.finished(spark, store).count() == 30
    n = len(calls(asked))
    assert R.run(rows, client, store, HOW) == {"done": 0, "failed": 0, "skipped": 0, "records": 0} and len(calls(asked)) == n


def test_failures_are_letters_and_tried_again(spark, rows, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    store = f"{tmp_path}/run"
    got = R.run(rows, Counted(asked, wrong=["A：text 5"], limited=["A：text 12"]), store, HOW)
    assert got == {"done": 7, "failed": 1, "skipped": 0, "records": 26}
    letters = sorted((r["attempt"], r["reason"], r["response"]) for r in R.dead_letters(spark, store).collect())
    assert letters == [(1, "RateLimited", None), (1, "count_mismatch", "B：nothing"), (2, "RateLimited", None), (3, "RateLimited", None)]
    assert R.run(rows, Counted(asked), store, HOW)["records"] == 4
    assert R.dead_letters(spark, store).count() == 4
    out = {r["id"]: r["para_text"] for r in R.with_texts(rows.dropDuplicates(["id"]), store).collect()}
    assert out[25_000] == "TEXT 5" and out[-1] is None and out[None] is None and len(out) == 33
    changed = rows.withColumn("origin_text", F.when(F.col("id") == 1000, "new").otherwise(F.col("origin_text")))
    assert {r["id"]: r["para_text"] for r in R.with_texts(changed, store).collect()}[1000] is None
    assert R.run(changed, Counted(asked), store, HOW)["records"] == 1


def test_a_committed_batch_is_skipped_by_another_try(spark, rows, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    store = R.Folder(f"{tmp_path}/run")
    name = R.batch_name([0, 1000, 4000, 9000], [f"A：text {i}" for i in range(4)])
    store.commit(f"done/{name}.parquet", [{"batch": name, "kind": "text", "id": -9, "line_hash": 1, "text": "other"}])
    assert R.run(rows, Counted(asked), store.uri, HOW) == {"done": 7, "failed": 0, "skipped": 1, "records": 26}
    store.commit(f"done/{name}.parquet", [])
    assert store.read(f"done/{name}.parquet").num_rows == 1
    assert R.run(rows.filter("id < -5"), Counted(asked), store.uri, HOW)["records"] == 0
