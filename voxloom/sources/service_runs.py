"""Runs of a paraphrase service that can stop anywhere: each batch is committed as it ends, and no later run asks for it again.

A batch is known by a hash of its ids and prompt lines. Its texts and the responses that failed on the way (dead letters)
are one Parquet file in the run's folder, which appears under its name whole or not at all. A task that is tried again, a
second copy of a task and a later run all find what is there. A batch that failed to the end leaves its letters only, in
a file of its own, and is asked for again by the next run.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.corpus import RateLimited, client_lines
from ..operators.sampling import numbered
from .services import Paraphraser, Processing

SCHEMA = pa.schema([("batch", pa.string()), ("kind", pa.string()), ("id", pa.int64()), ("line_hash", pa.int64()), ("text", pa.string()), ("attempt", pa.int32()), ("reason", pa.string()), ("response", pa.string())])
STORED = "batch string, kind string, id long, line_hash long, text string, attempt int, reason string, response string"
OUTCOME = "batch string, outcome string, attempts int, records int"


@dataclass(frozen=True)
class Folder:
    """Where a run's batches are: any file system that pyarrow can name (local, hdfs, s3, gs), as tasks write there themselves."""

    uri: str

    def at(self, name: str) -> tuple[pafs.FileSystem, str]:
        fs, path = pafs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (pafs.LocalFileSystem(), self.uri)
        return fs, f"{path}/{name}"

    def has(self, name: str) -> bool:
        fs, path = self.at(name)
        return fs.get_file_info(path).type == pafs.FileType.File

    def read(self, name: str) -> pa.Table:
        fs, path = self.at(name)
        with fs.open_input_file(path) as f:
            return pq.read_table(f)

    def commit(self, name: str, rows: list[dict]) -> None:
        """Write beside, then rename: readers see the file whole or not at all, and one that is there stays."""
        if self.has(name):
            return
        fs, end = self.at(name)
        beside = self.at(f"unfinished/{uuid.uuid4().hex}")[1]
        for path in (beside, end):
            fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(beside) as f:
            pq.write_table(pa.Table.from_pylist(rows, SCHEMA), f)
        fs.move(beside, end)

    def table(self, spark: SparkSession, part: str) -> DataFrame:
        fs, path = self.at(part)
        fs.create_dir(path, recursive=True)
        return spark.read.schema(STORED).parquet(f"{self.uri.rstrip('/')}/{part}")


def batch_name(ids: list[int], lines: list[str]) -> str:
    return hashlib.sha256(json.dumps([ids, lines]).encode()).hexdigest()[:40]


def asked(client: Paraphraser, lines: list[str], speakers: list[str], how: Processing) -> tuple[list[str] | None, int, list[tuple[int, str, str | None]]]:
    """(texts or None, attempts, letters (attempt, reason, response)) of one batch: see ``corpus.paraphrased`` for the rules."""
    strict, letters = False, []
    for attempt in range(1, how.max_retries + 1):
        wait = how.retry_delay
        try:
            answer = client.paraphrase(lines, strict)
        except RateLimited:
            wait = how.retry_delay * attempt
            letters.append((attempt, "RateLimited", None))
        except Exception as e:
            letters.append((attempt, type(e).__name__, None))
        else:
            status, texts = client_lines(answer, speakers)
            if status == "ok":
                return texts, attempt, letters
            strict = True
            letters.append((attempt, status, answer))
        if attempt < how.max_retries:
            time.sleep(wait)
    return None, how.max_retries, letters


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(id, line_hash, text) of all finished batches."""
    return Folder(folder).table(spark, "done").filter("kind = 'text'").select("id", "line_hash", "text")


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, attempt, reason, response) of all attempts that failed, of finished and of failed batches."""
    store = Folder(folder)
    return store.table(spark, "done").union(store.table(spark, "failed")).filter("kind = 'letter'").select("batch", "attempt", "reason", "response")


def prompt_lines(rows: DataFrame) -> DataFrame:
    """(id, speaker, line, line_hash) of the rows that have a speaker and a text."""
    line = X.prompt_line(F.col("speaker"), F.col("origin_text"))
    return rows.select("id", "speaker", line.alias("line")).filter("line is not null").withColumn("line_hash", F.xxhash64("line"))


def run(rows: DataFrame, client: Paraphraser, folder: str, how: Processing | None = None) -> dict[str, int]:
    """Ask the service for all rows (id, speaker, origin_text) that have no text yet; counts of batches and records by outcome.

    Rows of finished batches (same id and prompt line) are left out first; the others go in batches of ``batch_size`` in
    the order of ids, ``concurrency`` at a time. ``skipped`` batches were committed by another try of the task.
    Rows that repeat are asked for once; those without an id, speaker or text never are. ``folder`` must be shared by all executors.
    """
    how, spark, store = how or Processing(), rows.sparkSession, Folder(folder)
    todo = prompt_lines(rows).filter("id is not null").dropDuplicates(["id", "line_hash"])
    todo = todo.join(finished(spark, folder).select("id", "line_hash"), ["id", "line_hash"], "left_anti")
    dealt = numbered(todo, [F.asc("id"), F.asc("line_hash")]).withColumn("slot", F.floor((F.col("number") - 1) / how.batch_size))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        ids, lines = pdf["id"].tolist(), pdf["line"].tolist()
        name = batch_name(ids, lines)
        outcome, attempts, n = "skipped", 0, 0
        if not store.has(f"done/{name}.parquet"):
            texts, attempts, letters = asked(client, lines, pdf["speaker"].tolist(), how)
            kept = [{"batch": name, "kind": "letter", "attempt": a, "reason": r, "response": x} for a, r, x in letters]
            outcome = "failed" if texts is None else "done"
            if texts is not None:
                n = len(texts)
                kept += [{"batch": name, "kind": "text", "id": i, "line_hash": h, "text": t} for i, h, t in zip(ids, pdf["line_hash"].tolist(), texts, strict=True)]
            store.commit(f"{outcome}/{name}{'' if texts is not None else '-' + uuid.uuid4().hex}.parquet", kept)
        return pd.DataFrame({"batch": [name], "outcome": [outcome], "attempts": [attempts], "records": [n]}).astype({"attempts": "int32", "records": "int32"})

    outcomes = dealt.repartition(how.concurrency, "slot").groupBy("slot").applyInPandas(one, OUTCOME)
    got = outcomes.groupBy("outcome").agg(F.count("*").alias("batches"), F.sum("records").alias("records")).collect()
    return {"done": 0, "failed": 0, "skipped": 0} | {r["outcome"]: r["batches"] for r in got} | {"records": sum(r["records"] for r in got)}


def with_texts(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with para_text from finished batches where the prompt line is still the same; others keep what they have."""
    done = finished(rows.sparkSession, folder).dropDuplicates(["id", "line_hash"]).select(F.col("id").alias("_id"), F.col("line_hash").alias("_hash"), F.col("text").alias("_text"))
    hashed = F.xxhash64(X.prompt_line(F.col("speaker"), F.col("origin_text")))
    both = rows.withColumn("_line", hashed).join(done, (F.col("id") == F.col("_id")) & (F.col("_line") == F.col("_hash")), "left")
    return both.withColumn("para_text", F.coalesce("_text", "para_text")).drop("_line", "_id", "_hash", "_text")
