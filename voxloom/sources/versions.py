"""Tables with versions: sliced and bucketed by an id, so that an update rewrites the slices it touches and nothing else.

A table is a folder. Its rows lie in Parquet folders, one for each slice (a range of ids), bucketed by id within; a version is
a small file that names the folder of each slice. An update or delete joins the touched slices with the changes bucket
by bucket, without moving the table's rows, writes those slices anew beside the old ones, and publishes the next version
by one rename. Readers see a version whole or not at all, and a writer that lost its executors or died leaves
only folders that no version names; ``forget`` deletes them.

Ids are numbers. Null ids have a slice of their own, are kept, and no change meets them. An id may repeat: a change
meets all its rows. But it should be a key, as equal ids share one bucket and so one task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import apart
from ..session import materialised, own_stages


class VersionConflict(RuntimeError):
    """Another writer published the version first; run the change again on what it left."""


@dataclass(frozen=True)
class Version:
    """``cuts``: the ids at which slices but the first begin; ``folders``: where each slice that has rows lies."""

    number: int
    key: str
    slice: str
    buckets: int
    cuts: list[float]
    schema: str
    folders: dict[str, str]


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _listed(spark: SparkSession, path: str) -> list[str]:
    p = _path(spark, path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p = _path(spark, path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are published, ascending."""
    return [int(n.removesuffix(".json")) for n in _listed(spark, f"{path}/versions") if n.endswith(".json") and n[0] != "."]


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version by its number, by default the last."""
    known = versions(spark, path)
    if not known or number is not None and number not in known:
        raise FileNotFoundError(f"no version {number or ''} at {path}")
    text = spark.read.text(f"{path}/versions/{number or known[-1]:06d}.json", wholetext=True).first()[0]
    return Version(**json.loads(text))


def _publish(spark: SparkSession, path: str, v: Version) -> Version:
    """Make ``v`` the next version, unless there is one of its number already: a rename that doesn't replace decides."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside, end = _path(spark, f"{path}/versions/.{uuid.uuid4().hex}"), _path(spark, f"{path}/versions/{v.number:06d}.json")
    out = beside.getFileSystem(conf).create(beside, False)
    out.write(bytearray(json.dumps(asdict(v)).encode()))
    out.close()
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.getFileSystem(conf).getUri(), conf).rename(beside, end, keep)
    except Exception as e:
        beside.getFileSystem(conf).delete(beside, False)
        if v.number in versions(spark, path):
            raise VersionConflict(f"version {v.number} of {path}") from e
        raise
    return v


def sliced(rows: DataFrame, v: Version) -> DataFrame:
    """``rows`` with the slice of each id: how many cuts are at or below it; null ids come last."""
    p = apart(rows)
    ends = [-float("inf"), *(v.cuts or [0.0]), float("inf")]
    put = Bucketizer(splits=ends, inputCol=f"{p}id", outputCol=f"{p}at", handleInvalid="keep")
    placed = put.transform(rows.withColumn(f"{p}id", F.coalesce(F.col(v.key).cast("double"), F.lit(float("nan")))))
    return placed.withColumn(v.slice, F.col(f"{p}at").cast("int")).drop(f"{p}id", f"{p}at")


def _written(rows: DataFrame, path: str, v: Version) -> dict[str, str]:
    """Slices of ``rows`` in a new folder: one file for each slice and bucket, if each task has whole buckets."""
    spark, folder, name = rows.sparkSession, f"{path}/rows-{uuid.uuid4().hex}", f"voxloom_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", folder).partitionBy(v.slice).bucketBy(v.buckets, v.key).sortBy(v.key).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    begin = f"{v.slice}="
    return {n.removeprefix(begin): f"{folder}/{n}" for n in _listed(spark, folder) if n.startswith(begin)}


def create(rows: DataFrame, path: str, key: str, slices: int = 64, buckets: int = 64) -> Version:
    """A table of ``rows`` at ``path`` as version 1.

    ``slices`` is what an update can leave alone, ``buckets`` how many tasks join and rewrite; files number their product. Slices
    have about equal rows: their cuts are quantiles of the ids. Columns keep their names, whatever they are; an empty table has no slice.
    """
    spark = rows.sparkSession
    if versions(spark, path):
        raise VersionConflict(f"there is a table at {path}")
    with own_stages(spark):
        held = materialised(rows)
        at = held.select(F.col(key).cast("double").alias("x")).approxQuantile("x", [i / slices for i in range(1, slices)], 0.1 / slices)
        v = Version(1, key, f"{apart(rows)}slice", buckets, sorted(set(at)), rows.schema.json(), {})
        folders = _written(sliced(held, v).repartition(buckets, key), path, v)
    return _publish(spark, path, Version(**asdict(v) | {"folders": folders}))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _registered(spark: SparkSession, path: str, v: Version) -> DataFrame:
    """A version with its slice column, as a table of the session's catalogue, which tells Spark of slices and buckets."""
    name = f"voxloom_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{v.number}"
    if not spark.catalog.tableExists(name):
        schema = T.StructType.fromJson(json.loads(v.schema))
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
        by = f"PARTITIONED BY ({v.slice}) CLUSTERED BY ({_quoted(v.key)}) SORTED BY ({_quoted(v.key)}) INTO {v.buckets} BUCKETS"
        spark.sql(f"CREATE TABLE {name} ({columns}, {v.slice} INT) USING parquet {by} LOCATION '{path}/none'")
        if v.folders:
            parts = " ".join(f"PARTITION ({v.slice} = {s}) LOCATION '{f}'" for s, f in v.folders.items())
            spark.sql(f"ALTER TABLE {name} ADD {parts}")
    return spark.table(name)


def opened(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version, by default the last: bucketed by id, so that joins and groups by id don't move them."""
    v = version(spark, path, number)
    return _registered(spark, path, v).drop(v.slice)


def _touched(spark: SparkSession, path: str, v: Version, changes: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows of the slices that hold ids of ``changes``, and those slices: at most as many as the table has."""
    at = sliced(changes.select(v.key), v).select(v.slice).distinct()
    slices = sorted({str(s) for (s,) in at.collect()} & set(v.folders))
    return _registered(spark, path, v).filter(F.col(v.slice).isin([int(s) for s in slices])), slices


def _replaced(spark: SparkSession, path: str, v: Version, rows: DataFrame, slices: list[str]) -> Version:
    folders = {s: f for s, f in v.folders.items() if s not in slices}
    new = _written(rows, path, v) if slices else {}
    try:
        return _publish(spark, path, Version(**asdict(v) | {"number": v.number + 1, "folders": folders | new}))
    except VersionConflict:
        for f in new.values():
            _delete(spark, f)
        raise


def update_plan(rows: DataFrame, v: Version, changes: DataFrame) -> DataFrame:
    """``rows`` of a version with the columns of ``changes`` set where ids meet, to nulls too. The changes alone are shuffled."""
    p = apart(rows)
    values = [c for c in changes.columns if c != v.key]
    one = changes.filter(F.col(v.key).isNotNull()).groupBy(F.col(v.key).alias(f"{p}id")).agg(F.max(F.struct(*values)).alias(f"{p}new"))
    met = rows.join(one.hint("merge"), F.col(v.key) == F.col(f"{p}id"), "left")
    set_to = [F.when(F.col(f"{p}id").isNotNull(), F.col(f"{p}new")[c].cast(rows.schema[c].dataType)).otherwise(F.col(_quoted(c))).alias(c) if c in values else F.col(_quoted(c)) for c in rows.columns]
    return met.select(*set_to)


def updated(spark: SparkSession, path: str, changes: DataFrame) -> Version:
    """Set columns by id: ``changes`` holds the id and some of the table's other columns. Returns the version that has them.

    Of changes that repeat an id the greatest counts, column by column in their order; ids that the table lacks change nothing.
    Without changes there is a new version of the same files.
    """
    v = version(spark, path)
    known = {f["name"] for f in json.loads(v.schema)["fields"]}
    if not set(changes.columns) <= known or v.key not in changes.columns or len(changes.columns) < 2:
        raise ValueError(f"changes need {v.key} and columns of the table, not {sorted(changes.columns)}")
    with own_stages(spark):
        held = materialised(changes)
        rows, slices = _touched(spark, path, v, held)
        return _replaced(spark, path, v, update_plan(rows, v, held), slices)


def delete_plan(rows: DataFrame, v: Version, ids: DataFrame) -> DataFrame:
    """``rows`` of a version without those whose id is among ``ids``. The ids alone are shuffled."""
    gone = ids.select(F.col(v.key).alias(f"{apart(rows)}id"))
    return rows.join(gone.hint("merge"), F.col(v.key) == gone[0], "left_anti")


def deleted(spark: SparkSession, path: str, ids: DataFrame) -> Version:
    """Delete the rows of some ids (the column of the table's key). Returns the version without them."""
    v = version(spark, path)
    with own_stages(spark):
        held = materialised(ids)
        rows, slices = _touched(spark, path, v, held)
        return _replaced(spark, path, v, delete_plan(rows, v, held), slices)


def forget(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all versions but the last ``keep``, and the folders of slices that no version left names.

    Only while nobody writes or reads older versions: a writer's folders have no version yet.
    """
    known = versions(spark, path)
    gone, left = known[:-keep], [version(spark, path, n) for n in known[-keep:]]
    named = {f for v in left for f in v.folders.values()}
    for n in gone:
        spark.sql(f"DROP TABLE IF EXISTS voxloom_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{n}")
        _delete(spark, f"{path}/versions/{n:06d}.json")
    for folder in _listed(spark, path):
        if folder.startswith("rows-"):
            inside = [f"{path}/{folder}/{s}" for s in _listed(spark, f"{path}/{folder}") if "=" in s]
            for f in inside:
                if f not in named:
                    _delete(spark, f)
            if not any(f in named for f in inside):
                _delete(spark, f"{path}/{folder}")
