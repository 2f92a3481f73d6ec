"""Large JSON arrays read by many tasks: byte ranges find the borders of records by the state of strings and braces.

1. The text reader cuts a file at every ``}`` and splits it by bytes as usual; a fragment is never cut. An escape never
   crosses a fragment's end, so the parity of its quotes, and its braces for either state, don't depend on what came before.
2. One pass sums those by range; sums over the ranges before give each range's first state and depth.
3. A second pass follows the state and emits whole records, and of a record that crosses ranges its pieces, at most two a
   range, which are put together by one small shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A quote, or an escape with what it escapes.
_MARK = re.compile(r'\\.|"', re.DOTALL)
PIECES = "file string, block long, place long, kind int, value string"
WHOLE, BEGINS, GOES_ON = 0, 1, 2


def outside(fragment: str, inside: bool) -> tuple[list[str], bool]:
    """The parts of a fragment that lie outside strings, and whether its end lies inside one."""
    parts, at = [], 0
    for m in _MARK.finditer(fragment):
        if m[0] == '"':
            if not inside:
                parts.append(fragment[at : m.start()])
            inside, at = not inside, m.end()
    if not inside:
        parts.append(fragment[at:])
    return parts, inside


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between closing braces, in the order of the file within each block (byte range)."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), "value")


def block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, odd, from_outside, from_inside): whether quotes are odd, and the change of depth from either state."""
    sums: dict[tuple, list[int]] = {}
    for b in batches:
        for file, block, value in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            s = sums.setdefault((file, block), [0, 0, 0])
            ends = [outside(value, inside) for inside in (False, True)]
            for first in (0, 1):
                parts, inside = ends[(s[0] + first) % 2]
                s[1 + first] += sum(p.count("{") for p in parts) - (not inside)
            s[0] = (s[0] + ends[0][1]) % 2
    keys = list(sums)
    columns = [[k[0] for k in keys], [k[1] for k in keys], *([sums[k][i] for k in keys] for i in range(3))]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "odd", "from_outside", "from_inside"])


def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments with their block's first ``inside`` and ``depth`` to records and pieces of records."""
    at, held, place, inside, depth, crossing = None, [], 0, False, 0, False
    out: list[tuple] = []

    def left() -> list[tuple]:
        return [(*at, -1 if crossing else place, GOES_ON if crossing else BEGINS, "".join(held))] if at and held else []

    for b in batches:
        for file, block, value, first_inside, first_depth in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
            if (file, block) != at:
                out += left()
                at, held, place, inside, depth = (file, block), [], 0, bool(first_inside), first_depth
                crossing = depth > 0
            parts, inside = outside(value, inside)
            opened = sum(p.count("{") for p in parts)
            if not depth and opened:
                held, value = [], value[value.index("{") :]
            if depth + opened > 0:
                held.append(value + "}")
            depth = max(depth + opened - (not inside), 0)
            if held and not depth:
                out.append((*at, -1 if crossing else place, GOES_ON if crossing else WHOLE, "".join(held)))
                place, held, crossing = place + (not crossing), [], False
        yield table_of(out)
        out = []
    yield table_of(left())


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "block", "place", "kind", "value"])


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): the objects of JSON arrays at ``path``, one row each as text; the first three give their order.

    ``path`` is a file or a folder of files. A file is split as spark.sql.files.maxPartitionBytes says, whatever its lines are.
    Objects may nest and hold any text; elements that aren't objects are left out, and so is an object that never ends.
    """
    cut = fragments(spark, path)
    sums = cut.mapInArrow(block_sums, "file string, block long, odd long, from_outside long, from_inside long")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    states = sums.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    states = states.withColumn("change", F.when(F.col("inside") == 1, F.col("from_inside")).otherwise(F.col("from_outside")))
    states = states.select("file", "block", F.col("inside").cast("int").alias("inside"), F.coalesce(F.sum("change").over(before), F.lit(0)).cast("int").alias("depth"))
    # one row for each byte range, as many as tasks
    found = cut.join(F.broadcast(states), ["file", "block"]).select("file", "block", "bytes", "value", "inside", "depth").mapInArrow(records_of, PIECES)
    whole = found.filter(F.col("kind") == WHOLE).select("file", "block", "place", "value")
    own = F.when(F.col("kind") == BEGINS, F.struct("block", "place"))
    upto = W.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    pieces = found.filter(F.col("kind") != WHOLE).withColumn("start", F.last(own, ignorenulls=True).over(upto)).filter("start is not null")
    joined = pieces.groupBy("file", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("turn"), "value"))), lambda p: p["value"]), "").alias("value"))
    return whole.unionByName(joined.select("file", "start.block", "start.place", "value"))


def write_arrays(rows: DataFrame, path: str) -> None:
    """Each partition of ``rows`` as one file that is a JSON array of its rows, in their order."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([("," if begun else "[") + json.dumps(r, ensure_ascii=False)])], names=["value"])
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], names=["value"])

    rows.mapInArrow(lines, "value string").write.mode("overwrite").text(path)
