"""Line dedup: range-partitioned line hashes, streamed in order, give per-document keep bitmaps.

Plan (built-in functions only):

1. split every text at line feeds; a line becomes a 128-bit hash of its key, its document and position;
2. range-partition by hash and a document bucket, sorted by hash, document and position. The bucket
   spreads a line that a third of all documents hold over many partitions, and range partitioning on
   exactly these columns lets the window below stream without another shuffle;
3. one pass over each sorted run flags the first line of each document and the first occurrence;
4. per-bucket counts meet in a second, far smaller shuffle that gives each key's document count and
   first occurrence over all buckets;
5. only lines to drop are grouped by document, into runs of kept line numbers.

What is returned per document is a run-length compressed bitmap, not text; ``apply`` turns it into text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, fresh, materialise, shuffle_partitions


def lines_of(text: Column) -> Column:
    """A text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What makes lines equal: white space at both ends stripped, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def keep_bitmaps(docs: DataFrame, mode: str = "all", min_docs: int = 10, min_chars: int = 1, doc_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: (doc, text_hash, n_dropped, drop_runs).

    ``mode`` "all": a key of at least ``min_chars`` code points that at least ``min_docs`` documents
    hold loses all its lines. ``mode`` "first": of every such key the first occurrence by document and
    position stays and later ones go (``min_docs`` is then not used). ``drop_runs`` is the run-length
    compressed bitmap: runs (first, last) of line numbers from 0 that go, all others stay; documents that
    aren't returned keep every line. A document is a row's (doc_col, text): rows that repeat both are one document and
    share a bitmap. Null ids form documents of their own, null and empty texts are one empty line, very long texts
    are split whole, and an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    if mode not in ("all", "first"):
        raise ValueError(f"mode must be all or first, not {mode!r}")
    n = buckets or max(64, shuffle_partitions(docs.sparkSession))
    text = F.col(text_col)
    exploded = docs.select(F.col(doc_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keyed = exploded.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    # sampling the ranges and both uses below read the hashes; texts are split only once
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int").alias("bucket"), "doc", "text_hash", "pos")
    ordered = materialise(hashed).repartitionByRange("h1", "bucket").sortWithinPartitions("h1", "h2", "bucket", "doc", "text_hash", "pos")
    run = W.partitionBy("h1", "h2", "bucket").orderBy("doc", "text_hash", "pos")
    before = F.lag(F.struct("doc")).over(run)
    streamed = ordered.withColumn("opens", (before.isNull() | ~before.eqNullSafe(F.struct("doc"))).cast("int"))
    local = streamed.groupBy("h1", "h2", "bucket").agg(F.sum("opens").alias("docs"), F.count("*").alias("rows"), F.min(F.struct("doc", "text_hash", "pos")).alias("head"))
    over_key = W.partitionBy("h1", "h2")
    total = local.withColumn("all_docs", F.sum("docs").over(over_key)).withColumn("all_rows", F.sum("rows").over(over_key)).withColumn("first", F.min("head").over(over_key))
    wanted = F.col("all_docs") >= min_docs if mode == "all" else F.col("all_rows") > 1
    hit = total.filter(wanted).select("h1", "h2", "bucket", "first")
    marked = ordered.join(hit, ["h1", "h2", "bucket"])
    if mode == "first":
        marked = marked.filter(~F.struct("doc", "text_hash", "pos").eqNullSafe(F.col("first")))
    dropped = marked.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return dropped.select("doc", "text_hash", F.size("gone").cast("long").alias("n_dropped"), drop_runs(F.col("gone")).alias("drop_runs"))


def drop_runs(gone: Column) -> Column:
    """Sorted line numbers as runs (first, last), in linear time."""
    at = lambda i: F.get(gone, i)
    firsts = F.filter(gone, lambda x, i: (i == 0) | (at(i - 1) != x - 1))
    lasts = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (at(i + 1) != x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def keep_runs(n_lines: Column, runs: Column) -> Column:
    """The complement of ``runs`` in 0..n_lines-1, as (first, length) runs."""
    m = F.size(runs)
    gaps = F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["last"] + 1).alias("first"), F.when(i == m, n_lines).otherwise(F.get(runs, i)["first"]).alias("end")))
    return F.transform(F.filter(gaps, lambda g: g["end"] > g["first"]), lambda g: F.struct(g["first"].alias("first"), (g["end"] - g["first"]).alias("length")))


def apply(docs: DataFrame, bitmaps: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text column replaced by the kept lines, and columns n_lines, n_dropped and keep_runs.

    Clashing columns of ``docs`` get new values; all others, whatever their names, stay. No row is lost, and an empty table
    gives no rows.
    """
    right = {c: fresh(f"_bm_{c}", docs.columns) for c in ("doc", "text_hash", "n_dropped", "drop_runs")}
    marks = bitmaps.select([F.col(c).alias(name) for c, name in right.items()])
    same = docs[doc_col].eqNullSafe(marks[right["doc"]]) & (F.xxhash64(docs[text_col]) == marks[right["text_hash"]])
    lines = lines_of(F.col(text_col))
    names = {c: fresh(f"_ld_{c}", [*docs.columns, *right.values()]) for c in ("lines", "keep")}
    joined = docs.join(marks, same, "left").withColumn(names["lines"], lines)
    total = F.size(names["lines"])
    joined = joined.withColumn(names["keep"], keep_runs(total, F.coalesce(F.col(right["drop_runs"]), F.array().cast("array<struct<first:int,last:int>>"))))
    kept = F.flatten(F.transform(names["keep"], lambda r: F.slice(F.col(names["lines"]), r["first"] + 1, r["length"])))
    text = F.when(F.col(right["n_dropped"]).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "keep_runs")]
    cols = [text.alias(c) if c == text_col else F.col(c) for c in out]
    return joined.select(*cols, total.cast("long").alias("n_lines"), F.coalesce(right["n_dropped"], F.lit(0).cast("long")).alias("n_dropped"), F.col(names["keep"]).alias("keep_runs"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), l AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 10
), m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
