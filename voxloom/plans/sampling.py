"""Queries that count, sample, split and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import preview
from ..operators import sampling as S
from ..operators.corpus import spread_sample as spread
from .base import query, table

COUNTS = "c AS (SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source)::INT AS rank FROM c)"
TURN = "t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang")


@query("AGG4 TOP1 FIL4 SRT1", f"WITH {COUNTS} SELECT source, n, rank, CASE WHEN rank <= 8 THEN 'train' ELSE 'test' END AS split FROM r WHERE rank <= 10")
def speaker_counts_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest groups, the first 80 % of them for training: the limit is the operator."""
    top = S.ranked(docs(spark, sf_dir), "source").withColumn("rank", F.col("rank").cast("int")).filter("rank <= 10").orderBy("rank")
    return top.withColumn("split", F.when(F.col("rank") <= 8, "train").otherwise("test"))


@query("FIL9", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1 HAVING count(*) >= 200")
def having_min_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.counts(table(spark, sf_dir, "events"), "event_type").filter("n >= 200")


@query("PRJ4", "WITH c AS (SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1 UNION ALL SELECT -1, count(*) FROM events UNION ALL SELECT -2, count(*) FROM documents) SELECT user_id, n, (CASE WHEN n >= 10000 THEN 1000 WHEN n >= 1000 THEN 150 WHEN n >= 200 THEN 50 ELSE 0 END)::INT AS sample_size FROM c")
def tiered_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    whole = events.agg(F.lit(-1).cast("long").alias("user_id"), F.count("*").alias("n"))
    other = table(spark, sf_dir, "documents").agg(F.lit(-2).cast("long").alias("user_id"), F.count("*").alias("n"))
    return S.counts(events, "user_id").unionByName(whole).unionByName(other).withColumn("sample_size", F.coalesce(S.tier_size(F.col("n")), F.lit(0)))


@query("WIN1 FIL3", f"WITH {TURN} SELECT source, doc_id FROM t WHERE turn <= 10")
def per_speaker_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows per group: sampling is the operator."""
    return S.sample(docs(spark, sf_dir), "source", "doc_id", 10).select("source", "doc_id")


@query("WIN1 PRJ4", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents) SELECT t.lang, t.doc_id FROM t JOIN c ON t.lang = c.lang WHERE turn <= CASE WHEN n >= 10000 THEN 1000 WHEN n >= 1000 THEN 150 WHEN n >= 200 THEN 50 END")
def tiered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    sized = d.join(S.counts(d, "lang").select("lang", S.tier_size(F.col("n")).alias("size")), "lang")
    return S.sample(sized, "lang", "doc_id", F.col("size")).select("lang", "doc_id")


@query("WIN2", f"WITH {TURN} SELECT doc_id, source, turn::BIGINT AS turn FROM t")
def permutation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ordered(docs(spark, sf_dir), "source", "doc_id", 42).select("doc_id", "source", "turn")


@query("WIN2b", f"WITH {COUNTS}, l AS (SELECT source, n, (row_number() OVER (ORDER BY source) - 1)::INT AS label FROM c) SELECT label, unnest(range(1, least(n, 25) + 1))::INT AS item FROM l")
def label_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label per row that a sample of 25 per group holds, from counts alone."""
    roster = S.labels(S.counts(docs(spark, sf_dir), "source"), [F.col("source").asc()])
    return roster.select("label", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(25)).cast("int"))).alias("item"))


@query("WIN3 AGG4", f"WITH {COUNTS} SELECT source, (sum(n) OVER (ORDER BY source) - n)::BIGINT AS first, (sum(n) OVER (ORDER BY source))::BIGINT AS past FROM c")
def group_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each group's rows begin and end if groups follow each other by name: a running sum of counts."""
    sums = S.running_total(S.counts(docs(spark, sf_dir), "source"), [F.col("source").asc()], "n", "past")
    return sums.select("source", (F.col("past") - F.col("n")).alias("first"), "past")


@query("PRJ1 PRJ3 PRJ5 JN2 JN3 M6", """WITH roster(position, speaker, split, alias_of) AS (VALUES (0, 'user', 'train', 'user'), (1, 'assistant', 'train', 'assistant'), (2, 'system', 'gen', 'assistant')),
l AS (SELECT *, (dense_rank() OVER (PARTITION BY split ORDER BY position) - 1)::INT AS label FROM roster)
SELECT c.conv_id * 1000 + c.turn AS id, l.alias_of AS speaker, l.split, l.label FROM conversations c JOIN l ON c.role = l.speaker""")
def roster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a fixed roster, each with its split, label and display name."""
    roster = spark.createDataFrame([(0, "user", "train", "user"), (1, "assistant", "train", "assistant"), (2, "system", "gen", "assistant")], "position int, role string, split string, alias_of string")
    labelled = roster.withColumn("label", (F.dense_rank().over(W.partitionBy("split").orderBy("position")) - 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return turns.join(F.broadcast(labelled), "role").select("id", F.coalesce("alias_of", "role").alias("speaker"), "split", "label")


@query("SPL1", f"WITH {COUNTS} SELECT source, n, CASE WHEN rank <= floor((SELECT count(*) FROM c) * 0.8) THEN 'train' ELSE 'val' END AS split FROM r")
def split_speaker_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_groups(S.counts(docs(spark, sf_dir), "source"), [F.desc("n"), F.col("source")], 0.8)


@query("SPL2", f"WITH {COUNTS}, o AS (SELECT *, row_number() OVER (ORDER BY source) AS place FROM c) SELECT source, n, CASE WHEN place <= floor((SELECT count(*) FROM c) * 0.85) THEN 'train' ELSE 'val' END AS split FROM o")
def split_name_85_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_groups(S.counts(docs(spark, sf_dir), "source"), [F.col("source").asc()], 0.85)


@query("SPL3", f"WITH {TURN}, {COUNTS} SELECT doc_id, t.source, CASE WHEN turn <= greatest(1, floor(n * 0.8)) THEN 'train' ELSE 'val' END AS split FROM t JOIN c ON t.source = c.source")
def split_within_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_within(docs(spark, sf_dir), "source", "doc_id", 0.8).select("doc_id", "source", "split")


@query("SPL4 SET2", "WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents) SELECT doc_id, CASE WHEN turn <= floor((SELECT count(*) FROM documents) * 0.8) THEN 'train' ELSE 'val' END AS split FROM t")
def split_global_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_all(docs(spark, sf_dir), "doc_id", 0.8).select("doc_id", "split")


@query("SPL5 M7", f"WITH {TURN} SELECT doc_id, source, CASE WHEN turn <= 20 THEN 'train' ELSE 'val' END AS split FROM t WHERE turn <= 25")
def split_fixed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 training and 5 validation rows per group: the counts are the operator."""
    return S.split_fixed(docs(spark, sf_dir), "source", "doc_id", 20, 5).select("doc_id", "source", "split")


@query("SMP1", f"""WITH {TURN}, {COUNTS}, g AS (SELECT source, n, row_number() OVER (ORDER BY md5('42:' || source), source) - 1 AS r FROM c),
w AS (SELECT source, n, floor(r / 4)::BIGINT AS batch, unnest(range(0, 6))::INT AS item FROM g WHERE r < floor((SELECT count(*) FROM c) / 4) * 4)
SELECT batch, w.source, item, doc_id FROM w JOIN t ON t.source = w.source AND t.turn = item % n + 1""")
def pk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pk_batches(docs(spark, sf_dir), "source", "doc_id", p=4, k=6)


@query("SMP2 SET3")
def triplet_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.triplets(docs(spark, sf_dir), "source", "doc_id", 2048)


@query("SET1 SET3", "SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents WHERE lang = 'es' GROUP BY source HAVING count(*) >= 6")
def class_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("source").distinct().join(S.counts(d.filter("lang = 'es'"), "source").filter("n >= 6"), "source", "left_anti")


@query("TOP3 STR15", """WITH b AS (SELECT conv_id * 1000 + turn AS id, role, left(replace(text, chr(10), ' '), 80) AS preview FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY id) AS turn FROM b) SELECT id, role, preview FROM t WHERE turn <= ceil(10.0 / (SELECT count(DISTINCT role) FROM b)) ORDER BY role, turn LIMIT 10""")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows spread over batches, for display: the limit is the operator."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", preview(F.col("text")).alias("preview"))
    return spread(turns, "role", F.col("id"), 10)
