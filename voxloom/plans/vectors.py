"""Queries over labelled vectors: metrics, residuals, losses, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import pooling as P
from ..operators import reduction as R
from ..operators.sampling import numbered
from .base import micro, query, table

E_SQL = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, label, v, [x / greatest(sqrt(list_dot_product(v, v)), 1e-10) FOR x IN v] AS n FROM e)"
#: Every pair within the table, by brute force: only for the oracle.
SIL_SQL = f"""{E_SQL}, d AS (SELECT a.vec_id, a.label, b.label AS other, avg(1 - list_dot_product(a.n, b.n)) FILTER (WHERE a.vec_id <> b.vec_id) AS m, count(*) AS c FROM u a, u b GROUP BY ALL),
s AS (SELECT vec_id, label, max(m) FILTER (WHERE label = other) AS a, max(c) FILTER (WHERE label = other) AS c, min(m) FILTER (WHERE label <> other) AS b FROM d GROUP BY ALL),
f AS (SELECT vec_id, label, CASE WHEN b IS NULL THEN NULL WHEN c = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM s)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("vec"))


def digest(v: Column) -> Column:
    """One number for a vector: dimensions weighted by their place."""
    return V.total(F.transform(v, lambda x, i: x * (i + 1)))


def sql_digest(v: str) -> str:
    return f"round(list_sum([{v}[i] * i FOR i IN range(1, len({v}) + 1)]), 6) + 0.0"


@query("AGG8 MTH1 MTH2 JN5", f"WITH {E_SQL}, p AS (SELECT a.label, avg(list_dot_product(a.n, b.n)) AS m FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1) SELECT label, round(m, 6) + 0.0 AS consistency FROM p")
def intra_class_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.consistency(embeddings(spark, sf_dir)).select("label", micro(F.col("consistency"), "consistency"))


@query("AGG8 M11", f"WITH {E_SQL}, p AS (SELECT a.label, avg(list_dot_product(a.n, b.n)) AS m FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1) SELECT round(avg(m), 6) + 0.0 AS consistency, count(*)::BIGINT AS classes FROM p")
def mean_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.consistency(embeddings(spark, sf_dir))
    return c.agg(micro(F.avg("consistency"), "consistency"), F.count("*").alias("classes"))


@query("AGG9", f"WITH {SIL_SQL} SELECT round(avg(s), 6) + 0.0 AS silhouette FROM f")
def silhouette_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.silhouette(embeddings(spark, sf_dir), "vec_id").agg(micro(F.avg("silhouette"), "silhouette"))


@query("AGG10 SRT1 M12", f"WITH {SIL_SQL} SELECT label, count(*)::BIGINT AS n, round(avg(s), 6) + 0.0 AS mean_sil, round(stddev_pop(s), 6) + 0.0 AS std, round(min(s), 6) + 0.0 AS low, round(max(s), 6) + 0.0 AS high FROM f GROUP BY label")
def silhouette_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("silhouette")
    return M.silhouette(embeddings(spark, sf_dir), "vec_id").groupBy("label").agg(F.count("*").alias("n"), micro(F.avg(s), "mean_sil"), micro(F.stddev_pop(s), "std"), micro(F.min(s), "low"), micro(F.max(s), "high"))


CENT_SQL = f"""{E_SQL}, x AS (SELECT label, unnest(range(1, len(n) + 1)) AS i, unnest(n) AS c, list_dot_product(n, n) AS q FROM u), m AS (SELECT label, i, sum(c) AS s, count(*) AS k FROM x GROUP BY ALL),
c AS (SELECT label, max(k) AS k, list(s ORDER BY i) AS s FROM m GROUP BY label), z AS (SELECT label, k, s, [y / greatest(sqrt(list_dot_product(s, s)), 1e-10) FOR y IN s] AS z FROM c),
w AS (SELECT a.label, b.label AS other, 1 - list_dot_product(a.z, b.z) AS d FROM z a JOIN z b ON a.label <> b.label),
r AS (SELECT label, min(d) AS nearest_dist, arg_min(other, d) AS nearest FROM w GROUP BY label)"""


@query("JN6 MTH10 AGG12", f"WITH {CENT_SQL} SELECT label, nearest::VARCHAR AS nearest, round(nearest_dist, 6) AS distance FROM r")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_centroids(M.centroids(embeddings(spark, sf_dir))).select("label", "nearest", micro(F.col("distance"), "distance"))


SEP_SQL = f"""{CENT_SQL}, i AS (SELECT label, k, 1 - (list_dot_product(s, s) - k) / (k * (k - 1)) AS intra FROM z),
t AS (SELECT i.label, k AS n, intra, nearest, nearest_dist, nearest_dist / (intra + 1e-9) AS sep FROM i JOIN r ON i.label = r.label)"""


@query("AGG11 AGG12 SRT1 M12", f"WITH {SEP_SQL} SELECT label, n::BIGINT AS n, round(intra, 6) AS intra_dist, nearest::VARCHAR AS nearest, round(nearest_dist, 6) AS nearest_dist, round(sep, 6) AS separability FROM t")
def separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.separability(embeddings(spark, sf_dir))
    return s.select("label", "n", micro(F.col("intra_dist"), "intra_dist"), "nearest", micro(F.col("nearest_dist"), "nearest_dist"), micro(F.col("separability"), "separability"))


@query("AGG13", f"WITH {SEP_SQL} SELECT round(avg(intra), 6) AS mean_intra, round(median(intra), 6) AS median_intra, round(avg(sep), 6) AS mean_sep, round(median(sep), 6) AS median_sep FROM t")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.separability(embeddings(spark, sf_dir))
    return s.agg(micro(F.avg("intra_dist"), "mean_intra"), micro(F.median("intra_dist"), "median_intra"), micro(F.avg("separability"), "mean_sep"), micro(F.median("separability"), "median_sep"))


PAIR_SQL = "p AS (SELECT vec_id, label, embedding::DOUBLE[] AS a, (lead(embedding) OVER (PARTITION BY label ORDER BY vec_id))::DOUBLE[] AS b FROM embeddings), q AS (SELECT vec_id, label, a, b, [a[i] - b[i] FOR i IN range(1, len(a) + 1)] AS r FROM p WHERE b IS NOT NULL)"


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector (a) with its label's next one (b): by numbers, as a window over a label would be one task."""
    e = numbered(embeddings(spark, sf_dir), [F.asc("vec_id")], "label")
    after = e.select(F.col("label").alias("same"), (F.col("number") - 1).alias("at"), F.col("vec").alias("b"))
    return e.join(after, F.col("label").eqNullSafe(F.col("same")) & (F.col("number") == F.col("at"))).select("vec_id", "label", F.col("vec").alias("a"), "b")


@query("MTH3 JN1", f"WITH {PAIR_SQL} SELECT vec_id, label, {sql_digest('r')} AS digest, round(sqrt(list_dot_product(r, r)), 6) AS length FROM q")
def residual_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.residuals(vector_pairs(spark, sf_dir), "a", "b")
    return r.select("vec_id", "label", micro(digest(F.col("vec")), "digest"), micro(V.norm(F.col("vec")), "length"))


@query("MTH3b AGG8", f"""WITH {PAIR_SQL}, m AS (SELECT vec_id, label, 'direct' AS mode, a AS v FROM q UNION ALL SELECT vec_id, label, 'raw', r FROM q),
u AS (SELECT *, [x / greatest(sqrt(list_dot_product(v, v)), 1e-10) FOR x IN v] AS n FROM m), c AS (SELECT a.mode, a.label, avg(list_dot_product(a.n, b.n)) AS c FROM u a JOIN u b ON a.mode = b.mode AND a.label = b.label AND a.vec_id < b.vec_id GROUP BY ALL)
SELECT mode, round(avg(c), 6) + 0.0 AS consistency FROM c GROUP BY mode""")
def vector_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vector_pairs(spark, sf_dir)
    modes = pairs.select("vec_id", F.lit("direct").alias("mode"), "label", F.col("a").alias("vec")).unionByName(M.residuals(pairs, "a", "b").select("vec_id", F.lit("raw").alias("mode"), "label", "vec"))
    out = M.consistency(modes.withColumn("group", F.struct("mode", "label")), "group")
    return out.groupBy(F.col("group.mode").alias("mode")).agg(micro(F.avg("consistency"), "consistency"))


@query("MTH3b MTH5 MTH6")
def vector_mode_pca50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals without the space that explains half of the variance of the second vectors: consistency and components."""
    pairs = vector_pairs(spark, sf_dir)
    out, k = R.without_space_of(M.residuals(pairs, "a", "b"), pairs.select(F.col("b").alias("vec")), 0.5)
    return M.consistency(out).agg(F.avg("consistency").alias("consistency"), F.count("*").alias("classes")).withColumn("components", F.lit(k))


@query("MTH4", f"""WITH {E_SQL}, t AS (SELECT unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e WHERE label < 8), m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM t GROUP BY i)),
c AS (SELECT vec_id, [v[i] - m[i] FOR i IN range(1, len(v) + 1)] AS c FROM e, m) SELECT vec_id, {sql_digest('c')} AS digest FROM c""")
def center_train_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors less the mean of the training speakers (labels below 8)."""
    e = embeddings(spark, sf_dir)
    return M.centred(e, e.filter("label < 8")).select("vec_id", micro(digest(F.col("vec")), "digest"))


ARC_SQL = f"""{CENT_SQL}, l AS (SELECT u.vec_id, u.label, z.label AS class, 30 * cos(acos(least(greatest(list_dot_product(u.n, z.z), -1 + 1e-7), 1 - 1e-7)) + CASE WHEN u.label = z.label THEN 0.5 ELSE 0 END) AS logit FROM u, z)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return M.row_logits(e, M.centroids(e).select(F.col("label").alias("class"), F.col("centroid").alias("w")), "vec_id")


@query("MTH7 JN7", f"WITH {ARC_SQL} SELECT vec_id, label, class, round(logit, 6) + 0.0 AS logit FROM l")
def arcface_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("vec_id", "label", F.inline("logits")).select("vec_id", "label", "class", micro(F.col("logit"), "logit"))


@query("MTH8", f"WITH {ARC_SQL}, top AS (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS t FROM l) SELECT vec_id, round(max(t) + ln(sum(exp(logit - t))) - max(logit) FILTER (WHERE class = label), 6) AS loss FROM top GROUP BY vec_id")
def softmax_xent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cross_entropy(logits(spark, sf_dir), "vec_id").select("vec_id", micro(F.col("loss"), "loss"))


@query("AGG15 AGG16 MTH10", f"""WITH {ARC_SQL}, top AS (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS t FROM l), y AS (SELECT vec_id, label, arg_max(class, logit) AS p, max(t) + ln(sum(exp(logit - t))) - max(logit) FILTER (WHERE class = label) AS loss FROM top GROUP BY ALL)
SELECT round(avg((p = label)::INT), 6) AS accuracy, round(avg(loss), 6) AS mean_loss FROM y""")
def arcface_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = logits(spark, sf_dir)
    both = M.predicted_class(l, "vec_id").join(M.cross_entropy(l, "vec_id"), "vec_id")
    return both.agg(micro(F.avg((F.col("predicted") == F.col("label")).cast("int")), "accuracy"), micro(F.avg("loss"), "mean_loss"))


@query("MTH9", """WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS a, (lead(embedding) OVER (PARTITION BY label ORDER BY vec_id))::DOUBLE[] AS p FROM embeddings), n AS (SELECT vec_id, lead(label) OVER (ORDER BY vec_id) AS other, (lead(embedding) OVER (ORDER BY vec_id))::DOUBLE[] AS n FROM embeddings),
t AS (SELECT a, p, n FROM s JOIN n ON s.vec_id = n.vec_id WHERE p IS NOT NULL AND label <> other) SELECT round(avg(greatest(0, list_distance(a, p) - list_distance(a, n) + 0.3)), 6) AS loss FROM t""")
def triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor, the next of its label, and the next of all, where that has another label."""
    pairs, e = vector_pairs(spark, sf_dir), numbered(embeddings(spark, sf_dir), [F.asc("vec_id")])
    after = e.select((F.col("number") - 1).alias("number"), F.col("label").alias("other"), F.col("vec").alias("negative"))
    other = e.select("vec_id", "number").join(after, "number").drop("number")
    rows = pairs.join(other, "vec_id").filter("label <> other").select(F.col("a").alias("anchor"), F.col("b").alias("positive"), "negative")
    return M.triplet_loss(rows).select(micro(F.col("loss"), "loss"))


@query("AGG17", f"""WITH {E_SQL}, x AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e), m AS (SELECT label, i, avg(x) AS m, count(*) AS k FROM x GROUP BY ALL), g AS (SELECT i, avg(x) AS g FROM x GROUP BY i),
b AS (SELECT sum(k * (m - g) * (m - g)) AS b, count(DISTINCT label) AS c FROM m JOIN g ON m.i = g.i), w AS (SELECT sum((x - m) * (x - m)) AS w FROM x JOIN m ON x.label = m.label AND x.i = m.i)
SELECT c::BIGINT AS classes, (SELECT count(*) FROM e)::BIGINT AS rows, round((b / (c - 1)) / (w / ((SELECT count(*) FROM e) - c)), 6) AS score FROM b, w""")
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calinski_harabasz(embeddings(spark, sf_dir)).select("classes", "rows", micro(F.col("score"), "score"))


TOK_SQL = """t AS (SELECT label AS sample_id, vec_id % 3 AS layer, row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) AS pos, embedding::DOUBLE[] AS v FROM embeddings),
h AS (SELECT sample_id, layer, pos, v, 1.0 / (1 + pos) AS attn, (pos % 4 <> 0)::INT AS mask FROM t)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as token states: labels are sentences, three layers, made-up attention and mask."""
    e = embeddings(spark, sf_dir).withColumn("layer", F.col("vec_id") % 3)
    placed = numbered(e.withColumn("sentence", F.struct("label", "layer")), [F.asc("vec_id")], "sentence", "pos")
    return placed.select(F.col("label").alias("sample_id"), "layer", F.col("pos").cast("int").alias("pos"), "vec").withColumn("attn", 1.0 / (1 + F.col("pos"))).withColumn("mask", (F.col("pos") % 4 != 0).cast("int"))


def pool_sql(weight: str, norm: str) -> str:
    return f"""WITH {TOK_SQL}, s AS (SELECT *, attn / (sum(attn) OVER (PARTITION BY sample_id, layer) + 1e-10) AS share FROM h), x AS (SELECT sample_id, layer, {weight} AS w, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM s WHERE layer > 0),
p AS (SELECT sample_id, layer, i, sum(w * x) / {norm} AS p FROM x GROUP BY ALL), a AS (SELECT sample_id, layer, list(p ORDER BY i) AS v FROM p GROUP BY ALL UNION ALL SELECT sample_id, layer, arg_max(v, pos) FROM h WHERE layer = 0 GROUP BY ALL)
SELECT sample_id, layer, {sql_digest('v')} AS digest FROM a"""


def pooled(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return P.attention(tokens(spark, sf_dir), ["sample_id", "layer"], method).select("sample_id", "layer", micro(digest(F.col("vec")), "digest"))


@query("POOL1 M9", f"WITH {TOK_SQL}, a AS (SELECT sample_id, layer, arg_max(v, pos) AS v FROM h GROUP BY ALL) SELECT sample_id, layer, {sql_digest('v')} AS digest FROM a")
def pool_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir, "last")


@query("POOL2 POOL5", pool_sql("share", "1"))
def pool_attn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir, "attn")


@query("POOL3 POOL5", pool_sql("1 - share", "(sum(w) + 1e-10)"))
def pool_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir, "comp")


@query("POOL4 POOL5", pool_sql("1 / (share + 1e-8)", "(sum(w) + 1e-10)"))
def pool_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir, "inv")


@query("POOL6", f"""WITH {TOK_SQL}, x AS (SELECT sample_id, layer, mask, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM h), p AS (SELECT sample_id, layer, i, sum(mask * x) / greatest(sum(mask), 1e-9) AS p FROM x GROUP BY ALL),
a AS (SELECT sample_id, layer, list(p ORDER BY i) AS v FROM p GROUP BY ALL) SELECT sample_id, layer, {sql_digest('v')} AS digest FROM a""")
def pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.masked_mean(tokens(spark, sf_dir), ["sample_id", "layer"]).select("sample_id", "layer", micro(digest(F.col("vec")), "digest"))


QUERY = [((i * 7) % 11 - 5) / 4 for i in range(64)]


@query("POOL7", f"""WITH {TOK_SQL}, s AS (SELECT *, list_dot_product(v, {QUERY}::DOUBLE[]) / 8.0 AS s FROM h WHERE mask = 1), m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id, layer)) AS w FROM s),
x AS (SELECT sample_id, layer, w, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM m), p AS (SELECT sample_id, layer, i, sum(w * x) / sum(w) AS p FROM x GROUP BY ALL), a AS (SELECT sample_id, layer, list(p ORDER BY i) AS v FROM p GROUP BY ALL)
SELECT sample_id, layer, {sql_digest('v')} AS digest FROM a""")
def pool_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.query_pool(tokens(spark, sf_dir), ["sample_id", "layer"], QUERY).select("sample_id", "layer", micro(digest(F.col("vec")), "digest"))


@query("POOL8", f"""WITH {TOK_SQL}, a AS (SELECT sample_id, layer, arg_max(v, pos) AS v FROM h GROUP BY ALL), w AS (SELECT layer, exp(weight - 0.7) / (exp(0.2 - 0.7) + exp(-0.1 - 0.7) + exp(0.7 - 0.7)) AS share FROM (VALUES (0, 0.2), (1, -0.1), (2, 0.7)) t(layer, weight)),
x AS (SELECT sample_id, share, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM a JOIN w ON a.layer = w.layer), p AS (SELECT sample_id, i, sum(share * x) AS p FROM x GROUP BY ALL), f AS (SELECT sample_id, list(p ORDER BY i) AS v FROM p GROUP BY ALL)
SELECT sample_id, {sql_digest('v')} AS digest FROM f""")
def layer_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = P.last_token(tokens(spark, sf_dir), ["sample_id", "layer"])
    weights = spark.createDataFrame([(0, 0.2), (1, -0.1), (2, 0.7)], "layer long, weight double")
    return P.fused_layers(last, weights, ["sample_id"]).select("sample_id", micro(digest(F.col("vec")), "digest"))


@query("TOK1 M8", """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings)
SELECT label, (count(*) FILTER (WHERE pos <= 128))::BIGINT AS real_tokens, 128::BIGINT AS length, (sum(vec_id * pos) FILTER (WHERE pos <= 128) + sum(pos) FILTER (WHERE pos <= 128) - 128 * 129 / 2)::BIGINT AS digest FROM r GROUP BY label""")
def padded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a label's first 128 rows, filled with -1: ranked before they are collected, so that a large label is never held."""
    rank = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    first = table(spark, sf_dir, "embeddings").select("label", "vec_id").withColumn("pos", rank).filter("pos <= 128")
    ids = first.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("vec_id").cast("int").alias("id")))).alias("r")).select("label", F.col("r.id").alias("ids"))
    filled, mask = P.pad_tokens(F.col("ids"), pad=-1)
    weighed = F.aggregate(F.transform(filled, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return ids.select("label", F.aggregate(mask, F.lit(0), lambda s, x: s + x).cast("long").alias("real_tokens"), F.size(filled).cast("long").alias("length"), weighed.alias("digest"))
