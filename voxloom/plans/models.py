"""Queries that fit models, and the grid of experiments over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clustering as K
from ..operators import metrics as M
from ..operators import reduction as R
from ..operators import sampling as S
from ..operators import training as T
from ..session import materialised, shared_folder
from ..sources import artefacts, caches, tables
from ..sources.services import CountEmbedder, SumEncoder, WordLengths, WordStates, embedded, encoded, pooled_states, tokenized
from .base import DIALOGUES, dialogues, micro, query
from .vectors import CENT_SQL, E_SQL, SEP_SQL, SIL_SQL, digest, embeddings, sql_digest


@query("ML1 MTH5 MTH6")
def pca_project_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without their main space: the consistency that is left per label, and the number of components."""
    rows, k = R.without_main_space(embeddings(spark, sf_dir), 0.9)
    return M.consistency(rows).select("label", "n", micro(F.col("consistency"), "consistency"), F.lit(k).alias("components"))


@query("ML2 MTH4")
def lda_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discriminant fitted on labels below 8, applied to all: consistency by label."""
    e = embeddings(spark, sf_dir)
    fitted = R.discriminant(e.filter("label < 8"), 4, shrinkage=0.1)
    return M.consistency(e.withColumn("vec", R.projected(F.col("vec"), fitted.scalings, fitted.mean))).select("label", "n", micro(F.col("consistency"), "consistency"))


def centroid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.centroids(embeddings(spark, sf_dir)).select("label", F.col("centroid").alias("vec"))


@query("ML3 AGG17 SNK11")
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class centroids in 2 to min(30, classes - 1) clusters, ten seeds each."""
    return K.kmeans_sweep(centroid_rows(spark, sf_dir), None, "label")


@query("ML4")
def gmm_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of class centroids by BIC, diagonal where classes are few."""
    return K.mixture_sweep(centroid_rows(spark, sf_dir))


@query("ML5 M13 SNK11")
def ward_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ward(centroid_rows(spark, sf_dir), "label")


@query("ML5 MTH11 WIN4")
def hierarchy_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ward_elbow(K.ward(centroid_rows(spark, sf_dir), "label"))


@query("ML2")
def lda_auto_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lda_transform, with the shrinkage estimated from the rows."""
    e = embeddings(spark, sf_dir)
    fitted = R.discriminant(e.filter("label < 8"), 4, shrinkage="auto")
    return M.consistency(e.withColumn("vec", R.projected(F.col("vec"), fitted.scalings, fitted.mean))).select("label", "n", micro(F.col("consistency"), "consistency"))


@query("ML2")
def lda_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lda_transform, by singular values instead of a shrunk covariance."""
    e = embeddings(spark, sf_dir)
    fitted = R.svd_discriminant(e.filter("label < 8"), 4)
    return M.consistency(e.withColumn("vec", R.projected(F.col("vec"), fitted.scalings, fitted.mean))).select("label", "n", micro(F.col("consistency"), "consistency"))


@query("ML10 SMP2 MTH9")
def triplet_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head trained on drawn triplets of labels below 8: loss before and after, consistency of seen and unseen labels."""
    e = embeddings(spark, sf_dir)
    head = T.triplet_head(e.filter("label < 8"), "vec_id", width=16, epochs=5, draws=256)
    # written: a task that also summed them up would hold two Python workers at a time
    z = materialised(e.withColumn("vec", head.embed(F.col("vec")))).withColumn("group", F.struct(F.when(F.col("label") < 8, "train").otherwise("gen").alias("split"), "label"))
    out = M.consistency(z, "group").groupBy(F.col("group.split").alias("split")).agg(F.avg("consistency").alias("consistency"))
    return out.select("split", "consistency", F.lit(head.losses[0]).alias("first_loss"), F.lit(head.losses[-1]).alias("last_loss"))


@query("MTH11 WIN4", """WITH c AS (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY label), d AS (SELECT *, n - 2 * lag(n, 1) OVER (ORDER BY label) + lag(n, 2) OVER (ORDER BY label) AS second FROM c)
SELECT label, n, coalesce(second, 0) AS second, label = (SELECT arg_min(label, -second * 1000 + label) FROM d WHERE second IS NOT NULL) AS is_elbow FROM d""")
def second_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").cast("double").alias("n"))
    return K.elbow(counts, "label", "n").withColumn("second", F.coalesce("second", F.lit(0.0)))


EPS = [round(i * 0.05, 2) for i in range(1, 9)] + [0.8, 0.9]


@query("ML6", f"""WITH RECURSIVE {CENT_SQL}, eps AS (SELECT unnest({EPS}) AS eps), g AS (SELECT eps, label AS a, other AS b FROM w, eps WHERE round(d, 9) <= eps),
n AS (SELECT eps, label FROM z, eps), reach(eps, a, b) AS (SELECT eps, label, label FROM n UNION SELECT r.eps, r.a, g.b FROM reach r JOIN g ON r.eps = g.eps AND r.b = g.a),
k AS (SELECT eps, a, min(b) AS c FROM reach GROUP BY ALL), s AS (SELECT eps, c, count(*) AS n FROM k GROUP BY ALL)
SELECT eps, (count(*) FILTER (WHERE n >= 2))::BIGINT AS clusters, coalesce(sum(n) FILTER (WHERE n < 2), 0)::BIGINT AS noise FROM s GROUP BY eps""")
def dbscan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = M.centroids(embeddings(spark, sf_dir)).select("label", F.col("centroid").alias("vec"))
    found = K.density_clusters(cents, EPS, "label")
    return found.groupBy("eps").agg(F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("cluster").isNull()).alias("noise"))


NEAR = [0.55, 0.6, 0.65]


@query("ML6", f"""WITH RECURSIVE {E_SQL}, eps AS (SELECT unnest({NEAR}) AS eps), d AS (SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_dot_product(a.n, b.n), 9) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id),
g AS (SELECT eps, a, b FROM d, eps WHERE d <= eps), reach(eps, a, b) AS (SELECT DISTINCT eps, a, a FROM g UNION SELECT r.eps, r.a, g.b FROM reach r JOIN g ON r.eps = g.eps AND r.b = g.a),
k AS (SELECT eps, a, min(b) AS c FROM reach GROUP BY ALL), n AS (SELECT eps, count(DISTINCT c) AS clusters, count(*) AS held FROM k GROUP BY eps)
SELECT eps.eps, coalesce(clusters, 0)::BIGINT AS clusters, ((SELECT count(*) FROM e) - coalesce(held, 0))::BIGINT AS noise FROM eps LEFT JOIN n ON n.eps = eps.eps""")
def dbscan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of all vectors, not of class centroids, at three radii."""
    found = K.density_clusters(embeddings(spark, sf_dir), NEAR, "vec_id")
    return found.groupBy("eps").agg(F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("cluster").isNull()).alias("noise"))


#: The grid of heads: every backbone in three widths.
GRID = [(arch, width) for arch in T.ARCHS for width in (32, 64, 128)]
#: The operator's epochs, each a minibatch of 512 rows.
EPOCHS = 500


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of labels below 8 as train and val, four to one within a label, and of the others as gen."""
    e = embeddings(spark, sf_dir)
    seen = S.split_within(e.filter("label < 8"), "label", "vec_id", 0.8)
    return seen.unionByName(e.filter("label >= 8").withColumn("split", F.lit("gen")))


def grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, split, silhouette, loss) of all heads of the grid, trained together on the train rows for ``EPOCHS`` epochs."""
    rows = materialised(splits(spark, sf_dir))
    trained = T.margin_heads(rows.filter("split = 'train'"), 8, GRID, EPOCHS, key="vec_id", batch=512, cosine=True, moments=False)
    z = T.embedded_by(rows, trained.heads).withColumn("group", F.struct("cell", "split"))
    losses = spark.createDataFrame([(f"{a}-{w}", h.losses[-1] if h.losses else None) for (a, w), h in trained.heads.items()], "cell string, loss double")
    return M.group_silhouettes(z, "group").select("group.cell", "group.split", "silhouette").join(F.broadcast(losses), "cell")


@query("ML8 ML9 AGG16 POOL9 SMP3")
def mlp_arcface_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five backbones in three widths, trained together in minibatches with a cosine rate and judged by split: the operator's 500 epochs."""
    return grid_scores(spark, sf_dir)


@query("JN8 TOP2 SRT1 M11 ML9")
def experiment_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's heads, trained for all epochs, by silhouette of unseen rows; the limit of 20 is the operator."""
    scores = grid_scores(spark, sf_dir).groupBy("cell").pivot("split", ["train", "val", "gen"]).agg(F.first("silhouette"))
    flag = F.when((F.col("val") > 0) & (F.col("gen") > 0), "***").otherwise("").alias("flag")
    return scores.select("cell", F.col("train").alias("train_sil"), F.col("val").alias("val_sil"), F.col("gen").alias("gen_sil"), flag).orderBy(F.desc("val_sil"), "cell").limit(20)


@query("TOP2 SRT1 AGG10 AGG8", f"""WITH {SIL_SQL}, p AS (SELECT a.label, avg(list_dot_product(a.n, b.n)) AS m FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1),
m AS (SELECT label, round(avg(s), 6) + 0.0 AS sil FROM f GROUP BY label) SELECT m.label, sil, round(m, 6) + 0.0 AS cons, CASE WHEN sil > 0 AND m > 0 THEN '***' ELSE '' END AS flag FROM m JOIN p ON m.label = p.label ORDER BY sil DESC, m.label LIMIT 20""")
def speaker_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 labels of the highest mean silhouette, with their consistency: the limit is the operator."""
    e = embeddings(spark, sf_dir)
    sil = M.silhouette(e, "vec_id").groupBy("label").agg(micro(F.avg("silhouette"), "sil"))
    both = sil.join(M.consistency(e).filter("consistency is not null"), "label")
    flag = F.when((F.col("sil") > 0) & (F.col("consistency") > 0), "***").otherwise("").alias("flag")
    return both.select("label", "sil", micro(F.col("consistency"), "cons"), flag).orderBy(F.desc("sil"), "label").limit(20)


@query("SNK10 ML12 ML9")
def resumed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two heads trained for six epochs with a stop after three: published, loaded and gone on with; their last losses and classes."""
    rows, path = embeddings(spark, sf_dir).filter("label < 8"), f"{shared_folder(spark)}/heads-{uuid.uuid4().hex}"
    how = {"epochs": 6, "key": "vec_id", "batch": 256, "cosine": True}
    artefacts.save(spark, T.margin_heads(rows, 8, [("linear", 32), ("1h-256", 32)], until=3, **how), path)
    done = T.margin_heads(rows, 8, [], after=artefacts.load(spark, path), **how)
    artefacts.save(spark, done, path)
    last = artefacts.load(spark, path)
    return spark.createDataFrame([(a, w, len(h.classes), last.epoch, len(h.losses), h.losses[-1]) for (a, w), h in last.heads.items()], "arch string, width int, classes int, epoch int, losses int, last_loss double")


@query("EXT0 SET3", "WITH g AS (SELECT layer, pool FROM (SELECT unnest(range(0, 5)) AS layer) l, (VALUES ('last'), ('attn')) p(pool)) SELECT layer::BIGINT AS layer, pool FROM g WHERE NOT (pool = 'attn' AND layer >= 3)  EXCEPT SELECT DISTINCT vec_id % 3, 'last' FROM embeddings")
def cache_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a layer x pool grid that a cache lacks."""
    grid = spark.range(5).withColumnRenamed("id", "layer").select("layer", F.explode(F.array(F.lit("last"), F.lit("attn"))).alias("pool")).filter("not (pool = 'attn' and layer >= 3)")
    have = embeddings(spark, sf_dir).select((F.col("vec_id") % 3).alias("layer"), F.lit("last").alias("pool")).distinct()
    return grid.join(have, ["layer", "pool"], "left_anti")


@query("SRC7", f"WITH {DIALOGUES} SELECT id, len(origin_text) AS chars, list_sum([(len(origin_text) * i % 17) * i FOR i IN range(1, 17)])::DOUBLE AS digest FROM dialogues")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through an injected embedder, 64 at a time, five tries; here a stand-in."""
    rows = embedded(dialogues(spark, sf_dir), CountEmbedder(16), "origin_text", batch=64, tries=5)
    return rows.select("id", F.char_length("origin_text").cast("long").alias("chars"), digest(V.as_double(F.col("vector"))).alias("digest"))


@query("SRC8 M9 POOL1 POOL2 POOL3 POOL4", f"""WITH {DIALOGUES}, t AS (SELECT id, string_split(origin_text, ' ') AS ws FROM dialogues WHERE origin_text IS NOT NULL),
n AS (SELECT id, unnest(range(0, len(ws))) AS p, length(unnest(ws)) AS n FROM t), h AS (SELECT id, layer, p, (1 + (n + p) % 5)::DOUBLE AS a, list_sum([((n * i + 3 * p + 7 * layer) % 17) / 17::DOUBLE * i FOR i IN range(1, 9)]) AS d FROM n, (SELECT unnest(range(0, 3)) AS layer)),
s AS (SELECT *, a / (sum(a) OVER (PARTITION BY id, layer) + 1e-10) AS w FROM h WHERE layer > 0),
k AS (SELECT id, layer, 'attn' AS pool, sum(w * d) AS digest FROM s GROUP BY ALL UNION ALL SELECT id, layer, 'comp', sum((1 - w) * d) / (sum(1 - w) + 1e-10) FROM s GROUP BY ALL
  UNION ALL SELECT id, layer, 'inv', sum(d / (w + 1e-8)) / (sum(1 / (w + 1e-8)) + 1e-10) FROM s GROUP BY ALL UNION ALL SELECT id, layer, 'last', arg_max(d, p) FROM h GROUP BY ALL
  UNION ALL SELECT id, 0, unnest(['attn', 'comp', 'inv']), arg_max(d, p) FROM h WHERE layer = 0 GROUP BY id)
SELECT id, layer::INT AS layer, pool, round(digest, 6) AS digest FROM k""")
def hidden_state_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden states of every turn from an injected provider, here a stand-in, pooled by layer in the task that has them."""
    pooled = pooled_states(dialogues(spark, sf_dir), WordStates(3, 8), "id", "origin_text")
    return pooled.select("id", "layer", "pool", micro(digest(F.col("vec")), "digest"))


@query("SRC9 TOK1 M8 M10", f"""WITH {DIALOGUES}, t AS (SELECT id, speaker, string_split(origin_text, ' ')[1:128] AS ws FROM dialogues WHERE origin_text IS NOT NULL),
s AS (SELECT id, speaker, len(ws) AS m, list_sum([length(ws[i]) * i FOR i IN range(1, len(ws) + 1)])::BIGINT AS s FROM t)
SELECT id, speaker, m::BIGINT AS real_tokens, round(list_sum([((s + j * m) % 101 / 101::DOUBLE)::FLOAT::DOUBLE * (j + 1) FOR j IN range(0, 128)]), 6) AS digest FROM s""")
def encoded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as 128 tokens through an injected tokenizer and a batched encoder of 128 dimensions; both are stand-ins here."""
    rows = tokenized(dialogues(spark, sf_dir).filter("origin_text is not null"), WordLengths(), "origin_text")
    vectors = encoded(rows, SumEncoder(128), batch=256)
    real = F.aggregate("mask", F.lit(0), lambda s, x: s + x).cast("long")
    return vectors.select("id", "speaker", real.alias("real_tokens"), micro(digest(V.as_double(F.col("vector"))), "digest"))


@query("SRC5 SNK8", f"WITH {E_SQL} SELECT vec_id, label, {sql_digest('v')} AS digest FROM e")
def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vectors from a cache named by their content: written once to the shared folder, then read."""
    rows = embeddings(spark, sf_dir)
    held = tables.cached(spark, f"{shared_folder(spark)}/vectors-{tables.content_key(rows)}", lambda: rows)
    return held.select("vec_id", "label", micro(digest(F.col("vec")), "digest"))


@query("SRC6 TOK1 SPL2 SET1", f"""WITH {DIALOGUES}, l AS (SELECT speaker, row_number() OVER (ORDER BY speaker) - 1 AS label FROM (SELECT DISTINCT speaker FROM dialogues)),
t AS (SELECT id, label, string_split(origin_text, ' ')[1:128] AS ws, CASE WHEN id // 1000 % 20 < 14 THEN 'train' WHEN id // 1000 % 20 < 17 THEN 'val_acc' ELSE 'val' END AS s FROM dialogues JOIN l USING (speaker) WHERE origin_text IS NOT NULL),
u AS (SELECT *, s AS split FROM t UNION ALL SELECT *, 'all_train' FROM t WHERE s <> 'val'), k AS (SELECT count(DISTINCT label) AS train_speakers FROM t WHERE s <> 'val')
SELECT split, label::INT AS label, count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS real_tokens, sum(list_sum([length(ws[i]) * i FOR i IN range(1, len(ws) + 1)]))::BIGINT AS digest, any_value(train_speakers)::BIGINT AS train_speakers FROM u, k GROUP BY split, label""")
def token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as token sequences, labelled by speaker and split by conversation, saved as a cache and read by split."""
    turns = dialogues(spark, sf_dir).filter("origin_text is not null")
    labelled = turns.join(S.labels(dialogues(spark, sf_dir).select("speaker").distinct(), [F.asc("speaker")]), "speaker")
    at = F.floor(F.col("id") / 1000) % 20
    split = F.when(at < 14, "train").when(at < 17, "val_acc").otherwise("val")
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    caches.save_tokens(tokenized(labelled, WordLengths(), "origin_text").withColumn("split", split).withColumnRenamed("ids", "tokens"), path)
    cache, out = caches.load_tokens(spark, path), None
    for name in (*caches.SPLITS, "all_train"):
        part = cache.split(name).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    places = F.aggregate(F.transform("tokens", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    real = F.aggregate("mask", F.lit(0).cast("long"), lambda s, x: s + x)
    sums = out.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum(real).alias("real_tokens"), F.sum(places).alias("digest"))
    return sums.crossJoin(F.broadcast(cache.train_speakers()))


@query("EXT0 SET3", """WITH c AS (SELECT DISTINCT label AS layer, CASE WHEN vec_id % 3 = 0 THEN 'attn' ELSE 'last' END AS pool FROM embeddings),
m AS (SELECT min(layer) AS layers FROM (SELECT 0 AS layer UNION ALL SELECT layer + 1 FROM c WHERE pool = 'last') x WHERE layer NOT IN (SELECT layer FROM c WHERE pool = 'last' AND layer IS NOT NULL))
SELECT layers::BIGINT AS layers, count(g.layer)::BIGINT AS gaps FROM m LEFT JOIN (SELECT layer, pool FROM (SELECT unnest(range(0, (SELECT layers FROM m)::BIGINT)) AS layer) l, (VALUES ('last'), ('attn'), ('comp')) p(pool) EXCEPT SELECT layer, pool FROM c) g ON true GROUP BY layers""")
def cache_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many layers a cache of vectors holds without a gap, and how many cells of three poolings it lacks there."""
    pool = F.when(F.col("vec_id") % 3 == 0, "attn").otherwise("last")
    cells = materialised(embeddings(spark, sf_dir).select(F.col("label").alias("layer"), pool.alias("pool")).distinct())
    gaps = caches.cell_gaps(cells, ["last", "attn", "comp"]).agg(F.count("*").alias("gaps"))
    return caches.layer_count(cells).crossJoin(gaps)


@query("SNK7 AGG11", f"WITH {SEP_SQL} SELECT label, n::BIGINT AS n, round(intra, 6) AS intra_dist, nearest::VARCHAR AS nearest, round(sep, 6) AS separability FROM t")
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by class as a CSV file with a header, read back."""
    got = M.separability(embeddings(spark, sf_dir)).select("label", "n", micro(F.col("intra_dist"), "intra_dist"), "nearest", micro(F.col("separability"), "separability"))
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    tables.write_csv(got, path)
    return spark.read.schema(got.schema).option("header", True).csv(path)
