"""The queries of the training-data operators, as __spark_entry__.py registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language_id, line_dedup, minhash, neighbours, packing, phrases, quality, sharding, simhash, token_counts, url_filter, vector_codes
from .common import id_remainder, materialise, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = materialise(quality.extract(table(spark, sf_dir, "documents")))
    model = quality.train(feats, table(spark, sf_dir, "labels"))
    scored = feats.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), model.score_features(F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 4) == 2
    model = language_id.learn(docs.filter(~held_out).select("text", "lang", "doc_id"))
    found = language_id.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs, "all", min_docs=10, min_chars=1))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.components(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_url_filter": op2_url_filter,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_neighbours": op9_neighbours,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_phrases": op12_phrases,
    "op13_minhash": op13_minhash,
}
ORACLE_SQL = {
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_phrases": phrases.ORACLE_SQL,
}
