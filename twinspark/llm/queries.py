"""The thin queries of the subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.llm import bpe, centroids, class_lm, fingerprints, language_id, licenses, mixing, negatives, ngram_join, packing, quality_gam, quality_rules, suffix_dedup
from twinspark.llm.common import fold, read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(read(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(read(spark, sf_dir, "documents"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scorer, counts, total, different = class_lm.fit(docs, ~fold(F.col("doc_id"), 7, 2))
    found = class_lm.score(docs, scorer, counts, total, different)
    return found.select("doc_id", fold(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = language_id.fit(docs, lambda doc_id: ~fold(doc_id, 3, 1))
    found = language_id.predict(docs, net)
    return found.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents")).drop("class")


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_gam.fit(docs, read(spark, sf_dir, "labels"), "quality", lambda doc_id: ~fold(doc_id, 3, 1))
    found = quality_gam.score(docs, model)
    return found.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), TOKENIZER, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER, columns=("ids_crc32",))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(read(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


_ALL = (
    op1_license_scan,
    op2_quality_rules,
    op3_fingerprints,
    op4_class_lm,
    op5_mixing,
    op6_language_id,
    op7_ngram_join,
    op8_quality_gam,
    op9_bpe,
    op10_suffix_dedup,
    op11_packing,
    op12_centroids,
    op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "op1_license_scan": licenses.sql(),
    "op2_quality_rules": quality_rules.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
    "op12_centroids": centroids.sql(),
    "op13_hard_negatives": negatives.sql(),
}
