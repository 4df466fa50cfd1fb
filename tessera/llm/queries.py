"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, embedding_dedup, langid, line_dedup, merkle, packing, pii, quality_classifier, quality_rules, sharding, simhash, toxicity
from .shared import table


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component_id").cast("long").alias("component_id"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


_ALL = (
    op1_embedding_neardup, op2_pii_bootstrap, op3_simhash_neardup, op4_byte_bpe, op5_best_fit_packing, op6_hierarchical_langid, op7_line_dedup,
    op8_quality_rules, op9_rule_ensemble_quality, op10_hilbert_sharding, op11_toxicity, op12_lloyd, op13_merkle_manifest,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op1_embedding_neardup": embedding_dedup.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op12_lloyd": centroids.oracle(), "op13_merkle_manifest": merkle.oracle(),
}
