"""The queries of this subpackage, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratingmill.llm import clusters, collocations, decontaminate, language_model, licenses, packing, pii, quality, repeats, secrets, simhash, vectors, wordpiece
from ratingmill.llm.common import read
from ratingmill.llm.oracles import ORACLES


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op4_wordpiece_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"))


def op5_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op7_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"))


def op8_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op11_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(read(spark, sf_dir, "embeddings"))


def op13_sketch_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_weak_label_quality": op1_weak_label_quality,
    "op2_simhash_bktree": op2_simhash_bktree,
    "op3_personal_data": op3_personal_data,
    "op4_wordpiece_automaton": op4_wordpiece_automaton,
    "op5_trigram_secrets": op5_trigram_secrets,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_log_bilinear_scores": op7_log_bilinear_scores,
    "op8_pivot_range_join": op8_pivot_range_join,
    "op9_decontamination": op9_decontamination,
    "op10_residual_packing": op10_residual_packing,
    "op11_template_licenses": op11_template_licenses,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_sketch_collocations": op13_sketch_collocations,
}

__all__ = ["ORACLES", "QUERIES"]
