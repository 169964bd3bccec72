"""Queries of the training-data operators over the given tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manchete.llm import (
    clustering,
    filter_audit,
    hnsw,
    langid,
    latent,
    line_dedup,
    mixing,
    oracles,
    pii,
    simhash,
    suffix_tree,
    tokens,
    toxicity,
    warc,
)
from manchete.llm.common import remainder
from manchete.workspace import working_folder

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return mixing.mix(docs, mixing.cyclic_weights(docs))


def op2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return hnsw.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), is_query=F.col("vec_id") % 100 == 0)


def op3_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_tree.score_texts(_documents(spark, sf), held_out=remainder("doc_id", 10) == 0)


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = working_folder(spark)
    warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), path)
    return warc.capture_digests(warc.assemble(warc.read_records(spark, path), captured_content=False))


def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_pii(_documents(spark, sf))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    held_out = remainder("doc_id", 4) == 2
    machine = toxicity.learn(docs.where(~held_out), spark.read.parquet(f"{sf}/labels.parquet"))
    found = toxicity.score(docs, machine)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return latent.find_leaks(_documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    held_out = remainder("doc_id", 5) == 0
    profiles = langid.learn_profiles(docs.where(~held_out))
    found = langid.identify(docs, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf), words=3, max_bits=2)


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_documents(spark, sf), public_tokenizers.path(TOKENIZER), limit=2048)


def op11_clustering(spark: SparkSession, sf: str) -> DataFrame:
    found = clustering.cluster_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        clustering.centroid_digest().alias("centroid_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_filters(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_documents(spark, sf).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_nearest": op2_nearest,
        "op3_lm_scores": op3_lm_scores,
        "op4_warc": op4_warc,
        "op5_pii": op5_pii,
        "op6_toxicity": op6_toxicity,
        "op7_decontamination": op7_decontamination,
        "op8_language_id": op8_language_id,
        "op9_simhash": op9_simhash,
        "op10_token_counts": op10_token_counts,
        "op11_clustering": op11_clustering,
        "op12_filter_audit": op12_filter_audit,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": oracles.MIX,
        "op4_warc": oracles.WARC,
        "op11_clustering": oracles.clusters(),
        "op12_filter_audit": oracles.FILTER_AUDIT,
        "op13_line_dedup": oracles.LINE_DEDUP,
    }
