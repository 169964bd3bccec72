"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manchete.llm import langid, latent, mixing, pii, simhash
from manchete.workspace import materialise

#: The columns that every stage but the last returns; other columns are left out.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Shingle length and bit distance of the near copies.
SHINGLE_WORDS, MAX_BITS = 3, 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without text or letters go.

    Profiles are learnt from the documents whose language is known, and a document of
    unknown language gets the one found; a known one stays as it is. Where no language is
    known nothing can be learnt, and all documents with a letter stay.
    """
    docs = docs.select(*COLUMNS)
    profiles = langid.learn_profiles(docs)
    found = langid.identify(docs, profiles, keep=COLUMNS)
    is_text = F.col("lang_pred") != langid.UNKNOWN if profiles else F.col("text").rlike(r"\p{L}")
    known = F.coalesce(F.col("lang"), F.nullif("lang_pred", F.lit(langid.UNKNOWN)))
    return found.where(is_text).withColumn("lang", known).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS), words=SHINGLE_WORDS, max_bits=MAX_BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, word for word or in other words."""
    return latent.drop_leaking(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew."""
    masked = pii.mask_pii(docs.select(*COLUMNS), keep=COLUMNS)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken."""
    docs = docs.select(*COLUMNS)
    return mixing.mix(docs, mixing.cyclic_weights(docs), keep=COLUMNS).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Profiles, near copies, latent search and masking have no SQL form; the stages are tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for _, stage in before:
        docs = materialise(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
