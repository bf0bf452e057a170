"""From raw documents to packed training sequences: quality, language, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.llm import language, near_dedup, packing, pii, quality
from corrweave.llm.common import small_batches, stored, table

#: Documents that score lower than this are rejected.
QUALITY_AT_LEAST = 0.5
#: Documents whose language has a smaller share than this of all languages' are rejected: as likely another one's.
LANGUAGE_AT_LEAST = 0.5
#: The languages to keep; None: those of at least LANGUAGE_SHARE of the labelled documents.
LANGUAGES: tuple[str, ...] | None = None
#: Languages with fewer of the labelled documents than this are learned, so that they are told apart, and rejected.
LANGUAGE_SHARE = 0.01


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, learned from these documents' labels, finds good.

    Null and empty texts get the score of one empty passage. Repeated rows get equal scores and stay or go together; columns
    of any name stay as they are; an empty table stays empty.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= QUALITY_AT_LEAST)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages kept that the model tells with a share of at least LANGUAGE_AT_LEAST.

    Kept are LANGUAGES or, where these are None, the languages of at least LANGUAGE_SHARE of the labelled documents with
    text; a language too rare to train on goes, whatever its documents' labels. Texts that are null or have no letter, and all texts where no label teaches a language, are in none. Repeated rows stay
    or go together; columns of any name stay as they are; an empty table stays empty.
    """
    kept = language.common(docs, LANGUAGE_SHARE) if LANGUAGES is None else LANGUAGES
    return in_languages(docs, kept, LANGUAGE_AT_LEAST)


def in_languages(docs: DataFrame, languages: tuple[str, ...], at_least: float) -> DataFrame:
    said = language.predict(F.col("text"), language.learn(docs))
    return docs.where(said["lang_pred"].isin(*languages) & (said["score"] >= at_least) & (said["lang_pred"] != language.UNDETERMINED))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component, as `near_dedup.deduplicated` chooses it, with its columns as they are."""
    return near_dedup.deduplicated(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts kinds in brackets in place of personal data; n_chars follows. Null texts and other columns stay; every row stays."""
    small_batches(spark)
    masked = docs.withColumn("text", pii.redact(F.col("text")))
    return masked.withColumn("n_chars", F.char_length("text").cast("bigint"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences, as `packing.pack` gives them: null and empty texts are an end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A learned classifier, suffix automata and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
