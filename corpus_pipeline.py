"""A corpus from raw documents to tokens: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoframe.llm import bpe, decontaminate, language_id, line_dedup, simhash
from ecoframe.llm.common import small_batches, table
from ecoframe.llm.queries import BYTE_BPE, language_model
from ecoframe.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MIN_LANGUAGE_SCORE = 0.5
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
MAX_BROADCAST = 2_000_000  # ids of removed documents


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no language explains better than all others together, go."""
    small_batches(spark)
    judged = language_id.identify(docs.drop("lang_pred", "score"), language_model(docs))
    kept = judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in one; n_chars follows the text."""
    small_batches(spark)
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Near-duplicates are texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Few documents leave. Up to ``MAX_BROADCAST`` their ids are broadcast, beyond they are joined.
    """
    small_batches(spark)
    groups = simhash.near_duplicates(docs, words=COPY_WORDS, min_similarity=COPY_SIMILARITY)
    gone = materialise(groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct(), "near-copies")
    few = gone.count() <= MAX_BROADCAST
    gone = gone.withColumnRenamed("doc_id", "_gone")
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and digests of them and of the text decoded again."""
    small_batches(spark)
    decoded = bpe.round_trip(docs, BYTE_BPE)
    return decoded.select("doc_id", "lang", "source", "n_chars", *bpe.token_digest(), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode_tokens),
]

# Language scores and groups of near copies are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
