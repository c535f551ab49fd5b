"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import language_model, quality, toxicity
from mercato.llm.common import remainder_of_id, table
from mercato.llm.decontaminate import decontaminate
from mercato.llm.exact_dedup import exact_dedup
from mercato.llm.hard_negatives import mine
from mercato.llm.licenses import scan
from mercato.llm.mixing import mix
from mercato.llm.near_dedup import near_dedup
from mercato.llm.sharding import shard
from mercato.llm.simhash import simhash_components
from mercato.llm.token_counts import histogram, lengths, suffix_sums
from mercato.llm.whitening import whiten


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_weighted_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "class_id", "class_size", "kept"
    )


def op3_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(lengths(table(spark, sf_dir, "documents"))))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "contaminated", "items", "coverage"
    )


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = remainder_of_id("doc_id", 7) != 2
    return language_model.score(table(spark, sf_dir, "documents"), training).select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


#: Documents are kept when grade 1 or higher is at least as likely as not.
QUALITY_KEEP = 0.5


def grade_of_labels() -> Column:
    """The grade that ``labels`` give: 0 poor, 1 well written but toxic, 2 well written."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels"), grade_of_labels(), top=2)
    return quality.score(docs, model).withColumn("kept", F.col("tails")[0] >= QUALITY_KEEP)


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir).select(
        "doc_id",
        "expected_grade",
        F.col("tails")[0].alias("p_grade_1"),
        F.col("tails")[1].alias("p_grade_2"),
        "kept",
    )


def op8_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op10_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_of_id("doc_id", 5) == 0
    lexicon = toxicity.learn(docs.where(~held_out), table(spark, sf_dir, "labels"), F.col("toxic"))
    return toxicity.score(docs, lexicon).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "score", "predicted", "matched", "words"
    )


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_weighted_minhash_dedup,
        op3_token_lengths,
        op4_minimax_shards,
        op5_template_decontamination,
        op6_backoff_lm,
        op7_ordinal_quality,
        op8_bloom_exact_dedup,
        op9_license_scan,
        op10_toxicity_lexicon,
        op11_simhash_dedup,
        op12_hard_negatives,
        op13_whitening,
    )
}
