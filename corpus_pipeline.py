"""The corpus pipeline: each stage is one operator of ``mercato.llm`` and works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercato.llm.common import Stored, table
from mercato.llm.decontaminate import decontaminate
from mercato.llm.mixing import emit, mix
from mercato.llm.near_dedup import near_dedup
from mercato.llm.queries import quality_scores
from mercato.llm.sharding import shard


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of grade 1 or higher, by a model fitted on the labelled ones among them."""
    return quality_scores(spark, docs, sf_dir).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies."""
    return near_dedup(docs).where("kept").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, re-parameterised ones included."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return emit(mix(docs), docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it."""
    return shard(docs).select(*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


STAGES = [
    ("keep_quality", keep_quality),
    ("drop_near_copies", drop_near_copies),
    ("drop_benchmark", drop_benchmark),
    ("mix_sources", mix_sources),
    ("cut_shards", cut_shards),
]

#: Training and iterated components have no SQL counterpart; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next one reads them."""
    stored = Stored(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
