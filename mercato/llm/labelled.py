"""Bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: Column, rows: int, text: str = "text", key: str = "doc_id", seed: str = "fit"
) -> DataFrame:
    """At most ``rows`` distinct labelled texts (``text``, ``label``), chosen by a hash of the id.

    An id with several labels takes the largest; null labels and ids are left out. Only ids are ranked, and the bound on their number is what
    makes the broadcast and everything fitted on the sample bounded.
    """
    marked = labels.select(F.col(key).alias("__id"), label.cast("int").alias("label")).where(
        F.col("__id").isNotNull() & F.col("label").isNotNull()
    )
    chosen = (
        marked.groupBy("__id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "__id"), "__id")
        .limit(rows)
    )
    met = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("__key") == F.col("__id")
    )
    # Copies of one text would count as independent evidence.
    return met.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("label").alias("label"))
