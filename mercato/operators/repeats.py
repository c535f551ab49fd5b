"""Repeated keys in two passes: hashes of all keys, then the keys behind repeated hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Repeated hashes that are sent to all executors, some 32 MB; more of them are joined.
BROADCAST = 1 << 20


def key_repeats(keyed: Mapping[str, tuple[DataFrame, Sequence[str]]], bits: int = 64) -> DataFrame:
    """Rows, rows whose key has a NULL part, and repeated keys of each of the named tables, with their key columns.

    ``duplicate_groups`` and ``extra_rows`` count whole keys that occur more than once and their rows beyond the first;
    ``extra_rows_any`` counts the latter for all keys, a NULL part being a value.

    Whole keys are wide and nearly all unique, so grouping by them would shuffle the tables for nothing. The first pass, a job that runs at once for
    all tables, shuffles a hash of ``bits`` bits per key and counts the hashes that occur twice; for most tables that is all. In the others only rows
    behind such a hash are grouped by their keys, so two keys with one hash change nothing in the result.
    """
    names = list(keyed)
    hashed = [
        df.select(F.lit(place).alias("place"), _hash(key, bits).alias("hash"), _has_null(key).alias("null_part"))
        for place, (df, key) in enumerate(keyed.values())
    ]
    groups = reduce(DataFrame.union, hashed).groupBy("place", "hash").agg(F.count("*").alias("n"), F.count_if("null_part").alias("nulls"))
    totals = groups.groupBy("place").agg(
        F.sum("n").alias("rows"), F.sum("nulls").alias("nulls"), F.count_if(F.col("n") > 1).alias("suspects")
    )
    found = {names[r["place"]]: r for r in totals.collect()}
    return reduce(DataFrame.union, [_resolved(name, df, key, bits, found.get(name)) for name, (df, key) in keyed.items()])


def _hash(key: Sequence[str], bits: int) -> Column:
    whole = F.xxhash64(*key)
    return whole if bits == 64 else F.pmod(whole, F.lit(1 << bits))


def _has_null(key: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in key])


def _resolved(name: str, df: DataFrame, key: Sequence[str], bits: int, found: Row | None) -> DataFrame:
    """One row for one table; a table without repeated hashes is not read again."""
    rows, nulls, suspects = (found["rows"], found["nulls"], found["suspects"]) if found else (0, 0, 0)
    numbers = [F.lit(name).alias("name"), F.lit(rows).cast("long").alias("rows"), F.lit(nulls).cast("long").alias("null_key_rows")]
    counted = ("duplicate_groups", "extra_rows", "extra_rows_any")
    if not suspects:
        return df.sparkSession.range(0, 1, 1, 1).select(*numbers, *[F.lit(0).cast("long").alias(c) for c in counted])
    repeated = df.groupBy(_hash(key, bits).alias("hash")).agg(F.count("*").alias("n")).where("n > 1").select("hash")
    repeated = F.broadcast(repeated) if suspects <= BROADCAST else repeated
    groups = (
        df.select(*key, _hash(key, bits).alias("hash"))
        .join(repeated, "hash", "left_semi")
        .groupBy(*key)
        .agg(F.count("*").alias("n"))
        .withColumn("repeated", ~_has_null(key) & (F.col("n") > 1))
    )
    totals = groups.agg(
        F.count_if("repeated").alias(counted[0]),
        F.coalesce(F.sum(F.when(F.col("repeated"), F.col("n") - 1)), F.lit(0)).alias(counted[1]),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(counted[2]),
    )
    return totals.select(*numbers, *counted)
