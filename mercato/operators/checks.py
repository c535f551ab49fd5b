"""Declared constraints as counting queries; Spark tables do not enforce them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.repeats import key_repeats
from mercato.schemas import TABLE_SPECS
from mercato.sources.tables import Tables


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_not_null(tables: Tables) -> DataFrame:
    """NULLs in key columns and in columns declared NOT NULL: one aggregate pass per table, whatever its column count."""
    found = []
    for name, df in tables.named().items():
        columns = TABLE_SPECS[name].required
        if columns:
            counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
            found.append(
                counts.select(
                    F.explode(
                        F.array(
                            *[
                                F.struct(
                                    F.lit(name).alias("table_name"),
                                    F.lit(c).alias("column_name"),
                                    F.col(c).alias("null_rows"),
                                )
                                for c in columns
                            ]
                        )
                    ).alias("r")
                ).select("r.*")
            )
    return union_all(found)


def check_primary_keys(tables: Tables) -> DataFrame:
    """Keys that occur more than once, the rows beyond the first of each, and the rows whose key has a NULL part.

    A NULL part makes a key invalid by itself, so such rows are not counted as repeats. A first pass over hashes of the keys runs at once (see
    :func:`mercato.operators.repeats.key_repeats`).
    """
    keyed = {name: (df, TABLE_SPECS[name].primary_key) for name, df in tables.named().items() if TABLE_SPECS[name].primary_key}
    columns = F.create_map(*[F.lit(v) for name, (_, key) in keyed.items() for v in (name, ", ".join(key))])
    return key_repeats(keyed).select(
        F.col("name").alias("table_name"),
        columns[F.col("name")].alias("key_columns"),
        "duplicate_groups",
        "extra_rows",
        "null_key_rows",
    )


def check_foreign_keys(tables: Tables) -> DataFrame:
    """Child rows whose parent is missing, by reference.

    Each child table is scanned once, every row giving a key per reference, and each parent table once. Keys are counted per (parent, key) before they
    meet their parents, with one count per reference: a key that holds a large part of a table enters the join as one row, and one join, on the
    partitioning of the counts, serves all references.
    """
    frames = tables.named()
    references = [(name, fk) for name in frames for fk in TABLE_SPECS[name].foreign_keys]
    place = {(name, fk.column): i for i, (name, fk) in enumerate(references)}
    # Tables and references go by number: these rows are many.
    number = {parent: i for i, parent in enumerate(dict.fromkeys(fk.parent for _, fk in references))}
    asked = []
    for name, df in frames.items():
        keys = TABLE_SPECS[name].foreign_keys
        if keys:
            cells = [
                F.struct(F.lit(number[fk.parent]).alias("parent"), F.col(fk.column).alias("key"), F.lit(place[name, fk.column]).alias("place"))
                for fk in keys
            ]
            asked.append(df.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where("key is not null"))
    counts = [F.count_if(F.col("place") == n).alias(f"n{n}") for n in place.values()]
    counted = union_all(asked).groupBy("parent", "key").agg(*counts)
    parents = union_all([
        frames[parent].select(F.lit(number[parent]).alias("parent"), F.col(column).alias("key"), F.lit(True).alias("known"))
        for parent, column in dict.fromkeys((fk.parent, fk.parent_column) for _, fk in references)
    ])
    # An anti-join would be pushed below the counts and into each child's scan, and so read every parent once per child. A repeated parent key
    # multiplies only keys that are not counted.
    missing = counted.join(parents, ["parent", "key"], "left").where("known is null")
    orphans = missing.agg(*[F.coalesce(F.sum(f"n{n}"), F.lit(0)).alias(f"n{n}") for n in place.values()])
    rows = [
        F.struct(
            F.lit(name).alias("child_table"),
            F.lit(fk.column).alias("child_column"),
            F.lit(fk.parent).alias("parent_table"),
            F.col(f"n{place[name, fk.column]}").alias("orphan_rows"),
        )
        for name, fk in references
    ]
    return orphans.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_review_score_range(reviews: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """Scores outside the allowed range; a missing score is allowed."""
    return reviews.agg(
        F.count_if(F.col("review_score").isNotNull() & ~F.col("review_score").between(low, high)).alias(
            "violating_rows"
        )
    )
