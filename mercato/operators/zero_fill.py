"""Complete an integer axis inside each group, with zeros where no row exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_fill(
    rows: DataFrame,
    axis: str,
    values: Sequence[str],
    first: Column,
    last: Column,
    by: Sequence[str] = (),
    carry: Sequence[Column] = (),
) -> DataFrame:
    """One row per group and axis value in ``first..last``, measures defaulting to zero.

    ``rows`` must be aggregated already, one row per group and axis value, on a calendar axis: a group
    then has as many rows as the calendar has months, so a map per group is small and the grid
    needs neither a self-join nor a second pass over the facts. ``first``, ``last`` and ``carry`` are
    aggregate expressions over the group. Rows outside the range drop out, an empty range gives no rows.
    """
    # No alias may repeat an input name: aggregates such as max(axis) still refer to the input.
    known = F.collect_list(
        F.when(F.col(axis).isNotNull(), F.struct(F.col(axis).alias("k"), F.struct(*values).alias("v")))
    )
    groups = rows.groupBy(*by).agg(
        F.map_from_entries(known).alias("_known"),
        first.cast("int").alias("_first"),
        last.cast("int").alias("_last"),
        *carry,
    )
    # sequence(0, -1) counts downwards, hence the guard.
    span = F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last"))
    carried = [c for c in groups.columns if c not in {*by, "_known", "_first", "_last"}]
    grid = groups.select(*by, *carried, "_known", F.explode(span).alias(axis))
    cell = F.try_element_at("_known", F.col(axis))
    types = dict(rows.dtypes)
    return grid.select(
        *by,
        axis,
        *carried,
        *[F.coalesce(cell[v], F.lit(0).cast(types[v])).alias(v) for v in values],
    )
