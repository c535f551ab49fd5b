"""Exact NTILE over a whole table by the keys at which its tiles start."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Values are compared as decimals of this type, dates as days.
_SORT_TYPE = "decimal(38,6)"
# Steps of the coarse scale per doubling of a value: at most some ten thousand steps exist, whatever the table's size.
_STEPS = 64
# Parts into which an interval of values is cut, and hexadecimal digits by which keys are told apart: 4096 counts per interval and round.
_PARTS, _DIGITS = 4096, 3
# An interval of this many rows or fewer is read instead of counted.
LAST = 4096


@dataclass(frozen=True)
class TileOrder:
    """Sort order of one NTILE: a numeric or date column, then the key."""

    value: str
    descending: bool = False
    nulls_first: bool = False


Start = tuple[int, Decimal, str]


@dataclass(frozen=True)
class _Interval:
    """Rows of one order between two values, or of one value with keys of one beginning, and the positions in it that start a tile."""

    order: str
    rank: int
    low: Decimal
    high: Decimal
    rows: int
    wanted: tuple[tuple[int, int], ...] = field(default=())
    prefix: str | None = None

    def holds(self, row: Column) -> Column:
        # The value comes first: a column of the table that Parquet's own ranges can be compared with.
        inside = (row["r"] == self.rank) & row["s"].between(_decimal(self.low), _decimal(self.high))
        return inside if self.prefix is None else inside & _digits(row["id"]).startswith(self.prefix)


def with_tiles(df: DataFrame, key: str, orders: Mapping[str, TileOrder], n: int) -> DataFrame:
    """Add one ``ntile(n)`` column per entry of ``orders``; ``key`` is a string that settles ties.

    A window without PARTITION BY would sort every row in a single task. Here only the first row of each tile is looked for (see
    :func:`tile_starts`, whose jobs run at once and read ``df`` two or more times, so it is best a stored table); a row's tile then
    follows from comparing its value and key with at most ``n - 1`` constants, without any shuffle.
    """
    starts = tile_starts(df, key, orders, n)

    def tile(name: str, order: TileOrder) -> Column:
        row = _row(df, key, order)
        place = F.struct(row["r"], row["s"], row["id"])
        reached = [F.struct(F.lit(r).alias("r"), _decimal(s).alias("s"), F.lit(i).alias("id")) <= place for r, s, i in starts[name]]
        return reduce(add, [reach.cast("int") for reach in reached], F.lit(1))

    return df.withColumns({name: tile(name, order) for name, order in orders.items()})


def tile_starts(df: DataFrame, key: str, orders: Mapping[str, TileOrder], n: int) -> dict[str, list[Start]]:
    """NULL rank, value and key of the first rows of tiles 2..n of each order, by counting.

    A selection for all starts at once, by ever finer histograms. The first counts the rows of each step of a coarse scale. An interval that holds a
    start and has more than LAST rows is cut further: between its least and greatest value into equal parts; where it is a single value, by the digits
    that follow what all its keys begin with. Each round is one pass that brings a bounded number of counts to the driver, and makes every interval
    smaller, whatever the values and keys look like. Intervals of at most LAST rows are read: no task and no step sees a whole group of ties.
    """
    rows = {name: _row(df, key, order) for name, order in orders.items()}
    total, open_ = _coarse(df, rows)
    positions = [(j, j * (total // n) + min(j, total % n)) for j in range(1, n)]
    at = {name: tuple((j, p) for j, p in positions if p < total) for name in orders}
    intervals = [found for name in orders for found in _holding([i for i in open_ if i.order == name], at[name])]
    starts: dict[tuple[str, int], Start] = {}
    while large := [i for i in intervals if i.rows > LAST]:
        small = [i for i in intervals if i.rows <= LAST]
        of_values = [i for i in large if i.low < i.high]
        of_keys, single = _common_prefixes(df, rows, [i for i in large if i.low == i.high])
        for interval, only in single:
            starts |= {(interval.order, j): (interval.rank, interval.low, only) for j, _ in interval.wanted}
        intervals = small + _refined(df, rows, of_values, _value_part, _value_parts) + _refined(df, rows, of_keys, _key_part, _key_parts)
    for interval, found in zip(intervals, _read(df, rows, intervals), strict=True):
        starts |= {(interval.order, j): (interval.rank, *found[p]) for j, p in interval.wanted}
    return {name: [starts[name, j] for j, _ in at[name]] for name in orders}


def _decimal(value: Decimal) -> Column:
    return F.lit(str(value)).cast(_SORT_TYPE)


def _digits(key: Column) -> Column:
    """A key's bytes in UTF-8 as hexadecimal digits, which sort as the keys do."""
    return F.hex(key.cast("binary"))


def _row(df: DataFrame, key: str, order: TileOrder) -> dict[str, Column]:
    """Place of a row in one order: NULL rank, sort value, key."""
    value = F.col(order.value)
    if isinstance(df.schema[order.value].dataType, T.DateType):
        value = F.unix_date(value)
    value = value.cast(_SORT_TYPE)
    value = F.coalesce(-value if order.descending else value, F.lit(0).cast(_SORT_TYPE))
    rank = F.when(F.col(order.value).isNull(), -1 if order.nulls_first else 1).otherwise(0)
    return {"r": rank, "s": value, "id": F.col(key)}


def _coarse(df: DataFrame, rows: Mapping[str, dict[str, Column]]) -> tuple[int, list[_Interval]]:
    """The number of rows, and all steps of the coarse scale with their counts."""

    def step(row: dict[str, Column]) -> Column:
        size = row["s"].cast("double")
        return (F.signum(size) * F.floor(F.log2(F.abs(size) + 1) * _STEPS)).cast("int")

    places = [
        F.struct(F.lit(name).alias("o"), row["r"].alias("r"), step(row).alias("a"), row["s"].alias("s")) for name, row in rows.items()
    ]
    counted = (
        df.select(F.explode(F.array(*places)).alias("p"))
        .groupBy("p.o", "p.r", "p.a")
        .agg(F.count("*").alias("n"), F.min("p.s").alias("low"), F.max("p.s").alias("high"))
        .collect()
    )
    steps = [_Interval(c.o, c.r, c.low, c.high, c.n) for c in sorted(counted, key=lambda c: (c.o, c.r, c.a))]
    return sum(i.rows for i in steps if i.order == next(iter(rows), None)), steps


def _holding(parts: list[_Interval], wanted: tuple[tuple[int, int], ...]) -> list[_Interval]:
    """Of consecutive parts those that hold a wanted position, which is then counted from the part's first row."""
    found, before = [], 0
    for part in parts:
        inside = tuple((j, p - before) for j, p in wanted if before <= p < before + part.rows)
        if inside:
            found.append(replace(part, wanted=inside))
        before += part.rows
    return found


def _value_part(interval: _Interval, row: dict[str, Column]) -> Column:
    width = F.lit(float(interval.high - interval.low))
    return F.floor((row["s"] - _decimal(interval.low)).cast("double") / width * _PARTS).cast("string")


def _value_parts(interval: _Interval, counted: list) -> list[_Interval]:
    ordered = sorted(counted, key=lambda c: int(c.part))
    return [replace(interval, low=c.low, high=c.high, rows=c.n, wanted=()) for c in ordered]


def _key_part(interval: _Interval, row: dict[str, Column]) -> Column:
    return F.substring(_digits(row["id"]), 1, len(interval.prefix) + _DIGITS)


def _key_parts(interval: _Interval, counted: list) -> list[_Interval]:
    ordered = sorted(counted, key=lambda c: c.part)
    return [replace(interval, prefix=c.part, rows=c.n, wanted=()) for c in ordered]


def _refined(df: DataFrame, rows: Mapping[str, dict], intervals: list[_Interval], part: Callable, parts: Callable) -> list[_Interval]:
    """The parts of all intervals that hold a wanted position, counted in one pass."""
    if not intervals:
        return []
    cells = [
        F.when(i.holds(rows[i.order]), F.struct(F.lit(k).alias("k"), part(i, rows[i.order]).alias("part"), rows[i.order]["s"].alias("s")))
        for k, i in enumerate(intervals)
    ]
    counted = (
        df.select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
        .groupBy("c.k", "c.part")
        .agg(F.count("*").alias("n"), F.min("c.s").alias("low"), F.max("c.s").alias("high"))
        .collect()
    )
    return [
        found
        for k, interval in enumerate(intervals)
        for found in _holding(parts(interval, [c for c in counted if c.k == k]), interval.wanted)
    ]


def _common_prefixes(
    df: DataFrame, rows: Mapping[str, dict], intervals: list[_Interval]
) -> tuple[list[_Interval], list[tuple[_Interval, str]]]:
    """Intervals of one value with the digits that all their keys begin with; those of a single key apart, with the key."""
    if not intervals:
        return [], []
    ends = [
        end(F.when(i.holds(rows[i.order]), rows[i.order]["id"])).alias(f"{name}{k}")
        for k, i in enumerate(intervals)
        for name, end in (("least", F.min), ("most", F.max))
    ]
    found = df.agg(*ends).first()
    several, single = [], []
    for k, interval in enumerate(intervals):
        least, most = found[f"least{k}"], found[f"most{k}"]
        if least == most:
            single.append((interval, least))
            continue
        pairs = zip(least.encode().hex().upper(), most.encode().hex().upper(), strict=False)
        same = next((at for at, (a, b) in enumerate(pairs) if a != b), min(len(least.encode()), len(most.encode())) * 2)
        several.append(replace(interval, prefix=least.encode().hex().upper()[:same]))
    return several, single


def _read(df: DataFrame, rows: Mapping[str, dict], intervals: list[_Interval]) -> list[list[tuple[Decimal, str]]]:
    """Values and keys of each interval in their order; at most LAST rows of each."""
    if not intervals:
        return []
    cells = [
        F.when(i.holds(rows[i.order]), F.struct(F.lit(k).alias("k"), rows[i.order]["s"].alias("s"), rows[i.order]["id"].alias("id")))
        for k, i in enumerate(intervals)
    ]
    found = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*").collect()
    return [sorted((c.s, c.id) for c in found if c.k == k) for k in range(len(intervals))]
