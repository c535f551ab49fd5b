import random
from decimal import Decimal

import pytest
from shop_rows import as_dicts
from pyspark.sql import functions as F

from mercato.operators import tiles
from mercato.operators.tiles import TileOrder


def brute_ntile(rows: list, n: int) -> list[int]:
    """Tile of each position of an already sorted list."""
    size, big = divmod(len(rows), n)
    return [tile + 1 for tile in range(n) for _ in range(size + (tile < big))]


@pytest.mark.parametrize("count", [0, 1, 3, 5, 7, 101, 1000])
def test_equals_ntile_for_any_row_count(spark, count):
    df = spark.range(count).select(F.format_string("k%05d", "id").alias("key"), (F.col("id") % 7).alias("v"))
    got = as_dicts(tiles.with_tiles(df, "key", {"t": TileOrder("v", descending=True)}, 5))
    got.sort(key=lambda r: (-r["v"], r["key"]))
    assert [r["t"] for r in got] == brute_ntile(got, 5)


def test_a_third_of_the_rows_share_one_value(spark):
    rng = random.Random(7)
    rows = [
        (f"c{i:05d}", None if i % 97 == 0 else Decimal("10.00") if i % 3 == 0 else Decimal(rng.randrange(5000)) / 100)
        for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "key string, value decimal(38,2)").repartition(7)
    got = as_dicts(
        tiles.with_tiles(
            df,
            "key",
            {
                "up": TileOrder("value"),
                "down": TileOrder("value", descending=True, nulls_first=True),
            },
            5,
        )
    )
    assert sorted(got[0]) == ["down", "key", "up", "value"]
    up = sorted(got, key=lambda r: (r["value"] is None, r["value"] or 0, r["key"]))
    assert [r["up"] for r in up] == brute_ntile(up, 5)
    down = sorted(got, key=lambda r: (r["value"] is not None, -(r["value"] or 0), r["key"]))
    assert [r["down"] for r in down] == brute_ntile(down, 5)


def test_tiles_are_a_projection(spark):
    """Once the starts are known, a tile is a comparison with constants."""
    df = spark.range(500).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("v"))
    plan = tiles.with_tiles(df, "key", {"t": TileOrder("v")}, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


@pytest.fixture
def read_rows(monkeypatch):
    """Rows of each interval that is read instead of counted."""
    counts = []
    read = tiles._read

    def counted(*args):
        found = read(*args)
        counts.extend(len(rows) for rows in found)
        return found

    monkeypatch.setattr(tiles, "_read", counted)
    return counts


def test_no_step_sees_a_group_of_ties(spark, read_rows):
    """Two thirds of 60,000 rows tie, and one id that differs early has nothing in common with the others."""
    df = spark.range(60_000).select(
        F.format_string("customer_%09d", "id").alias("key"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 101).alias("v")
    )
    df = df.union(spark.createDataFrame([("x1", 7)], "key string, v long"))
    got = as_dicts(tiles.with_tiles(df, "key", {"t": TileOrder("v")}, 5))
    got.sort(key=lambda r: (r["v"], r["key"]))
    assert [r["t"] for r in got] == brute_ntile(got, 5)
    assert read_rows and max(read_rows) <= tiles.LAST


@pytest.mark.parametrize("last", [1, 3, 50])
def test_small_bounds_refine_values_and_keys_to_the_end(spark, monkeypatch, read_rows, last):
    monkeypatch.setattr(tiles, "LAST", last)
    monkeypatch.setattr(tiles, "_PARTS", 4)
    rng = random.Random(last)
    keys = ["", "a", "ab", "abc", "b", "ä", "äß", "Customer#1", "Customer#10", "Customer#2", "🙂", "é", "e"]
    keys += [f"{'z' * rng.randrange(30)}{i}" for i in range(150)]
    rows = [(k, rng.choice([None, Decimal("-3.50"), Decimal("0.00"), Decimal("0.01"), Decimal("7.00"), Decimal(rng.randrange(10**6)) / 100])) for k in keys]
    df = spark.createDataFrame(rows, "key string, v decimal(38,2)").repartition(5)
    orders = {"up": TileOrder("v"), "down": TileOrder("v", descending=True, nulls_first=True)}
    got = as_dicts(tiles.with_tiles(df, "key", orders, 4))
    up = sorted(got, key=lambda r: (r["v"] is None, r["v"] or 0, r["key"]))
    assert [r["up"] for r in up] == brute_ntile(up, 4)
    down = sorted(got, key=lambda r: (r["v"] is not None, -(r["v"] or 0), r["key"]))
    assert [r["down"] for r in down] == brute_ntile(down, 4)
    assert max(read_rows) <= last


def test_one_key_for_all_rows(spark, monkeypatch):
    monkeypatch.setattr(tiles, "LAST", 10)
    df = spark.range(100).select(F.lit("same").alias("key"), F.lit(1).alias("v"))
    assert {r["t"] for r in as_dicts(tiles.with_tiles(df, "key", {"t": TileOrder("v")}, 5))} == {5}


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_same_tiles_for_any_partitioning(spark, parts):
    df = spark.range(2_000).select(
        F.format_string("Customer#%09d", "id").alias("key"),
        F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * 37) % 101).alias("v"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("d"),
    )
    orders = {"a": TileOrder("v", descending=True), "b": TileOrder("d", nulls_first=True)}
    rows = tiles.with_tiles(df.repartition(parts), "key", orders, 5).collect()
    by_value = sorted(rows, key=lambda r: (-r.v, r.key))
    by_date = sorted(rows, key=lambda r: (r.d, r.key))
    assert [r.a for r in by_value] == brute_ntile(rows, 5) and [r.b for r in by_date] == brute_ntile(rows, 5)
