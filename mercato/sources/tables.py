"""Readers and writers for the nine input tables and the marts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.schemas import TABLE_SPECS
from mercato.sources.records import read_multiline_csv


class Tables:
    """The nine input tables, named as their files are; each is opened on first use."""

    def __init__(self, open_table: Callable[[str], DataFrame]) -> None:
        self._open = cache(open_table)

    @property
    def customers(self) -> DataFrame:
        return self._open("customers")

    @property
    def sellers(self) -> DataFrame:
        return self._open("sellers")

    @property
    def products(self) -> DataFrame:
        return self._open("products")

    @property
    def product_category_name_translation(self) -> DataFrame:
        return self._open("product_category_name_translation")

    @property
    def orders(self) -> DataFrame:
        return self._open("orders")

    @property
    def order_items(self) -> DataFrame:
        return self._open("order_items")

    @property
    def order_payments(self) -> DataFrame:
        return self._open("order_payments")

    @property
    def order_reviews(self) -> DataFrame:
        return self._open("order_reviews")

    @property
    def geolocation(self) -> DataFrame:
        return self._open("geolocation")

    def named(self) -> dict[str, DataFrame]:
        return {name: self._open(name) for name in TABLE_SPECS}


# The only table whose text may hold line breaks.
FREE_TEXT_TABLE = "order_reviews"


def read_csv(spark: SparkSession, name: str, path: str, multiline: bool | None = None) -> DataFrame:
    """One table from CSV with its declared schema; a value of the wrong type stops the load.

    ``path`` may be a folder. With ``multiline``, by default for review files, quoted line breaks are resolved across the byte ranges of a file, so
    that many tasks read it (:func:`mercato.sources.records.read_multiline_csv`); pass False where comments are single lines.
    """
    if multiline is None:
        multiline = name == FREE_TEXT_TABLE
    schema = TABLE_SPECS[name].schema
    options = {"mode": "FAILFAST", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    if multiline:
        return read_multiline_csv(spark, path, schema, options)
    return spark.read.schema(schema).options(header=True, enforceSchema=False, **options).csv(path)


def tables_from_csv(spark: SparkSession, paths: dict[str, str]) -> Tables:
    return Tables(lambda name: read_csv(spark, name, paths[name]))


def tables_from_parquet(spark: SparkSession, root: str) -> Tables:
    """Tables written by :func:`write_tables`."""
    return Tables(lambda name: spark.read.schema(TABLE_SPECS[name].schema).parquet(f"{root}/{name}"))


def write_tables(tables: Tables, root: str, mode: str = "errorifexists") -> None:
    """Load step: turn CSV input into Parquet once, so that later scans prune and push down."""
    for name, df in tables.named().items():
        df.write.mode(mode).parquet(f"{root}/{name}")


def write_bucketed_tables(
    tables: Tables, database: str, buckets: int, root: str | None = None, mode: str = "errorifexists"
) -> None:
    """Load step into catalog tables of ``database``: what belongs to an order is stored in ``buckets`` buckets by ``order_id``.

    Orders, items, payments and reviews then meet without any shuffle, in :func:`mercato.plans.order_model.order_analytics` and in every later run. Choose
    ``buckets`` so that one holds 128 to 256 MB of items. A bucket is one task's: where a single order holds a large part of all items,
    keep the tables of :func:`write_tables`, whose joins are shuffled and can be split. ``root`` puts the files there instead of in the warehouse.
    """
    for name, df in tables.named().items():
        writer = df.write.mode(mode).format("parquet")
        if "order_id" in df.columns:
            # One file per bucket: rows come to the tasks that write their bucket, sorted by it.
            writer = df.repartition(buckets, "order_id").write.mode(mode).format("parquet").bucketBy(buckets, "order_id").sortBy("order_id")
        if root:
            writer = writer.option("path", f"{root}/{name}")
        writer.saveAsTable(f"{database}.{name}")


def tables_from_catalog(spark: SparkSession, database: str) -> Tables:
    """Tables written by :func:`write_bucketed_tables`."""
    return Tables(lambda name: spark.table(f"{database}.{name}"))


def register_tables(tables: Tables) -> None:
    for name, df in tables.named().items():
        df.createOrReplaceTempView(name)


def table_presence(spark: SparkSession, names: Iterable[str] = tuple(TABLE_SPECS)) -> DataFrame:
    """Which of the expected tables the catalog knows, in name order."""
    found = [(name,) for name in sorted(names) if spark.catalog.tableExists(name)]
    return spark.createDataFrame(found, "table_name string").orderBy(F.col("table_name"))
