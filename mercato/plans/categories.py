"""Product category sales.

``orders`` is already filtered to the population wanted (``sold`` or ``delivered``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.exact import MONEY, percent, rounded_ratio

# Label of products without a category, by analysis.
UNKNOWN = "Unknown"
UNCATEGORIZED = "Uncategorized"


def labelled_products(products: DataFrame, translation: DataFrame, missing: str) -> DataFrame:
    """Product to category label: translated name, else source name, else ``missing``.

    Translating products rather than item rows keeps the second lookup off the fact table.
    """
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name", F.lit(missing)).alias(
            "category"
        ),
    )


def _items_of(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    return order_items.join(orders.select("order_id"), "order_id", "left_semi")


def category_revenue(
    order_items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    missing: str = UNKNOWN,
) -> DataFrame:
    """Revenue, distinct orders and item rows per category."""
    return revenue_of_items(_items_of(orders, order_items), products, translation, missing)


def revenue_of_items(items: DataFrame, products: DataFrame, translation: DataFrame, missing: str = UNKNOWN) -> DataFrame:
    """``category_revenue`` of the items of one population.

    The distinct count is planned per (category, order_id) first, so a category that holds a large
    part of the items is spread over the cluster.
    """
    return (
        items.select("order_id", "product_id", "price")
        .join(labelled_products(products, translation, missing), "product_id")
        .groupBy("category")
        .agg(
            F.sum("price").cast(MONEY).alias("revenue"),
            F.count_distinct("order_id").alias("orders"),
            F.count("*").alias("items_sold"),
        )
        .orderBy(F.desc_nulls_first("revenue"), "category")
    )


def category_totals(
    order_items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    missing: str = UNKNOWN,
) -> DataFrame:
    """Revenue per category.

    Sums per product before the product lookup, so each product enters the join as one row however often it sold.
    """
    per_product = (
        _items_of(orders, order_items).groupBy("product_id").agg(F.sum("price").cast(MONEY).alias("revenue"))
    )
    return (
        per_product.join(labelled_products(products, translation, missing), "product_id")
        .groupBy("category")
        .agg(F.sum("revenue").cast(MONEY).alias("revenue"))
    )


def category_revenue_share(totals: DataFrame) -> DataFrame:
    """Share of each category in the revenue of ``category_totals``."""
    everything = F.sum("revenue").over(Window.partitionBy())
    return totals.withColumn("revenue_share_pct", percent("revenue", everything)).orderBy(
        F.desc_nulls_first("revenue"), "category"
    )


def category_top(totals: DataFrame, n: int = 10) -> DataFrame:
    """Categories of rank ``n`` or better; a tie at the last rank returns more than ``n`` rows."""
    rank = F.rank().over(Window.orderBy(F.desc_nulls_first("revenue"))).cast("bigint")
    return (
        totals.withColumn("revenue_rank", rank)
        .where(F.col("revenue_rank") <= n)
        .select("revenue_rank", "category", "revenue")
        .orderBy("revenue_rank", "category")
    )


def category_share_check(totals: DataFrame) -> DataFrame:
    """Sum of the shares before any rounding, 100.00 when there is revenue: the revenues are summed and divided once."""
    everything = totals.agg(F.sum("revenue").alias("revenue"))
    return everything.select(percent("revenue", "revenue").cast(MONEY).alias("total_revenue_share_pct"))


def product_category_performance(
    order_items: DataFrame, orders: DataFrame, products: DataFrame, translation: DataFrame
) -> DataFrame:
    """``category_revenue`` under the names of the published view; products without category are kept."""
    return performance_of_items(_items_of(orders, order_items), products, translation)


def performance_of_items(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """``product_category_performance`` of the items of delivered orders."""
    return revenue_of_items(items, products, translation, UNCATEGORIZED).select(
        F.col("category").alias("product_category"),
        F.col("revenue").alias("product_revenue"),
        "orders",
        F.col("items_sold").alias("items"),
    )


def category_reconciliation(performance: DataFrame) -> DataFrame:
    return performance.agg(
        F.sum("product_revenue").cast(MONEY).alias("categorized_and_uncategorized_revenue")
    )
