"""Load counts and profile queries over the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.exact import percent, rounded_ratio
from mercato.operators.checks import union_all
from mercato.operators.repeats import key_repeats
from mercato.sources.tables import Tables


def load_row_counts(tables: Tables) -> DataFrame:
    return union_all(
        [
            df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.named().items()
        ]
    )


def customer_ids(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count("*").alias("total_rows"),
        F.count_distinct("customer_id").alias("unique_customer_ids"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
    )


def order_ids(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count("*").alias("total_rows"), F.count_distinct("order_id").alias("unique_order_ids")
    )


def status_distribution(orders: DataFrame) -> DataFrame:
    """Orders per status and their share; the total runs over the grouped rows only."""
    everything = F.sum("orders").over(Window.partitionBy())
    return (
        orders.groupBy("order_status")
        .agg(F.count("*").alias("orders"))
        .withColumn("pct", percent("orders", everything))
        .orderBy(F.desc("orders"), F.asc_nulls_last("order_status"))
    )


def order_date_range(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.min("order_purchase_timestamp").alias("first_order"),
        F.max("order_purchase_timestamp").alias("last_order"),
    )


def order_date_completeness(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count("*").alias("total_orders"),
        F.count("order_purchase_timestamp").alias("purchase_dates"),
        F.count("order_approved_at").alias("approved_dates"),
        F.count("order_delivered_carrier_date").alias("carrier_dates"),
        F.count("order_delivered_customer_date").alias("delivered_dates"),
        F.count("order_estimated_delivery_date").alias("estimated_dates"),
    )


def orders_without_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders, NULL customer included, that match no customer; counted per customer before the join."""
    return (
        orders.groupBy("customer_id")
        .agg(F.count("*").alias("n"))
        .join(customers.select("customer_id"), "customer_id", "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders_without_customer"))
    )


def payment_structure(payments: DataFrame) -> DataFrame:
    return payments.agg(
        F.count("*").alias("payment_rows"), F.count_distinct("order_id").alias("orders_with_payments")
    )


def payments_per_order(payments: DataFrame) -> DataFrame:
    """Histogram of the number of payment rows per order."""
    per_order = payments.groupBy("order_id").agg(F.count("*").alias("payment_count"))
    return (
        per_order.groupBy("payment_count")
        .agg(F.count("*").alias("number_of_orders"))
        .orderBy("payment_count")
    )


def review_structure(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count("*").alias("total_review_rows"),
        F.count_distinct("review_id").alias("unique_review_ids"),
        F.count_distinct("order_id").alias("orders_with_reviews"),
    )


def review_scores(reviews: DataFrame) -> DataFrame:
    return (
        reviews.groupBy("review_score")
        .agg(F.count("*").alias("review_count"))
        .orderBy(F.asc_nulls_last("review_score"))
    )


def _multi_review_orders(reviews: DataFrame) -> DataFrame:
    return (
        reviews.groupBy("order_id").agg(F.count("*").alias("review_count")).where(F.col("review_count") > 1)
    )


def orders_multi_review_count(reviews: DataFrame) -> DataFrame:
    return _multi_review_orders(reviews).agg(F.count("*").alias("orders_with_multiple_reviews"))


def orders_multi_review_top(reviews: DataFrame, n: int = 20) -> DataFrame:
    return _multi_review_orders(reviews).orderBy(F.desc("review_count"), "order_id").limit(n)


def item_structure(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("total_item_rows"),
        F.count_distinct("order_id").alias("orders_with_items"),
        F.count_distinct("product_id").alias("unique_products"),
        F.count_distinct("seller_id").alias("unique_sellers"),
    )


def item_key_uniqueness(items: DataFrame) -> DataFrame:
    """Distinct keys as one row value, so that a key with a NULL part still counts; only keys with a repeated hash are compared whole."""
    return key_repeats({"items": (items, ("order_id", "order_item_id"))}).select(
        F.col("rows").alias("total_rows"), (F.col("rows") - F.col("extra_rows_any")).alias("unique_order_items")
    )


def price_freight_stats(items: DataFrame, places: int = 12) -> DataFrame:
    """Bounds and averages; an average has ``places`` digits after the point, beyond any difference between prices in cents."""
    return items.agg(
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_n"),
        F.min("freight_value").alias("min_freight"),
        F.max("freight_value").alias("max_freight"),
        F.sum("freight_value").alias("freight_sum"),
        F.count("freight_value").alias("freight_n"),
    ).select(
        "min_price",
        "max_price",
        rounded_ratio("price_sum", "price_n", places).alias("avg_price"),
        "min_freight",
        "max_freight",
        rounded_ratio("freight_sum", "freight_n", places).alias("avg_freight"),
    )


def negative_price(items: DataFrame) -> DataFrame:
    return items.where(F.col("price") < 0).agg(F.count("*").alias("negative_price_rows"))


def negative_freight(items: DataFrame) -> DataFrame:
    return items.where(F.col("freight_value") < 0).agg(F.count("*").alias("negative_freight_rows"))
