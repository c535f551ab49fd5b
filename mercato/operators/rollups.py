"""Bring each order-related table to one row per order before it is joined.

Grouping comes first so that several items, payments and reviews of one order never multiply each other.
It also keeps the joins even (each side has one row per order, however many items one order has) and lets
Catalyst prove that an unused roll-up can be dropped from a plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.exact import MONEY, mean_score


def order_revenue(order_items: DataFrame) -> DataFrame:
    return order_items.groupBy("order_id").agg(
        F.sum("price").cast(MONEY).alias("product_revenue"),
        F.sum("freight_value").cast(MONEY).alias("freight_revenue"),
        F.sum(F.col("price") + F.col("freight_value")).cast(MONEY).alias("total_order_value"),
        F.count("*").alias("item_count"),
    )


def order_payments(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").cast(MONEY).alias("total_payment_value"),
        F.count("*").alias("payment_row_count"),
        F.max("payment_installments").alias("max_installments"),
    )


def order_reviews(reviews: DataFrame) -> DataFrame:
    """The average is rounded to two places here; later averages start from the rounded value."""
    scored = reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("_score"),
        F.count("review_score").alias("_scored"),
        F.count("*").alias("review_count"),
    )
    return scored.select(
        "order_id", mean_score("_score", "_scored").alias("average_review_score"), "review_count"
    )
