"""One row per order: the frame that every later analysis starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.calendar import days_late, month_start
from mercato.operators import rollups
from mercato.sources.tables import Tables

# The two populations.
DELIVERED = "delivered"
NOT_SOLD = ("canceled", "unavailable")

ALL_PARTS = ("person", "items", "payments", "reviews")

ORDER_COLUMNS = (
    "order_id",
    "customer_id",
    "order_status",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)


def orders_clean(orders: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Orders with month, date and delay, and with the person behind ``customer_id``.

    Leave ``customers`` out where the person is not needed: the lookup is the one join Catalyst cannot
    drop by itself. Both of its sides are plain scans, so AQE can split a customer that holds a large part of
    the orders.
    """
    derived = [
        month_start("order_purchase_timestamp").alias("purchase_month"),
        F.col("order_purchase_timestamp").cast("date").alias("purchase_date"),
        days_late("order_delivered_customer_date", "order_estimated_delivery_date").alias(
            "delivery_delay_days"
        ),
    ]
    if customers is None:
        return orders.select(*ORDER_COLUMNS, *derived)
    people = customers.select("customer_id", "customer_unique_id")
    return orders.join(people, "customer_id", "left").select(
        *ORDER_COLUMNS[:2], "customer_unique_id", *ORDER_COLUMNS[2:], *derived
    )


def order_analytics(tables: Tables, parts: Sequence[str] = ALL_PARTS) -> DataFrame:
    """Clean orders with the person and the item, payment and review roll-ups.

    ``parts`` names what the caller reads, so that a report without payments does not plan their join. The
    roll-ups join on one key: the order side is shuffled once for all three.
    """
    facts = orders_clean(tables.orders, tables.customers if "person" in parts else None)
    if "items" in parts:
        facts = facts.join(rollups.order_revenue(tables.order_items), "order_id", "left")
    if "payments" in parts:
        facts = facts.join(rollups.order_payments(tables.order_payments), "order_id", "left")
    if "reviews" in parts:
        facts = facts.join(rollups.order_reviews(tables.order_reviews), "order_id", "left")
    return facts


def delivered(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("order_status") == DELIVERED)


def sold(facts: DataFrame, excluded: Sequence[str] = NOT_SOLD) -> DataFrame:
    """Everything not canceled or unavailable; an order without status belongs to neither population."""
    return facts.where(~F.col("order_status").isin(*excluded))
