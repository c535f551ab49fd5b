"""Figures of customers and months kept per batch of orders, so that new orders do not have old ones read again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, LongType, StringType, StructField, StructType, TimestampNTZType

from mercato.functions.exact import MONEY
from mercato.plans import cohorts, executive, rfm
from mercato.plans.order_model import DELIVERED, delivered, order_analytics
from mercato.sources.tables import Tables

KEYS = ("customer_unique_id", "purchase_month")
SUMS = (
    "orders",
    "product_revenue",
    "total_order_value",
    "valued",
    "score_sum",
    "scored",
    "late_orders",
    "orders_with_delivery_data",
)
_MONEY_SUMS = ("product_revenue", "total_order_value", "score_sum")
STATE = StructType(
    [
        StructField("customer_unique_id", StringType()),
        StructField("purchase_month", TimestampNTZType()),
        *(StructField(name, DecimalType(38, 2) if name in _MONEY_SUMS else LongType()) for name in SUMS),
        StructField("first_purchase_date", DateType()),
        StructField("last_purchase_date", DateType()),
        StructField("batch", StringType()),
    ]
)


def batch_state(facts: DataFrame) -> DataFrame:
    """One row per customer and month of delivered orders: sums and the first and last day, all of which can be merged.

    Orders without a known customer or a date have rows of their own, under NULL.
    """
    return (
        delivered(facts)
        .groupBy(*KEYS)
        .agg(
            *executive.order_sums(),
            F.min("purchase_date").alias("first_purchase_date"),
            F.max("purchase_date").alias("last_purchase_date"),
        )
    )


def tables_of_batch(tables: Tables, of_batch: Column) -> Tables:
    """The tables with those orders alone that ``of_batch`` picks; an order it is NULL for is not picked."""
    return Tables(lambda name: tables.orders.where(of_batch) if name == "orders" else getattr(tables, name))


def write_batch(tables: Tables, root: str, batch: str) -> None:
    """Store the state of one batch below ``root``; ``tables`` need only hold the batch's orders and what belongs to them.

    Every order belongs to one batch, such as its purchase month. Writing a batch again, after a delivery or a correction, replaces that batch and
    no other: the partitions written are put in place when the job commits. A row without orders stands for the batch itself, so a batch
    that has become empty is replaced as well.
    """
    facts = order_analytics(tables, ("person", "items", "reviews"))
    rows = batch_state(facts).select(*(F.col(f.name).cast(f.dataType) for f in STATE.fields[:-1]))
    spark = facts.sparkSession
    itself = spark.range(1).select(
        *((F.lit(0) if f.name == "orders" else F.lit(None)).cast(f.dataType).alias(f.name) for f in STATE.fields[:-1])
    )
    marked = rows.unionByName(itself).withColumn("batch", F.lit(batch))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(root)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The state of all batches together, one row per customer and month."""
    rows = spark.read.schema(STATE).parquet(root).where(F.col("orders") > 0)
    return rows.groupBy(*KEYS).agg(
        *(F.sum(name).cast(STATE[name].dataType).alias(name) for name in SUMS),
        F.min("first_purchase_date").alias("first_purchase_date"),
        F.max("last_purchase_date").alias("last_purchase_date"),
    )


def as_purchases(state: DataFrame) -> DataFrame:
    """The state as one delivered purchase per customer and month, on its first day: all that the cohort reports read of the orders."""
    return state.select(*KEYS, F.col("first_purchase_date").alias("purchase_date"), F.lit(DELIVERED).alias("order_status"))


def customer_totals(state: DataFrame) -> DataFrame:
    """What :func:`rfm.customer_totals` computes from orders, for ``rfm.rfm_scores(..., totals=...)``."""
    return (
        state.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            F.max("last_purchase_date").alias("last_purchase_date"),
            F.sum("orders").alias("frequency"),
            F.sum("product_revenue").cast(MONEY).alias("monetary"),
        )
    )


def executive_kpis(state: DataFrame) -> DataFrame:
    per_customer = state.groupBy("customer_unique_id").agg(*(F.sum(name).alias(name) for name in SUMS))
    return executive.kpis_of_customers(per_customer)


def monthly_business_performance(state: DataFrame) -> DataFrame:
    customers = F.count("customer_unique_id").alias("customers")
    return executive.report_of_months(
        state.groupBy("purchase_month").agg(customers, *(F.sum(name).cast(STATE[name].dataType).alias(name) for name in SUMS))
    )


def customer_rfm(state: DataFrame, snapshot: dt.date | None = None) -> DataFrame:
    totals = state.groupBy("customer_unique_id").agg(
        F.sum("orders").alias("frequency"),
        F.sum("product_revenue").cast(MONEY).alias("monetary_value"),
        F.sum("total_order_value").cast(MONEY).alias("total_order_value"),
        F.max("last_purchase_date").alias("last_purchase_date"),
    )
    return rfm.customer_rfm_of_totals(totals, snapshot)


def state_marts(spark: SparkSession, root: str, snapshot: dt.date | None = None) -> dict[str, DataFrame]:
    """The published views of customers and months, read from the state alone."""
    state = read_state(spark, root)
    return {
        "vw_cohort_retention": cohorts.cohort_retention(as_purchases(state), snapshot),
        "vw_executive_kpis": executive_kpis(state),
        "vw_monthly_business_performance": monthly_business_performance(state),
        "vw_customer_rfm": customer_rfm(state, snapshot),
    }
