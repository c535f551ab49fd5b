"""Customer cohorts by month of first delivered purchase, and their retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.calendar import month_index, month_start
from mercato.functions.exact import RATE, percent
from mercato.operators.zero_fill import zero_fill
from mercato.plans.order_model import delivered


def _known_customers(facts: DataFrame) -> DataFrame:
    return delivered(facts).where(F.col("customer_unique_id").isNotNull())


def first_purchase(facts: DataFrame) -> DataFrame:
    return (
        _known_customers(facts)
        .groupBy("customer_unique_id")
        .agg(F.min("purchase_date").alias("first_purchase_date"))
        .withColumn("cohort_month", month_start("first_purchase_date"))
    )


def first_purchase_listing(facts: DataFrame) -> DataFrame:
    return first_purchase(facts).orderBy(F.asc_nulls_last("first_purchase_date"), "customer_unique_id")


def cohort_sizes(facts: DataFrame) -> DataFrame:
    return (
        first_purchase(facts)
        .groupBy("cohort_month")
        .agg(F.count("*").alias("cohort_customers"))
        .orderBy(F.asc_nulls_last("cohort_month"))
    )


def cohort_size_check(facts: DataFrame) -> DataFrame:
    return cohort_sizes(facts).agg(
        F.sum("cohort_customers").alias("total_cohort_customers"),
        F.count("*").alias("number_of_cohorts"),
    )


def cohort_activity(facts: DataFrame) -> DataFrame:
    """Active customers per cohort and calendar month, in one pass over the facts.

    A customer's orders are gathered to the set of their months on the map side, at most one entry per calendar month, so
    one exchange on the customer gives both the distinct months and the first of them. The set has no NULL: a customer
    without any purchase month stays with a single empty one.
    """
    bought = F.collect_set("purchase_month")
    undated = F.max(F.col("purchase_month").isNull())
    months = (
        _known_customers(facts)
        .groupBy("customer_unique_id")
        .agg(bought.alias("months"), F.min("purchase_month").alias("cohort_month"), undated.alias("undated"))
    )
    missing = F.array(F.lit(None).cast(facts.schema["purchase_month"].dataType))
    every = F.when(F.col("undated"), F.concat("months", missing)).otherwise(F.col("months"))
    return (
        months.select("cohort_month", F.explode(every).alias("purchase_month"))
        .groupBy("cohort_month", "purchase_month")
        .agg(F.count("*").alias("active_customers"))
    )


def cohort_activity_calendar(facts: DataFrame) -> DataFrame:
    return cohort_activity(facts).orderBy(
        F.asc_nulls_last("cohort_month"), F.asc_nulls_last("purchase_month")
    )


def _relative(facts: DataFrame) -> DataFrame:
    number = month_index("purchase_month") - month_index("cohort_month")
    return cohort_activity(facts).select(
        "cohort_month", "purchase_month", number.alias("month_number"), "active_customers"
    )


def cohort_activity_relative(facts: DataFrame) -> DataFrame:
    """Calendar months as months since the cohort's first."""
    return _relative(facts).orderBy(F.asc_nulls_last("cohort_month"), F.asc_nulls_last("month_number"))


def cohort_retention_observed(facts: DataFrame) -> DataFrame:
    """Retention for the months in which a cohort bought; a cohort's size is its activity in month 0."""
    size = F.max(F.when(F.col("month_number") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month")
    )
    return (
        _relative(facts)
        .where(F.col("cohort_month").isNotNull())
        .withColumn("cohort_customers", size)
        .withColumn("retention_pct", percent("active_customers", "cohort_customers"))
        .orderBy("cohort_month", F.asc_nulls_last("month_number"))
    )


def cohort_retention(facts: DataFrame, snapshot: dt.date | None = None) -> DataFrame:
    """Every cohort and month number up to the month of ``snapshot``, zero where nobody returned.

    The snapshot defaults to the latest delivered purchase. Cohorts after it have no rows.
    """
    activity = _relative(facts).where(F.col("cohort_month").isNotNull())
    if snapshot:
        end = F.lit(snapshot.year * 12 + snapshot.month - 1)
    else:
        # At most one row per cohort and month reaches this window.
        latest = F.max(month_index("purchase_month")).over(Window.partitionBy())
        activity = activity.withColumn("_latest", latest)
        end = F.max("_latest")
    grid = zero_fill(
        activity,
        axis="month_number",
        values=["active_customers"],
        first=F.lit(0),
        last=end - month_index("cohort_month"),
        by=["cohort_month"],
        carry=[
            F.max(F.when(F.col("month_number") == 0, F.col("active_customers"))).alias("cohort_customers")
        ],
    )
    return grid.select(
        "cohort_month",
        "month_number",
        "active_customers",
        "cohort_customers",
        percent("active_customers", "cohort_customers").alias("retention_pct"),
    )


def cohort_listing(retention: DataFrame) -> DataFrame:
    return retention.orderBy("cohort_month", "month_number")


def cohort_month0_check(retention: DataFrame) -> DataFrame:
    """Month 0 is 100 % for every cohort."""
    return retention.where(F.col("month_number") == 0).agg(
        F.count("*").alias("cohorts"),
        F.count_if(F.col("retention_pct") == 100).alias("full_retention_month_0"),
    )


def retention_curve(retention: DataFrame) -> DataFrame:
    """Weighted retention: active over eligible customers, the headline figure."""
    return (
        retention.groupBy("month_number")
        .agg(
            F.sum("active_customers").alias("active_customers"),
            F.sum("cohort_customers").alias("eligible_cohort_customers"),
        )
        .withColumn("retention_pct", percent("active_customers", "eligible_cohort_customers"))
        .orderBy("month_number")
    )


def cohort_maturity(retention: DataFrame) -> DataFrame:
    return (
        retention.groupBy("cohort_month")
        .agg(
            F.max("month_number").alias("available_months"),
            F.max("cohort_customers").alias("cohort_customers"),
        )
        .orderBy(F.desc("cohort_month"))
    )


def retention_summary(retention: DataFrame) -> DataFrame:
    """Totals, and the best cohort's retention in months 1 to 3 (not the weighted curve)."""
    in_month = [
        F.max(F.when(F.col("month_number") == n, F.col("retention_pct")))
        .cast(RATE)
        .alias(f"month_{n}_retention_pct")
        for n in (1, 2, 3)
    ]
    month_0 = F.when(F.col("month_number") == 0, F.col("cohort_customers")).otherwise(0)
    return retention.agg(
        F.count_distinct("cohort_month").alias("total_cohorts"),
        F.sum(month_0).alias("total_customers"),
        *in_month,
    )


def cohort_bounds_check(retention: DataFrame) -> DataFrame:
    return retention.agg(
        F.count_distinct("cohort_month").alias("number_of_cohorts"),
        F.min("month_number").alias("minimum_month_number"),
        F.max("month_number").alias("maximum_month_number"),
    )
