"""Monthly sales and growth over the sold population.

``facts`` is one row per order (``order_analytics``). Its order_id is a declared key, so the number of distinct
orders of a group is its row count, and no shuffle on order_id is spent on it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.calendar import month_from_index, month_index
from mercato.functions.exact import MONEY, rounded_ratio
from mercato.operators.zero_fill import zero_fill
from mercato.plans.order_model import sold


def _previous(column: str) -> Column:
    """Value of the row before in month order; only month rows reach this window."""
    return F.lag(column).over(Window.orderBy(F.asc_nulls_last("month")))


def monthly_sales(facts: DataFrame) -> DataFrame:
    """Revenue and orders per observed month; every growth query works on these few rows."""
    return (
        sold(facts)
        .groupBy(F.col("purchase_month").alias("month"))
        .agg(F.sum("product_revenue").cast(MONEY).alias("revenue"), F.count("order_id").alias("orders"))
    )


def monthly_revenue(facts: DataFrame) -> DataFrame:
    return monthly_sales(facts).select("month", "revenue").orderBy(F.asc_nulls_last("month"))


def monthly_revenue_orders(facts: DataFrame) -> DataFrame:
    return monthly_sales(facts).orderBy(F.asc_nulls_last("month"))


def monthly_revenue_aov(facts: DataFrame) -> DataFrame:
    return (
        monthly_sales(facts)
        .withColumn("aov", rounded_ratio("revenue", "orders"))
        .orderBy(F.asc_nulls_last("month"))
    )


def _growth() -> Column:
    change = F.col("revenue") - F.col("previous_month_revenue")
    return rounded_ratio(change * 100, "previous_month_revenue")


def mom_growth_observed(facts: DataFrame) -> DataFrame:
    """Growth against the previous month that has sales, which need not be the previous calendar month."""
    return (
        monthly_sales(facts)
        .withColumn("aov", rounded_ratio("revenue", "orders"))
        .withColumn("previous_month_revenue", _previous("revenue"))
        .withColumn("revenue_growth_pct", _growth())
        .orderBy(F.asc_nulls_last("month"))
    )


def _complete_months(facts: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    monthly = monthly_sales(facts).withColumn("month_no", month_index("month"))
    bounds = [
        F.lit(day.year * 12 + day.month - 1) if day else default("month_no")
        for day, default in ((first, F.min), (last, F.max))
    ]
    filled = zero_fill(monthly, "month_no", ["revenue", "orders"], *bounds)
    return filled.select(month_from_index("month_no").alias("month"), "revenue", "orders")


def monthly_sales_calendar(
    facts: DataFrame, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Every calendar month from ``first`` to ``last``, zero where nothing was sold.

    The bounds default to the first and last month with sales.
    """
    return (
        _complete_months(facts, first, last)
        .withColumn("aov", rounded_ratio("revenue", "orders"))
        .orderBy("month")
    )


def mom_growth_calendar(
    facts: DataFrame,
    first: dt.date | None = None,
    last: dt.date | None = None,
    comparable_from: dt.date | None = None,
) -> DataFrame:
    """Growth against the previous calendar month.

    NULL before ``comparable_from`` and where the previous month sold nothing.
    """
    comparable = F.col("previous_month_revenue") > 0
    if comparable_from:
        comparable &= F.col("month") >= F.lit(comparable_from)
    return (
        _complete_months(facts, first, last)
        .withColumn("aov", rounded_ratio("revenue", "orders"))
        .withColumn("previous_month_revenue", _previous("revenue"))
        .withColumn("previous_month_orders", _previous("orders"))
        .withColumn("revenue_growth_pct", F.when(comparable, _growth()))
        .orderBy("month")
    )


def revenue_check_view(facts: DataFrame) -> DataFrame:
    return sold(facts).agg(F.sum("product_revenue").cast(MONEY).alias("order_view_revenue"))


def revenue_check_raw(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """The same total from the item rows, past the roll-up; must equal ``revenue_check_view``."""
    return order_items.join(sold(orders).select("order_id"), "order_id").agg(
        F.sum("price").cast(MONEY).alias("raw_item_revenue")
    )


def sales_month_range(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.min("purchase_month").alias("first_month"), F.max("purchase_month").alias("last_month")
    )
