"""Headline figures and the monthly view over delivered orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.exact import MONEY, SCORE, percent, rounded_ratio
from mercato.plans.order_model import delivered


def order_sums() -> list:
    """Sums over orders that can be added up again; the executive figures are ratios of them."""
    return [
        F.count("*").alias("orders"),
        F.sum("product_revenue").cast(MONEY).alias("product_revenue"),
        F.sum("total_order_value").cast(MONEY).alias("total_order_value"),
        F.count("total_order_value").alias("valued"),
        F.sum("average_review_score").cast(MONEY).alias("score_sum"),
        F.count("average_review_score").alias("scored"),
        F.count_if(F.col("delivery_delay_days") > 0).alias("late_orders"),
        F.count("delivery_delay_days").alias("orders_with_delivery_data"),
    ]


def executive_kpis(facts: DataFrame) -> DataFrame:
    """One row of totals and rates.

    Orders are summed per customer and the customers are summed up, so order and customer figures come from
    one pass and need no join of two totals. Orders without a known customer count as one customer.
    """
    return kpis_of_customers(delivered(facts).groupBy("customer_unique_id").agg(*order_sums()))


def kpis_of_customers(per_customer: DataFrame) -> DataFrame:
    """:func:`executive_kpis` from one row of :func:`order_sums` per customer."""

    def total(name: str):
        return F.sum(name).alias(name)

    def count_of(name: str):
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    return per_customer.agg(
        count_of("orders"),
        F.count("*").alias("delivered_customers"),
        F.count_if(F.col("orders") >= 2).alias("repeat_customers"),
        total("product_revenue"),
        total("total_order_value"),
        count_of("valued"),
        total("score_sum"),
        count_of("scored"),
        count_of("late_orders"),
        count_of("orders_with_delivery_data"),
    ).select(
        F.col("orders").alias("delivered_orders"),
        "delivered_customers",
        "product_revenue",
        "total_order_value",
        rounded_ratio("total_order_value", "valued").alias("average_order_value"),
        "repeat_customers",
        percent("repeat_customers", "delivered_customers").alias("repeat_purchase_rate_pct"),
        percent("late_orders", "orders_with_delivery_data").alias("late_delivery_rate_pct"),
        rounded_ratio("score_sum", "scored").cast(SCORE).alias("average_review_score"),
    )


def monthly_business_performance(facts: DataFrame) -> DataFrame:
    customers = F.count_distinct("customer_unique_id").alias("customers")
    return report_of_months(delivered(facts).groupBy("purchase_month").agg(customers, *order_sums()))


def report_of_months(months: DataFrame) -> DataFrame:
    """:func:`monthly_business_performance` from ``customers`` and :func:`order_sums` per month."""
    return months.select(
        "purchase_month",
        "orders",
        "customers",
        "product_revenue",
        "total_order_value",
        rounded_ratio("total_order_value", "valued").alias("average_order_value"),
        rounded_ratio("score_sum", "scored").cast(SCORE).alias("average_review_score"),
        "late_orders",
        "orders_with_delivery_data",
        percent("late_orders", "orders_with_delivery_data").alias("late_delivery_rate_pct"),
    ).orderBy(F.asc_nulls_last("purchase_month"))


def monthly_totals_check(monthly: DataFrame) -> DataFrame:
    return monthly.agg(
        F.count("*").alias("monthly_rows"),
        F.sum("orders").alias("total_orders"),
        F.sum("product_revenue").cast(MONEY).alias("total_product_revenue"),
        F.sum("total_order_value").cast(MONEY).alias("total_order_value"),
    )


def customer_value_by_type(customers: DataFrame) -> DataFrame:
    """Average revenue and orders of repeat and one-time customers, from ``rfm.customer_rfm``."""
    return (
        customers.groupBy("customer_type")
        .agg(
            F.count("*").alias("customers"),
            F.sum("monetary_value").cast(MONEY).alias("revenue"),
            F.count("monetary_value").alias("valued"),
            F.sum("frequency").alias("orders"),
        )
        .select(
            "customer_type",
            "customers",
            rounded_ratio("revenue", "valued").alias("avg_product_revenue"),
            rounded_ratio("orders", "customers").alias("avg_orders"),
        )
    )


def category_concentration(totals: DataFrame, tops: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Share of revenue in the categories of rank ``n`` or better, from ``categories.category_totals``."""
    ranked = totals.withColumn("rank", F.rank().over(Window.orderBy(F.desc_nulls_last("revenue"))))
    sums = ranked.agg(
        F.sum("revenue").alias("everything"),
        *[F.sum(F.when(F.col("rank") <= n, F.col("revenue"))).alias(f"top_{n}") for n in tops],
    )
    cells = [
        F.struct(
            F.lit(n).alias("top_n"), percent(f"top_{n}", "everything").alias("revenue_share_pct")
        )
        for n in tops
    ]
    return sums.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def mean_retention(retention: DataFrame, month: int = 1) -> DataFrame:
    """Simple mean of the cohorts' retention in one month, in contrast to the weighted ``cohorts.retention_curve``."""
    return (
        retention.where(F.col("month_number") == month)
        .agg(F.sum("retention_pct").alias("total"), F.count("retention_pct").alias("cohorts"))
        .select(rounded_ratio("total", "cohorts").alias("retention_pct"))
    )


def dashboard_extras(customers: DataFrame, totals: DataFrame, retention: DataFrame) -> DataFrame:
    """The figures that the published report adds to its views, as (metric, value) rows."""
    by_type = customer_value_by_type(customers).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.concat(F.col("customer_type"), F.lit(f": {name}")).alias("metric"),
                        F.col(name).cast(MONEY).alias("value"),
                    )
                    for name in ("customers", "avg_product_revenue", "avg_orders")
                ]
            )
        ).alias("r")
    )
    tops = category_concentration(totals).select(
        F.format_string("top %d category share pct", "top_n").alias("metric"),
        F.col("revenue_share_pct").cast(MONEY).alias("value"),
    )
    mean = mean_retention(retention).select(
        F.lit("mean month 1 retention pct").alias("metric"), F.col("retention_pct").cast(MONEY).alias("value")
    )
    return by_type.select("r.*").unionByName(tops).unionByName(mean)
