"""Equalities that must hold between the layers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mercato.functions.exact import MONEY
from mercato.operators.checks import union_all
from mercato.plans import categories, executive, revenue, rfm
from mercato.plans.order_model import DELIVERED, NOT_SOLD, order_analytics
from mercato.sources.tables import Tables
from mercato.storage import observed, stored

#: What the reconciled layers read of the order frame.
ORDER_COLUMNS = (
    "order_id",
    "order_status",
    "customer_unique_id",
    "purchase_month",
    "purchase_date",
    "delivery_delay_days",
    "product_revenue",
    "total_order_value",
    "average_review_score",
)


# The marts whose totals are compared.
ORDER_ANALYTICS = "vw_order_analytics"
EXECUTIVE_MART, MONTHLY_MART, CUSTOMER_MART = "vw_executive_kpis", "vw_monthly_business_performance", "vw_customer_rfm"
CATEGORY_MART, SEGMENTS = "vw_product_category_performance", "customer_segments"
#: The item rows with the status of their orders, which are no mart.
RAW_ITEMS = "items"


def _sold() -> Column:
    return F.coalesce(~F.col("order_status").isin(*NOT_SOLD), F.lit(False))


#: What is summed of each mart while it is written: position and check of each total.
WATCHED: dict[str, dict[tuple[str, ...], Callable[[], Column]]] = {
    ORDER_ANALYTICS: {("left", "raw_item_revenue"): lambda: F.sum(F.when(_sold(), F.col("product_revenue")))},
    RAW_ITEMS: {("right", "raw_item_revenue"): lambda: F.sum(F.when(_sold(), F.col("price")))},
    EXECUTIVE_MART: {
        ("left", "monthly_orders"): lambda: F.sum("delivered_orders"),
        ("left", "monthly_product_revenue", "segment_product_revenue", "category_product_revenue"): lambda: F.sum("product_revenue"),
        ("left", "monthly_total_order_value"): lambda: F.sum("total_order_value"),
        ("left", "rfm_customers", "segment_customers"): lambda: F.sum("delivered_customers"),
        ("left", "rfm_repeat_customers"): lambda: F.sum("repeat_customers"),
    },
    MONTHLY_MART: {
        ("right", "monthly_orders"): lambda: F.sum("orders"),
        ("right", "monthly_product_revenue"): lambda: F.sum("product_revenue"),
        ("right", "monthly_total_order_value"): lambda: F.sum("total_order_value"),
    },
    CUSTOMER_MART: {
        ("right", "rfm_customers"): lambda: F.count("*"),
        ("right", "rfm_repeat_customers"): lambda: F.count_if(F.col("customer_type") == rfm.REPEAT),
    },
    SEGMENTS: {
        # A sum over no segments is missing, as it is where the segments are summed up from their own rows.
        ("right", "segment_customers"): lambda: F.sum(F.lit(1)),
        ("right", "segment_product_revenue"): lambda: F.sum("monetary"),
    },
    CATEGORY_MART: {("right", "category_product_revenue"): lambda: F.sum("product_revenue")},
}


class Sides:
    """Totals of the reconciled layers, observed while something else reads them."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, whose totals are known once an action on it has ended; unchanged if nothing of it is compared."""
        totals = WATCHED.get(name)
        if not totals:
            return df
        self.seen[name] = Observation()
        return df.observe(self.seen[name], *[total().cast(MONEY).alias(f"t{i}") for i, total in enumerate(totals.values())])

    def checks(self, spark: SparkSession) -> DataFrame | None:
        """The equalities of :func:`reconcile`, from what was observed; None if a layer is empty, of which Spark observes nothing."""
        sides: dict[str, dict] = {}
        for name, totals in WATCHED.items():
            found = observed(self.seen[name])
            if found is None:
                return None
            for i, (position, *checks) in enumerate(totals):
                for check in checks:
                    sides.setdefault(check, {})[position] = found[f"t{i}"]
        rows = [(check, v["left"], v["right"], v["left"] == v["right"]) for check, v in sorted(sides.items())]
        return spark.createDataFrame(rows, f"`check` string, left_value {MONEY}, right_value {MONEY}, passed boolean").coalesce(1)


def side(totals: DataFrame, position: str, **checks: str) -> DataFrame:
    """One side of some checks: ``check=column`` pairs read from a one-row frame."""
    cells = [
        F.struct(F.lit(check).alias("check"), F.col(column).cast(MONEY).alias("value"))
        for check, column in checks.items()
    ]
    return totals.select(F.explode(F.array(*cells)).alias("r")).select(
        "r.check", F.lit(position).alias("position"), "r.value"
    )


def compare(*sides: DataFrame) -> DataFrame:
    """One row per check with both values; ``passed`` treats two missing values as equal."""
    left = F.max(F.when(F.col("position") == "left", F.col("value")))
    right = F.max(F.when(F.col("position") == "right", F.col("value")))
    return (
        union_all(list(sides))
        .groupBy("check")
        .agg(left.alias("left_value"), right.alias("right_value"))
        .withColumn("passed", F.col("left_value").eqNullSafe(F.col("right_value")))
        .orderBy("check")
    )


def reconcile(
    executive: DataFrame,
    monthly: DataFrame,
    customers: DataFrame,
    segments: DataFrame,
    categories: DataFrame,
    order_view_revenue: DataFrame,
    raw_item_revenue: DataFrame,
) -> DataFrame:
    """Executive figures against the monthly, customer, segment and category layers, and sales against raw items.

    Inputs are the finished views: ``executive_kpis``, ``monthly_totals_check``, ``rfm_totals_check``, the
    ``rfm_segment_summary`` rows, the ``product_category_performance`` rows and the two revenue checks.
    """
    segment_totals = segments.agg(
        F.sum("customers").alias("customers"), F.sum("total_monetary").alias("revenue")
    )
    category_totals = categories.agg(F.sum("product_revenue").alias("revenue"))
    return compare(
        side(
            executive,
            "left",
            monthly_orders="delivered_orders",
            monthly_product_revenue="product_revenue",
            monthly_total_order_value="total_order_value",
            rfm_customers="delivered_customers",
            rfm_repeat_customers="repeat_customers",
            segment_customers="delivered_customers",
            segment_product_revenue="product_revenue",
            category_product_revenue="product_revenue",
        ),
        side(
            monthly,
            "right",
            monthly_orders="total_orders",
            monthly_product_revenue="total_product_revenue",
            monthly_total_order_value="total_order_value",
        ),
        side(customers, "right", rfm_customers="customers", rfm_repeat_customers="repeat_customers"),
        side(segment_totals, "right", segment_customers="customers", segment_product_revenue="revenue"),
        side(category_totals, "right", category_product_revenue="revenue"),
        side(order_view_revenue, "left", raw_item_revenue="order_view_revenue"),
        side(raw_item_revenue, "right", raw_item_revenue="raw_item_revenue"),
    )


def product_sales(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Item revenue per product in one pass: ``delivered`` and ``sold`` orders, NULL where a product has no item in them."""
    status = F.col("order_status")
    price = lambda population: F.sum(F.when(population, F.col("price"))).cast(MONEY)
    return (
        order_items.select("order_id", "product_id", "price")
        .join(orders.select("order_id", "order_status"), "order_id")
        .groupBy("product_id")
        .agg(price(status == DELIVERED).alias("delivered"), price(~status.isin(*NOT_SOLD)).alias("sold"))
    )


def reconcile_tables(tables: Tables, facts: DataFrame | None = None, snapshot: dt.date | None = None) -> DataFrame:
    """All equalities straight from the tables, or from a stored order frame given as ``facts``.

    Without ``facts`` the order frame is built once, with every status, and stored for the layers that read it; nothing is left in Spark's cache.
    """
    if facts is None:
        facts = stored(order_analytics(tables, ("person", "items", "reviews")).select(*ORDER_COLUMNS))
    sales = product_sales(tables.order_items, tables.orders)
    labels = categories.labelled_products(
        tables.products, tables.product_category_name_translation, categories.UNCATEGORIZED
    )
    by_category = (
        sales.join(labels, "product_id").groupBy("category").agg(F.sum("delivered").cast(MONEY).alias("product_revenue"))
    )
    return reconcile(
        executive=executive.executive_kpis(facts),
        monthly=executive.monthly_totals_check(executive.monthly_business_performance(facts)),
        customers=rfm.rfm_totals_check(rfm.customer_rfm(facts, snapshot)),
        segments=rfm.rfm_segment_summary(rfm.rfm_segments(rfm.rfm_scores(facts, snapshot))),
        categories=by_category,
        order_view_revenue=revenue.revenue_check_view(facts),
        raw_item_revenue=sales.agg(F.sum("sold").cast(MONEY).alias("raw_item_revenue")),
    )
