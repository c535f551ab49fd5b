"""Delivery delay against review score, over delivered orders.

A delay is a whole number of calendar days, so the orders collapse to one row per delay before anything else
is asked of them. Medians and averages per status or bucket are taken from that profile with counts as weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.exact import RATE, SCORE, percent, rounded_ratio
from mercato.operators.checks import union_all
from mercato.plans.categories import UNCATEGORIZED
from mercato.plans.order_model import delivered

# Labels and limits of the delay classes.
LATE = "Late"
ON_TIME = "On Time / Early"
DELAY_BUCKETS = (
    (0, "On Time / Early"),
    (3, "1-3 Days Late"),
    (7, "4-7 Days Late"),
    (14, "8-14 Days Late"),
    (None, "15+ Days Late"),
)
MIN_GROUP = 100

_DELAY = "delivery_delay_days"
_SCORE = "average_review_score"


def _is_late() -> Column:
    return F.col(_DELAY) > 0


def delivery_status() -> Column:
    return F.when(_is_late(), LATE).otherwise(ON_TIME)


def delay_bucket() -> Column:
    """Severity class of a delay; callers have removed missing delays."""
    *bounded, (_, worst) = DELAY_BUCKETS
    (limit, label), *others = bounded
    chain = F.when(F.col(_DELAY) <= limit, label)
    for limit, label in others:
        chain = chain.when(F.col(_DELAY) <= limit, label)
    return chain.otherwise(worst)


def _with_delay(facts: DataFrame) -> DataFrame:
    return delivered(facts).where(F.col(_DELAY).isNotNull())


def delivery_coverage(facts: DataFrame) -> DataFrame:
    return delivered(facts).agg(
        F.count("*").alias("total_delivered_orders"),
        F.count("order_delivered_customer_date").alias("orders_with_actual_delivery_date"),
        F.count("order_estimated_delivery_date").alias("orders_with_estimated_delivery_date"),
        F.count(_DELAY).alias("orders_with_delivery_delay"),
        F.count(_SCORE).alias("orders_with_review"),
        F.count_if(F.col(_DELAY).isNotNull() & F.col(_SCORE).isNotNull()).alias("orders_with_delivery_and_review"),
    )


def delivery_date_checks(facts: DataFrame) -> DataFrame:
    """Order of the timestamps. Lateness here compares full timestamps, everywhere else calendar days."""
    arrived = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    return (
        delivered(facts)
        .where(arrived.isNotNull() & promised.isNotNull())
        .agg(
            F.count("*").alias("delivered_orders"),
            F.count_if(arrived < F.col("order_purchase_timestamp")).alias("delivered_before_purchase"),
            F.count_if(arrived < F.col("order_approved_at")).alias("delivered_before_approval"),
            F.count_if(arrived > promised).alias("late_orders"),
            F.count_if(arrived <= promised).alias("on_time_or_early_orders"),
        )
    )


def delay_counts(facts: DataFrame) -> DataFrame:
    """Orders per day of delay."""
    return _with_delay(facts).groupBy("delivery_delay_days").agg(F.count("*").alias("orders"))


def delay_profile(facts: DataFrame) -> DataFrame:
    """Orders, reviewed orders and review total per day of delay."""
    return (
        _with_delay(facts)
        .groupBy("delivery_delay_days")
        .agg(
            F.count("*").alias("orders"),
            F.count(_SCORE).alias("reviewed"),
            F.sum(_SCORE).alias("score_sum"),
        )
    )


def _delays(weight: str) -> list[Column]:
    """Aggregates over the rows of a profile, each delay counting ``weight`` times."""
    return [
        F.coalesce(F.sum(weight), F.lit(0)).alias("n"),
        F.sum(F.col(_DELAY) * F.col(weight)).alias("delay_sum"),
        F.percentile(_DELAY, F.lit(0.5), F.col(weight)).cast(RATE).alias("median_delay_days"),
        F.min(_DELAY).alias("min_delay"),
        F.max(_DELAY).alias("max_delay"),
    ]


def _scores() -> list[Column]:
    return [F.sum("reviewed").alias("reviewed_n"), F.sum("score_sum").alias("score_total")]


def _mean_delay() -> Column:
    return rounded_ratio("delay_sum", "n").cast(RATE).alias("average_delay_days")


def _mean_score() -> Column:
    return rounded_ratio("score_total", "reviewed_n").cast(SCORE).alias("average_review_score")


def delay_distribution(facts: DataFrame) -> DataFrame:
    return (
        delay_counts(facts)
        .agg(*_delays("orders"))
        .select(
            F.col("n").alias("orders"),
            F.col("min_delay").alias("minimum_delay_days"),
            F.col("max_delay").alias("maximum_delay_days"),
            _mean_delay(),
            "median_delay_days",
        )
    )


def late_rate(facts: DataFrame) -> DataFrame:
    everything = F.sum("orders").over(Window.partitionBy())
    return (
        delay_counts(facts)
        .groupBy(delivery_status().alias("delivery_status"))
        .agg(F.sum("orders").alias("orders"))
        .withColumn("order_share_pct", percent("orders", everything))
        .orderBy(F.desc("orders"), "delivery_status")
    )


def _reviewed_summary(facts: DataFrame, group: Column, name: str) -> DataFrame:
    return (
        delay_profile(facts)
        .where(F.col("reviewed") > 0)
        .groupBy(group.alias(name))
        .agg(*_delays("reviewed"), *_scores())
        .select(
            name,
            F.col("n").alias("orders_with_review"),
            _mean_score(),
            _mean_delay(),
            "median_delay_days",
            "min_delay",
        )
    )


def status_vs_review(facts: DataFrame) -> DataFrame:
    return (
        _reviewed_summary(facts, delivery_status(), "delivery_status")
        .drop("min_delay")
        .orderBy("delivery_status")
    )


def delay_bucket_vs_review(facts: DataFrame) -> DataFrame:
    return (
        _reviewed_summary(facts, delay_bucket(), "delay_bucket").orderBy("min_delay").drop("min_delay")
    )


def review_score_distribution(facts: DataFrame) -> DataFrame:
    """Orders per status and order-level score, with the score's share within its status."""
    in_status = F.sum("orders").over(Window.partitionBy("delivery_status"))
    return (
        _with_delay(facts)
        .where(F.col(_SCORE).isNotNull())
        .groupBy(delivery_status().alias("delivery_status"), F.col(_SCORE).alias("review_score"))
        .agg(F.count("*").alias("orders"))
        .withColumn("score_share_pct", percent("orders", in_status))
        .orderBy("delivery_status", "review_score")
    )


def _measures() -> list[Column]:
    late = F.when(_is_late(), F.col(_SCORE))
    on_time = F.when(~_is_late(), F.col(_SCORE))
    return [
        F.count("*").alias("n"),
        F.count_if(_is_late()).alias("late_orders"),
        F.sum(_SCORE).alias("score_sum"),
        F.count(_SCORE).alias("score_n"),
        F.sum(late).alias("late_sum"),
        F.count(late).alias("late_n"),
        F.sum(on_time).alias("on_time_sum"),
        F.count(on_time).alias("on_time_n"),
    ]


_MEASURE_NAMES = (
    "n",
    "late_orders",
    "score_sum",
    "score_n",
    "late_sum",
    "late_n",
    "on_time_sum",
    "on_time_n",
)


def _group_rates(partial: DataFrame, key: str, count_name: str, min_group: int) -> DataFrame:
    """Add up partial measures per ``key`` and keep the groups that are large enough."""
    return (
        partial.groupBy(key)
        .agg(*[F.sum(m).alias(m) for m in _MEASURE_NAMES])
        .where(F.col("n") >= min_group)
        .select(
            key,
            F.col("n").alias(count_name),
            "late_orders",
            percent("late_orders", "n").alias("late_delivery_rate_pct"),
            rounded_ratio("score_sum", "score_n").cast(SCORE).alias("average_review_score"),
            rounded_ratio("late_sum", "late_n").cast(SCORE).alias("late_order_review_score"),
            rounded_ratio("on_time_sum", "on_time_n").cast(SCORE).alias("on_time_review_score"),
        )
    )


def by_late_rate(rates: DataFrame) -> DataFrame:
    """Worst late rate first."""
    return rates.orderBy(F.desc("late_delivery_rate_pct"), rates.columns[0])


def delivery_state(facts: DataFrame, customers: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Rates per customer state, over orders with a delay.

    Orders are summed per customer before the lookup, so the join is one row to one row even when one customer
    placed a large part of the orders.
    """
    per_customer = _with_delay(facts).groupBy("customer_id").agg(*_measures())
    located = per_customer.join(customers.select("customer_id", "customer_state"), "customer_id")
    return _group_rates(located, "customer_state", "delivered_orders", min_group)


def category_coverage(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count("*").alias("total_products"),
        F.count("product_category_name").alias("products_with_category"),
        F.count_distinct("product_category_name").alias("categories"),
    )


def translation_coverage(translation: DataFrame) -> DataFrame:
    return translation.agg(
        F.count("*").alias("translated_categories"),
        F.count_distinct("product_category_name").alias("original_category_names"),
        F.count_distinct("product_category_name_english").alias("english_category_names"),
    )


def order_categories(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct order and category pairs; products without a category are left out."""
    known = products.where(F.col("product_category_name").isNotNull())
    return (
        order_items.select("order_id", "product_id")
        .join(known.select("product_id", "product_category_name"), "product_id")
        .select("order_id", "product_category_name")
        .distinct()
    )


def order_category_check(order_items: DataFrame, products: DataFrame) -> DataFrame:
    return order_categories(order_items, products).agg(
        F.count("*").alias("order_category_rows"),
        F.count_distinct("order_id").alias("distinct_orders"),
        F.count_distinct("product_category_name").alias("distinct_categories"),
    )


def delivery_category(
    facts: DataFrame,
    order_items: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    min_group: int = MIN_GROUP,
    uncategorised: str = "drop",
) -> DataFrame:
    """Rates per category at order-category grain: an order counts once in each of its categories.

    The categories of an order are gathered as a set, at most as large as the number of categories and summed up on
    the map side, so one exchange on the order serves both the distinct pairs and the join with the delayed orders. Pairs are
    added per source category before translation, which then only touches category rows. Products without a category are left
    out, or with ``uncategorised="label"`` form the category of that name.
    """
    if uncategorised not in ("drop", "label"):
        raise ValueError("uncategorised is 'drop' or 'label'")
    category = F.col("product_category_name")
    known = products if uncategorised == "label" else products.where(category.isNotNull())
    if uncategorised == "label":
        known = known.withColumn("product_category_name", F.coalesce(category, F.lit(UNCATEGORIZED)))
    sets = (
        order_items.select("order_id", "product_id")
        .join(known.select("product_id", "product_category_name"), "product_id")
        .groupBy("order_id")
        .agg(F.collect_set("product_category_name").alias("_categories"))
    )
    per_category = (
        sets.join(_with_delay(facts).select("order_id", _DELAY, _SCORE), "order_id")
        .withColumn("product_category_name", F.explode("_categories"))
        .groupBy("product_category_name")
        .agg(*_measures())
    )
    label = F.coalesce("product_category_name_english", "product_category_name")
    labelled = per_category.join(translation, "product_category_name", "left").withColumn(
        "product_category", label
    )
    return _group_rates(labelled, "product_category", "category_orders", min_group)


def delivery_satisfaction(facts: DataFrame) -> DataFrame:
    """Per status, over all orders with a delay whether reviewed or not."""
    return (
        delay_profile(facts)
        .groupBy(delivery_status().alias("delivery_status"))
        .agg(*_delays("orders"), *_scores())
        .select(
            "delivery_status",
            F.col("n").alias("orders"),
            _mean_score(),
            _mean_delay(),
            "median_delay_days",
        )
    )


def delivery_delay_buckets(facts: DataFrame) -> DataFrame:
    return (
        delay_profile(facts)
        .groupBy(delay_bucket().alias("delay_bucket"))
        .agg(*_delays("orders"), *_scores())
        .select("delay_bucket", F.col("n").alias("orders"), _mean_score(), _mean_delay())
    )


def by_status(rates: DataFrame) -> DataFrame:
    return rates.orderBy("delivery_status")


def by_severity(buckets: DataFrame) -> DataFrame:
    """Delay buckets from on time to latest."""
    labels = F.array(*[F.lit(label) for _, label in DELAY_BUCKETS])
    return buckets.orderBy(F.array_position(labels, F.col("delay_bucket")))


def view_row_counts(views: dict[str, DataFrame]) -> DataFrame:
    return union_all(
        [
            df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("view_name"), "rows")
            for name, df in views.items()
        ]
    )
