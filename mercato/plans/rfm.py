"""Recency, frequency and monetary value of customers over their delivered orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.exact import MONEY, percent, rounded_ratio
from mercato.operators.tiles import TileOrder, with_tiles
from mercato.plans.order_model import delivered
from mercato.storage import stored

# Labels and score limits of the segments.
RECENT_HIGH = "Recent High Value"
RECENT_LOW = "Recent Low/Medium Value"
AT_RISK = "High Value At Risk"
INACTIVE = "Inactive / Low Value"
MIDDLE = "Middle Value"
REPEAT = "Repeat Customer"
ONE_TIME = "One-Time Customer"
TILES = 5
HIGH_SCORE = 4
LOW_RECENCY = 2


def _is_recent() -> Column:
    return F.col("recency_score") >= HIGH_SCORE


def _is_old() -> Column:
    return F.col("recency_score") <= LOW_RECENCY


def _is_high() -> Column:
    return F.col("monetary_score") >= HIGH_SCORE


def _is_repeat() -> Column:
    return F.col("frequency") >= 2


def _known_customers(facts: DataFrame) -> DataFrame:
    return delivered(facts).where(F.col("customer_unique_id").isNotNull())


def purchase_type() -> Column:
    return F.when(_is_repeat(), REPEAT).otherwise(ONE_TIME)


def customer_frequency(facts: DataFrame) -> DataFrame:
    """Delivered orders per known customer; ``facts`` has one row per order, so this is a row count."""
    return _known_customers(facts).groupBy("customer_unique_id").agg(F.count("order_id").alias("frequency"))


def customer_totals(facts: DataFrame) -> DataFrame:
    """Last purchase, frequency and product revenue per known customer."""
    return (
        _known_customers(facts)
        .groupBy("customer_unique_id")
        .agg(
            F.max("purchase_date").alias("last_purchase_date"),
            F.count("order_id").alias("frequency"),
            F.sum("product_revenue").cast(MONEY).alias("monetary"),
        )
    )


def snapshot_date(facts: DataFrame) -> DataFrame:
    """Latest delivered purchase of a known customer."""
    return _known_customers(facts).agg(F.max("purchase_date").alias("snapshot_date"))


def frequency_distribution(facts: DataFrame) -> DataFrame:
    everything = F.sum("customer_count").over(Window.partitionBy())
    return (
        customer_frequency(facts)
        .groupBy("frequency")
        .agg(F.count("*").alias("customer_count"))
        .withColumn("customer_share_pct", percent("customer_count", everything))
        .orderBy("frequency")
    )


def _latest(totals: DataFrame) -> Column:
    """Latest purchase of a known customer in per-customer totals, as a scalar subquery.

    It reads every column of the totals, so its plan is theirs and Spark reuses their shuffle instead of joining the orders
    to the persons a second time.
    """
    others = [c for c in totals.columns if c not in ("customer_unique_id", "last_purchase_date")]
    known = F.when(F.col("customer_unique_id").isNotNull(), F.struct("last_purchase_date", *others))
    return totals.agg(F.max(known).alias("latest")).select("latest.last_purchase_date").scalar()


def _with_recency(customers: DataFrame, snapshot: Column) -> DataFrame:
    return customers.withColumn("snapshot_date", snapshot).withColumn(
        "recency", F.datediff("snapshot_date", "last_purchase_date")
    )


def rfm_metrics(facts: DataFrame, snapshot: dt.date | None = None) -> DataFrame:
    """Recency is counted from ``snapshot``, by default the latest delivered purchase."""
    totals = customer_totals(facts)
    date = F.lit(snapshot) if snapshot else _latest(totals)
    return _with_recency(totals, date).select(
        "customer_unique_id", "snapshot_date", "last_purchase_date", "recency", "frequency", "monetary"
    )


def rfm_metrics_listing(facts: DataFrame, snapshot: dt.date | None = None) -> DataFrame:
    return rfm_metrics(facts, snapshot).orderBy(F.desc_nulls_first("monetary"), "customer_unique_id")


def rfm_scores(
    facts: DataFrame, snapshot: dt.date | None = None, tiles: int = TILES, totals: DataFrame | None = None
) -> DataFrame:
    """Quintile scores 1..5, 5 being the most recent and the highest spending.

    Customers that tie are told apart by id, which makes the result repeatable. A customer without any
    item sorts last by value, so it scores 5. The search for the tiles runs at once and reads the totals, one narrow row per customer, several
    times: they are stored first, unless ``totals`` already has the stored or cached rows of :func:`customer_totals`. Nothing is left in Spark's cache.
    """
    totals = stored(customer_totals(facts)) if totals is None else totals
    tiled = with_tiles(
        totals,
        "customer_unique_id",
        {
            # Falling recency is rising last purchase, whatever the snapshot.
            "recency_score": TileOrder("last_purchase_date", nulls_first=True),
            "monetary_score": TileOrder("monetary"),
        },
        tiles,
    )
    date = F.lit(snapshot) if snapshot else _latest(totals)
    return _with_recency(tiled, date).select(
        "customer_unique_id",
        "snapshot_date",
        "last_purchase_date",
        "recency",
        "frequency",
        "monetary",
        "recency_score",
        "monetary_score",
        F.concat(F.col("recency_score").cast("string"), F.col("monetary_score").cast("string")).alias(
            "rm_score"
        ),
    )


def by_score(scores: DataFrame) -> DataFrame:
    """Best scores first, the order in which scores and segments are listed."""
    return scores.orderBy(
        F.desc("recency_score"),
        F.desc("monetary_score"),
        F.desc_nulls_first("monetary"),
        "customer_unique_id",
    )


def repeat_purchase_rate(facts: DataFrame) -> DataFrame:
    return (
        customer_frequency(facts)
        .agg(
            F.count("*").alias("total_customers"),
            F.count_if(_is_repeat()).alias("repeat_customers"),
            F.count_if(F.col("frequency") == 1).alias("one_time_customers"),
        )
        .withColumn("repeat_purchase_rate_pct", percent("repeat_customers", "total_customers"))
        .withColumn("one_time_customer_rate_pct", percent("one_time_customers", "total_customers"))
    )


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Segment and purchase type of each customer of ``rfm_scores``."""
    segment = (
        F.when(_is_recent() & _is_high(), RECENT_HIGH)
        .when(_is_recent(), RECENT_LOW)
        .when(_is_old() & _is_high(), AT_RISK)
        .when(_is_old(), INACTIVE)
        .otherwise(MIDDLE)
    )
    return scores.drop("rm_score").withColumns(
        {"customer_segment": segment, "purchase_type": purchase_type()}
    )


def rfm_segment_summary(segments: DataFrame) -> DataFrame:
    everything = F.sum("customers").over(Window.partitionBy())
    return (
        segments.groupBy("customer_segment")
        .agg(
            F.count("*").alias("customers"),
            F.count_if(_is_repeat()).alias("repeat_customers"),
            F.sum("monetary").cast(MONEY).alias("total_monetary"),
            F.count("monetary").alias("_valued"),
        )
        .select(
            "customer_segment",
            "customers",
            percent("customers", everything).alias("customer_share_pct"),
            "repeat_customers",
            "total_monetary",
            rounded_ratio("total_monetary", "_valued").alias("avg_customer_value"),
        )
        .orderBy(F.desc_nulls_first("total_monetary"))
    )


def rfm_segment_by_type(segments: DataFrame) -> DataFrame:
    in_segment = F.sum("customers").over(Window.partitionBy("customer_segment"))
    return (
        segments.groupBy("customer_segment", "purchase_type")
        .agg(F.count("*").alias("customers"))
        .withColumn("segment_purchase_type_pct", percent("customers", in_segment))
        .orderBy("customer_segment", "purchase_type")
    )


def _group_value(scores: DataFrame, members: Column, count_name: str) -> DataFrame:
    value = F.when(members, F.col("monetary"))
    return scores.agg(
        F.count_if(members).alias(count_name),
        F.count_if(members & _is_repeat()).alias("repeat_customers"),
        F.sum(value).cast(MONEY).alias("total_monetary"),
        F.count(value).alias("_valued"),
        F.count("*").alias("_everyone"),
    ).withColumn("avg_customer_value", rounded_ratio("total_monetary", "_valued"))


def rfm_high_value_at_risk(scores: DataFrame) -> DataFrame:
    """Old but high-spending customers.

    ``segment_share_pct`` is the share of these customers among themselves, always 100, as published;
    ``share_of_all_customers_pct`` is their share of the whole population.
    """
    name = "high_value_at_risk_customers"
    return _group_value(scores, _is_old() & _is_high(), name).select(
        name,
        "repeat_customers",
        "total_monetary",
        "avg_customer_value",
        percent(name, name).alias("segment_share_pct"),
        percent(name, "_everyone").alias("share_of_all_customers_pct"),
    )


def rfm_recent_high_value(scores: DataFrame) -> DataFrame:
    name = "recent_high_value_customers"
    return _group_value(scores, _is_recent() & _is_high(), name).drop("_valued", "_everyone")


def rfm_top_customers(facts: DataFrame, n: int = 20) -> DataFrame:
    """Highest monetary value first, customers without a value leading as in a descending SQL sort."""
    return (
        customer_totals(facts)
        .orderBy(F.desc_nulls_first("monetary"), "customer_unique_id")
        .limit(n)
    )


def rfm_validation(facts: DataFrame, snapshot: dt.date | None = None) -> DataFrame:
    """Counts over ``rfm_metrics``; the customers are distinct because they are grouped by id."""
    latest = F.lit(snapshot) if snapshot else F.max("last_purchase_date")
    return customer_totals(facts).agg(
        F.count("*").alias("total_customers"),
        F.count("customer_unique_id").alias("unique_customer_ids"),
        F.count_if(_is_repeat()).alias("repeat_customers"),
        F.count_if(F.col("frequency") == 1).alias("one_time_customers"),
        latest.alias("snapshot_date"),
    )


def customer_rfm(facts: DataFrame, snapshot: dt.date | None = None) -> DataFrame:
    """Published customer view. Orders without a known customer form one row, unlike ``rfm_metrics``."""
    totals = delivered(facts).groupBy("customer_unique_id").agg(
        F.count("*").alias("frequency"),
        F.sum("product_revenue").cast(MONEY).alias("monetary_value"),
        F.sum("total_order_value").cast(MONEY).alias("total_order_value"),
        F.max("purchase_date").alias("last_purchase_date"),
    )
    return customer_rfm_of_totals(totals, snapshot)


def customer_rfm_of_totals(totals: DataFrame, snapshot: dt.date | None = None) -> DataFrame:
    """:func:`customer_rfm` from frequency, sums and last purchase per customer."""
    date = F.lit(snapshot) if snapshot else _latest(totals)
    return totals.withColumn("recency_days", F.datediff(date, "last_purchase_date")).withColumn(
        "customer_type", purchase_type()
    )


def rfm_totals_check(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count("*").alias("customers"),
        F.count_if(F.col("customer_type") == REPEAT).alias("repeat_customers"),
        F.count_if(F.col("customer_type") == ONE_TIME).alias("one_time_customers"),
    )
