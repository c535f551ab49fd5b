"""Every registered query: a plan function applied to the mapped tables of one scale-factor folder."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.mapping import load_tables
from mercato.operators import checks, rollups
from mercato.plans import categories, cohorts, customer_state, delivery, executive, quality, reconciliation, revenue, rfm
from mercato.plans.order_model import delivered, order_analytics, orders_clean, sold
from mercato.sources.tables import Tables
from mercato.storage import shared_folder

# Calendar given wider than the data, as a report with fixed bounds would.
CALENDAR_FIRST = dt.date(1994, 11, 1)
CALENDAR_LAST = dt.date(2001, 10, 1)
COMPARABLE_FROM = dt.date(1995, 6, 1)
# Orders from here on are the later of the two batches that the state is kept in.
LATER_BATCH = dt.date(1997, 3, 1)


def _facts(*parts: str) -> Callable[[Tables], DataFrame]:
    return lambda t: order_analytics(t, parts)


_orders = _facts()
_order_values = _facts("items")
_order_reviews = _facts("reviews")
_customer_orders = _facts("person")
_customer_values = _facts("person", "items")
_delivered_layer = _facts("person", "items", "reviews")


def _sold_totals(t: Tables) -> DataFrame:
    return categories.category_totals(
        t.order_items, sold(t.orders), t.products, t.product_category_name_translation
    )


def _performance(t: Tables) -> DataFrame:
    return categories.product_category_performance(
        t.order_items, delivered(t.orders), t.products, t.product_category_name_translation
    )


def _state(t: Tables) -> DataFrame:
    return delivery.delivery_state(_order_reviews(t), t.customers)


def _category(t: Tables) -> DataFrame:
    return delivery.delivery_category(
        _order_reviews(t), t.order_items, t.products, t.product_category_name_translation
    )


def _view_counts(t: Tables) -> DataFrame:
    facts = _order_reviews(t)
    return delivery.view_row_counts(
        {
            "vw_delivery_satisfaction": delivery.delivery_satisfaction(facts),
            "vw_delivery_delay_buckets": delivery.delivery_delay_buckets(facts),
            "vw_delivery_state": _state(t),
            "vw_delivery_category": _category(t),
        }
    )


def _retention(t: Tables) -> DataFrame:
    return cohorts.cohort_retention(_customer_orders(t))


def _from_state(view: str) -> Callable[[Tables], DataFrame]:
    """A view read from the state of two batches, the later one added to the earlier."""

    def plan(t: Tables) -> DataFrame:
        spark = t.orders.sparkSession
        root = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
        later = F.coalesce(F.col("order_purchase_timestamp") >= F.lit(LATER_BATCH), F.lit(False))
        for batch, of_batch in (("earlier", ~later), ("later", later)):
            customer_state.write_batch(customer_state.tables_of_batch(t, of_batch), root, batch)
        return customer_state.state_marts(spark, root)[view]

    return plan


def _extras(t: Tables) -> DataFrame:
    totals = categories.category_totals(
        t.order_items,
        delivered(t.orders),
        t.products,
        t.product_category_name_translation,
        categories.UNCATEGORIZED,
    )
    return executive.dashboard_extras(rfm.customer_rfm(_customer_values(t)), totals, _retention(t))


PLANS: dict[str, Callable[[Tables], DataFrame]] = {
    # load checks and declared constraints
    "load_row_counts": quality.load_row_counts,
    "check_not_null": checks.check_not_null,
    "check_primary_keys": checks.check_primary_keys,
    "check_foreign_keys": checks.check_foreign_keys,
    "check_review_score_range": lambda t: checks.check_review_score_range(t.order_reviews),
    # data quality
    "dq_customer_ids": lambda t: quality.customer_ids(t.customers),
    "dq_order_ids": lambda t: quality.order_ids(t.orders),
    "dq_status_distribution": lambda t: quality.status_distribution(t.orders),
    "dq_order_date_range": lambda t: quality.order_date_range(t.orders),
    "dq_order_date_completeness": lambda t: quality.order_date_completeness(t.orders),
    "dq_orders_without_customer": lambda t: quality.orders_without_customer(t.orders, t.customers),
    "dq_payment_structure": lambda t: quality.payment_structure(t.order_payments),
    "dq_payments_per_order": lambda t: quality.payments_per_order(t.order_payments),
    "dq_review_structure": lambda t: quality.review_structure(t.order_reviews),
    "dq_review_scores": lambda t: quality.review_scores(t.order_reviews),
    "dq_orders_multi_review_count": lambda t: quality.orders_multi_review_count(t.order_reviews),
    "dq_orders_multi_review_top": lambda t: quality.orders_multi_review_top(t.order_reviews),
    "dq_item_structure": lambda t: quality.item_structure(t.order_items),
    "dq_item_key_uniqueness": lambda t: quality.item_key_uniqueness(t.order_items),
    "dq_price_freight_stats": lambda t: quality.price_freight_stats(t.order_items),
    "dq_negative_price": lambda t: quality.negative_price(t.order_items),
    "dq_negative_freight": lambda t: quality.negative_freight(t.order_items),
    # order model
    "orders_clean": lambda t: orders_clean(t.orders, t.customers),
    "order_payments_rollup": lambda t: rollups.order_payments(t.order_payments),
    "order_revenue_rollup": lambda t: rollups.order_revenue(t.order_items),
    "order_reviews_rollup": lambda t: rollups.order_reviews(t.order_reviews),
    "order_analytics": order_analytics,
    # revenue
    "monthly_revenue": lambda t: revenue.monthly_revenue(_order_values(t)),
    "monthly_revenue_orders": lambda t: revenue.monthly_revenue_orders(_order_values(t)),
    "monthly_revenue_aov": lambda t: revenue.monthly_revenue_aov(_order_values(t)),
    "mom_growth_observed": lambda t: revenue.mom_growth_observed(_order_values(t)),
    "monthly_sales_calendar": lambda t: revenue.monthly_sales_calendar(_order_values(t)),
    "mom_growth_calendar": lambda t: revenue.mom_growth_calendar(
        _order_values(t), CALENDAR_FIRST, CALENDAR_LAST, COMPARABLE_FROM
    ),
    "category_revenue": lambda t: categories.category_revenue(
        t.order_items, sold(t.orders), t.products, t.product_category_name_translation
    ),
    "category_revenue_share": lambda t: categories.category_revenue_share(_sold_totals(t)),
    "category_top10": lambda t: categories.category_top(_sold_totals(t)),
    "revenue_check_view": lambda t: revenue.revenue_check_view(_order_values(t)),
    "revenue_check_raw": lambda t: revenue.revenue_check_raw(t.order_items, t.orders),
    "category_share_check": lambda t: categories.category_share_check(_sold_totals(t)),
    "sales_month_range": lambda t: revenue.sales_month_range(_orders(t)),
    "product_category_performance": _performance,
    "category_reconciliation": lambda t: categories.category_reconciliation(_performance(t)),
    # recency, frequency, monetary value
    "rfm_snapshot_date": lambda t: rfm.snapshot_date(_customer_orders(t)),
    "rfm_frequency_distribution": lambda t: rfm.frequency_distribution(_customer_orders(t)),
    "rfm_metrics": lambda t: rfm.rfm_metrics_listing(_customer_values(t)),
    "rfm_scores": lambda t: rfm.by_score(rfm.rfm_scores(_customer_values(t))),
    "repeat_purchase_rate": lambda t: rfm.repeat_purchase_rate(_customer_orders(t)),
    "rfm_segments": lambda t: rfm.by_score(rfm.rfm_segments(rfm.rfm_scores(_customer_values(t)))),
    "rfm_segment_summary": lambda t: rfm.rfm_segment_summary(rfm.rfm_segments(rfm.rfm_scores(_customer_values(t)))),
    "rfm_segment_by_type": lambda t: rfm.rfm_segment_by_type(rfm.rfm_segments(rfm.rfm_scores(_customer_values(t)))),
    "rfm_high_value_at_risk": lambda t: rfm.rfm_high_value_at_risk(rfm.rfm_scores(_customer_values(t))),
    "rfm_recent_high_value": lambda t: rfm.rfm_recent_high_value(rfm.rfm_scores(_customer_values(t))),
    "rfm_top_customers": lambda t: rfm.rfm_top_customers(_customer_values(t)),
    "rfm_validation": lambda t: rfm.rfm_validation(_customer_values(t)),
    # cohorts
    "first_purchase": lambda t: cohorts.first_purchase_listing(_customer_orders(t)),
    "cohort_sizes": lambda t: cohorts.cohort_sizes(_customer_orders(t)),
    "cohort_size_check": lambda t: cohorts.cohort_size_check(_customer_orders(t)),
    "cohort_activity_calendar": lambda t: cohorts.cohort_activity_calendar(_customer_orders(t)),
    "cohort_activity_relative": lambda t: cohorts.cohort_activity_relative(_customer_orders(t)),
    "cohort_retention_observed": lambda t: cohorts.cohort_retention_observed(_customer_orders(t)),
    "cohort_retention_matrix": lambda t: cohorts.cohort_listing(_retention(t)),
    "cohort_retention": _retention,
    "cohort_view_listing": lambda t: cohorts.cohort_listing(_retention(t)),
    "cohort_month0_check": lambda t: cohorts.cohort_month0_check(_retention(t)),
    "retention_curve": lambda t: cohorts.retention_curve(_retention(t)),
    "cohort_maturity": lambda t: cohorts.cohort_maturity(_retention(t)),
    "retention_summary": lambda t: cohorts.retention_summary(_retention(t)),
    # delivery
    "delivery_coverage": lambda t: delivery.delivery_coverage(_order_reviews(t)),
    "delivery_date_checks": lambda t: delivery.delivery_date_checks(_orders(t)),
    "delay_distribution": lambda t: delivery.delay_distribution(_orders(t)),
    "late_rate": lambda t: delivery.late_rate(_orders(t)),
    "status_vs_review": lambda t: delivery.status_vs_review(_order_reviews(t)),
    "delay_bucket_vs_review": lambda t: delivery.delay_bucket_vs_review(_order_reviews(t)),
    "review_score_distribution": lambda t: delivery.review_score_distribution(_order_reviews(t)),
    "delivery_by_state": lambda t: delivery.by_late_rate(_state(t)),
    "category_coverage": lambda t: delivery.category_coverage(t.products),
    "translation_coverage": lambda t: delivery.translation_coverage(t.product_category_name_translation),
    "order_category_check": lambda t: delivery.order_category_check(t.order_items, t.products),
    "delivery_by_category": lambda t: delivery.by_late_rate(_category(t)),
    "delivery_satisfaction": lambda t: delivery.delivery_satisfaction(_order_reviews(t)),
    "delivery_delay_buckets": lambda t: delivery.delivery_delay_buckets(_order_reviews(t)),
    "delivery_state": _state,
    "delivery_category": _category,
    "delivery_view_row_counts": _view_counts,
    "delivery_satisfaction_listing": lambda t: delivery.by_status(
        delivery.delivery_satisfaction(_order_reviews(t))
    ),
    "delay_buckets_listing": lambda t: delivery.by_severity(
        delivery.delivery_delay_buckets(_order_reviews(t))
    ),
    "delivery_state_listing": lambda t: delivery.by_late_rate(_state(t)),
    "delivery_category_listing": lambda t: delivery.by_late_rate(_category(t)),
    # executive layer
    "executive_kpis": lambda t: executive.executive_kpis(_delivered_layer(t)),
    "monthly_business_performance": lambda t: executive.monthly_business_performance(_delivered_layer(t)),
    "customer_rfm": lambda t: rfm.customer_rfm(_customer_values(t)),
    "cohort_retention_bi": lambda t: cohorts.cohort_listing(_retention(t)),
    "executive_listing": lambda t: executive.executive_kpis(_delivered_layer(t)),
    "monthly_totals_check": lambda t: executive.monthly_totals_check(
        executive.monthly_business_performance(_delivered_layer(t))
    ),
    "rfm_totals_check": lambda t: rfm.rfm_totals_check(rfm.customer_rfm(_customer_values(t))),
    "cohort_bounds_check": lambda t: cohorts.cohort_bounds_check(_retention(t)),
    # the same views from state kept per batch of orders
    "cohort_retention_from_state": _from_state("vw_cohort_retention"),
    "executive_kpis_from_state": _from_state("vw_executive_kpis"),
    "monthly_performance_from_state": _from_state("vw_monthly_business_performance"),
    "customer_rfm_from_state": _from_state("vw_customer_rfm"),
    "reconcile": reconciliation.reconcile_tables,
    "dashboard_extras": _extras,
}


def _bind(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(load_tables(spark, sf_dir))


QUERIES = {name: _bind(plan) for name, plan in PLANS.items()}
