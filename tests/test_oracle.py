"""Every registered query against its SQL counterpart, on the smallest driver data."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from contract import oracle, registry

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver data not present")

QUERIES = registry.QUERIES
ORACLE = oracle.statements()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_a_counterpart():
    assert sorted(QUERIES) == sorted(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF_DIR))
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())


# Listings with a stated order; ties are broken as the plans break them.
SEQUENCES = {
    "dq_status_distribution": "orders DESC",
    "dq_payments_per_order": "payment_count",
    "dq_review_scores": "review_score NULLS LAST",
    "dq_orders_multi_review_top": "review_count DESC, order_id",
    "monthly_revenue": "month NULLS LAST",
    "mom_growth_calendar": "month",
    "category_revenue": "revenue DESC NULLS FIRST, category",
    "category_revenue_share": "revenue DESC NULLS FIRST, category",
    "category_top10": "revenue_rank, category",
    "rfm_frequency_distribution": "frequency",
    "rfm_metrics": "monetary DESC NULLS FIRST, customer_unique_id",
    "rfm_scores": "recency_score DESC, monetary_score DESC, monetary DESC NULLS FIRST, customer_unique_id",
    "rfm_segments": "recency_score DESC, monetary_score DESC, monetary DESC NULLS FIRST, customer_unique_id",
    "rfm_segment_summary": "total_monetary DESC NULLS FIRST",
    "rfm_segment_by_type": "customer_segment, purchase_type",
    "rfm_top_customers": "monetary DESC NULLS FIRST, customer_unique_id",
    "first_purchase": "first_purchase_date NULLS LAST, customer_unique_id",
    "cohort_sizes": "cohort_month NULLS LAST",
    "cohort_activity_calendar": "cohort_month NULLS LAST, purchase_month NULLS LAST",
    "cohort_activity_relative": "cohort_month NULLS LAST, month_number NULLS LAST",
    "cohort_retention_observed": "cohort_month, month_number NULLS LAST",
    "cohort_retention_matrix": "cohort_month, month_number",
    "retention_curve": "month_number",
    "cohort_maturity": "cohort_month DESC",
    "delivery_by_state": "late_delivery_rate_pct DESC, customer_state",
    "delivery_by_category": "late_delivery_rate_pct DESC, product_category",
    "delivery_satisfaction_listing": "delivery_status",
    "review_score_distribution": "delivery_status, review_score",
    "reconcile": '"check"',
}


@pytest.mark.parametrize("name", sorted(SEQUENCES))
def test_sequence(spark, duck, name):
    df = QUERIES[name](spark, str(SF_DIR))
    cursor = duck.execute(f"SELECT * FROM ({ORACLE[name]}) ORDER BY {SEQUENCES[name]}")
    columns = [c[0] for c in cursor.description]
    listed = lambda names, rows: [tuple(str(r[names.index(c)]) for c in sorted(columns)) for r in rows]
    assert listed(df.columns, df.collect()) == listed(columns, cursor.fetchall())


def test_entry(spark):
    assert len(entry_module.entry(spark).collect()) == 1


def test_every_reconciliation_holds(spark):
    rows = QUERIES["reconcile"](spark, str(SF_DIR)).collect()
    assert len(rows) == 9 and all(r.passed for r in rows)
