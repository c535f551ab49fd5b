import datetime as dt

import pytest
from pyspark.sql import functions as F
from shop_rows import customer, item, order, review

from mercato.plans import cohorts, customer_state, executive, rfm
from mercato.plans.order_model import order_analytics

CUSTOMERS = [customer("c1", "U1"), customer("c2", "U1"), customer("c3", "U2"), customer("c4", "U3"), customer("c5"), customer("c6", "U2")]
ORDERS = [
    order("o1", "c1", "2020-01-03", arrived="2020-01-20", promised="2020-01-15"),
    order("o2", "c3", "2020-01-31 23:59", arrived="2020-02-02", promised="2020-02-10"),
    order("o3", "c2", "2020-02-01", promised="2020-02-10"),
    order("o4", "c4", "2020-02-15", status="canceled"),
    order("o5", "c5", "2020-02-16"),
    order("o6", "c6", "2020-03-05", arrived="2020-03-09", promised="2020-03-08"),
    order("o7", "c4", None),
    order("o8", "missing", "2020-03-06"),
]
ITEMS = [item("o1", "10.05", "1.00"), item("o1", "3.33", "0.50", 2), item("o2", "7.10"), item("o4", "99.00"), item("o6", "0.01"), item("o7", "5.00")]
REVIEWS = [review("o1", 5), review("o1", 2), review("o2", 4), review("o6", 1), review("o3", None)]
LISTS = ("vw_cohort_retention", "vw_executive_kpis", "vw_monthly_business_performance", "vw_customer_rfm")


def month_of_order():
    return F.date_format("order_purchase_timestamp", "yyyy-MM")


def of_month(month):
    return month_of_order() == month if month else F.col("order_purchase_timestamp").isNull()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def from_orders(tables, snapshot=None):
    facts = order_analytics(tables, ("person", "items", "reviews"))
    return {
        "vw_cohort_retention": cohorts.cohort_retention(facts, snapshot),
        "vw_executive_kpis": executive.executive_kpis(facts),
        "vw_monthly_business_performance": executive.monthly_business_performance(facts),
        "vw_customer_rfm": rfm.customer_rfm(facts, snapshot),
    }


def assert_same(spark, root, tables, snapshot=None):
    kept, full = customer_state.state_marts(spark, root, snapshot), from_orders(tables, snapshot)
    assert set(kept) == set(full) == set(LISTS)
    for name in LISTS:
        assert kept[name].schema.simpleString() == full[name].schema.simpleString(), name
        assert rows(kept[name]) == rows(full[name]), name


@pytest.fixture
def tables(make_tables):
    return make_tables(customers=CUSTOMERS, orders=ORDERS, order_items=ITEMS, order_reviews=REVIEWS)


def test_a_month_more_gives_the_marts_of_a_full_run(spark, tables, tmp_path):
    root = str(tmp_path / "state")
    for month in ("2020-01", "2020-02", None):
        customer_state.write_batch(customer_state.tables_of_batch(tables, of_month(month)), root, month or "undated")
    before = F.coalesce(month_of_order(), F.lit("")) < "2020-03"
    assert_same(spark, root, customer_state.tables_of_batch(tables, before))
    customer_state.write_batch(customer_state.tables_of_batch(tables, of_month("2020-03")), root, "2020-03")
    assert_same(spark, root, tables)
    assert_same(spark, root, tables, dt.date(2020, 5, 1))


def test_one_month_in_two_batches(spark, tables, tmp_path):
    root, first = str(tmp_path / "state"), F.col("order_id").isin("o1", "o6", "o5")
    customer_state.write_batch(customer_state.tables_of_batch(tables, first), root, "a")
    customer_state.write_batch(customer_state.tables_of_batch(tables, ~first), root, "b")
    assert_same(spark, root, tables)


def test_writing_a_batch_again_replaces_it(spark, tables, tmp_path):
    root = str(tmp_path / "state")
    for month in ("2020-01", "2020-02", "2020-03", "2020-03", None):
        customer_state.write_batch(customer_state.tables_of_batch(tables, of_month(month)), root, month or "undated")
    assert_same(spark, root, tables)
    # A batch that has become empty leaves nothing of what it held.
    none = customer_state.tables_of_batch(tables, F.lit(False))
    customer_state.write_batch(none, root, "2020-01")
    assert_same(spark, root, customer_state.tables_of_batch(tables, F.coalesce(~of_month("2020-01"), F.lit(True))))


def test_all_cohort_reports_and_segments_from_state(spark, tables, tmp_path):
    root = str(tmp_path / "state")
    for month in ("2020-01", "2020-02", "2020-03", None):
        customer_state.write_batch(customer_state.tables_of_batch(tables, of_month(month)), root, month or "undated")
    state = customer_state.read_state(spark, root)
    facts, kept = order_analytics(tables, ("person", "items")), customer_state.as_purchases(state)
    for report in (
        cohorts.first_purchase, cohorts.cohort_sizes, cohorts.cohort_size_check, cohorts.cohort_activity_calendar,
        cohorts.cohort_activity_relative, cohorts.cohort_retention_observed,
    ):
        assert rows(report(kept)) == rows(report(facts)), report.__name__
    assert rows(customer_state.customer_totals(state)) == rows(rfm.customer_totals(facts))
    totals = customer_state.customer_totals(state)
    assert rows(rfm.rfm_scores(facts, totals=totals)) == rows(rfm.rfm_scores(facts))


def test_the_marts_read_nothing_but_the_state(spark, tables, tmp_path):
    root = str(tmp_path / "state")
    customer_state.write_batch(tables, root, "all")
    for name, mart in customer_state.state_marts(spark, root).items():
        assert mart.inputFiles() and all(root in f for f in mart.inputFiles()), name


def test_empty_tables(spark, make_tables, tmp_path):
    empty, root = make_tables(), str(tmp_path / "state")
    customer_state.write_batch(empty, root, "none")
    assert_same(spark, root, empty)
