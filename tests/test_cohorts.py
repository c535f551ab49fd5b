import datetime as dt

import pytest
from shop_rows import as_dicts, customer, money, month, only, order

from mercato.plans import cohorts
from mercato.plans.order_model import order_analytics


@pytest.fixture
def facts(make_tables):
    """U1 buys in January (twice) and March, U2 in January, U3 in March."""
    t = make_tables(
        customers=[customer("c1", "U1"), customer("c1b", "U1"), customer("c2", "U2"), customer("c3", "U3")],
        orders=[
            order("o1", "c1", "2020-01-03"),
            order("o2", "c1", "2020-01-20"),
            order("o3", "c1b", "2020-03-02"),
            order("o4", "c2", "2020-01-31 23:59"),
            order("o5", "c3", "2020-03-15"),
            order("o6", "c2", "2020-02-15", status="canceled"),
        ],
    )
    return order_analytics(t, ("person",))


def _cells(df):
    return [
        (r["cohort_month"], r["month_number"], r["active_customers"], r["cohort_customers"], r["retention_pct"])
        for r in as_dicts(df)
    ]


GRID = [
    (month("2020-01"), 0, 2, 2, money("100.00")),
    (month("2020-01"), 1, 0, 2, money("0.00")),
    (month("2020-01"), 2, 1, 2, money("50.00")),
    (month("2020-03"), 0, 1, 1, money("100.00")),
]


def test_complete_grid(facts):
    retention = cohorts.cohort_retention(facts)
    assert _cells(cohorts.cohort_listing(retention)) == GRID
    assert _cells(cohorts.cohort_listing(cohorts.cohort_retention(facts, dt.date(2020, 3, 29)))) == GRID


def test_cohort_after_the_snapshot_has_no_rows(facts):
    grid = _cells(cohorts.cohort_listing(cohorts.cohort_retention(facts, dt.date(2020, 2, 1))))
    assert grid == GRID[:2]


def test_snapshot_after_the_data_extends_every_cohort(facts):
    grid = _cells(cohorts.cohort_listing(cohorts.cohort_retention(facts, dt.date(2020, 4, 30))))
    assert [c[:3] for c in grid] == [
        (month("2020-01"), 0, 2),
        (month("2020-01"), 1, 0),
        (month("2020-01"), 2, 1),
        (month("2020-01"), 3, 0),
        (month("2020-03"), 0, 1),
        (month("2020-03"), 1, 0),
    ]


def test_activity(facts):
    assert [tuple(r.values()) for r in as_dicts(cohorts.cohort_activity_relative(facts))] == [
        (month("2020-01"), month("2020-01"), 0, 2),
        (month("2020-01"), month("2020-03"), 2, 1),
        (month("2020-03"), month("2020-03"), 0, 1),
    ]
    assert len(as_dicts(cohorts.cohort_activity_calendar(facts))) == 3
    observed = as_dicts(cohorts.cohort_retention_observed(facts))
    assert [r["retention_pct"] for r in observed] == [money("100.00"), money("50.00"), money("100.00")]


def test_sizes(facts):
    assert [tuple(r.values()) for r in as_dicts(cohorts.cohort_sizes(facts))] == [
        (month("2020-01"), 2),
        (month("2020-03"), 1),
    ]
    assert only(cohorts.cohort_size_check(facts)) == {"total_cohort_customers": 3, "number_of_cohorts": 2}
    first = as_dicts(cohorts.first_purchase_listing(facts))
    assert [(r["customer_unique_id"], r["first_purchase_date"]) for r in first] == [
        ("U1", dt.date(2020, 1, 3)),
        ("U2", dt.date(2020, 1, 31)),
        ("U3", dt.date(2020, 3, 15)),
    ]


def test_figures_over_the_grid(facts):
    retention = cohorts.cohort_retention(facts)
    assert only(cohorts.cohort_month0_check(retention)) == {"cohorts": 2, "full_retention_month_0": 2}
    curve = as_dicts(cohorts.retention_curve(retention))
    assert [(r["active_customers"], r["eligible_cohort_customers"], r["retention_pct"]) for r in curve] == [
        (3, 3, money("100.00")),
        (0, 2, money("0.00")),
        (1, 2, money("50.00")),
    ]
    assert [r["available_months"] for r in as_dicts(cohorts.cohort_maturity(retention))] == [0, 2]
    assert only(cohorts.retention_summary(retention)) == {
        "total_cohorts": 2,
        "total_customers": 3,
        "month_1_retention_pct": money("0.00"),
        "month_2_retention_pct": money("50.00"),
        "month_3_retention_pct": None,
    }
    assert only(cohorts.cohort_bounds_check(retention)) == {
        "number_of_cohorts": 2,
        "minimum_month_number": 0,
        "maximum_month_number": 2,
    }


def test_orders_without_purchase_time(make_tables):
    t = make_tables(
        customers=[customer("c1", "U1"), customer("c2", "U2")],
        orders=[order("o1", "c1", "2020-01-03"), order("o2", "c1", None), order("o3", "c2", None)],
    )
    facts = order_analytics(t, ("person",))
    assert [tuple(r.values()) for r in as_dicts(cohorts.cohort_activity_calendar(facts))] == [
        (month("2020-01"), month("2020-01"), 1),
        (month("2020-01"), None, 1),
        (None, None, 1),
    ]
    assert len(as_dicts(cohorts.cohort_retention_observed(facts))) == 2
    assert _cells(cohorts.cohort_retention(facts)) == [(month("2020-01"), 0, 1, 1, money("100.00"))]
    assert only(cohorts.cohort_size_check(facts)) == {"total_cohort_customers": 2, "number_of_cohorts": 2}
