import datetime as dt

import pytest
from shop_rows import as_dicts, customer, item, money, only, order, product, review, translation

from mercato.plans import delivery
from mercato.plans.order_model import order_analytics

PROMISED = dt.date(2020, 6, 15)


def late_order(order_id: str, delay: int | None, customer_id: str = "c", status: str = "delivered") -> dict:
    arrived = None if delay is None else f"{PROMISED + dt.timedelta(days=delay)} 12:00"
    return order(order_id, customer_id, "2020-06-01", status, arrived, str(PROMISED))


@pytest.fixture
def facts(make_tables):
    delays = [-1, 0, 1, 3, 4, 7, 8, 14, 15]
    t = make_tables(
        orders=[late_order(f"d{d}", d) for d in delays]
        + [late_order("open", None), late_order("sent", 40, status="shipped")],
        order_reviews=[review("d-1", 5), review("d0", 4), review("d1", 3), review("d15", 1), review("open", 2)],
    )
    return order_analytics(t, ("reviews",))


def test_bucket_edges(facts):
    rows = as_dicts(delivery.by_severity(delivery.delivery_delay_buckets(facts)))
    assert [(r["delay_bucket"], r["orders"]) for r in rows] == [
        ("On Time / Early", 2),
        ("1-3 Days Late", 2),
        ("4-7 Days Late", 2),
        ("8-14 Days Late", 2),
        ("15+ Days Late", 1),
    ]
    assert [r["average_review_score"] for r in rows] == [money("4.50"), money("3.00"), None, None, money("1.00")]
    assert [r["average_delay_days"] for r in rows] == [
        money("-0.50"),
        money("2.00"),
        money("5.50"),
        money("11.00"),
        money("15.00"),
    ]
    reviewed = as_dicts(delivery.delay_bucket_vs_review(facts))
    assert [(r["delay_bucket"], r["orders_with_review"], r["median_delay_days"]) for r in reviewed] == [
        ("On Time / Early", 2, money("-0.50")),
        ("1-3 Days Late", 1, money("1.00")),
        ("15+ Days Late", 1, money("15.00")),
    ]


def test_status(facts):
    rows = {r["delivery_status"]: r for r in as_dicts(delivery.delivery_satisfaction(facts))}
    assert (rows["Late"]["orders"], rows["On Time / Early"]["orders"]) == (7, 2)
    assert rows["Late"]["average_review_score"] == money("2.00")
    assert rows["Late"]["median_delay_days"] == money("7.00")
    assert rows["Late"]["average_delay_days"] == money("7.43")
    reviewed = {r["delivery_status"]: r for r in as_dicts(delivery.status_vs_review(facts))}
    assert reviewed["Late"]["orders_with_review"] == 2
    assert reviewed["Late"]["average_delay_days"] == money("8.00")
    assert [(r["delivery_status"], r["order_share_pct"]) for r in as_dicts(delivery.late_rate(facts))] == [
        ("Late", money("77.78")),
        ("On Time / Early", money("22.22")),
    ]
    assert [tuple(r.values()) for r in as_dicts(delivery.review_score_distribution(facts))] == [
        ("Late", money("1.00"), 1, money("50.00")),
        ("Late", money("3.00"), 1, money("50.00")),
        ("On Time / Early", money("4.00"), 1, money("50.00")),
        ("On Time / Early", money("5.00"), 1, money("50.00")),
    ]


def test_coverage_and_distribution(facts):
    assert only(delivery.delivery_coverage(facts)) == {
        "total_delivered_orders": 10,
        "orders_with_actual_delivery_date": 9,
        "orders_with_estimated_delivery_date": 10,
        "orders_with_delivery_delay": 9,
        "orders_with_review": 5,
        "orders_with_delivery_and_review": 4,
    }
    assert only(delivery.delay_distribution(facts)) == {
        "orders": 9,
        "minimum_delay_days": -1,
        "maximum_delay_days": 15,
        "average_delay_days": money("5.67"),
        "median_delay_days": money("4.00"),
    }


def test_delivery_on_the_promised_day_is_late_only_by_timestamp(make_tables):
    t = make_tables(
        orders=[
            order("same", "c", "2020-01-01", arrived="2020-02-01 23:00", promised="2020-02-01"),
            order("early", "c", "2020-01-01", arrived="2019-12-31", promised="2020-02-01"),
            order("open", "c", "2020-01-01", promised="2020-02-01"),
        ]
    )
    facts = order_analytics(t, ())
    checks = only(delivery.delivery_date_checks(facts))
    assert checks == {
        "delivered_orders": 2,
        "delivered_before_purchase": 1,
        "delivered_before_approval": 0,
        "late_orders": 1,
        "on_time_or_early_orders": 1,
    }
    assert [r["delivery_status"] for r in as_dicts(delivery.late_rate(facts))] == ["On Time / Early"]


def test_states_and_group_size(make_tables):
    t = make_tables(
        customers=[customer("c1", "U1", "AA"), customer("c2", "U2", "AA"), customer("c3", "U3", "BB")],
        orders=[
            late_order("o1", 2, "c1"),
            late_order("o2", 0, "c1"),
            late_order("o3", -3, "c2"),
            late_order("o4", 5, "c3"),
            late_order("o5", None, "c3"),
            late_order("o6", 5, "nobody"),
        ],
        order_reviews=[review("o1", 1), review("o2", 5), review("o3", 4)],
    )
    facts = order_analytics(t, ("reviews",))
    rows = as_dicts(delivery.by_late_rate(delivery.delivery_state(facts, t.customers, min_group=1)))
    assert [(r["customer_state"], r["delivered_orders"], r["late_orders"]) for r in rows] == [
        ("BB", 1, 1),
        ("AA", 3, 1),
    ]
    aa = rows[1]
    assert aa["late_delivery_rate_pct"] == money("33.33")
    assert (aa["average_review_score"], aa["late_order_review_score"], aa["on_time_review_score"]) == (
        money("3.33"),
        money("1.00"),
        money("4.50"),
    )
    assert rows[0]["average_review_score"] is None
    large = as_dicts(delivery.delivery_state(facts, t.customers, min_group=3))
    assert [r["customer_state"] for r in large] == ["AA"]
    assert delivery.delivery_state(facts, t.customers).count() == 0


@pytest.fixture
def mixed(make_tables):
    """One late order with two items of A and one of B; A and C are translated to the same name."""
    return make_tables(
        orders=[late_order("o1", 2), late_order("o2", 0)],
        order_items=[
            item("o1", "1.00", number=1, product="a1"),
            item("o1", "1.00", number=2, product="a2"),
            item("o1", "1.00", number=3, product="b"),
            item("o1", "1.00", number=4, product="none"),
            item("o2", "1.00", product="c"),
        ],
        products=[product("a1", "A"), product("a2", "A"), product("b", "B"), product("c", "C"), product("none", None)],
        product_category_name_translation=[translation("A", "same"), translation("C", "same")],
        order_reviews=[review("o1", 2), review("o2", 5)],
    )


def test_order_counts_once_per_category(mixed):
    facts = order_analytics(mixed, ("reviews",))
    dims = mixed.order_items, mixed.products, mixed.product_category_name_translation
    rows = {r["product_category"]: r for r in as_dicts(delivery.delivery_category(facts, *dims, min_group=1))}
    assert sorted(rows) == ["B", "same"]
    assert (rows["B"]["category_orders"], rows["B"]["late_orders"]) == (1, 1)
    assert (rows["same"]["category_orders"], rows["same"]["late_delivery_rate_pct"]) == (2, money("50.00"))
    assert rows["same"]["average_review_score"] == money("3.50")
    assert only(delivery.order_category_check(mixed.order_items, mixed.products)) == {
        "order_category_rows": 3,
        "distinct_orders": 2,
        "distinct_categories": 3,
    }


def test_dimension_coverage(mixed):
    assert only(delivery.category_coverage(mixed.products)) == {
        "total_products": 5,
        "products_with_category": 4,
        "categories": 3,
    }
    assert only(delivery.translation_coverage(mixed.product_category_name_translation)) == {
        "translated_categories": 2,
        "original_category_names": 2,
        "english_category_names": 1,
    }


def test_view_row_counts(facts):
    views = {"a": delivery.delivery_satisfaction(facts), "b": delivery.delivery_delay_buckets(facts)}
    assert [tuple(r.values()) for r in as_dicts(delivery.view_row_counts(views))] == [("a", 2), ("b", 5)]


def test_products_without_category_can_be_labelled(make_tables):
    t = make_tables(
        orders=[order(o, "c", arrived="2020-01-20", promised="2020-01-15") for o in ("o1", "o2")],
        order_items=[item("o1", "1.00", product="p"), item("o1", "1.00", product="q", number=2), item("o2", "1.00", product="q")],
        products=[product("p", "casa"), product("q", None)],
        product_category_name_translation=[translation("casa", "home")],
    )
    facts = order_analytics(t, ("reviews",))
    args = facts, t.order_items, t.products, t.product_category_name_translation, 1
    count = lambda df: {r["product_category"]: r["category_orders"] for r in as_dicts(df)}
    assert count(delivery.delivery_category(*args)) == {"home": 1}
    assert count(delivery.delivery_category(*args, uncategorised="label")) == {"home": 1, "Uncategorized": 2}
    with pytest.raises(ValueError, match="uncategorised"):
        delivery.delivery_category(*args, uncategorised="keep")
