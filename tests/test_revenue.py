import datetime as dt

import pytest
from shop_rows import as_dicts, item, money, month, only, order, product, translation

from mercato.plans import categories, revenue
from mercato.plans.order_model import delivered, order_analytics, sold


@pytest.fixture
def gap(make_tables):
    """Sales in October and December, nothing in November."""
    t = make_tables(
        orders=[
            order("o1", "c", "2020-10-05"),
            order("o2", "c", "2020-12-05"),
            order("o3", "c", "2020-11-01", "canceled"),
        ],
        order_items=[item("o1", "100.00"), item("o2", "150.00"), item("o3", "9.00")],
    )
    return order_analytics(t, ("items",))


def test_growth_over_observed_months(gap):
    october, december = as_dicts(revenue.mom_growth_observed(gap))
    assert october["revenue_growth_pct"] is None
    assert december["previous_month_revenue"] == money("100.00")
    assert december["revenue_growth_pct"] == money("50.00")


def test_growth_over_the_calendar(gap):
    rows = as_dicts(revenue.mom_growth_calendar(gap))
    assert [r["month"] for r in rows] == [month("2020-10"), month("2020-11"), month("2020-12")]
    assert [r["revenue"] for r in rows] == [money("100.00"), money("0.00"), money("150.00")]
    assert [r["orders"] for r in rows] == [1, 0, 1]
    assert [r["aov"] for r in rows] == [money("100.00"), None, money("150.00")]
    assert [r["revenue_growth_pct"] for r in rows] == [None, money("-100.00"), None]
    assert [r["previous_month_orders"] for r in rows] == [None, 1, 0]


def test_calendar_bounds_and_comparable_start(gap):
    rows = as_dicts(revenue.monthly_sales_calendar(gap, dt.date(2020, 9, 1), dt.date(2021, 1, 1)))
    assert [r["orders"] for r in rows] == [0, 1, 0, 1, 0]
    inner = as_dicts(revenue.monthly_sales_calendar(gap, dt.date(2020, 11, 1), dt.date(2020, 11, 1)))
    assert [r["month"] for r in inner] == [month("2020-11")]
    later = as_dicts(revenue.mom_growth_calendar(gap, comparable_from=dt.date(2020, 12, 1)))
    assert [r["revenue_growth_pct"] for r in later] == [None, None, None]


def test_a_fixed_calendar_without_any_sale(make_tables):
    facts = order_analytics(make_tables(), ("items",))
    rows = as_dicts(revenue.monthly_sales_calendar(facts, dt.date(2020, 1, 1), dt.date(2020, 3, 1)))
    assert [(r["revenue"], r["orders"], r["aov"]) for r in rows] == [(money("0.00"), 0, None)] * 3


def test_monthly_listings(gap):
    assert [r["revenue"] for r in as_dicts(revenue.monthly_revenue(gap))] == [money("100.00"), money("150.00")]
    assert [r["orders"] for r in as_dicts(revenue.monthly_revenue_orders(gap))] == [1, 1]
    assert only(revenue.sales_month_range(gap)) == {"first_month": month("2020-10"), "last_month": month("2020-12")}
    assert only(revenue.revenue_check_view(gap)) == {"order_view_revenue": money("250.00")}


@pytest.fixture
def shop(make_tables):
    return make_tables(
        orders=[order("o1", "c"), order("o2", "c", status="shipped"), order("o3", "c", status="canceled")],
        order_items=[
            item("o1", "10.00", number=1, product="translated"),
            item("o1", "5.00", number=2, product="translated"),
            item("o1", "3.00", number=3, product="raw"),
            item("o1", "2.00", number=4, product="bare"),
            item("o2", "7.00", product="raw"),
            item("o3", "90.00", product="raw"),
        ],
        products=[product("translated", "brinquedos"), product("raw", "pc_gamer"), product("bare", None)],
        product_category_name_translation=[translation("brinquedos", "toys")],
    )


def test_category_labels_and_populations(shop):
    dims = shop.products, shop.product_category_name_translation
    sales = as_dicts(categories.category_revenue(shop.order_items, sold(shop.orders), *dims))
    assert [(r["category"], r["revenue"], r["orders"], r["items_sold"]) for r in sales] == [
        ("toys", money("15.00"), 1, 2),
        ("pc_gamer", money("10.00"), 2, 2),
        ("Unknown", money("2.00"), 1, 1),
    ]
    done = categories.product_category_performance(shop.order_items, delivered(shop.orders), *dims)
    assert [tuple(r.values()) for r in as_dicts(done)] == [
        ("toys", money("15.00"), 1, 2),
        ("pc_gamer", money("3.00"), 1, 1),
        ("Uncategorized", money("2.00"), 1, 1),
    ]
    assert only(categories.category_reconciliation(done)) == {
        "categorized_and_uncategorized_revenue": money("20.00")
    }
    raw = only(revenue.revenue_check_raw(shop.order_items, shop.orders))
    assert raw == {"raw_item_revenue": money("27.00")}


def test_category_shares(shop):
    totals = categories.category_totals(
        shop.order_items, sold(shop.orders), shop.products, shop.product_category_name_translation
    )
    shares = {r["category"]: r["revenue_share_pct"] for r in as_dicts(categories.category_revenue_share(totals))}
    assert shares == {"toys": money("55.56"), "pc_gamer": money("37.04"), "Unknown": money("7.41")}
    assert only(categories.category_share_check(totals)) == {"total_revenue_share_pct": money("100.00")}


def test_ties_at_the_last_rank_are_all_returned(spark):
    rows = [(f"k{n:02d}", money(f"{100 - n}.00")) for n in range(9)] + [("x", money("1.00")), ("y", money("1.00"))]
    totals = spark.createDataFrame(rows, "category string, revenue decimal(38,2)")
    top = as_dicts(categories.category_top(totals, 10))
    assert len(top) == 11
    assert [r["revenue_rank"] for r in top[-2:]] == [10, 10]
    assert len(as_dicts(categories.category_top(totals, 3))) == 3
