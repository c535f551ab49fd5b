from shop_rows import as_dicts, customer, item, money, month, only, order, review, ts

from mercato.plans import cohorts, executive, revenue, rfm
from mercato.plans.order_model import delivered, order_analytics, sold


def test_one_person_with_two_customer_ids_is_one_customer(make_tables):
    t = make_tables(
        customers=[customer("c1", "U1"), customer("c2", "U1")], orders=[order("o1", "c1"), order("o2", "c2")]
    )
    kpis = only(executive.executive_kpis(order_analytics(t)))
    assert (kpis["delivered_orders"], kpis["delivered_customers"], kpis["repeat_customers"]) == (2, 1, 1)
    assert kpis["repeat_purchase_rate_pct"] == money("100.00")


def test_several_items_payments_and_reviews_do_not_multiply(make_tables):
    t = make_tables(
        customers=[customer("c1", "U1")],
        orders=[order("o1", "c1")],
        order_items=[item("o1", "10.00", "1.00"), item("o1", "20.00", "2.00", 2)],
        order_payments=[
            {"order_id": "o1", "payment_sequential": n, "payment_value": money("11.00"), "payment_installments": n}
            for n in (1, 2, 3)
        ],
        order_reviews=[review("o1", 5), review("o1", 2)],
    )
    row = only(order_analytics(t))
    assert len(row) == 21
    assert row["product_revenue"] == money("30.00")
    assert row["freight_revenue"] == money("3.00")
    assert row["total_order_value"] == money("33.00")
    assert (row["item_count"], row["payment_row_count"], row["max_installments"]) == (2, 3, 3)
    assert row["total_payment_value"] == money("33.00")
    assert (row["average_review_score"], row["review_count"]) == (money("3.50"), 2)


def test_delay_counts_calendar_days(make_tables):
    t = make_tables(
        orders=[
            order("same", "c", arrived="2020-02-01 23:00", promised="2020-02-01"),
            order("next", "c", arrived="2020-02-02 00:01", promised="2020-02-01"),
            order("open", "c", promised="2020-02-01"),
        ]
    )
    delays = {r["order_id"]: r["delivery_delay_days"] for r in as_dicts(order_analytics(t, ()))}
    assert delays == {"same": 0, "next": 1, "open": None}


def test_month_and_date_ignore_the_session_time_zone(spark, make_tables):
    t = make_tables(orders=[order("o1", "c", "2020-03-01 00:30"), order("o2", "c", "2020-03-31 23:30")])
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        rows = as_dicts(order_analytics(t, ()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {r["purchase_month"] for r in rows} == {month("2020-03")}
    assert {str(r["purchase_date"]) for r in rows} == {"2020-03-01", "2020-03-31"}


def test_review_without_score_leaves_the_average_empty(make_tables):
    t = make_tables(
        orders=[order("o1", "c"), order("o2", "c")],
        order_reviews=[review("o1", None), review("o2", 4), review("o2", None)],
    )
    rows = {r["order_id"]: r for r in as_dicts(order_analytics(t, ("reviews",)))}
    assert rows["o1"]["average_review_score"] is None and rows["o1"]["review_count"] == 1
    assert rows["o2"]["average_review_score"] == money("4.00") and rows["o2"]["review_count"] == 2


def test_review_average_rounds_half_up(make_tables):
    # 1 + 1 + 1 + ... : 8 scores summing to 17 give 2.125, which rounds to 2.13.
    scores = [1, 1, 2, 2, 2, 3, 3, 3]
    t = make_tables(orders=[order("o", "c")], order_reviews=[review("o", s) for s in scores])
    assert only(order_analytics(t, ("reviews",)))["average_review_score"] == money("2.13")


def test_order_without_status_is_in_no_population(make_tables):
    t = make_tables(orders=[order("o1", "c", status=None), order("o2", "c", status="canceled"), order("o3", "c")])
    assert [r["order_id"] for r in as_dicts(delivered(t.orders))] == ["o3"]
    assert [r["order_id"] for r in as_dicts(sold(t.orders))] == ["o3"]


def test_orders_without_a_person(make_tables):
    t = make_tables(customers=[customer("c1", None)], orders=[order("o1", "c1"), order("o2", "c1")])
    facts = order_analytics(t)
    kpis = only(executive.executive_kpis(facts))
    assert (kpis["delivered_customers"], kpis["repeat_customers"]) == (1, 1)
    assert only(executive.monthly_business_performance(facts))["customers"] == 0
    assert rfm.rfm_metrics(facts).count() == 0
    assert cohorts.first_purchase(facts).count() == 0
    listed = only(rfm.customer_rfm(facts))
    assert (listed["customer_unique_id"], listed["frequency"], listed["recency_days"]) == (None, 2, None)


def test_two_definitions_of_average_order_value(make_tables):
    t = make_tables(
        customers=[customer("c1", "U1"), customer("c2", "U2")],
        orders=[order("o1", "c1"), order("o2", "c2")],
        order_items=[item("o1", "10.00", "2.00")],
    )
    facts = order_analytics(t)
    assert only(executive.executive_kpis(facts))["average_order_value"] == money("12.00")
    assert only(revenue.monthly_revenue_aov(facts))["aov"] == money("5.00")


def test_figures_of_an_empty_population(make_tables):
    facts = order_analytics(make_tables())
    kpis = only(executive.executive_kpis(facts))
    assert (kpis["delivered_orders"], kpis["delivered_customers"], kpis["repeat_customers"]) == (0, 0, 0)
    assert kpis["product_revenue"] is None and kpis["late_delivery_rate_pct"] is None
    assert only(rfm.repeat_purchase_rate(facts))["repeat_purchase_rate_pct"] is None
    assert cohorts.cohort_retention(facts).count() == 0
    assert revenue.monthly_sales_calendar(facts).count() == 0


def test_monthly_view(make_tables):
    t = make_tables(
        customers=[customer("c1", "U1"), customer("c2", "U2")],
        orders=[
            order("o1", "c1", "2020-01-05", arrived="2020-01-12", promised="2020-01-10"),
            order("o2", "c1", "2020-01-06", arrived="2020-01-09", promised="2020-01-10"),
            order("o3", "c2", "2020-01-07"),
            order("o4", "c2", "2020-02-07", arrived="2020-02-09", promised="2020-02-09"),
        ],
        order_items=[item("o1", "10.00", "1.00"), item("o2", "5.00"), item("o4", "7.50", "0.25")],
        order_reviews=[review("o1", 1), review("o2", 4)],
    )
    january, february = as_dicts(executive.monthly_business_performance(order_analytics(t)))
    assert january["purchase_month"] == ts("2020-01-01")
    assert (january["orders"], january["customers"]) == (3, 2)
    assert (january["late_orders"], january["orders_with_delivery_data"]) == (1, 2)
    assert january["late_delivery_rate_pct"] == money("50.00")
    assert january["average_order_value"] == money("8.00")
    assert january["average_review_score"] == money("2.50")
    assert february["total_order_value"] == money("7.75")
    assert february["average_review_score"] is None
