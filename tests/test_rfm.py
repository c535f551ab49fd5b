import datetime as dt
from itertools import product as pairs

from shop_rows import as_dicts, customer, item, money, only, order

from mercato.plans import rfm
from mercato.plans.order_model import order_analytics


def _facts(make_tables, bought: dict[str, str], spent: dict[str, str | None]):
    return order_analytics(
        make_tables(
            customers=[customer(f"c-{u}", u) for u in bought],
            orders=[order(f"o-{u}", f"c-{u}", day) for u, day in bought.items()],
            order_items=[item(f"o-{u}", price) for u, price in spent.items() if price],
        ),
        ("person", "items"),
    )


def test_remainder_goes_to_the_oldest_tiles(make_tables):
    people = {f"U{n}": f"2020-01-{n:02d}" for n in range(1, 8)}
    facts = _facts(make_tables, people, dict.fromkeys(people, "1.00"))
    scores = {r["customer_unique_id"]: r["recency_score"] for r in as_dicts(rfm.rfm_scores(facts))}
    assert [scores[f"U{n}"] for n in range(1, 8)] == [1, 1, 2, 2, 3, 4, 5]


def test_customer_without_items_has_the_top_monetary_score(make_tables):
    spent = {"A": "1.00", "B": "2.00", "C": "3.00", "D": "4.00", "E": None}
    facts = _facts(make_tables, dict.fromkeys(spent, "2020-01-01"), spent)
    scores = {r["customer_unique_id"]: r["monetary_score"] for r in as_dicts(rfm.rfm_scores(facts))}
    assert scores == {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5}
    top = as_dicts(rfm.rfm_top_customers(facts, 2))
    assert [r["customer_unique_id"] for r in top] == ["E", "D"]


def test_ties_are_told_apart_by_id(make_tables):
    people = [f"U{n:02d}" for n in range(10)]
    facts = _facts(make_tables, dict.fromkeys(people, "2020-01-01"), dict.fromkeys(people, "5.00"))
    rows = sorted(as_dicts(rfm.rfm_scores(facts)), key=lambda r: r["customer_unique_id"])
    assert [r["recency_score"] for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [r["rm_score"] for r in rows] == [f"{n}{n}" for n in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5)]


def test_segments_cover_all_25_cells(spark):
    cells = [(f"{r}{m}", r, m, 1, money("1.00"), f"{r}{m}") for r, m in pairs(range(1, 6), repeat=2)]
    scores = spark.createDataFrame(
        cells,
        "customer_unique_id string, recency_score int, monetary_score int, frequency bigint,"
        " monetary decimal(38,2), rm_score string",
    )
    segments = rfm.rfm_segments(scores)
    counts = {r["customer_segment"]: r["customers"] for r in as_dicts(rfm.rfm_segment_summary(segments))}
    assert counts == {
        "Recent High Value": 4,
        "Recent Low/Medium Value": 6,
        "High Value At Risk": 4,
        "Inactive / Low Value": 6,
        "Middle Value": 5,
    }
    at_risk = only(rfm.rfm_high_value_at_risk(scores))
    assert at_risk["high_value_at_risk_customers"] == 4
    assert at_risk["segment_share_pct"] == money("100.00")
    assert at_risk["share_of_all_customers_pct"] == money("16.00")
    assert only(rfm.rfm_recent_high_value(scores))["recent_high_value_customers"] == 4


def test_metrics_and_counts(make_tables):
    t = make_tables(
        customers=[customer("c1", "U1"), customer("c2", "U1"), customer("c3", "U2")],
        orders=[
            order("o1", "c1", "2020-01-01"),
            order("o2", "c2", "2020-01-31 22:00"),
            order("o3", "c3", "2020-01-11"),
            order("o4", "c3", "2020-03-01", status="shipped"),
        ],
        order_items=[item("o1", "10.00"), item("o2", "5.50"), item("o3", "7.25"), item("o4", "99.00")],
    )
    facts = order_analytics(t)
    rows = {r["customer_unique_id"]: r for r in as_dicts(rfm.rfm_metrics(facts))}
    assert rows["U1"]["snapshot_date"] == dt.date(2020, 1, 31)
    assert (rows["U1"]["recency"], rows["U1"]["frequency"], rows["U1"]["monetary"]) == (0, 2, money("15.50"))
    assert (rows["U2"]["recency"], rows["U2"]["frequency"], rows["U2"]["monetary"]) == (20, 1, money("7.25"))
    later = {r["customer_unique_id"]: r["recency"] for r in as_dicts(rfm.rfm_metrics(facts, dt.date(2020, 2, 10)))}
    assert later == {"U1": 10, "U2": 30}
    rate = only(rfm.repeat_purchase_rate(facts))
    assert (rate["total_customers"], rate["repeat_customers"], rate["one_time_customers"]) == (2, 1, 1)
    assert rate["repeat_purchase_rate_pct"] == money("50.00")
    assert only(rfm.snapshot_date(facts)) == {
        "snapshot_date": dt.date(2020, 1, 31)
    }
    check = only(rfm.rfm_validation(facts))
    assert (check["total_customers"], check["unique_customer_ids"]) == (2, 2)
    assert [r["frequency"] for r in as_dicts(rfm.frequency_distribution(facts))] == [1, 2]
    view = {r["customer_unique_id"]: r for r in as_dicts(rfm.customer_rfm(facts))}
    assert view["U1"]["customer_type"] == "Repeat Customer"
    assert view["U2"]["recency_days"] == 20
    totals = only(rfm.rfm_totals_check(rfm.customer_rfm(facts)))
    assert totals == {"customers": 2, "repeat_customers": 1, "one_time_customers": 1}
