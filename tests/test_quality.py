import pytest
from shop_rows import as_dicts, customer, item, money, only, order, product, review, ts

from mercato.operators import checks, repeats
from mercato.plans import quality
from mercato.sources.tables import tables_from_parquet, write_tables


def test_declared_constraints(make_tables):
    t = make_tables(
        customers=[customer("c1", "U1"), customer("c2", None)],
        orders=[order("o1", "c1"), order("o1", "c1"), order("o2", None), order("o3", "gone")],
        order_items=[item("o1", "1.00"), item("lost", "2.00"), item("lost", "2.00", number=2)],
        products=[product("p", None)],
        order_reviews=[review("o1", 6), review("o1", None), review("o1", 5)],
    )
    nulls = {(r["table_name"], r["column_name"]): r["null_rows"] for r in as_dicts(checks.check_not_null(t))}
    assert len(nulls) == 14
    assert {k for k, v in nulls.items() if v} == {("customers", "customer_unique_id"), ("orders", "customer_id")}
    keys = {r["table_name"]: r for r in as_dicts(checks.check_primary_keys(t))}
    assert len(keys) == 7
    assert (keys["orders"]["duplicate_groups"], keys["orders"]["extra_rows"]) == (1, 1)
    assert keys["order_items"]["key_columns"] == "order_id, order_item_id"
    assert sum(r["duplicate_groups"] for r in keys.values()) == 1
    orphans = {(r["child_table"], r["child_column"]): r["orphan_rows"] for r in as_dicts(checks.check_foreign_keys(t))}
    assert len(orphans) == 6
    assert orphans[("order_items", "order_id")] == 2
    assert orphans[("order_items", "seller_id")] == 3
    assert orphans[("orders", "customer_id")] == 1
    assert orphans[("order_items", "product_id")] == 0
    assert only(checks.check_review_score_range(t.order_reviews)) == {"violating_rows": 1}


def test_order_profile(make_tables):
    t = make_tables(
        customers=[customer("c1", "U1"), customer("c2", "U1")],
        orders=[
            order("o1", "c1", "2020-01-02", arrived="2020-01-05"),
            order("o2", "c2", "2020-01-01"),
            order("o3", None, None, status="canceled"),
            order("o4", "gone", "2020-03-04", status=None),
        ],
    )
    assert only(quality.customer_ids(t.customers)) == {
        "total_rows": 2,
        "unique_customer_ids": 2,
        "unique_customers": 1,
    }
    assert only(quality.order_ids(t.orders)) == {"total_rows": 4, "unique_order_ids": 4}
    assert [tuple(r.values()) for r in as_dicts(quality.status_distribution(t.orders))] == [
        ("delivered", 2, money("50.00")),
        ("canceled", 1, money("25.00")),
        (None, 1, money("25.00")),
    ]
    assert only(quality.order_date_range(t.orders)) == {
        "first_order": ts("2020-01-01"),
        "last_order": ts("2020-03-04"),
    }
    assert only(quality.order_date_completeness(t.orders)) == {
        "total_orders": 4,
        "purchase_dates": 3,
        "approved_dates": 0,
        "carrier_dates": 0,
        "delivered_dates": 1,
        "estimated_dates": 0,
    }
    assert only(quality.orders_without_customer(t.orders, t.customers)) == {"orders_without_customer": 2}
    counts = {r["table_name"]: r["row_count"] for r in as_dicts(quality.load_row_counts(t))}
    assert len(counts) == 9 and counts["orders"] == 4 and counts["geolocation"] == 0


def test_detail_profiles(make_tables):
    t = make_tables(
        order_payments=[{"order_id": o, "payment_sequential": n} for o, n in [("o1", 1), ("o1", 2), ("o2", 1)]],
        order_reviews=[review("o1", 5), review("o1", 1), review("o2", 5), review("o3", None)],
        order_items=[item("o1", "1.00", "0.10"), item("o1", "-2.00", "0.20", number=2), item("o2", "4.00", "-0.05")],
    )
    assert only(quality.payment_structure(t.order_payments)) == {"payment_rows": 3, "orders_with_payments": 2}
    assert [tuple(r.values()) for r in as_dicts(quality.payments_per_order(t.order_payments))] == [(1, 1), (2, 1)]
    assert only(quality.review_structure(t.order_reviews)) == {
        "total_review_rows": 4,
        "unique_review_ids": 3,
        "orders_with_reviews": 3,
    }
    assert [tuple(r.values()) for r in as_dicts(quality.review_scores(t.order_reviews))] == [(1, 1), (5, 2), (None, 1)]
    assert only(quality.orders_multi_review_count(t.order_reviews)) == {"orders_with_multiple_reviews": 1}
    assert only(quality.orders_multi_review_top(t.order_reviews)) == {"order_id": "o1", "review_count": 2}
    assert only(quality.item_structure(t.order_items)) == {
        "total_item_rows": 3,
        "orders_with_items": 2,
        "unique_products": 1,
        "unique_sellers": 1,
    }
    stats = only(quality.price_freight_stats(t.order_items))
    assert (stats["min_price"], stats["max_price"], stats["avg_price"]) == (
        money("-2.00"),
        money("4.00"),
        money("1.000000000000"),
    )
    assert stats["avg_freight"] == money("0.083333333333")
    assert only(quality.negative_price(t.order_items)) == {"negative_price_rows": 1}
    assert only(quality.negative_freight(t.order_items)) == {"negative_freight_rows": 1}


def test_row_value_keys_count_missing_parts(spark):
    items = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("a", 1)], "order_id string, order_item_id int")
    assert only(quality.item_key_uniqueness(items)) == {"total_rows": 4, "unique_order_items": 3}


def test_null_keys_are_found(make_tables):
    t = make_tables(
        orders=[order(None, "c1"), order(None, "c1"), order("o1", "c1"), order("o1", "c1")],
        customers=[customer(None, "U1"), customer("c1", "U1")],
        products=[product(None, "a")],
        order_items=[item(None, "1.00"), item("o1", "1.00")],
    )
    nulls = {(r["table_name"], r["column_name"]): r["null_rows"] for r in as_dicts(checks.check_not_null(t))}
    assert nulls[("orders", "order_id")] == 2 and nulls[("customers", "customer_id")] == 1
    assert nulls[("products", "product_id")] == 1 and nulls[("order_items", "order_id")] == 1
    keys = {r["table_name"]: (r["duplicate_groups"], r["extra_rows"], r["null_key_rows"]) for r in as_dicts(checks.check_primary_keys(t))}
    assert keys["orders"] == (1, 1, 2) and keys["customers"] == (0, 0, 1) and keys["products"] == (0, 0, 1)
    assert keys["order_items"] == (0, 0, 1) and keys["sellers"] == (0, 0, 0)


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_repeated_keys_with_forced_collisions(spark, bits):
    """With few hash bits nearly every key is suspected; the counts are those of plain grouping all the same."""
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 1), (None, 1), (None, 1), ("c", None), ("1", None), (None, None)]
    rows += [(f"k{i}", i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "x string, y int")
    unique = spark.createDataFrame([(f"u{i}",) for i in range(40)], "id string")
    empty = unique.where("id is null")
    found = {
        r["name"]: tuple(r)[1:] for r in repeats.key_repeats({"t": (df, ("x", "y")), "u": (unique, ["id"]), "e": (empty, ["id"])}, bits).collect()
    }
    assert found == {"t": (61, 5, 2, 3, 4), "u": (40, 0, 0, 0, 0), "e": (0, 0, 0, 0, 0)}


def test_keys_of_empty_tables(make_tables):
    found = as_dicts(checks.check_primary_keys(make_tables()))
    assert len(found) == 7 and all(r["duplicate_groups"] == r["extra_rows"] == r["null_key_rows"] == 0 for r in found)


def test_clean_keys_are_not_shuffled_whole(spark, tmp_path, make_tables, monkeypatch):
    write_tables(make_tables(orders=[order(f"o{i}", "c") for i in range(30)]), str(tmp_path / "t"))
    t = tables_from_parquet(spark, str(tmp_path / "t"))
    plans, collect = [], type(t.orders).collect
    monkeypatch.setattr(type(t.orders), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    result = checks.check_primary_keys(t)
    monkeypatch.undo()
    assert all(r["duplicate_groups"] == 0 for r in as_dicts(result))
    # What the only job shuffles is table number and hash; the result of clean tables reads no table again.
    assert len(plans) == 1
    exchanged = [line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and all("order_id" not in line for line in exchanged) and any("hash#" in line for line in exchanged)
    assert "FileScan" not in result._jdf.queryExecution().executedPlan().toString()


def test_each_child_table_is_scanned_once_for_its_references(spark, tmp_path, make_tables):
    write_tables(make_tables(), str(tmp_path / "t"))
    plan = checks.check_foreign_keys(tables_from_parquet(spark, str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    # Four children; customers, orders, products and sellers as parents.
    assert len(scans) == 8
    assert sum("seller_id" in s and "product_id" in s and "order_id" in s for s in scans) == 1
    # One join, on the partitioning of the counts: keys shuffle once on either side.
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") + plan.count("ShuffledHashJoin") == 1
