"""Physical plans: what is read, what is shuffled, and how a hot key is handled."""

import re
from collections import Counter
from decimal import Decimal

import pytest
from shop_rows import as_dicts, customer, order
from pyspark.sql import functions as F

from mercato.plans import categories, cohorts, delivery, executive, quality, reconciliation, revenue, rfm
from mercato.plans.order_model import delivered, order_analytics, orders_clean
from mercato.sources.tables import tables_from_parquet, write_tables


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A few orders as Parquet tables, so that plans show real scans."""
    from mercato.schemas import TABLE_SPECS
    from mercato.sources.tables import Tables

    rows = {
        "customers": [customer("c1", "U1", "AA")],
        "orders": [order("o1", "c1", arrived="2020-01-20", promised="2020-01-18")],
    }

    def frame(name):
        schema = TABLE_SPECS[name].schema
        return spark.createDataFrame(
            [tuple(r.get(f.name) for f in schema) for r in rows.get(name, [])], schema
        )

    root = str(tmp_path_factory.mktemp("stored"))
    write_tables(Tables(frame), root)
    return tables_from_parquet(spark, root)


@pytest.fixture
def large_tables(spark):
    """Plan as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_status_filter_and_columns_reach_the_scan(stored):
    plan = physical(executive.executive_kpis(order_analytics(stored)))
    orders_scan = next(line for line in plan.splitlines() if "FileScan" in line and "order_status" in line)
    assert "EqualTo(order_status,delivered)" in orders_scan
    assert "order_approved_at" not in orders_scan
    items_scan = next(line for line in plan.splitlines() if "FileScan" in line and "price" in line)
    schema = re.search(r"ReadSchema: (.*)", items_scan).group(1)
    assert "order_item_id" not in schema and "seller_id" not in schema


def test_unused_rollups_leave_the_plan(stored):
    plan = physical(revenue.monthly_revenue(order_analytics(stored)))
    assert "payment" not in plan and "review" not in plan


def test_order_side_is_shuffled_once_for_all_rollups(stored, large_tables):
    plan = physical(order_analytics(stored))
    keys = Counter(re.findall(r"Exchange hashpartitioning\((\w+)#", plan))
    # Orders and each of the three detail tables once on order_id; orders and customers once on customer_id.
    assert keys == {"order_id": 4, "customer_id": 2}


def test_no_cross_join_and_no_python(spark, stored, large_tables):
    facts = order_analytics(stored)
    dims = stored.products, stored.product_category_name_translation
    frames = [
        executive.executive_kpis(facts),
        executive.monthly_business_performance(facts),
        rfm.rfm_metrics(facts),
        rfm.customer_rfm(facts),
        cohorts.cohort_retention(facts),
        revenue.mom_growth_calendar(facts),
        categories.product_category_performance(stored.order_items, delivered(stored.orders), *dims),
        delivery.delivery_state(facts, stored.customers),
        delivery.delivery_category(facts, stored.order_items, *dims),
        quality.orders_without_customer(stored.orders, stored.customers),
    ]
    frames += [rfm.rfm_scores(facts), reconciliation.reconcile_tables(stored)]
    for df in frames:
        plan = physical(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "Python" not in plan and "Pandas" not in plan
        assert "BroadcastExchange" not in plan


def test_single_partition_steps_follow_an_aggregation(stored, large_tables):
    """Only grouped rows may meet in one task."""
    facts = order_analytics(stored)
    for df in (
        cohorts.cohort_retention(facts),
        revenue.mom_growth_observed(facts),
        delivery.late_rate(facts),
        quality.status_distribution(stored.orders),
    ):
        plan = physical(df).splitlines()
        for number, line in enumerate(plan):
            if "SinglePartition" in line:
                below = "\n".join(plan[number + 1 : number + 4])
                assert "HashAggregate" in below or "ObjectHashAggregate" in below, below


HOT_SHARE = 3


@pytest.fixture
def skewed_orders(spark):
    """60,000 orders of which one customer placed a third, and 20,000 customers."""
    orders = spark.range(0, 60_000, 1, 8).select(
        F.format_string("o%06d", "id").alias("order_id"),
        F.when(F.col("id") % HOT_SHARE == 0, "hot")
        .otherwise(F.format_string("c%05d", F.col("id") % 20_000))
        .alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        *[
            F.lit("2020-01-01").cast("timestamp_ntz").alias(c)
            for c in (
                "order_purchase_timestamp",
                "order_approved_at",
                "order_delivered_carrier_date",
                "order_delivered_customer_date",
                "order_estimated_delivery_date",
            )
        ],
    )
    customers = spark.range(20_000).select(
        F.format_string("c%05d", "id").alias("customer_id"), F.format_string("U%05d", "id").alias("customer_unique_id")
    )
    return orders, customers.union(spark.createDataFrame([("hot", "HOT")], "a string, b string"))


def test_hot_customer_is_split_over_tasks(spark, skewed_orders, large_tables):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        clean = orders_clean(*skewed_orders)
        frequency = clean.groupBy("customer_unique_id").agg(
            F.count("*").alias("n"), F.max("order_id").alias("last_order")
        )
        rows = {r.customer_unique_id: r.n for r in frequency.collect()}
        plan = physical(frequency)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert rows["HOT"] == 20_000 and sum(rows.values()) == 60_000
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_product_enters_the_lookup_as_one_row(spark, stored, large_tables):
    totals = categories.category_totals(
        stored.order_items, delivered(stored.orders), stored.products, stored.product_category_name_translation
    )
    lines = physical(totals).splitlines()
    joins = [n for n, line in enumerate(lines) if "SortMergeJoin [product_id" in line]
    below = "\n".join(lines[joins[0] : joins[0] + 5])
    assert "HashAggregate(keys=[product_id" in below


def test_hot_product_and_hot_order_give_whole_results(spark):
    """A third of the items sit in one order, another third are one product; compared with plain counting."""
    n = 9_000
    rows = [
        (
            "hot" if i % 3 == 0 else f"o{i % 500}",
            i,
            "hot" if i % 3 == 1 else f"p{i % 40}",
            "s",
            None,
            Decimal(i % 90),
            Decimal(1),
        )
        for i in range(n)
    ]
    from mercato.schemas import TABLE_SPECS

    items = spark.createDataFrame(rows, TABLE_SPECS["order_items"].schema)
    orders = spark.createDataFrame([(o,) for o in sorted({r[0] for r in rows})], "order_id string")
    label = {p: None if p == "p0" else f"k{len(p)}" for p in {r[2] for r in rows}}
    products = spark.createDataFrame(list(label.items()), "product_id string, product_category_name string")
    names = spark.createDataFrame(
        [("k3", "three")], "product_category_name string, product_category_name_english string"
    )

    got = {
        r["category"]: (r["revenue"], r["orders"], r["items_sold"])
        for r in as_dicts(categories.category_revenue(items, orders, products, names))
    }
    expected = {}
    for category in {"k2", "three", "Unknown"}:
        mine = [r for r in rows if {"k3": "three", None: "Unknown"}.get(label[r[2]], label[r[2]]) == category]
        expected[category] = (sum(r[5] for r in mine), len({r[0] for r in mine}), len(mine))
    assert got == expected
    totals = {r["category"]: r["revenue"] for r in as_dicts(categories.category_totals(items, orders, products, names))}
    assert totals == {k: v[0] for k, v in expected.items()}


@pytest.mark.parametrize("build", [rfm.rfm_metrics, rfm.customer_rfm])
def test_default_snapshot_reuses_the_person_join(spark, stored, large_tables, build):
    facts = order_analytics(stored, ("person", "items"))
    df = build(facts)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") :]
    assert "ReusedExchange" in final


def test_nothing_runs_while_a_plan_is_built(spark, stored):
    tracker = spark.sparkContext.statusTracker()
    facts = order_analytics(stored)
    spark.sparkContext.setJobGroup("build", "building plans")
    try:
        for build in (rfm.rfm_metrics, rfm.customer_rfm, cohorts.cohort_retention, executive.executive_kpis):
            build(facts)
        assert not tracker.getJobIdsForGroup("build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_frame_stays_in_the_cache(spark, stored):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    facts = order_analytics(stored)
    rfm.rfm_segment_summary(rfm.rfm_segments(rfm.rfm_scores(facts))).collect()
    reconciliation.reconcile_tables(stored).collect()
    rfm.rfm_top_customers(facts).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_given_totals_are_not_stored_again(spark, stored, monkeypatch):
    facts = order_analytics(stored)
    totals = rfm.stored(rfm.customer_totals(facts))
    expected = sorted(map(str, rfm.rfm_scores(facts).collect()))
    monkeypatch.setattr(rfm, "stored", None)
    assert sorted(map(str, rfm.rfm_scores(facts, totals=totals).collect())) == expected


def test_reconciliation_builds_the_order_frame_once(spark, stored, large_tables):
    plan = physical(reconciliation.reconcile_tables(stored))
    # The order frame is read from where it was stored; beside it, items are read for the sales by product alone.
    passes = [line for line in plan.splitlines() if "FileScan" in line and "freight_value" in line]
    assert not passes


def test_category_sets_and_cohort_months_take_one_exchange_each(stored, large_tables):
    facts = order_analytics(stored, ("person", "reviews"))
    dims = stored.products, stored.product_category_name_translation
    by_category = Counter(re.findall(r"Exchange hashpartitioning\((\w+)#", physical(delivery.delivery_category(facts, stored.order_items, *dims))))
    # Items grouped to category sets, reviews, and the orders that meet both.
    assert by_category["order_id"] <= 3 and by_category["product_id"] == 2
    cohort = Counter(re.findall(r"Exchange hashpartitioning\((\w+)#", physical(cohorts.cohort_activity(facts))))
    assert cohort["customer_unique_id"] == 1


@pytest.mark.parametrize("key", ["order_id", "product_id"])
def test_hot_order_and_hot_product_are_split(spark, large_tables, key):
    """A third of 60,000 items share one key; both row-level lookups of the items are split."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    number = F.col("id") % 20_000
    hot = lambda name, letter: F.when(F.lit(key == name) & (F.col("id") % 3 == 0), "hot").otherwise(
        F.format_string(f"{letter}%05d", number)
    )
    items = spark.range(0, 60_000, 1, 8).select(
        hot("order_id", "o").alias("order_id"), hot("product_id", "p").alias("product_id"), F.lit(1).cast("decimal(12,2)").alias("price")
    )
    try:
        if key == "order_id":
            orders = spark.range(20_000).select(F.format_string("o%05d", "id").alias("order_id"), F.lit("delivered").alias("order_status"))
            orders = orders.union(spark.createDataFrame([("hot", "delivered")], "a string, b string"))
            found = revenue.revenue_check_raw(items, orders)
            assert found.first()[0] == 60_000
        else:
            products = spark.range(20_000).select(
                F.format_string("p%05d", "id").alias("product_id"), F.format_string("k%d", F.col("id") % 7).alias("product_category_name")
            )
            products = products.union(spark.createDataFrame([("hot", "k9")], "a string, b string"))
            found = delivery.order_category_check(items, products)
            assert found.first()["distinct_categories"] == 8
        found.collect()
        plan = physical(found)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan
