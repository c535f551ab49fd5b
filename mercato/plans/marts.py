"""The published views by name: as temp views, or written as Parquet marts."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mercato.operators import rollups
from mercato.plans import categories, cohorts, delivery, executive, revenue, rfm
from mercato.plans.order_model import delivered, order_analytics, orders_clean
from mercato.plans.reconciliation import CATEGORY_MART, ORDER_ANALYTICS, RAW_ITEMS, SEGMENTS, Sides, reconcile_tables
from mercato.sources.tables import Tables, register_tables


@dataclass(frozen=True)
class Params:
    """Settings of the published views.

    A missing snapshot means the latest delivered purchase, missing calendar bounds the months of the data. ``comparable_from`` is the
    first month whose growth counts; ``uncategorised`` drops or labels products without a category in delivery by category.
    """

    snapshot: dt.date | None = None
    min_group: int = delivery.MIN_GROUP
    calendar_first: dt.date | None = None
    calendar_last: dt.date | None = None
    comparable_from: dt.date | None = None
    tiles: int = rfm.TILES
    uncategorised: str = "drop"


# View names.
ORDER_VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "vw_orders_clean": lambda t: orders_clean(t.orders, t.customers),
    "vw_order_payments": lambda t: rollups.order_payments(t.order_payments),
    "vw_order_revenue": lambda t: rollups.order_revenue(t.order_items),
    "vw_order_reviews": lambda t: rollups.order_reviews(t.order_reviews),
}
MART_VIEWS: dict[str, Callable[[DataFrame, Tables, Params], DataFrame]] = {
    "vw_cohort_retention": lambda f, t, p: cohorts.cohort_retention(f, p.snapshot),
    "vw_delivery_satisfaction": lambda f, t, p: delivery.delivery_satisfaction(f),
    "vw_delivery_delay_buckets": lambda f, t, p: delivery.delivery_delay_buckets(f),
    "vw_delivery_state": lambda f, t, p: delivery.delivery_state(f, t.customers, p.min_group),
    "vw_delivery_category": lambda f, t, p: delivery.delivery_category(
        f, t.order_items, t.products, t.product_category_name_translation, p.min_group, p.uncategorised
    ),
    CATEGORY_MART: lambda f, t, p: categories.product_category_performance(
        t.order_items, delivered(t.orders), t.products, t.product_category_name_translation
    ),
    "vw_executive_kpis": lambda f, t, p: executive.executive_kpis(f),
    "vw_monthly_business_performance": lambda f, t, p: executive.monthly_business_performance(f),
    "vw_customer_rfm": lambda f, t, p: rfm.customer_rfm(f, p.snapshot),
}
# Beyond the published views: what the dashboard's segment and growth pages read.
EXTRA_MARTS: dict[str, Callable[[DataFrame, Tables, Params], DataFrame]] = {
    SEGMENTS: lambda f, t, p: rfm.rfm_segments(rfm.rfm_scores(f, p.snapshot, p.tiles)),
    "monthly_growth": lambda f, t, p: revenue.mom_growth_calendar(
        f, p.calendar_first, p.calendar_last, p.comparable_from
    ),
}
# Views over another view, which is read and not computed again.
DERIVED_VIEWS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "vw_cohort_retention_powerbi": ("vw_cohort_retention", cohorts.cohort_listing),
}
RECONCILIATION = "reconciliation"


def register_views(tables: Tables, params: Params = Params()) -> list[str]:
    """Make the input tables and all views available to ``spark.sql``. Only the segments' tile starts are counted now, nothing else is computed."""
    register_tables(tables)
    facts = order_analytics(tables)
    for name, build in ORDER_VIEWS.items():
        build(tables).createOrReplaceTempView(name)
    facts.createOrReplaceTempView(ORDER_ANALYTICS)
    for name, build in {**MART_VIEWS, **EXTRA_MARTS}.items():
        build(facts, tables, params).createOrReplaceTempView(name)
    for name, (source, build) in DERIVED_VIEWS.items():
        build(facts.sparkSession.table(source)).createOrReplaceTempView(name)
    return [*ORDER_VIEWS, ORDER_ANALYTICS, *MART_VIEWS, *EXTRA_MARTS, *DERIVED_VIEWS]


# File that names the current version, and how the folders of versions begin.
POINTER = "CURRENT"
VERSION = "version-"


def write_marts(spark: SparkSession, tables: Tables, root: str, params: Params = Params()) -> dict[str, str]:
    """Write a new version of all marts below ``root`` and make it the current one; returns their paths.

    The order frame is written once and every mart from the written copy: the scan-heavy joins run a single time, and a lost executor costs at
    most the mart being written. The customer segments are stored too. A version is a folder of its own, and the pointer file that names the current
    one is switched at the very end, so readers (:func:`open_marts`) see the old marts, complete, until all new ones are. A run that
    fails leaves them as they are, and the next run needs no clean-up. Old versions stay for those that still read them (:func:`drop_versions`).

    ``reconciliation`` holds the equalities between what was written and the tables. Their sides are observed while the marts are written, without
    another scan. If one fails or a layer is empty, they are computed again from the written order frame: a task that ran twice may have been
    counted twice.
    """
    version = f"{VERSION}{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    paths, seen = {}, Sides()

    def write(name: str, frame: DataFrame) -> DataFrame:
        paths[name] = f"{root}/{version}/{name}"
        frame.write.parquet(paths[name])
        return spark.read.parquet(paths[name])

    facts = write(ORDER_ANALYTICS, seen.watch(ORDER_ANALYTICS, order_analytics(tables)))
    for name, build in {**MART_VIEWS, **EXTRA_MARTS}.items():
        frame = _category_mart(tables, seen) if name == CATEGORY_MART else build(facts, tables, params)
        write(name, seen.watch(name, frame))
    for name, (source, build) in DERIVED_VIEWS.items():
        write(name, build(spark.read.parquet(paths[source])))
    checks = seen.checks(spark)
    if checks is None or not all(r["passed"] for r in checks.collect()):
        checks = reconcile_tables(tables, facts, params.snapshot)
    write(RECONCILIATION, checks)
    _point(spark, root, version)
    return paths


def _category_mart(tables: Tables, seen: Sides) -> DataFrame:
    """The category view from items joined with all orders, which shows the sold items to the reconciliation on the way."""
    items = tables.order_items.select("order_id", "product_id", "price").join(tables.orders.select("order_id", "order_status"), "order_id")
    watched = seen.watch(RAW_ITEMS, items)
    return categories.performance_of_items(delivered(watched), tables.products, tables.product_category_name_translation)


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the folder of the current version; none before the first run has ended."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root, POINTER)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()["value"].strip()


def open_marts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The marts of the current version by name, all of one run."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"No marts have been written to {root}.")
    names = [ORDER_ANALYTICS, *MART_VIEWS, *EXTRA_MARTS, *DERIVED_VIEWS, RECONCILIATION]
    return {name: spark.read.parquet(f"{root}/{version}/{name}") for name in names}


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all versions but the current one and the newest ``keep - 1`` older ones, those of failed runs included; returns what was deleted."""
    hadoop, current = spark._jvm.org.apache.hadoop.fs, current_version(spark, root)
    files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(hadoop.Path(root)) if s.getPath().getName().startswith(VERSION)]
    # Versions newer than the current one failed, or are still being written.
    older = sorted(v for v in found if current and v < current)
    gone = older[: max(0, len(older) - (keep - 1))]
    for version in gone:
        files.delete(hadoop.Path(root, version), True)
    return gone


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Switch the pointer: written beside it and renamed over it, which file systems do in one step."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    made, final = hadoop.Path(root, f"_{version}"), hadoop.Path(root, POINTER)
    out = made.getFileSystem(conf).create(made, True)
    out.write(version.encode())
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(final.toUri(), conf).rename(made, final, overwrite)
