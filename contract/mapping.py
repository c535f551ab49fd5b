"""Map the driver's Parquet files to the nine input tables.

Fixed arithmetic on real columns, row by row and over whole tables. ``contract.oracle_mapping`` states
the same in SQL. Only the registered queries and the tests use it; no operator depends on it.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from mercato.schemas import TABLE_SPECS
from mercato.sources.tables import Tables

# Columns read from each file, with the types the files have; a declared schema saves the inference job.
FILE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_tax double, l_returnflag string,
        l_shipdate timestamp_ntz""",
}


# Column expressions over the files; columns the data does not have are NULL.
ARRIVAL = "o_orderdate + make_dt_interval(0, cast((5 + o_orderkey * 37 % 53) * 24 + o_orderkey % 24 as int))"
PRICE = "cast(l_extendedprice as decimal(12,2))"
EXPRESSIONS = {
    "customers": {
        "customer_id": "c_custkey",
        "customer_unique_id": "c_name",
        "customer_state": "n_name",
    },
    "sellers": {"seller_id": "s_suppkey", "seller_state": "n_name"},
    "products": {
        "product_id": "p_partkey",
        "product_category_name": "if(p_partkey % 50 = 0, null, p_brand)",
    },
    "product_category_name_translation": {
        "product_category_name": "p_brand",
        "product_category_name_english": "replace(p_brand, 'Brand#', 'category_')",
    },
    "orders": {
        "order_id": "o_orderkey",
        "customer_id": "o_custkey",
        "order_status": """case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped'
            when 'P' then 'canceled' end""",
        "order_purchase_timestamp": "o_orderdate",
        "order_approved_at": "o_orderdate + make_dt_interval(0, cast(o_orderkey % 48 as int))",
        "order_delivered_carrier_date": "if(o_orderstatus in ('F', 'O'), o_orderdate + interval 2 days, null)",
        "order_delivered_customer_date": f"if(o_orderstatus = 'F' and o_orderkey % 211 <> 0, {ARRIVAL}, null)",
        "order_estimated_delivery_date": "o_orderdate + interval 36 days",
    },
    "order_items": {
        "order_id": "l_orderkey",
        "order_item_id": "l_linenumber",
        "product_id": "l_partkey",
        "seller_id": "l_suppkey",
        "shipping_limit_date": "l_shipdate",
        "price": PRICE,
        "freight_value": f"{PRICE} * cast(l_tax as decimal(4,2))",
    },
    "order_payments": {
        "order_id": "o_orderkey",
        "payment_sequential": "seq",
        "payment_type": "o_orderpriority",
        "payment_installments": "1 + o_orderkey % 10",
        "payment_value": "if(seq = 1, cast(o_totalprice as decimal(12,2)), 0)",
    },
    "order_reviews": {
        "review_id": "concat_ws('-', l_orderkey, l_linenumber)",
        "order_id": "l_orderkey",
        "review_score": "1 + cast(l_quantity as int) % 5",
    },
    "geolocation": {"geolocation_state": "n_name"},
}


@lru_cache(maxsize=8)
def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The mapped tables of one folder; only their plans are kept, every query scans its files."""

    def read(name: str) -> DataFrame:
        return spark.read.schema(FILE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    def with_nation(name: str, key: str) -> DataFrame:
        nation = read("nation").withColumnRenamed("n_nationkey", key)
        return read(name).join(nation, key, "left")

    rows = {
        "customers": lambda: with_nation("customer", "c_nationkey"),
        "sellers": lambda: with_nation("supplier", "s_nationkey"),
        "products": lambda: read("part"),
        "product_category_name_translation": lambda: read("part")
        .where("p_brand not in ('Brand#24', 'Brand#25')")
        .select("p_brand")
        .distinct(),
        "orders": lambda: read("orders"),
        "order_items": lambda: read("lineitem"),
        "order_payments": lambda: read("orders").selectExpr(
            "*", "explode(sequence(1, cast(1 + o_orderkey % 3 as int))) as seq"
        ),
        "order_reviews": lambda: read("lineitem").where("l_returnflag = 'R'"),
        "geolocation": lambda: read("nation"),
    }
    return Tables(lambda name: _conform(rows[name](), name))


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Declared columns in declared order and type."""
    return df.selectExpr(
        *[
            f"cast({EXPRESSIONS[name].get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}"
            for f in TABLE_SPECS[name].schema
        ]
    )
