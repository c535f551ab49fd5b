"""The mapping of ``contract.mapping`` and the order model as SQL common table expressions."""

from __future__ import annotations


def ratio(num: str, den: str, places: int = 2) -> str:
    """``num / den`` rounded half away from zero by whole-number arithmetic (inputs have two decimals at most)."""
    n = f"CAST(({num}) * 100 AS HUGEINT)"
    d = f"NULLIF(CAST(({den}) * 100 AS HUGEINT), 0)"
    digits = f"(CASE WHEN {n} < 0 THEN -1 ELSE 1 END) * ((2 * abs({n}) * {10**places} + {d}) // (2 * {d}))"
    unit = f"{10**-places:.{places}f}"
    scaled = f"CAST({digits} AS DECIMAL(26,0)) * CAST('{unit}' AS DECIMAL({places + 1},{places}))"
    return f"CAST({scaled} AS DECIMAL(38,{places}))"


def rate(num: str, den: str) -> str:
    return f"CAST({ratio(num, den)} AS DECIMAL(10,2))"


def pct(part: str, whole: str) -> str:
    return rate(f"({part}) * 100", whole)


TABLES = """
t_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_unique_id, n_name AS customer_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
), t_sellers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS seller_id FROM supplier
), t_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS product_category_name
  FROM part
), t_translation AS (
  SELECT DISTINCT p_brand AS product_category_name,
         replace(p_brand, 'Brand#', 'category_') AS product_category_name_english
  FROM part WHERE p_brand NOT IN ('Brand#24', 'Brand#25')
), t_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'canceled' END
           AS order_status,
         CAST(o_orderdate AS TIMESTAMP) AS order_purchase_timestamp,
         CAST(o_orderdate + to_hours(o_orderkey % 48) AS TIMESTAMP) AS order_approved_at,
         CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(o_orderdate + INTERVAL 2 DAY AS TIMESTAMP) END
           AS order_delivered_carrier_date,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 211 <> 0
              THEN CAST(o_orderdate + to_hours((5 + o_orderkey * 37 % 53) * 24 + o_orderkey % 24) AS TIMESTAMP)
         END AS order_delivered_customer_date,
         CAST(o_orderdate + INTERVAL 36 DAY AS TIMESTAMP) AS order_estimated_delivery_date
  FROM orders
), t_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2))
           AS freight_value
  FROM lineitem
), t_payments AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, seq AS payment_sequential,
         CAST(1 + o_orderkey % 10 AS INTEGER) AS payment_installments,
         CASE WHEN seq = 1 THEN CAST(o_totalprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END
           AS payment_value
  FROM (SELECT *, unnest(range(1, 2 + o_orderkey % 3)) AS seq FROM orders)
), t_reviews AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS review_id,
         CAST(l_orderkey AS VARCHAR) AS order_id,
         1 + CAST(trunc(l_quantity) AS INTEGER) % 5 AS review_score
  FROM lineitem WHERE l_returnflag = 'R'
)"""

MODEL = f"""
clean AS (
  SELECT o.*, c.customer_unique_id,
         CAST(date_trunc('month', order_purchase_timestamp) AS TIMESTAMP) AS purchase_month,
         CAST(order_purchase_timestamp AS DATE) AS purchase_date,
         CAST(date_diff('day', CAST(order_estimated_delivery_date AS DATE),
                        CAST(order_delivered_customer_date AS DATE)) AS INTEGER) AS delivery_delay_days
  FROM t_orders o LEFT JOIN t_customers c ON c.customer_id = o.customer_id
), item_sums AS (
  SELECT order_id, CAST(SUM(price) AS DECIMAL(38,2)) AS product_revenue,
         CAST(SUM(freight_value) AS DECIMAL(38,2)) AS freight_revenue,
         CAST(SUM(price + freight_value) AS DECIMAL(38,2)) AS total_order_value, COUNT(*) AS item_count
  FROM t_items GROUP BY order_id
), payment_sums AS (
  SELECT order_id, CAST(SUM(payment_value) AS DECIMAL(38,2)) AS total_payment_value,
         COUNT(*) AS payment_row_count, MAX(payment_installments) AS max_installments
  FROM t_payments GROUP BY order_id
), review_sums AS (
  SELECT order_id, {rate("SUM(review_score)", "COUNT(review_score)")} AS average_review_score,
         COUNT(*) AS review_count
  FROM t_reviews GROUP BY order_id
), facts AS (
  SELECT clean.*, i.* EXCLUDE (order_id), p.* EXCLUDE (order_id), r.* EXCLUDE (order_id)
  FROM clean
  LEFT JOIN item_sums i ON i.order_id = clean.order_id
  LEFT JOIN payment_sums p ON p.order_id = clean.order_id
  LEFT JOIN review_sums r ON r.order_id = clean.order_id
), done AS (SELECT * FROM facts WHERE order_status = 'delivered'
), known AS (SELECT * FROM done WHERE customer_unique_id IS NOT NULL
), sales AS (SELECT * FROM facts WHERE order_status NOT IN ('canceled', 'unavailable'))"""

BASE = TABLES + "," + MODEL
