"""SQL counterparts of the registered queries, written against the driver's tables.

Predicates are phrased on their own, not taken from the plans (a limit as ``< 4`` for ``<= 3``): a second formulation that shows
off-by-one errors.
"""

from __future__ import annotations

from contract.oracle_mapping import BASE, pct, rate, ratio

MONEY = "DECIMAL(38,2)"


def _money(expr: str) -> str:
    return f"CAST({expr} AS {MONEY})"


def _whole(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def _violations() -> dict[str, str]:
    not_null = [
        ("customers", "t_customers", ["customer_id", "customer_unique_id"]),
        ("sellers", "t_sellers", ["seller_id"]),
        ("products", "t_products", ["product_id"]),
        ("product_category_name_translation", "t_translation", ["product_category_name"]),
        ("orders", "t_orders", ["order_id", "customer_id"]),
        ("order_items", "t_items", ["order_id", "order_item_id", "product_id", "seller_id"]),
        ("order_payments", "t_payments", ["order_id", "payment_sequential"]),
        ("order_reviews", "t_reviews", ["order_id"]),
    ]
    keys = [
        ("customers", "t_customers", "customer_id"),
        ("sellers", "t_sellers", "seller_id"),
        ("products", "t_products", "product_id"),
        ("product_category_name_translation", "t_translation", "product_category_name"),
        ("orders", "t_orders", "order_id"),
        ("order_items", "t_items", "order_id, order_item_id"),
        ("order_payments", "t_payments", "order_id, payment_sequential"),
    ]
    references = [
        ("orders", "t_orders", "customer_id", "customers", "t_customers", "customer_id"),
        ("order_items", "t_items", "order_id", "orders", "t_orders", "order_id"),
        ("order_items", "t_items", "product_id", "products", "t_products", "product_id"),
        ("order_items", "t_items", "seller_id", "sellers", "t_sellers", "seller_id"),
        ("order_payments", "t_payments", "order_id", "orders", "t_orders", "order_id"),
        ("order_reviews", "t_reviews", "order_id", "orders", "t_orders", "order_id"),
    ]
    return {
        "check_not_null": " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, COUNT(*) AS null_rows FROM {t} WHERE {c} IS NULL"
            for name, t, columns in not_null
            for c in columns
        ),
        "check_primary_keys": " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, '{key}' AS key_columns,"
            f" COUNT(*) FILTER (WHERE n > 1 AND NOT gap) AS duplicate_groups,"
            f" {_whole('COALESCE(SUM(n - 1) FILTER (WHERE NOT gap), 0)')} AS extra_rows,"
            f" {_whole('COALESCE(SUM(n) FILTER (WHERE gap), 0)')} AS null_key_rows"
            f" FROM (SELECT COUNT(*) AS n, {' OR '.join(f'{c} IS NULL' for c in key.split(', '))} AS gap"
            f" FROM {t} GROUP BY {key})"
            for name, t, key in keys
        ),
        "check_foreign_keys": " UNION ALL ".join(
            f"SELECT '{name}' AS child_table, '{c}' AS child_column, '{parent}' AS parent_table,"
            f" COUNT(*) AS orphan_rows FROM {t} ch WHERE ch.{c} IS NOT NULL"
            f" AND NOT EXISTS (SELECT 1 FROM {pt} pa WHERE pa.{pc} = ch.{c})"
            for name, t, c, parent, pt, pc in references
        ),
        "check_review_score_range": "SELECT COUNT(*) AS violating_rows FROM t_reviews"
        " WHERE review_score < 1 OR review_score > 5",
    }


def _quality() -> dict[str, str]:
    counted = {
        "customers": "t_customers",
        "sellers": "t_sellers",
        "products": "t_products",
        "product_category_name_translation": "t_translation",
        "orders": "t_orders",
        "order_items": "t_items",
        "order_payments": "t_payments",
        "order_reviews": "t_reviews",
        "geolocation": "nation",
    }
    multi = "SELECT order_id, COUNT(*) AS review_count FROM t_reviews GROUP BY order_id HAVING COUNT(*) > 1"
    return {
        "load_row_counts": " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {t}" for name, t in counted.items()
        ),
        "dq_customer_ids": """SELECT COUNT(*) AS total_rows, COUNT(DISTINCT customer_id) AS unique_customer_ids,
            COUNT(DISTINCT customer_unique_id) AS unique_customers FROM t_customers""",
        "dq_order_ids": "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT order_id) AS unique_order_ids FROM t_orders",
        "dq_status_distribution": f"""SELECT order_status, COUNT(*) AS orders,
            {pct("COUNT(*)", "SUM(COUNT(*)) OVER ()")} AS pct FROM t_orders GROUP BY order_status""",
        "dq_order_date_range": """SELECT MIN(order_purchase_timestamp) AS first_order,
            MAX(order_purchase_timestamp) AS last_order FROM t_orders""",
        "dq_order_date_completeness": """SELECT COUNT(*) AS total_orders,
            COUNT(order_purchase_timestamp) AS purchase_dates, COUNT(order_approved_at) AS approved_dates,
            COUNT(order_delivered_carrier_date) AS carrier_dates,
            COUNT(order_delivered_customer_date) AS delivered_dates,
            COUNT(order_estimated_delivery_date) AS estimated_dates FROM t_orders""",
        "dq_orders_without_customer": """SELECT COUNT(*) AS orders_without_customer FROM t_orders o
            WHERE NOT EXISTS (SELECT 1 FROM t_customers c WHERE c.customer_id = o.customer_id)""",
        "dq_payment_structure": """SELECT COUNT(*) AS payment_rows, COUNT(DISTINCT order_id) AS orders_with_payments
            FROM t_payments""",
        "dq_payments_per_order": """SELECT n AS payment_count, COUNT(*) AS number_of_orders
            FROM (SELECT COUNT(*) AS n FROM t_payments GROUP BY order_id) GROUP BY n""",
        "dq_review_structure": """SELECT COUNT(*) AS total_review_rows, COUNT(DISTINCT review_id) AS unique_review_ids,
            COUNT(DISTINCT order_id) AS orders_with_reviews FROM t_reviews""",
        "dq_review_scores": "SELECT review_score, COUNT(*) AS review_count FROM t_reviews GROUP BY ALL",
        "dq_orders_multi_review_count": f"SELECT COUNT(*) AS orders_with_multiple_reviews FROM ({multi})",
        "dq_orders_multi_review_top": f"{multi} ORDER BY review_count DESC, order_id LIMIT 20",
        "dq_item_structure": """SELECT COUNT(*) AS total_item_rows, COUNT(DISTINCT order_id) AS orders_with_items,
            COUNT(DISTINCT product_id) AS unique_products, COUNT(DISTINCT seller_id) AS unique_sellers FROM t_items""",
        "dq_item_key_uniqueness": """SELECT COUNT(*) AS total_rows,
            (SELECT COUNT(*) FROM (SELECT DISTINCT order_id, order_item_id FROM t_items)) AS unique_order_items
            FROM t_items""",
        "dq_price_freight_stats": f"""SELECT MIN(price) AS min_price, MAX(price) AS max_price,
            {ratio("SUM(price)", "COUNT(price)", 12)} AS avg_price,
            MIN(freight_value) AS min_freight, MAX(freight_value) AS max_freight,
            {ratio("SUM(freight_value)", "COUNT(freight_value)", 12)} AS avg_freight FROM t_items""",
        "dq_negative_price": "SELECT COUNT(*) AS negative_price_rows FROM t_items WHERE price < 0",
        "dq_negative_freight": "SELECT COUNT(*) AS negative_freight_rows FROM t_items WHERE freight_value < 0",
    }


_CLEAN_COLUMNS = """order_id, customer_id, customer_unique_id, order_status, order_purchase_timestamp,
    order_approved_at, order_delivered_carrier_date, order_delivered_customer_date,
    order_estimated_delivery_date, purchase_month, purchase_date, delivery_delay_days"""


def _model() -> dict[str, str]:
    return {
        "orders_clean": f"SELECT {_CLEAN_COLUMNS} FROM clean",
        "order_payments_rollup": "SELECT * FROM payment_sums",
        "order_revenue_rollup": "SELECT * FROM item_sums",
        "order_reviews_rollup": "SELECT * FROM review_sums",
        "order_analytics": f"""SELECT {_CLEAN_COLUMNS}, product_revenue, freight_revenue, total_order_value, item_count,
            total_payment_value, payment_row_count, max_installments, average_review_score, review_count FROM facts""",
    }


_MONTHLY = f"""monthly AS (
  SELECT purchase_month AS month, {_money("SUM(product_revenue)")} AS revenue, COUNT(DISTINCT order_id) AS orders
  FROM sales GROUP BY purchase_month)"""
_AOV = ratio("revenue", "orders")


def _calendar(first: str, last: str) -> str:
    return f"""{_MONTHLY}, axis AS (
      SELECT CAST(unnest(generate_series({first}, {last}, INTERVAL 1 MONTH)) AS TIMESTAMP) AS month
    ), filled AS (
      SELECT axis.month, COALESCE(revenue, {_money("0")}) AS revenue, COALESCE(orders, 0) AS orders
      FROM axis LEFT JOIN monthly ON monthly.month = axis.month)"""


def _category_sums(orders: str, missing: str) -> str:
    return f"""category_sums AS (
      SELECT COALESCE(product_category_name_english, p.product_category_name, '{missing}') AS category,
             {_money("SUM(price)")} AS revenue, COUNT(DISTINCT i.order_id) AS orders, COUNT(*) AS items_sold
      FROM t_items i JOIN {orders} o ON o.order_id = i.order_id
      JOIN t_products p ON p.product_id = i.product_id
      LEFT JOIN t_translation tr ON tr.product_category_name = p.product_category_name
      GROUP BY 1)"""


def _revenue() -> dict[str, str]:
    sold_categories = _category_sums("sales", "Unknown")
    done_categories = _category_sums("done", "Uncategorized")
    growth = ratio("(revenue - previous_month_revenue) * 100", "previous_month_revenue")
    fixed_bounds = _calendar("TIMESTAMP '1994-11-01'", "TIMESTAMP '2001-10-01'")
    own_bounds = _calendar("(SELECT MIN(month) FROM monthly)", "(SELECT MAX(month) FROM monthly)")
    return {
        "monthly_revenue": f"WITH {_MONTHLY} SELECT month, revenue FROM monthly",
        "monthly_revenue_orders": f"WITH {_MONTHLY} SELECT * FROM monthly",
        "monthly_revenue_aov": f"WITH {_MONTHLY} SELECT *, {_AOV} AS aov FROM monthly",
        "mom_growth_observed": f"""WITH {_MONTHLY}, lagged AS (
            SELECT *, LAG(revenue) OVER (ORDER BY month) AS previous_month_revenue FROM monthly)
            SELECT *, {_AOV} AS aov, {growth} AS revenue_growth_pct FROM lagged""",
        "monthly_sales_calendar": f"WITH {own_bounds} SELECT *, {_AOV} AS aov FROM filled",
        "mom_growth_calendar": f"""WITH {fixed_bounds}, lagged AS (
            SELECT *, LAG(revenue) OVER w AS previous_month_revenue, LAG(orders) OVER w AS previous_month_orders
            FROM filled WINDOW w AS (ORDER BY month))
            SELECT *, {_AOV} AS aov, CASE WHEN month >= TIMESTAMP '1995-06-01' AND previous_month_revenue > 0
                THEN {growth} END AS revenue_growth_pct FROM lagged""",
        "category_revenue": f"WITH {sold_categories} SELECT * FROM category_sums",
        "category_revenue_share": f"""WITH {sold_categories} SELECT category, revenue,
            {pct("revenue", "SUM(revenue) OVER ()")} AS revenue_share_pct FROM category_sums""",
        "category_top10": f"""WITH {sold_categories} SELECT * FROM (
            SELECT RANK() OVER (ORDER BY revenue DESC) AS revenue_rank, category, revenue FROM category_sums)
            WHERE revenue_rank <= 10""",
        "revenue_check_view": f"SELECT {_money('SUM(product_revenue)')} AS order_view_revenue FROM sales",
        "revenue_check_raw": f"""SELECT {_money("SUM(price)")} AS raw_item_revenue FROM t_items i
            JOIN t_orders o ON o.order_id = i.order_id WHERE order_status NOT IN ('canceled', 'unavailable')""",
        "category_share_check": f"""WITH {sold_categories} SELECT {_money(pct("SUM(revenue)", "SUM(revenue)"))} AS total_revenue_share_pct
            FROM category_sums""",
        "sales_month_range": "SELECT MIN(purchase_month) AS first_month, MAX(purchase_month) AS last_month FROM facts",
        "product_category_performance": f"""WITH {done_categories} SELECT category AS product_category,
            revenue AS product_revenue, orders, items_sold AS items FROM category_sums""",
        "category_reconciliation": f"""WITH {done_categories}
            SELECT {_money("SUM(revenue)")} AS categorized_and_uncategorized_revenue FROM category_sums""",
    }


_PEOPLE = f"""people AS (
  SELECT customer_unique_id, MAX(purchase_date) AS last_purchase_date, COUNT(DISTINCT order_id) AS frequency,
         {_money("SUM(product_revenue)")} AS monetary
  FROM known GROUP BY customer_unique_id
), aged AS (
  SELECT *, (SELECT MAX(purchase_date) FROM known) AS snapshot_date,
         CAST((SELECT MAX(purchase_date) FROM known) - last_purchase_date AS INTEGER) AS recency
  FROM people)"""
_SCORED = f"""{_PEOPLE}, scored AS (
  SELECT *, CAST(NTILE(5) OVER (ORDER BY recency DESC NULLS FIRST, customer_unique_id) AS INTEGER) AS recency_score,
         CAST(NTILE(5) OVER (ORDER BY monetary ASC NULLS LAST, customer_unique_id) AS INTEGER) AS monetary_score
  FROM aged)"""
_SEGMENTED = f"""{_SCORED}, segmented AS (
  SELECT *, CASE WHEN recency_score = 3 THEN 'Middle Value'
                 WHEN recency_score > 3 AND monetary_score > 3 THEN 'Recent High Value'
                 WHEN recency_score > 3 THEN 'Recent Low/Medium Value'
                 WHEN monetary_score > 3 THEN 'High Value At Risk'
                 ELSE 'Inactive / Low Value' END AS customer_segment,
         CASE WHEN frequency > 1 THEN 'Repeat Customer' ELSE 'One-Time Customer' END AS purchase_type
  FROM scored)"""
_CUSTOMER_RFM = f"""customer_view AS (
  SELECT customer_unique_id, COUNT(*) AS frequency, {_money("SUM(product_revenue)")} AS monetary_value,
         {_money("SUM(total_order_value)")} AS total_order_value, MAX(purchase_date) AS last_purchase_date,
         CAST((SELECT MAX(purchase_date) FROM known) - MAX(purchase_date) AS INTEGER) AS recency_days,
         CASE WHEN COUNT(*) > 1 THEN 'Repeat Customer' ELSE 'One-Time Customer' END AS customer_type
  FROM done GROUP BY customer_unique_id)"""
_BY_COUNT = """COUNT(*) FILTER (WHERE frequency >= 2) AS repeat_customers,
    COUNT(*) FILTER (WHERE frequency = 1) AS one_time_customers"""
_VALUE = f"""COUNT(*) FILTER (WHERE frequency >= 2) AS repeat_customers, {_money("SUM(monetary)")} AS total_monetary,
    {ratio("SUM(monetary)", "COUNT(monetary)")} AS avg_customer_value"""


def _rfm() -> dict[str, str]:
    metrics = "customer_unique_id, snapshot_date, last_purchase_date, recency, frequency, monetary"
    return {
        "rfm_snapshot_date": "SELECT MAX(purchase_date) AS snapshot_date FROM known",
        "rfm_frequency_distribution": f"""WITH {_PEOPLE} SELECT frequency, COUNT(*) AS customer_count,
            {pct("COUNT(*)", "SUM(COUNT(*)) OVER ()")} AS customer_share_pct FROM people GROUP BY frequency""",
        "rfm_metrics": f"WITH {_PEOPLE} SELECT {metrics} FROM aged",
        "rfm_scores": f"""WITH {_SCORED} SELECT {metrics}, recency_score, monetary_score,
            CAST(recency_score * 10 + monetary_score AS VARCHAR) AS rm_score FROM scored""",
        "repeat_purchase_rate": f"""WITH {_PEOPLE} SELECT COUNT(*) AS total_customers, {_BY_COUNT},
            {pct("COUNT(*) FILTER (WHERE frequency >= 2)", "COUNT(*)")} AS repeat_purchase_rate_pct,
            {pct("COUNT(*) FILTER (WHERE frequency = 1)", "COUNT(*)")} AS one_time_customer_rate_pct FROM people""",
        "rfm_segments": f"""WITH {_SEGMENTED} SELECT {metrics}, recency_score, monetary_score, customer_segment,
            purchase_type FROM segmented""",
        "rfm_segment_summary": f"""WITH {_SEGMENTED} SELECT customer_segment, COUNT(*) AS customers,
            {pct("COUNT(*)", "SUM(COUNT(*)) OVER ()")} AS customer_share_pct, {_VALUE}
            FROM segmented GROUP BY customer_segment""",
        "rfm_segment_by_type": f"""WITH {_SEGMENTED} SELECT customer_segment, purchase_type, COUNT(*) AS customers,
            {pct("COUNT(*)", "SUM(COUNT(*)) OVER (PARTITION BY customer_segment)")} AS segment_purchase_type_pct
            FROM segmented GROUP BY customer_segment, purchase_type""",
        "rfm_high_value_at_risk": f"""WITH {_SCORED} SELECT COUNT(*) AS high_value_at_risk_customers, {_VALUE},
            {pct("COUNT(*)", "COUNT(*)")} AS segment_share_pct,
            {pct("COUNT(*)", "(SELECT COUNT(*) FROM scored)")} AS share_of_all_customers_pct
            FROM scored WHERE recency_score < 3 AND monetary_score > 3""",
        "rfm_recent_high_value": f"""WITH {_SCORED} SELECT COUNT(*) AS recent_high_value_customers, {_VALUE}
            FROM scored WHERE recency_score > 3 AND monetary_score > 3""",
        "rfm_top_customers": f"""WITH {_PEOPLE} SELECT * FROM people
            ORDER BY monetary DESC NULLS FIRST, customer_unique_id LIMIT 20""",
        "rfm_validation": f"""WITH {_PEOPLE} SELECT COUNT(*) AS total_customers,
            COUNT(DISTINCT customer_unique_id) AS unique_customer_ids, {_BY_COUNT},
            MAX(snapshot_date) AS snapshot_date FROM aged""",
        "customer_rfm": f"WITH {_CUSTOMER_RFM} SELECT * FROM customer_view",
        "rfm_totals_check": f"""WITH {_CUSTOMER_RFM} SELECT COUNT(*) AS customers,
            COUNT(*) FILTER (WHERE customer_type = 'Repeat Customer') AS repeat_customers,
            COUNT(*) FILTER (WHERE customer_type = 'One-Time Customer') AS one_time_customers FROM customer_view""",
    }


def _month_number(later: str, earlier: str) -> str:
    return f"CAST((year({later}) - year({earlier})) * 12 + month({later}) - month({earlier}) AS INTEGER)"


_COHORTS = f"""firsts AS (
  SELECT customer_unique_id, MIN(purchase_date) AS first_purchase_date,
         CAST(date_trunc('month', MIN(purchase_date)) AS TIMESTAMP) AS cohort_month
  FROM known GROUP BY customer_unique_id
), sizes AS (SELECT cohort_month, COUNT(*) AS cohort_customers FROM firsts GROUP BY cohort_month
), activity AS (
  SELECT cohort_month, purchase_month, {_month_number("purchase_month", "cohort_month")} AS month_number,
         COUNT(DISTINCT known.customer_unique_id) AS active_customers
  FROM known JOIN firsts ON firsts.customer_unique_id = known.customer_unique_id
  GROUP BY cohort_month, purchase_month)"""
_RETENTION = f"""{_COHORTS}, grid AS (
  SELECT cohort_month, cohort_customers, CAST(unnest(range(0,
      1 + {_month_number("(SELECT MAX(purchase_date) FROM known)", "cohort_month")})) AS INTEGER) AS month_number
  FROM sizes
), retention AS (
  SELECT grid.cohort_month, grid.month_number, COALESCE(active_customers, 0) AS active_customers, cohort_customers,
         {pct("COALESCE(active_customers, 0)", "cohort_customers")} AS retention_pct
  FROM grid LEFT JOIN activity
    ON activity.cohort_month = grid.cohort_month AND activity.month_number = grid.month_number)"""


def _cohorts() -> dict[str, str]:
    everything = f"WITH {_RETENTION} SELECT * FROM retention"
    best = ", ".join(
        f"CAST(MAX(retention_pct) FILTER (WHERE month_number = {n}) AS DECIMAL(10,2)) AS month_{n}_retention_pct"
        for n in (1, 2, 3)
    )
    return {
        "first_purchase": f"WITH {_COHORTS} SELECT * FROM firsts",
        "cohort_sizes": f"WITH {_COHORTS} SELECT * FROM sizes",
        "cohort_size_check": f"""WITH {_COHORTS} SELECT {_whole("SUM(cohort_customers)")} AS total_cohort_customers,
            COUNT(*) AS number_of_cohorts FROM sizes""",
        "cohort_activity_calendar": f"""WITH {_COHORTS} SELECT cohort_month, purchase_month, active_customers
            FROM activity""",
        "cohort_activity_relative": f"WITH {_COHORTS} SELECT * FROM activity",
        "cohort_retention_observed": f"""WITH {_COHORTS} SELECT activity.*, cohort_customers,
            {pct("active_customers", "cohort_customers")} AS retention_pct
            FROM activity JOIN sizes ON sizes.cohort_month = activity.cohort_month""",
        "cohort_retention_matrix": everything,
        "cohort_retention": everything,
        "cohort_view_listing": everything,
        "cohort_retention_bi": everything,
        "cohort_month0_check": f"""WITH {_RETENTION} SELECT COUNT(*) AS cohorts,
            COUNT(*) FILTER (WHERE retention_pct = 100) AS full_retention_month_0 FROM retention WHERE month_number = 0""",
        "retention_curve": f"""WITH {_RETENTION} SELECT month_number,
            {_whole("SUM(active_customers)")} AS active_customers,
            {_whole("SUM(cohort_customers)")} AS eligible_cohort_customers,
            {pct("SUM(active_customers)", "SUM(cohort_customers)")} AS retention_pct
            FROM retention GROUP BY month_number""",
        "cohort_maturity": f"""WITH {_RETENTION} SELECT cohort_month, MAX(month_number) AS available_months,
            MAX(cohort_customers) AS cohort_customers FROM retention GROUP BY cohort_month""",
        "retention_summary": f"""WITH {_RETENTION} SELECT COUNT(DISTINCT cohort_month) AS total_cohorts,
            {_whole("SUM(cohort_customers) FILTER (WHERE month_number = 0)")} AS total_customers, {best} FROM retention""",
        "cohort_bounds_check": f"""WITH {_RETENTION} SELECT COUNT(DISTINCT cohort_month) AS number_of_cohorts,
            MIN(month_number) AS minimum_month_number, MAX(month_number) AS maximum_month_number FROM retention""",
    }


_LATE = "delivery_delay_days > 0"
_STATUS = f"CASE WHEN {_LATE} THEN 'Late' ELSE 'On Time / Early' END"
_BUCKET = """CASE WHEN delivery_delay_days < 1 THEN 'On Time / Early' WHEN delivery_delay_days < 4 THEN '1-3 Days Late'
    WHEN delivery_delay_days < 8 THEN '4-7 Days Late' WHEN delivery_delay_days < 15 THEN '8-14 Days Late'
    ELSE '15+ Days Late' END"""
_DELAYED = "delayed AS (SELECT * FROM done WHERE delivery_delay_days IS NOT NULL)"
_REVIEWED = f"{_DELAYED}, reviewed AS (SELECT * FROM delayed WHERE average_review_score IS NOT NULL)"
_AVG_DELAY = f"{rate('SUM(delivery_delay_days)', 'COUNT(*)')} AS average_delay_days"
_MEDIAN = "CAST(quantile_cont(delivery_delay_days, 0.5) AS DECIMAL(10,2)) AS median_delay_days"


def _avg_score(name: str = "average_review_score", where: str = "TRUE") -> str:
    score = "average_review_score"
    return f"{rate(f'SUM({score}) FILTER (WHERE {where})', f'COUNT({score}) FILTER (WHERE {where})')} AS {name}"


_RATES = f"""COUNT(*) FILTER (WHERE {_LATE}) AS late_orders,
    {pct(f"COUNT(*) FILTER (WHERE {_LATE})", "COUNT(*)")} AS late_delivery_rate_pct, {_avg_score()},
    {_avg_score("late_order_review_score", _LATE)}, {_avg_score("on_time_review_score", f"NOT ({_LATE})")}"""
_PAIRS = """pairs AS (
  SELECT DISTINCT order_id, product_category_name FROM t_items JOIN t_products USING (product_id)
  WHERE product_category_name IS NOT NULL)"""
_STATE = f"""WITH {_DELAYED} SELECT customer_state, COUNT(*) AS delivered_orders, {_RATES}
    FROM delayed JOIN t_customers c ON c.customer_id = delayed.customer_id
    GROUP BY customer_state HAVING COUNT(*) >= 100"""
_CATEGORY = f"""WITH {_DELAYED}, {_PAIRS}
    SELECT COALESCE(product_category_name_english, pairs.product_category_name) AS product_category,
           COUNT(*) AS category_orders, {_RATES}
    FROM pairs JOIN delayed ON delayed.order_id = pairs.order_id
    LEFT JOIN t_translation tr ON tr.product_category_name = pairs.product_category_name
    GROUP BY 1 HAVING COUNT(*) >= 100"""


def _delivery() -> dict[str, str]:
    satisfaction = f"""WITH {_DELAYED} SELECT {_STATUS} AS delivery_status, COUNT(*) AS orders, {_avg_score()},
        {_AVG_DELAY}, {_MEDIAN} FROM delayed GROUP BY 1"""
    buckets = f"""WITH {_DELAYED} SELECT {_BUCKET} AS delay_bucket, COUNT(*) AS orders, {_avg_score()}, {_AVG_DELAY}
        FROM delayed GROUP BY 1"""
    views = {
        "vw_delivery_satisfaction": satisfaction,
        "vw_delivery_delay_buckets": buckets,
        "vw_delivery_state": _STATE,
        "vw_delivery_category": _CATEGORY,
    }
    return {
        "delivery_coverage": """SELECT COUNT(*) AS total_delivered_orders,
            COUNT(order_delivered_customer_date) AS orders_with_actual_delivery_date,
            COUNT(order_estimated_delivery_date) AS orders_with_estimated_delivery_date,
            COUNT(delivery_delay_days) AS orders_with_delivery_delay,
            COUNT(average_review_score) AS orders_with_review,
            COUNT(CASE WHEN average_review_score IS NOT NULL THEN delivery_delay_days END)
              AS orders_with_delivery_and_review FROM done""",
        "delivery_date_checks": """SELECT COUNT(*) AS delivered_orders,
            COUNT(*) FILTER (WHERE order_delivered_customer_date < order_purchase_timestamp) AS delivered_before_purchase,
            COUNT(*) FILTER (WHERE order_delivered_customer_date < order_approved_at) AS delivered_before_approval,
            COUNT(*) FILTER (WHERE order_delivered_customer_date > order_estimated_delivery_date) AS late_orders,
            COUNT(*) FILTER (WHERE order_delivered_customer_date <= order_estimated_delivery_date)
              AS on_time_or_early_orders
            FROM done WHERE order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL""",
        "delay_distribution": f"""WITH {_DELAYED} SELECT COUNT(*) AS orders,
            MIN(delivery_delay_days) AS minimum_delay_days, MAX(delivery_delay_days) AS maximum_delay_days,
            {_AVG_DELAY}, {_MEDIAN} FROM delayed""",
        "late_rate": f"""WITH {_DELAYED} SELECT {_STATUS} AS delivery_status, COUNT(*) AS orders,
            {pct("COUNT(*)", "SUM(COUNT(*)) OVER ()")} AS order_share_pct FROM delayed GROUP BY 1""",
        "status_vs_review": f"""WITH {_REVIEWED} SELECT {_STATUS} AS delivery_status, COUNT(*) AS orders_with_review,
            {_avg_score()}, {_AVG_DELAY}, {_MEDIAN} FROM reviewed GROUP BY 1""",
        "delay_bucket_vs_review": f"""WITH {_REVIEWED} SELECT {_BUCKET} AS delay_bucket,
            COUNT(*) AS orders_with_review, {_avg_score()}, {_AVG_DELAY}, {_MEDIAN} FROM reviewed GROUP BY 1""",
        "review_score_distribution": f"""WITH {_REVIEWED}, cells AS (
            SELECT {_STATUS} AS delivery_status, average_review_score AS review_score, COUNT(*) AS orders
            FROM reviewed GROUP BY 1, 2)
            SELECT *, {pct("orders", "SUM(orders) OVER (PARTITION BY delivery_status)")} AS score_share_pct
            FROM cells""",
        "delivery_by_state": _STATE,
        "delivery_state": _STATE,
        "delivery_state_listing": _STATE,
        "category_coverage": """SELECT COUNT(*) AS total_products,
            COUNT(product_category_name) AS products_with_category,
            COUNT(DISTINCT product_category_name) AS categories FROM t_products""",
        "translation_coverage": """SELECT COUNT(*) AS translated_categories,
            COUNT(DISTINCT product_category_name) AS original_category_names,
            COUNT(DISTINCT product_category_name_english) AS english_category_names FROM t_translation""",
        "order_category_check": f"""WITH {_PAIRS} SELECT COUNT(*) AS order_category_rows,
            COUNT(DISTINCT order_id) AS distinct_orders,
            COUNT(DISTINCT product_category_name) AS distinct_categories FROM pairs""",
        "delivery_by_category": _CATEGORY,
        "delivery_category": _CATEGORY,
        "delivery_category_listing": _CATEGORY,
        "delivery_satisfaction": satisfaction,
        "delivery_satisfaction_listing": satisfaction,
        "delivery_delay_buckets": buckets,
        "delay_buckets_listing": buckets,
        "delivery_view_row_counts": " UNION ALL ".join(
            f"SELECT '{name}' AS view_name, COUNT(*) AS rows FROM ({sql})" for name, sql in views.items()
        ),
    }


_KPIS = f"""kpis AS (
  SELECT COUNT(*) AS delivered_orders,
         (SELECT COUNT(*) FROM (SELECT customer_unique_id FROM done GROUP BY 1)) AS delivered_customers,
         {_money("SUM(product_revenue)")} AS product_revenue, {_money("SUM(total_order_value)")} AS total_order_value,
         {ratio("SUM(total_order_value)", "COUNT(total_order_value)")} AS average_order_value,
         (SELECT COUNT(*) FROM (SELECT customer_unique_id FROM done GROUP BY 1 HAVING COUNT(*) > 1))
           AS repeat_customers,
         {pct(f"COUNT(*) FILTER (WHERE {_LATE})", "COUNT(delivery_delay_days)")} AS late_delivery_rate_pct, {_avg_score()}
  FROM done)"""
_MONTHS = f"""months AS (
  SELECT purchase_month, COUNT(*) AS orders, COUNT(DISTINCT customer_unique_id) AS customers,
         {_money("SUM(product_revenue)")} AS product_revenue, {_money("SUM(total_order_value)")} AS total_order_value,
         {ratio("SUM(total_order_value)", "COUNT(total_order_value)")} AS average_order_value, {_avg_score()},
         COUNT(*) FILTER (WHERE {_LATE}) AS late_orders, COUNT(delivery_delay_days) AS orders_with_delivery_data,
         {pct(f"COUNT(*) FILTER (WHERE {_LATE})", "COUNT(delivery_delay_days)")} AS late_delivery_rate_pct
  FROM done GROUP BY purchase_month)"""


def _executive() -> dict[str, str]:
    kpis = f"""WITH {_KPIS} SELECT *,
        {pct("repeat_customers", "delivered_customers")} AS repeat_purchase_rate_pct FROM kpis"""
    pairs = {
        "monthly_orders": ("delivered_orders FROM kpis", "SUM(orders) FROM months"),
        "monthly_product_revenue": ("product_revenue FROM kpis", "SUM(product_revenue) FROM months"),
        "monthly_total_order_value": ("total_order_value FROM kpis", "SUM(total_order_value) FROM months"),
        "rfm_customers": ("delivered_customers FROM kpis", "COUNT(*) FROM customer_view"),
        "rfm_repeat_customers": (
            "repeat_customers FROM kpis",
            "COUNT(*) FROM customer_view WHERE customer_type = 'Repeat Customer'",
        ),
        "segment_customers": ("delivered_customers FROM kpis", "COUNT(*) FROM segmented"),
        "segment_product_revenue": ("product_revenue FROM kpis", "SUM(monetary) FROM segmented"),
        "category_product_revenue": ("product_revenue FROM kpis", "SUM(revenue) FROM category_sums"),
        "raw_item_revenue": (
            "SUM(product_revenue) FROM sales",
            "SUM(price) FROM t_items WHERE order_id IN (SELECT order_id FROM sales)",
        ),
    }
    layers = ", ".join([_KPIS, _MONTHS, _CUSTOMER_RFM, _SEGMENTED, _category_sums("done", "Uncategorized")])
    sides = " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", {_money(f'(SELECT {left})')} AS left_value,"
        f" {_money(f'(SELECT {right})')} AS right_value"
        for name, (left, right) in pairs.items()
    )
    measures = {
        "customers": "COUNT(*)",
        "avg_product_revenue": ratio("SUM(monetary_value)", "COUNT(monetary_value)"),
        "avg_orders": ratio("SUM(frequency)", "COUNT(*)"),
    }
    by_type = " UNION ALL ".join(
        f"SELECT customer_type || ': {name}' AS metric, {_money(expr)} AS value FROM customer_view"
        " GROUP BY customer_type"
        for name, expr in measures.items()
    )
    tops = " UNION ALL ".join(
        f"SELECT 'top {n} category share pct' AS metric,"
        f" {_money(pct(f'SUM(revenue) FILTER (WHERE place <= {n})', 'SUM(revenue)'))} AS value FROM ranked"
        for n in (5, 10)
    )
    return {
        "executive_kpis": kpis,
        "executive_listing": kpis,
        "monthly_business_performance": f"WITH {_MONTHS} SELECT * FROM months",
        "monthly_totals_check": f"""WITH {_MONTHS} SELECT COUNT(*) AS monthly_rows,
            {_whole("SUM(orders)")} AS total_orders, {_money("SUM(product_revenue)")} AS total_product_revenue,
            {_money("SUM(total_order_value)")} AS total_order_value FROM months""",
        "reconcile": f"""WITH {layers}, sides AS ({sides})
            SELECT *, left_value IS NOT DISTINCT FROM right_value AS passed FROM sides""",
        "dashboard_extras": f"""WITH {_RETENTION}, {_CUSTOMER_RFM}, {_category_sums("done", "Uncategorized")}, ranked AS (
            SELECT *, RANK() OVER (ORDER BY revenue DESC) AS place FROM category_sums)
            {by_type} UNION ALL {tops} UNION ALL SELECT 'mean month 1 retention pct' AS metric,
            {_money(ratio("SUM(retention_pct)", "COUNT(retention_pct)"))} AS value FROM retention WHERE month_number = 1""",
    }


# Queries that read state kept per batch of orders have the result of the view over all orders.
FROM_STATE = {
    "cohort_retention_from_state": "cohort_retention",
    "executive_kpis_from_state": "executive_kpis",
    "monthly_performance_from_state": "monthly_business_performance",
    "customer_rfm_from_state": "customer_rfm",
}


def statements() -> dict[str, str]:
    parts = [_violations(), _quality(), _model(), _revenue(), _rfm(), _cohorts(), _delivery(), _executive()]
    plain = {name: _with_base(sql) for part in parts for name, sql in part.items()}
    return plain | {name: plain[view] for name, view in FROM_STATE.items()}


def _with_base(sql: str) -> str:
    """Put the mapped tables and the order model in front of a statement's own expressions."""
    if sql.startswith("WITH "):
        return f"WITH {BASE}, {sql[5:]}"
    return f"WITH {BASE} {sql}"
