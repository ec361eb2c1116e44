"""Expected results of the analyses and marts."""

from __future__ import annotations

from oracle.tables import avg_int, avg_money, day, money, pct, rnd

_STATUS_FILE = """CASE WHEN order_delivered_customer_date <= order_estimated_delivery_date THEN 'On Time'
                       WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 'Late' END"""
_FULL_DAYS = "date_sub('day', order_purchase_timestamp, order_delivered_customer_date)"
_LATE = "count(*) FILTER (order_delivered_customer_date > order_estimated_delivery_date)"
_IN_TIME = """FROM t_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
              AND order_estimated_delivery_date IS NOT NULL"""


def _growth(source: str) -> str:
    change = "(gross - previous)"
    return f"""
        SELECT strftime(month, '%Y-%m') AS sales_month, orders AS total_orders, {money('gross')} AS revenue,
               {rnd('gross', 'orders')} AS average_order_value, {pct(change, 'previous')} AS mom_growth_pct
        FROM (SELECT *, lag(gross) OVER (ORDER BY month) AS previous FROM {source})"""


_KPI = {
    "kpi_overall": f"""
        SELECT count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers,
               count(*) AS total_items_sold, {money('sum(price + freight_value)')} AS total_revenue,
               {rnd('sum(price + freight_value)', 'count(DISTINCT order_id)')} AS average_order_value
        FROM sold""",
    "kpi_monthly_mom": _growth("monthly"),
    "month_calendar": "SELECT strftime(month, '%Y-%m') AS sales_month FROM months",
    "kpi_monthly_filled": f"""
        SELECT strftime(month, '%Y-%m') AS sales_month, orders AS total_orders, {money('gross')} AS revenue
        FROM monthly_filled""",
    "kpi_monthly_full": _growth("monthly_filled"),
    "kpi_customer_orders_top20": """
        SELECT customer_unique_id, count(DISTINCT order_id) AS order_count FROM bought
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "kpi_order_frequency": """
        SELECT order_count, count(*) AS customer_count
        FROM (SELECT count(DISTINCT order_id) AS order_count FROM bought GROUP BY customer_unique_id)
        GROUP BY 1 ORDER BY 1 LIMIT 5""",
    "kpi_repeat_rate": f"""
        SELECT count(*) AS total_customers, count(*) FILTER (n > 1) AS repeat_customers,
               {pct('count(*) FILTER (n > 1)', 'count(*)')} AS repeat_customer_rate_pct
        FROM (SELECT count(DISTINCT order_id) AS n FROM bought GROUP BY customer_unique_id)""",
    "kpi_cancellation": f"""
        SELECT count(DISTINCT order_id) AS total_orders, count(*) FILTER (order_status = 'canceled') AS cancelled_orders,
               {pct("count(*) FILTER (order_status = 'canceled')", 'count(DISTINCT order_id)')} AS cancellation_rate_pct
        FROM t_orders""",
    "kpi_delivery_days": f"""
        SELECT count(DISTINCT order_id) AS delivered_orders,
               {rnd(f'sum({_FULL_DAYS})', f'count({_FULL_DAYS})', 1, 0)} AS avg_delivery_days
        FROM t_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL""",
    "kpi_late_rate": f"""
        SELECT count(DISTINCT order_id) AS delivered_orders, {_LATE} AS late_orders,
               {pct(_LATE, 'count(DISTINCT order_id)')} AS late_delivery_rate_pct {_IN_TIME}""",
    "kpi_delivery_combined": f"""
        SELECT count(DISTINCT order_id) AS delivered_orders, {avg_int(_FULL_DAYS)} AS avg_delivery_days,
               {_LATE} AS late_orders, {pct(_LATE, 'count(DISTINCT order_id)')} AS late_delivery_rate_pct {_IN_TIME}""",
    "kpi_satisfaction": f"""
        SELECT count(*) AS total_reviews, {avg_int('review_score')} AS avg_review_score,
               count(*) FILTER (review_score >= 4) AS positive_reviews,
               {pct('count(*) FILTER (review_score >= 4)', 'count(*)')} AS positive_review_rate_pct,
               count(*) FILTER (review_score <= 2) AS negative_reviews,
               {pct('count(*) FILTER (review_score <= 2)', 'count(*)')} AS negative_review_rate_pct
        FROM t_reviews""",
    "kpi_payment_types": f"""
        SELECT payment_type, count(DISTINCT order_id) AS orders, {money('sum(payment_value)')} AS total_payment_value,
               {avg_money('payment_value')} AS avg_payment_value
        FROM t_payments GROUP BY 1""",
    "kpi_aov": f"""
        SELECT count(DISTINCT order_id) AS total_orders, {money('sum(price)')} AS total_product_sales,
               {rnd('sum(price)', 'count(DISTINCT order_id)')} AS average_order_value
        FROM t_order_items""",
}

_RECENCY_BUCKET = """CASE WHEN recency_days <= 90 THEN '0-90 days' WHEN recency_days <= 180 THEN '91-180 days'
                          WHEN recency_days <= 365 THEN '181-365 days' WHEN recency_days <= 730 THEN '366-730 days'
                          ELSE '731+ days' END"""
_CUSTOMER_SHARE = pct("count(*)", "sum(count(*)) OVER ()")
_RFM = f"""customer_unique_id, recency_days, frequency, {money('monetary')} AS monetary, CAST(r_score AS BIGINT) AS r_score,
           CAST(f_score AS BIGINT) AS f_score, CAST(m_score AS BIGINT) AS m_score"""

_CUSTOMERS = {
    "cust_profile": f"""
        SELECT customer_unique_id, orders AS order_count, {money('revenue')} AS total_spent,
               {rnd('revenue', 'orders')} AS avg_order_value, first AS first_purchase_date, last AS last_purchase_date
        FROM people_all""",
    "cust_order_frequency": "SELECT orders AS order_count, count(*) AS customer_count FROM people_all GROUP BY 1",
    "cust_latest_date": "SELECT max(order_purchase_timestamp) AS latest_date FROM t_orders",
    "cust_recency": f"""
        SELECT customer_unique_id, orders AS order_count, {money('revenue')} AS total_spent,
               {rnd('revenue', 'orders')} AS avg_order_value, first AS first_purchase_date, last AS last_purchase_date,
               recency_days
        FROM people_all""",
    "cust_recency_segments": f"""
        SELECT {_RECENCY_BUCKET} AS recency_segment, count(*) AS customer_count, {_CUSTOMER_SHARE} AS customer_share_pct
        FROM people_all GROUP BY 1""",
    "cust_recency_frequency": f"""
        SELECT if(recency_days <= 180, 'Recent + ', 'Old + ') || if(orders > 1, 'Repeat', 'One-time') AS customer_segment,
               count(*) AS customer_count, {_CUSTOMER_SHARE} AS customer_share_pct
        FROM people_all GROUP BY 1""",
    "cust_monetary": f"""
        SELECT customer_unique_id, orders AS order_count, {money('revenue')} AS total_spent FROM people_all""",
    "rfm_scores": f"SELECT {_RFM} FROM rfm",
    "rfm_segments": f"SELECT {_RFM}, customer_segment FROM rfm_named",
    "rfm_segment_summary": f"""
        SELECT customer_segment, count(*) AS customer_count, {_CUSTOMER_SHARE} AS customer_share_pct
        FROM rfm_named GROUP BY 1""",
}

_CATEGORY_TOTALS = f"""product_category_name, count(*) AS units_sold, {money('sum(price)')} AS revenue"""
_PRODUCT = f"""product_id, units_sold, {money('revenue')} AS revenue, {rnd('score', 'scores', 100)} AS avg_review_score"""

_PRODUCTS = {
    "prod_units": "SELECT product_id, count(*) AS units_sold FROM t_order_items GROUP BY 1",
    "prod_units_category": """
        SELECT product_id, product_category_name, count(*) AS units_sold
        FROM t_order_items JOIN t_products USING (product_id) GROUP BY 1, 2""",
    "prod_revenue_top10": f"""
        SELECT product_id, {money('sum(price)')} AS revenue FROM t_order_items
        GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 10""",
    "prod_units_revenue_price": f"""
        SELECT product_id, count(*) AS units_sold, {money('sum(price)')} AS revenue,
               {avg_money('price')} AS avg_selling_price
        FROM t_order_items GROUP BY 1""",
    "category_sales": f"""
        SELECT {_CATEGORY_TOTALS}, {avg_money('price')} AS avg_selling_price
        FROM t_order_items JOIN t_products USING (product_id) GROUP BY 1""",
    "category_reviews_fanout": f"""
        SELECT {_CATEGORY_TOTALS}, {avg_int('review_score')} AS avg_review_score
        FROM t_order_items JOIN t_products USING (product_id) JOIN t_reviews USING (order_id) GROUP BY 1""",
    "category_reviews": f"""
        SELECT {_CATEGORY_TOTALS}, {rnd('sum(review)', 'count(*) * 100')} AS avg_review_score
        FROM t_order_items JOIN t_products USING (product_id) JOIN order_review USING (order_id) GROUP BY 1""",
    "prod_top10_units_revenue": f"""
        SELECT product_id, count(*) AS units_sold, {money('sum(price)')} AS revenue FROM t_order_items
        GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 10""",
    "prod_total_revenue": f"SELECT {money('sum(price)')} AS total_revenue FROM t_order_items",
    "prod_top10_share": f"""
        SELECT {money('top')} AS top_10_revenue, {money('total')} AS total_revenue,
               {pct('top', 'total')} AS top_10_revenue_share_pct
        FROM (SELECT sum(revenue) FILTER (position <= 10) AS top, sum(revenue) AS total
              FROM (SELECT revenue, row_number() OVER (ORDER BY revenue DESC) AS position
                    FROM (SELECT sum(price) AS revenue FROM t_order_items GROUP BY product_id)))""",
    "prod_reviews_left": f"SELECT {_PRODUCT} FROM performance",
    "prod_baseline": f"""
        SELECT {avg_int('units_sold')} AS avg_units_sold, {avg_money('revenue')} AS avg_revenue,
               {rnd('sum(review)', 'count(review) * 100')} AS avg_review_score
        FROM performance""",
    "prod_labels": f"""
        SELECT {_PRODUCT}, if(volume, 'High Volume', 'Low Volume') AS volume_category,
               if(rich, 'High Revenue', 'Low Revenue') AS revenue_category,
               if(coalesce(liked, false), 'Strong Reviews', 'Weak Reviews') AS review_category
        FROM judged""",
    "prod_performance": f"""
        SELECT {_PRODUCT}, CASE
                   WHEN volume AND rich AND liked THEN 'Best Performer'
                   WHEN volume AND rich AND NOT liked THEN 'Revenue & Review Concern'
                   WHEN volume AND NOT rich THEN 'High Volume / Low Revenue'
                   WHEN rich AND NOT volume THEN 'Low Volume / High Revenue'
                   WHEN NOT (volume OR rich OR liked) THEN 'Potential Underperformer'
                   ELSE 'Average Performer' END AS performance_category
        FROM judged""",
}

_SELLER_TOTALS = f"""seller_id, count(DISTINCT order_id) AS orders_handled, count(*) AS units_sold,
                     {money('sum(price)')} AS revenue"""

_SELLERS = {
    "seller_top10": f"SELECT {_SELLER_TOTALS} FROM t_order_items GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 10",
    "seller_avg_price": f"""
        SELECT {_SELLER_TOTALS}, {avg_money('price')} AS avg_selling_price FROM t_order_items GROUP BY 1""",
    "seller_reviews": f"""
        SELECT {_SELLER_TOTALS}, {rnd('sum(review)', 'count(*) * 100')} AS avg_review_score
        FROM t_order_items JOIN order_review USING (order_id) GROUP BY 1""",
    "seller_revenue_top10": f"""
        SELECT seller_id, {money('sum(price)')} AS revenue FROM t_order_items
        GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 10""",
    "seller_top10_share": f"""
        SELECT {pct('sum(revenue) FILTER (position <= 10)', 'sum(revenue)')} AS top_10_revenue_share_pct
        FROM (SELECT revenue, row_number() OVER (ORDER BY revenue DESC) AS position
              FROM (SELECT sum(price) AS revenue FROM t_order_items GROUP BY seller_id))""",
    "seller_category": f"""
        SELECT seller_id, {_CATEGORY_TOTALS}
        FROM t_order_items JOIN t_products USING (product_id) GROUP BY 1, 2""",
    "seller_specialisation": f"""
        SELECT seller_id, product_category_name, {money('part')} AS category_revenue,
               {money('total')} AS total_revenue, {pct('part', 'total')} AS category_revenue_share
        FROM (SELECT seller_id, product_category_name, sum(price) AS part,
                     sum(sum(price)) OVER (PARTITION BY seller_id) AS total
              FROM t_order_items JOIN t_products USING (product_id) GROUP BY 1, 2)""",
}

_PAYMENT_TOTALS = f"count(*) AS payment_count, {money('sum(payment_value)')} AS total_payment_value"
_PAYMENT_AVG = f"{avg_money('payment_value')} AS avg_payment_value"
_CARD = "FROM t_payments WHERE payment_type = 'credit_card'"

_PAYMENTS = {
    "pay_counts": "SELECT payment_type, count(*) AS payment_count FROM t_payments GROUP BY 1",
    "pay_totals": f"SELECT payment_type, {_PAYMENT_TOTALS} FROM t_payments GROUP BY 1",
    "pay_averages": f"SELECT payment_type, {_PAYMENT_TOTALS}, {_PAYMENT_AVG} FROM t_payments GROUP BY 1",
    "pay_installments": f"SELECT payment_installments, {_PAYMENT_TOTALS}, {_PAYMENT_AVG} {_CARD} GROUP BY 1",
    "pay_installment_groups": f"""
        SELECT CASE WHEN payment_installments = 1 THEN '1 installment' WHEN payment_installments < 4 THEN '2-3 installments'
                    WHEN payment_installments < 7 THEN '4-6 installments' WHEN payment_installments < 10 THEN '7-9 installments'
                    ELSE '10+ installments' END AS installment_group,
               count(*) AS payment_count, {_PAYMENT_AVG}
        {_CARD} AND payment_installments > 0 GROUP BY 1""",
    "pay_installment_share": f"""
        SELECT if(payment_installments = 1, '1 installment', '2+ installments') AS installment_type, {_PAYMENT_TOTALS},
               {pct('count(*)', 'sum(count(*)) OVER ()')} AS payment_share_pct,
               {pct('sum(payment_value)', 'sum(sum(payment_value)) OVER ()')} AS value_share_pct
        {_CARD} AND payment_installments > 0 GROUP BY 1""",
}

_ESTIMATED = """WHERE order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL"""
_DAYS_LATE = "date_sub('day', order_estimated_delivery_date, order_delivered_customer_date)"

_DELIVERY = {
    "deliv_time_stats": f"""
        SELECT count(*) AS delivered_orders, {avg_int(_FULL_DAYS)} AS avg_delivery_days,
               min({_FULL_DAYS}) AS fastest_delivery_days, max({_FULL_DAYS}) AS slowest_delivery_days
        FROM t_orders WHERE order_delivered_customer_date IS NOT NULL""",
    "deliv_time_groups": f"""
        SELECT CASE WHEN d < 0 THEN NULL WHEN d < 4 THEN '0-3 days' WHEN d < 8 THEN '4-7 days' WHEN d < 15 THEN '8-14 days'
                    WHEN d < 31 THEN '15-30 days' ELSE '30+ days' END AS delivery_time_group,
               count(*) AS order_count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS order_share_pct
        FROM (SELECT {_FULL_DAYS} AS d FROM t_orders WHERE order_delivered_customer_date IS NOT NULL) GROUP BY 1""",
    "deliv_ontime_late": f"""
        SELECT {_STATUS_FILE} AS delivery_status, count(*) AS order_count,
               {pct('count(*)', 'sum(count(*)) OVER ()')} AS order_share_pct
        FROM t_orders {_ESTIMATED} GROUP BY 1""",
    "deliv_days_late": f"""
        SELECT count(*) AS late_orders, {avg_int(_DAYS_LATE)} AS avg_days_late, min({_DAYS_LATE}) AS min_days_late,
               max({_DAYS_LATE}) AS max_days_late
        FROM t_orders WHERE order_delivered_customer_date > order_estimated_delivery_date""",
    "deliv_reviews": f"""
        SELECT {_STATUS_FILE} AS delivery_status, count(DISTINCT order_id) AS order_count,
               {avg_int('review_score')} AS avg_review_score
        FROM t_orders JOIN t_reviews USING (order_id) {_ESTIMATED} GROUP BY 1""",
}


def _running(source: str) -> str:
    recent = "OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return f"""
        SELECT {day('month')} AS month, {money('revenue')} AS monthly_revenue,
               {money('sum(revenue) OVER (ORDER BY month)')} AS running_revenue,
               {rnd(f'(sum(revenue) {recent})', f'(count(*) {recent})')} AS moving_avg_3_months
        FROM {source}"""


def _buckets(n: int, name: str, *columns: str) -> str:
    return f"""
        SELECT CAST(bucket AS BIGINT) AS {name}, count(*) AS customer_count, {', '.join(columns)},
               {pct('sum(revenue)', 'sum(sum(revenue)) OVER ()')} AS revenue_share_pct
        FROM (SELECT revenue, ntile({n}) OVER (ORDER BY revenue, customer_unique_id) AS bucket FROM people)
        GROUP BY bucket"""


_ADVANCED = {
    "adv_first_purchase": """
        SELECT customer_id, min(order_purchase_timestamp) AS first_purchase_date
        FROM t_orders WHERE order_status = 'delivered' GROUP BY 1""",
    "cohort_retention": f"""
        SELECT {day('cohort')} AS cohort_month, date_diff('month', cohort, month) AS months_since_first_purchase,
               count(DISTINCT customer_unique_id) AS active_customers, any_value(size) AS cohort_size,
               {pct('count(DISTINCT customer_unique_id)', 'any_value(size)')} AS retention_rate_pct
        FROM (SELECT customer_unique_id, date_trunc('month', order_purchase_timestamp) AS month
              FROM bought WHERE order_status = 'delivered')
        JOIN (SELECT customer_unique_id, date_trunc('month', min(order_purchase_timestamp)) AS cohort,
                     count(*) OVER (PARTITION BY date_trunc('month', min(order_purchase_timestamp))) AS size
              FROM bought WHERE order_status = 'delivered' GROUP BY 1) USING (customer_unique_id)
        GROUP BY cohort, month""",
    "pareto_deciles": _buckets(10, "revenue_decile", f"{money('sum(revenue)')} AS decile_revenue"),
    "seller_rank_in_category": f"""
        SELECT seller_id, category, {money('revenue')} AS total_revenue, place AS seller_rank
        FROM (SELECT seller_id, p.product_category_name AS category, sum(price) AS revenue,
                     rank() OVER (PARTITION BY p.product_category_name ORDER BY sum(price) DESC) AS place
              FROM sold s JOIN t_products p ON p.product_id = s.product_id
              WHERE p.product_category_name IS NOT NULL GROUP BY 1, 2)
        WHERE place <= 3""",
    "running_and_moving": _running("monthly"),
    "running_and_moving_gapsafe": _running("monthly_filled"),
    "value_quartiles": _buckets(4, "revenue_quartile", f"{money('sum(revenue)')} AS total_revenue",
                                f"{avg_money('revenue')} AS avg_customer_revenue"),
    "customer_revenue": f"SELECT customer_unique_id, {money('revenue')} AS total_revenue FROM people",
    "customer_revenue_top10": f"""
        SELECT customer_unique_id, {money('revenue')} AS total_revenue FROM people
        ORDER BY revenue DESC, customer_unique_id LIMIT 10""",
}

_TYPE = "if(orders > 1, 'Repeat Customer', 'One-Time Customer')"
_REVIEWS_MART = "t_reviews JOIN bought USING (order_id) WHERE order_status = 'delivered'"
_PAYMENTS_MART = "t_payments JOIN bought USING (order_id) WHERE order_status = 'delivered'"
_ITEM_TOTALS = f"{money('sum(price)')} AS total_revenue, {money('sum(freight_value)')} AS total_freight"
_MONTH = f"""{day("date_trunc('month', order_purchase_timestamp)")}"""
_MONTHLY_MART = f"""
        SELECT {_MONTH} AS sales_month, count(DISTINCT order_id) AS total_orders, count(*) AS total_items,
               count(DISTINCT customer_unique_id) AS unique_customers, {_ITEM_TOTALS},
               {rnd('sum(price)', 'count(DISTINCT order_id)')} AS average_order_value
        FROM sold GROUP BY 1"""

_MARTS = {
    "vw_sales": f"""
        SELECT order_id, customer_id, customer_unique_id, order_status, order_purchase_timestamp,
               {day('order_purchase_timestamp')} AS order_purchase_date, order_delivered_customer_date, order_item_id,
               product_id, seller_id, {money('price')} AS price, {money('freight_value')} AS freight_value,
               product_category, customer_city, customer_state
        FROM sold""",
    "vw_customers": f"""
        SELECT customer_unique_id, customer_city, customer_state, orders AS total_orders, items AS total_items,
               {money('revenue')} AS total_revenue, {money('freight')} AS total_freight, first AS first_purchase_date,
               last AS last_purchase_date, {day("date_trunc('month', first)")} AS first_purchase_month,
               {_TYPE} AS customer_type
        FROM people""",
    "vw_products": f"""
        SELECT product_id, nullif(trim(p.product_category_name), '') AS product_category, count(*) AS units_sold,
               count(DISTINCT order_id) AS total_orders, {_ITEM_TOTALS},
               {rnd('sum(price)', 'count(*)', 10000, 6)} AS average_price,
               count(DISTINCT customer_id) AS unique_customers
        FROM sold JOIN t_products p USING (product_id) GROUP BY 1, 2""",
    "vw_sellers": f"""
        SELECT seller_id, seller_city, seller_state, count(*) AS units_sold, count(DISTINCT order_id) AS total_orders,
               count(DISTINCT customer_unique_id) AS unique_customers, {_ITEM_TOTALS},
               {rnd('sum(price)', 'count(*)', 10000, 6)} AS average_item_price
        FROM sold LEFT JOIN t_sellers USING (seller_id) GROUP BY 1, 2, 3""",
    "vw_payments": f"""
        SELECT order_id, customer_unique_id, order_purchase_timestamp, payment_sequential, payment_type,
               payment_installments, {money('payment_value')} AS payment_value
        FROM {_PAYMENTS_MART}""",
    "vw_delivery": """
        SELECT order_id, customer_unique_id, customer_city, customer_state, order_purchase_timestamp,
               order_estimated_delivery_date, order_delivered_customer_date, delivery_days, delivery_delay_days,
               delivery_status
        FROM arrived""",
    "vw_reviews": f"""
        SELECT review_id, order_id, customer_unique_id, customer_city, customer_state, order_purchase_timestamp,
               review_score, review_comment_title, review_comment_message, review_creation_date, review_answer_timestamp
        FROM {_REVIEWS_MART}""",
    "vw_monthly_sales": _MONTHLY_MART,
    "vw_orders": f"""
        SELECT order_id, {day('order_purchase_timestamp')} AS order_purchase_date, customer_state, customer_city
        FROM bought WHERE order_status = 'delivered'""",
    "vw_sales_checks": f"""
        SELECT count(*) AS total_rows, count(DISTINCT order_id) AS total_orders,
               count(DISTINCT customer_unique_id) AS total_customers, count(DISTINCT product_id) AS total_products,
               count(DISTINCT seller_id) AS total_sellers, {money('sum(price)')} AS total_revenue,
               {day('min(order_purchase_timestamp)')} AS first_date, {day('max(order_purchase_timestamp)')} AS last_date
        FROM sold""",
    "vw_customers_checks": f"""
        SELECT count(*) AS total_customers, count(DISTINCT customer_unique_id) AS unique_customers,
               CAST(sum(orders) AS BIGINT) AS total_orders, CAST(sum(items) AS BIGINT) AS total_items,
               {money('sum(revenue)')} AS total_revenue, count(*) FILTER (orders > 1) AS repeat_customers,
               count(*) FILTER (orders = 1) AS one_time_customers
        FROM people""",
    "vw_products_checks": f"""
        SELECT count(DISTINCT product_id) AS total_products, count(*) AS total_units_sold,
               count(DISTINCT (product_id, order_id)) AS total_order_product_combinations, {_ITEM_TOTALS}
        FROM sold""",
    "vw_sellers_checks": f"""
        SELECT count(DISTINCT seller_id) AS total_sellers, count(*) AS total_units_sold, {_ITEM_TOTALS},
               count(DISTINCT seller_id) FILTER (seller_state IS NULL) AS missing_state
        FROM sold LEFT JOIN t_sellers USING (seller_id)""",
    "vw_sellers_by_state": """
        SELECT seller_state, count(DISTINCT seller_id) AS sellers
        FROM sold LEFT JOIN t_sellers USING (seller_id) GROUP BY 1""",
    "vw_payments_checks": f"""
        SELECT count(*) AS total_payment_records, count(DISTINCT order_id) AS total_orders,
               count(DISTINCT customer_unique_id) AS total_customers, {money('sum(payment_value)')} AS total_payment_value
        FROM {_PAYMENTS_MART}""",
    "vw_payments_by_type": f"""
        SELECT payment_type, count(*) AS payment_records, count(DISTINCT order_id) AS orders,
               {money('sum(payment_value)')} AS total_payment_value, {avg_money('payment_value')} AS average_payment_value
        FROM {_PAYMENTS_MART} GROUP BY 1""",
    "vw_delivery_checks": f"""
        SELECT count(*) AS total_delivered_orders, count(DISTINCT order_id) AS unique_orders,
               count(DISTINCT customer_unique_id) AS unique_customers, {avg_int('delivery_days')} AS avg_delivery_days,
               min(delivery_days) AS min_delivery_days, max(delivery_days) AS max_delivery_days,
               {avg_int('delivery_delay_days')} AS avg_delivery_delay_days
        FROM arrived""",
    "vw_delivery_by_status": f"""
        SELECT delivery_status, count(*) AS orders, {pct('count(*)', '(SELECT count(*) FROM arrived)')} AS percentage
        FROM arrived GROUP BY 1""",
    "vw_reviews_checks": f"""
        SELECT count(*) AS total_review_records, count(DISTINCT (review_id, order_id)) AS unique_review_order_records,
               count(DISTINCT order_id) AS reviewed_orders, count(DISTINCT customer_unique_id) AS unique_customers,
               min(review_score) AS min_score, max(review_score) AS max_score, {avg_int('review_score')} AS average_score
        FROM {_REVIEWS_MART}""",
    "vw_reviews_by_score": f"""
        SELECT review_score, count(*) AS review_records, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage
        FROM {_REVIEWS_MART} GROUP BY 1""",
    "vw_monthly_sales_first": f"{_MONTHLY_MART} ORDER BY 1 LIMIT 10",
    "vw_monthly_sales_checks": f"""
        SELECT count(*) AS total_months, CAST(sum(orders) AS BIGINT) AS total_orders,
               CAST(sum(items) AS BIGINT) AS total_items, CAST(sum(people) AS BIGINT) AS sum_monthly_customers,
               {money('sum(revenue)')} AS total_revenue, {money('sum(freight)')} AS total_freight
        FROM (SELECT {_MONTH} AS month, count(DISTINCT order_id) AS orders, count(*) AS items,
                     count(DISTINCT customer_unique_id) AS people, sum(price) AS revenue, sum(freight_value) AS freight
              FROM sold GROUP BY 1)""",
    "vw_orders_checks": """
        SELECT count(*) AS total_rows, count(DISTINCT order_id) AS distinct_orders
        FROM bought WHERE order_status = 'delivered'""",
}

ANALYSES = {**_KPI, **_CUSTOMERS, **_PRODUCTS, **_SELLERS, **_PAYMENTS, **_DELIVERY, **_ADVANCED, **_MARTS}
