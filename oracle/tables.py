"""The contract tables as common table expressions over the given tables, and rounding helpers."""

from __future__ import annotations

import re

TABLES = {
    "t_customers": """
        SELECT c_custkey AS customer_id, c_custkey - c_custkey % 2 AS customer_unique_id,
               c_custkey % 97 AS customer_zip_code_prefix, lower(c_mktsegment) AS customer_city,
               n_name AS customer_state
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "t_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
               o_orderdate + to_hours(o_orderkey % 24) AS order_purchase_timestamp,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_hours(o_orderkey % 24 + 1) END AS order_approved_at,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 2 DAY END AS order_delivered_carrier_date,
               CASE WHEN o_orderstatus = 'F' AND day(o_orderdate) <> 31
                    THEN o_orderdate + to_hours(o_orderkey % 24 + (o_orderkey * 37) % 800)
               END AS order_delivered_customer_date,
               o_orderdate + INTERVAL 30 DAY AS order_estimated_delivery_date
        FROM orders""",
    "t_order_items": """
        SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
               CAST(round(l_quantity * 2500) AS BIGINT) AS freight_value
        FROM lineitem""",
    "t_payments": """
        SELECT order_id, payment_sequential, payment_type,
               CASE WHEN payment_type = 'credit_card' THEN order_id % 13 ELSE 1 END AS payment_installments,
               payment_value
        FROM (SELECT o_orderkey AS order_id, CAST(1 AS BIGINT) AS payment_sequential,
                     CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'boleto'
                          WHEN o_orderpriority = '5-LOW' THEN if(o_orderstatus = 'P', 'not_defined', 'voucher')
                          ELSE 'credit_card' END AS payment_type,
                     CAST(round(o_totalprice * 100) AS BIGINT) AS payment_value
              FROM orders
              UNION ALL
              SELECT o_orderkey, 2, 'voucher', 1000 FROM orders WHERE day(o_orderdate) = 15)""",
    "t_reviews": """
        SELECT review_id, order_id, review_score,
               CASE WHEN review_score = 1 THEN 'bad' END AS review_comment_title,
               CASE WHEN review_score <> 3
                    THEN concat('says "', o_orderpriority, '",', chr(10), 'score ', review_score)
               END AS review_comment_message,
               o_orderdate + INTERVAL 15 DAY AS review_creation_date,
               o_orderdate + INTERVAL 17 DAY AS review_answer_timestamp
        FROM (SELECT o_orderkey - o_orderkey % 2 AS review_id, o_orderkey AS order_id,
                     1 + (o_orderkey * 7) % 5 AS review_score, o_orderpriority, o_orderdate
              FROM orders WHERE dayofweek(o_orderdate) <> 0
              UNION ALL
              SELECT o_orderkey + 1000000000, o_orderkey, 1, o_orderpriority, o_orderdate
              FROM orders WHERE day(o_orderdate) = 1)""",
    "t_products": """
        SELECT p_partkey AS product_id,
               CASE p_partkey % 40 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lower(p_type) END AS product_category_name,
               length(p_name) AS product_name_length, CAST(p_size AS BIGINT) * 10 AS product_description_length,
               CAST(p_size AS BIGINT) % 5 AS product_photos_qty,
               CASE WHEN p_size > 1 THEN CAST(p_size AS BIGINT) * 100 END AS product_weight_g,
               CASE WHEN p_size > 1 THEN CAST(p_size AS BIGINT) END AS product_length_cm,
               CASE WHEN p_size > 1 THEN CAST(p_size AS BIGINT) + 1 END AS product_height_cm,
               CASE WHEN p_size > 1 THEN CAST(p_size AS BIGINT) + 2 END AS product_width_cm
        FROM part""",
    "t_sellers": """
        SELECT s_suppkey AS seller_id, s_suppkey % 97 AS seller_zip_code_prefix,
               lower(n_name) AS seller_city, n_name AS seller_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "t_geolocation": """
        SELECT customer_zip_code_prefix AS geolocation_zip_code_prefix,
               CAST(-10 - customer_zip_code_prefix % 20 AS DOUBLE) AS geolocation_lat,
               CAST(-40 - customer_zip_code_prefix % 10 AS DOUBLE) AS geolocation_lng,
               customer_city AS geolocation_city, customer_state AS geolocation_state
        FROM t_customers""",
    "t_category_translation": """
        SELECT DISTINCT product_category_name, upper(product_category_name) AS product_category_name_english
        FROM t_products WHERE product_category_name NOT IN ('', 'medium')""",
    # Orders with their buyer.
    "bought": """
        SELECT * FROM t_orders JOIN t_customers USING (customer_id)""",
    # Delivered items with order, buyer and display category.
    "sold": """
        SELECT i.*, b.* EXCLUDE (order_id),
               coalesce(t.product_category_name_english, nullif(trim(p.product_category_name), ''),
                        'Uncategorized') AS product_category
        FROM t_order_items i JOIN bought b USING (order_id)
        LEFT JOIN t_products p ON p.product_id = i.product_id
        LEFT JOIN t_category_translation t ON t.product_category_name = p.product_category_name
        WHERE b.order_status = 'delivered'""",
    # Delivered orders with a delivery date.
    "arrived": """
        SELECT *, date_diff('day', CAST(order_purchase_timestamp AS DATE),
                            CAST(order_delivered_customer_date AS DATE)) AS delivery_days,
               date_diff('day', CAST(order_estimated_delivery_date AS DATE),
                         CAST(order_delivered_customer_date AS DATE)) AS delivery_delay_days,
               if(order_delivered_customer_date <= order_estimated_delivery_date, 'On Time', 'Late') AS delivery_status
        FROM bought WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL""",
    # Per order: average review in ten-thousandths.
    "order_review": """
        SELECT order_id, (2 * sum(review_score) * 10000 + count(*)) // (2 * count(*)) AS review
        FROM t_reviews GROUP BY order_id""",
    # Persons with orders, items, spend and purchase times; delivered orders and all orders.
    "people": """
        SELECT customer_unique_id, max(customer_city) AS customer_city, max(customer_state) AS customer_state,
               count(DISTINCT order_id) AS orders, count(*) AS items, sum(price) AS revenue,
               sum(freight_value) AS freight, min(order_purchase_timestamp) AS first, max(order_purchase_timestamp) AS last
        FROM sold GROUP BY customer_unique_id""",
    "people_all": """
        SELECT customer_unique_id, count(DISTINCT order_id) AS orders, sum(price) AS revenue,
               min(order_purchase_timestamp) AS first, max(order_purchase_timestamp) AS last,
               date_diff('day', CAST(max(order_purchase_timestamp) AS DATE),
                         (SELECT CAST(max(order_purchase_timestamp) AS DATE) FROM t_orders)) AS recency_days
        FROM t_order_items JOIN bought USING (order_id) GROUP BY customer_unique_id""",
    "rfm": """
        SELECT customer_unique_id, recency_days, orders AS frequency, revenue AS monetary,
               ntile(5) OVER (ORDER BY recency_days DESC, customer_unique_id) AS r_score,
               CASE WHEN orders <= 3 THEN orders WHEN orders <= 5 THEN 4 ELSE 5 END AS f_score,
               ntile(5) OVER (ORDER BY revenue, customer_unique_id) AS m_score
        FROM people_all""",
    "rfm_named": """
        -- Fixed values: the segments and their limits.
        SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
                       WHEN r_score >= 4 AND f_score >= 4 THEN 'Loyal Customers'
                       WHEN r_score >= 4 AND m_score >= 4 THEN 'Big Spenders'
                       WHEN r_score >= 4 AND f_score <= 2 THEN 'Recent Customers'
                       WHEN r_score <= 2 AND (f_score >= 3 OR m_score >= 3) THEN 'At Risk'
                       ELSE 'Lost / Low Value' END AS customer_segment
        FROM rfm""",
    # Products joined to the reviews of their orders, items repeating per review.
    "performance": """
        SELECT product_id, count(*) AS units_sold, sum(price) AS revenue, sum(review_score) AS score,
               count(review_score) AS scores,
               CASE WHEN count(review_score) > 0
                    THEN (2 * sum(review_score) * 10000 + count(review_score)) // (2 * count(review_score))
               END AS review
        FROM t_order_items LEFT JOIN t_reviews USING (order_id) GROUP BY product_id""",
    "judged": """
        SELECT p.*, p.units_sold * b.n > b.units AS volume, p.revenue * b.n > b.revenue AS rich,
               p.review * b.reviewed >= b.review AS liked
        FROM performance p, (SELECT count(*) AS n, sum(units_sold) AS units, sum(revenue) AS revenue,
                                    count(review) AS reviewed, sum(review) AS review FROM performance) b""",
    "months": """
        SELECT unnest(generate_series(
            (SELECT date_trunc('month', min(order_purchase_timestamp)) FROM t_orders),
            (SELECT date_trunc('month', max(order_purchase_timestamp)) FROM t_orders),
            INTERVAL 1 MONTH)) AS month""",
    "monthly": """
        SELECT date_trunc('month', order_purchase_timestamp) AS month, count(DISTINCT order_id) AS orders,
               sum(price + freight_value) AS gross, sum(price) AS revenue
        FROM sold GROUP BY 1""",
    "monthly_filled": """
        SELECT m.month, coalesce(s.orders, 0) AS orders, coalesce(s.gross, 0) AS gross,
               coalesce(s.revenue, 0) AS revenue
        FROM months m LEFT JOIN monthly s ON s.month = m.month""",
}


def with_tables(sql: str) -> str:
    """Prefix a query with the table expressions it uses, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(TABLES[name])

    visit(sql)
    parts = ",\n".join(f"{name} AS ({body})" for name, body in TABLES.items() if name in needed)
    return f"WITH {parts}\n{sql}" if parts else sql


def money(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / 100"


def rnd(num: str, den: str, up: int = 1, digits: int = 2) -> str:
    """num * up / den rounded half away from zero, as a double with the given decimals."""
    return (f"CASE WHEN ({den}) <> 0 THEN CAST(sign({num}) * ((2 * abs({num}) * {up} + ({den})) // (2 * ({den})))"
            f" AS DOUBLE) / {10 ** digits} END")


def pct(part: str, whole: str) -> str:
    return rnd(part, whole, 10000)


def avg_int(column: str) -> str:
    return rnd(f"sum({column})", f"count({column})", 100)


def avg_money(column: str) -> str:
    return rnd(f"sum({column})", f"count({column})")


def day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"
