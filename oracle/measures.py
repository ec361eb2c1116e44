"""Expected results of the dashboard measures."""

from __future__ import annotations

from oracle.tables import avg_int, day, money, pct, rnd

_REVENUE = f"{money('sum(price)')} AS revenue"
_CORE = f"""{_REVENUE}, count(DISTINCT order_id) AS orders, count(*) AS items,
            {rnd('sum(price)', 'count(DISTINCT order_id)')} AS aov, count(DISTINCT customer_unique_id) AS customers,
            {money('sum(freight_value)')} AS freight"""
_SLICE = """order_purchase_timestamp >= DATE '1996-01-01' AND order_purchase_timestamp < DATE '2001-01-01'
            AND customer_state IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5', 'NATION_6',
                                   'NATION_7', 'NATION_8', 'NATION_9')"""
_TYPED = """(SELECT s.*, if(p.orders > 1, 'Repeat Customer', 'One-Time Customer') AS customer_type
             FROM sold s JOIN people p USING (customer_unique_id))"""
_REVIEWED = "t_reviews JOIN bought USING (order_id) WHERE order_status = 'delivered'"
_PAID = "t_payments JOIN bought USING (order_id) WHERE order_status = 'delivered'"
_STATUS_REVIEWS = "t_reviews JOIN arrived USING (order_id)"
_LOW = "count(*) FILTER (review_score <= 2)"
_LOW_COLUMNS = f"{_LOW} AS low_reviews, count(*) AS reviews, {pct(_LOW, 'count(*)')} AS low_score_pct"


def tenth_pct(part: str, whole: str) -> str:
    """A percentage with one decimal, rounded once."""
    return rnd(part, whole, 1000, 1)


def _mix(share=pct) -> str:
    return f"""payment_type, {money('sum(payment_value)')} AS payment_value,
           {share('sum(payment_value)', 'sum(sum(payment_value)) OVER ()')} AS share_pct"""


_MIX = _mix()
_TOP_CATEGORIES = f"SELECT product_category, {_REVENUE} FROM sold GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 10"
_TOP_STATES = f"SELECT customer_state, {_REVENUE} FROM sold GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 10"
_FREIGHT = f"""
    SELECT customer_state, {pct('sum(freight_value)', 'sum(price)')} AS freight_pct, count(DISTINCT order_id) AS orders
    FROM sold GROUP BY 1 HAVING count(DISTINCT order_id) >= 100 ORDER BY 2 DESC, 1"""
_SLOWEST = f"""
    SELECT customer_state, {avg_int('delivery_days')} AS avg_delivery_days, count(*) AS orders
    FROM arrived GROUP BY 1 HAVING count(*) >= 100 ORDER BY 2 DESC, 1"""
_PRICED = f"""
    SELECT product_category, {rnd('sum(price)', 'count(*)')} AS avg_item_price
    FROM sold GROUP BY 1 HAVING count(*) >= 5 AND count(*) * 1000 >= (SELECT count(*) FROM sold)
    ORDER BY 2 DESC, 1 LIMIT 1"""


def _by_state(share=pct) -> str:
    return f"""
    SELECT customer_state, count(DISTINCT customer_unique_id) AS customers,
           {share('count(DISTINCT customer_unique_id)', '(SELECT count(DISTINCT customer_unique_id) FROM sold)')} AS share_pct
    FROM sold GROUP BY 1 ORDER BY 2 DESC, 1"""


_BY_STATE = _by_state()
_RATED = f"""
    SELECT customer_state, {avg_int('review_score')} AS avg_review_score FROM {_REVIEWED}
    GROUP BY 1 ORDER BY 2, 1"""


def _category_share(share=pct) -> str:
    return f"""
    SELECT {money('top')} AS top_revenue, {money('total')} AS revenue, {share('top', 'total')} AS share_pct
    FROM (SELECT sum(revenue) FILTER (place <= 10) AS top, sum(revenue) AS total
          FROM (SELECT sum(price) AS revenue, row_number() OVER (ORDER BY sum(price) DESC, product_category) AS place
                FROM sold GROUP BY product_category))"""


_CATEGORY_SHARE = _category_share()


def _decile(share=pct) -> str:
    return f"""
    SELECT count(*) FILTER (chosen) AS top_sellers, {share('sum(revenue) FILTER (chosen)', 'sum(revenue)')} AS share_pct
    FROM (SELECT sum(price) AS revenue,
                 row_number() OVER (ORDER BY sum(price) DESC, seller_id) <= (count(*) OVER () + 9) // 10 AS chosen
          FROM sold GROUP BY seller_id)"""


_DECILE = _decile()
_REPEAT = f"""
    SELECT count(*) FILTER (orders > 1) AS repeat_customers, count(*) AS customers,
           {pct('count(*) FILTER (orders > 1)', 'count(*)')} AS repeat_rate_pct
    FROM people"""


_AVG_SCORE = f"SELECT {avg_int('review_score')} AS avg_review_score FROM {_REVIEWED}"
_REVIEW_COUNT = f"SELECT count(*) AS reviews FROM {_REVIEWED}"
_TOTAL_PAID = f"SELECT {money('sum(payment_value)')} AS payment_value FROM {_PAID}"
_CARDS = f"SELECT count(*) AS payments FROM {_PAID} AND payment_type = 'credit_card'"


def _type_share(where: str = "", share=pct) -> str:
    return f"""
    SELECT customer_type, {_REVENUE}, {share('sum(price)', '(SELECT sum(price) FROM sold)')} AS share_pct
    FROM {_TYPED} {where} GROUP BY 1"""


_STATUS_SCORE = f"SELECT delivery_status, {avg_int('review_score')} AS avg_review_score FROM {_STATUS_REVIEWS} GROUP BY 1"
_STATUS_LOW = f"SELECT delivery_status, {_LOW_COLUMNS} FROM {_STATUS_REVIEWS} GROUP BY 1"
_PAYMENT_MIX = f"SELECT {_MIX} FROM {_PAID} GROUP BY 1"


def _month_from(column: str, table: str, columns: str) -> str:
    month = f"date_trunc('month', {column})"
    return f"SELECT {day(month)} AS month, {columns} FROM {table} {column} >= DATE '1996-01-01' GROUP BY 1"


def _txt(column: str, digits: int = 2) -> str:
    """A rounded double written with a fixed number of decimals."""
    scaled = f"CAST(round(({column}) * {10 ** digits}) AS BIGINT)"
    if digits == 0:
        return f"CAST({scaled} AS VARCHAR)"
    sign = f"if({scaled} < 0, '-', '')"
    whole, rest = f"abs({scaled}) // {10 ** digits}", f"abs({scaled}) % {10 ** digits}"
    return f"{sign} || ({whole}) || '.' || lpad(CAST({rest} AS VARCHAR), {digits}, '0')"


def _sentence(topic: str, source: str, text: str) -> str:
    return f"""SELECT '{topic}' AS topic, coalesce((SELECT {text} FROM ({source}) LIMIT 1),
               'Not enough data in this selection') AS sentence"""


_TAKEAWAYS = " UNION ALL ".join((
    _sentence("category share", _category_share(tenth_pct), f"'Top 10 categories bring ' || {_txt('share_pct', 1)} || '% of revenue'"),
    _sentence("price", _PRICED,
              f"'Highest average price: ' || product_category || ' (' || {_txt('avg_item_price')} || ')'"),
    _sentence("freight", _FREIGHT,
              f"'Highest freight share: ' || customer_state || ' (' || {_txt('freight_pct')} || '% of revenue)'"),
    _sentence("late reviews", f"""
        SELECT max(avg_review_score) FILTER (delivery_status = 'Late') AS late,
               max(avg_review_score) FILTER (delivery_status = 'On Time') AS fine FROM ({_STATUS_SCORE})""",
              f"'Late orders score ' || {_txt('late')} || ' against ' || {_txt('fine')} || ' on time'"),
    _sentence("slowest state", _SLOWEST, "'Slowest state with 100+ orders: ' || customer_state || ' (' || "
              f"{_txt('avg_delivery_days')} || ' days)'"),
    _sentence("seller share", _decile(tenth_pct), f"'Top 10% of sellers bring ' || {_txt('share_pct', 1)} || '% of revenue'"),
    _sentence("repeat rate", _REPEAT, f"{_txt('repeat_rate_pct')} || '% of customers came back'"),
    _sentence("repeat revenue", _type_share("WHERE customer_type = 'Repeat Customer'", tenth_pct),
              f"'Repeat customers bring ' || {_txt('share_pct', 1)} || '% of revenue'"),
    _sentence("top state", _by_state(tenth_pct), f"customer_state || ' has ' || {_txt('share_pct', 1)} || '% of customers'"),
    _sentence("lowest rated", _RATED,
              f"'Lowest rated state: ' || customer_state || ' (' || {_txt('avg_review_score')} || ')'"),
    _sentence("low scores", f"SELECT * FROM ({_STATUS_LOW}) WHERE delivery_status = 'Late'",
              f"{_txt('low_score_pct')} || '% of the reviews of late orders are 1 or 2 stars'"),
    _sentence("payment", f"SELECT * FROM (SELECT {_mix(tenth_pct)} FROM {_PAID} GROUP BY 1) WHERE payment_type = 'credit_card'",
              f"'Credit cards carry ' || {_txt('share_pct', 1)} || '% of payment value'"),
))


def _relationship(position: int, one: str, many: str, key: str, one_sql: str, many_sql: str) -> str:
    return f"""SELECT CAST({position} AS BIGINT) AS relationship, '{one}' AS one_side, '{many}' AS many_side, '{key}' AS key,
        (SELECT count(*) FROM ({one_sql})) AS one_rows, (SELECT count(DISTINCT k) FROM ({one_sql})) AS one_keys,
        (SELECT count(DISTINCT k) FROM ({many_sql}) WHERE k NOT IN (SELECT k FROM ({one_sql}))) AS orphan_keys"""


_HUB = "SELECT order_id AS k FROM bought WHERE order_status = 'delivered'"
_DATES = """SELECT CAST(unnest(generate_series((SELECT CAST(min(order_purchase_timestamp) AS DATE) FROM t_orders),
            (SELECT CAST(max(order_purchase_timestamp) AS DATE) FROM t_orders), INTERVAL 1 DAY)) AS DATE) AS k"""
_BILLED = "SELECT order_id, sum(price + freight_value) AS billed FROM sold GROUP BY 1"
_PAID_BY_ORDER = f"SELECT order_id, sum(payment_value) AS paid FROM {_PAID} GROUP BY 1"

MEASURES = {
    "date_dim": f"SELECT {day('k')} AS date, {day('date_trunc(' + chr(39) + 'month' + chr(39) + ', k)')} AS month_start FROM ({_DATES})",
    "star_relationships": " UNION ALL ".join((
        _relationship(1, "date", "orders", "order_purchase_date", _DATES,
                      "SELECT CAST(order_purchase_timestamp AS DATE) AS k FROM bought WHERE order_status = 'delivered'"),
        _relationship(2, "orders", "sales", "order_id", _HUB, "SELECT order_id AS k FROM sold"),
        _relationship(3, "orders", "reviews", "order_id", _HUB, f"SELECT order_id AS k FROM {_REVIEWED}"),
        _relationship(4, "orders", "payments", "order_id", _HUB, f"SELECT order_id AS k FROM {_PAID}"),
        _relationship(5, "orders", "delivery", "order_id", _HUB, "SELECT order_id AS k FROM arrived"),
        _relationship(6, "products", "sales", "product_id", "SELECT DISTINCT product_id AS k FROM sold",
                      "SELECT product_id AS k FROM sold"),
        _relationship(7, "sellers", "sales", "seller_id", "SELECT DISTINCT seller_id AS k FROM sold",
                      "SELECT seller_id AS k FROM sold"),
        _relationship(8, "customers", "sales", "customer_unique_id", "SELECT customer_unique_id AS k FROM people",
                      "SELECT customer_unique_id AS k FROM sold"),
    )),
    "slicer_filter": f"""
        SELECT {_CORE} FROM sold WHERE {_SLICE} AND product_category IN ('ECONOMY', 'PROMO', 'Uncategorized')""",
    "slicer_filter_payments": f"SELECT {_MIX} FROM {_PAID} AND {_SLICE} GROUP BY 1",
    "slicer_filter_status": """
        SELECT CAST(0 AS BIGINT) AS on_time_orders, count(*) AS delivered_orders, CAST(0 AS DOUBLE) AS on_time_pct
        FROM arrived""",
    "slicer_filter_type": _type_share("WHERE customer_type = 'Repeat Customer'"),
    "m_core": f"SELECT {_CORE} FROM sold",
    "m_freight_pct": f"SELECT {pct('sum(freight_value)', 'sum(price)')} AS freight_pct FROM sold",
    "m_avg_item_price": f"SELECT {rnd('sum(price)', 'count(*)')} AS avg_item_price FROM sold",
    "m_category_table": f"""
        SELECT product_category, {_REVENUE}, count(*) AS items, {rnd('sum(price)', 'count(*)')} AS avg_item_price,
               {pct('sum(freight_value)', 'sum(price)')} AS freight_pct
        FROM sold GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 10""",
    "m_freight_by_state": f"{_FREIGHT} LIMIT 8",
    "m_top10_category_share": _CATEGORY_SHARE,
    "m_top_price_category": _PRICED,
    "m_top_freight_state": f"SELECT customer_state, freight_pct FROM ({_FREIGHT} LIMIT 1)",
    "m_ontime_pct": f"""
        SELECT count(*) FILTER (delivery_status = 'On Time') AS on_time_orders, count(*) AS delivered_orders,
               {pct("count(*) FILTER (delivery_status = 'On Time')", 'count(*)')} AS on_time_pct
        FROM arrived""",
    "m_avg_delivery_days": f"SELECT {avg_int('delivery_days')} AS avg_delivery_days FROM arrived",
    "m_late_orders": "SELECT count(*) AS late_orders FROM arrived WHERE delivery_status = 'Late'",
    "m_avg_days_late": f"""
        SELECT {avg_int('delivery_delay_days')} AS avg_days_late FROM arrived WHERE delivery_status = 'Late'""",
    "m_active_sellers": "SELECT count(DISTINCT seller_id) AS active_sellers FROM sold",
    "m_delivered_orders": "SELECT count(DISTINCT order_id) AS delivered_orders FROM arrived",
    "m_review_by_status": _STATUS_SCORE,
    "m_slowest_states": f"{_SLOWEST} LIMIT 8",
    "m_delivery_histogram": "SELECT delivery_days // 5 * 5 AS days_from, count(*) AS orders FROM arrived GROUP BY 1",
    "m_revenue_by_seller_state": f"""
        SELECT seller_state, {_REVENUE}, count(DISTINCT seller_id) AS active_sellers
        FROM sold LEFT JOIN t_sellers USING (seller_id) GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 8""",
    "m_top_decile_seller_share": _DECILE,
    "m_repeat_rate": _REPEAT,
    "m_orders_per_customer": f"""
        SELECT {rnd('count(DISTINCT order_id)', 'count(DISTINCT customer_unique_id)', 100)} AS orders_per_customer
        FROM sold""",
    "m_revenue_per_customer": f"""
        SELECT {rnd('sum(price)', 'count(DISTINCT customer_unique_id)')} AS revenue_per_customer FROM sold""",
    "m_customers_by_type": f"""
        SELECT customer_type, count(DISTINCT customer_unique_id) AS customers FROM {_TYPED} GROUP BY 1""",
    "m_new_customers_month": _month_from("first", "people WHERE", "count(*) AS new_customers"),
    "m_customers_by_state": f"{_BY_STATE} LIMIT 6",
    "m_revenue_share_by_type": _type_share(),
    "m_state_customer_revenue_share": f"""
        SELECT customer_state,
               {pct('count(DISTINCT customer_unique_id)', '(SELECT count(DISTINCT customer_unique_id) FROM sold)')}
                   AS customer_share_pct,
               {pct('sum(price)', '(SELECT sum(price) FROM sold)')} AS revenue_share_pct
        FROM sold GROUP BY 1""",
    "m_review_trend": _month_from("order_purchase_timestamp", f"{_REVIEWED} AND",
                                  f"{avg_int('review_score')} AS avg_review_score, count(*) AS reviews"),
    "m_lowest_rated_states": f"{_RATED} LIMIT 8",
    "m_low_score_share": f"SELECT {_LOW_COLUMNS} FROM {_REVIEWED}",
    "m_low_score_by_status": _STATUS_LOW,
    "m_avg_review_score": _AVG_SCORE,
    "m_avg_review_score_sliced": f"{_AVG_SCORE} AND {_SLICE}",
    "m_review_count": _REVIEW_COUNT,
    "m_review_count_sliced": f"{_REVIEW_COUNT} AND {_SLICE}",
    "m_total_payment_value": _TOTAL_PAID,
    "m_total_payment_value_sliced": f"{_TOTAL_PAID} AND {_SLICE}",
    "m_cc_payments": _CARDS,
    "m_cc_payments_sliced": f"{_CARDS} AND {_SLICE}",
    "m_payment_mix": _PAYMENT_MIX,
    "m_avg_installments_cc": f"""
        SELECT {avg_int('payment_installments')} AS avg_installments FROM {_PAID} AND payment_type = 'credit_card'""",
    "m_cc_installments": f"""
        SELECT payment_installments AS installments, count(*) AS payments FROM {_PAID}
        AND payment_type = 'credit_card' AND payment_installments >= 1 AND payment_installments <= 10 GROUP BY 1""",
    "m_payment_reconciliation": f"""
        SELECT {money('paid')} AS payments, {money('billed')} AS billed, {money('(paid - billed)')} AS difference
        FROM (SELECT (SELECT sum(payment_value) FROM {_PAID}) AS paid,
                     (SELECT sum(price + freight_value) FROM sold) AS billed)""",
    "m_payment_reconciliation_by_order": f"""
        SELECT order_id, {money('coalesce(paid, 0)')} AS payments, {money('coalesce(billed, 0)')} AS billed,
               {money('(coalesce(paid, 0) - coalesce(billed, 0))')} AS difference
        FROM ({_PAID_BY_ORDER}) FULL JOIN ({_BILLED}) USING (order_id)
        WHERE coalesce(paid, 0) <> coalesce(billed, 0)""",
    "m_monthly_revenue": _month_from("order_purchase_timestamp", "sold WHERE", _REVENUE),
    "m_top_categories_states": f"""
        SELECT 'category' AS chart, product_category AS name, revenue FROM ({_TOP_CATEGORIES})
        UNION ALL SELECT 'state', customer_state, revenue FROM ({_TOP_STATES})""",
    "m_status_split": f"""
        SELECT delivery_status, count(*) AS orders, {pct('count(*)', 'sum(count(*)) OVER ()')} AS share_pct
        FROM arrived GROUP BY 1""",
    "m_review_distribution": f"SELECT review_score, count(*) AS reviews FROM {_REVIEWED} GROUP BY 1",
    "m_takeaways": _TAKEAWAYS,
}
