"""Expected results of sources, sinks, checks and cleaning."""

from __future__ import annotations

from oracle.tables import money, rnd

_ID, _INT, _STR, _TS, _MONEY, _DEGREES = "bigint", "int", "string", "timestamp_ntz", "decimal(12,2)", "decimal(11,8)"

# Columns with the types the adapted tables have, whether they are required, and the keys.
_SCHEMAS: dict[str, tuple[tuple[tuple[str, str, bool], ...], tuple[str, ...]]] = {
    "customers": ((("customer_id", _ID, True), ("customer_unique_id", _ID, True),
                   ("customer_zip_code_prefix", _INT, True), ("customer_city", _STR, True),
                   ("customer_state", _STR, True)), ("customer_id",)),
    "orders": ((("order_id", _ID, True), ("customer_id", _ID, True), ("order_status", _STR, True),
                ("order_purchase_timestamp", _TS, True), ("order_approved_at", _TS, False),
                ("order_delivered_carrier_date", _TS, False), ("order_delivered_customer_date", _TS, False),
                ("order_estimated_delivery_date", _TS, False)), ("order_id",)),
    "order_items": ((("order_id", _ID, True), ("order_item_id", _INT, True), ("product_id", _ID, True),
                     ("seller_id", _ID, True), ("shipping_limit_date", _TS, True), ("price", _MONEY, True),
                     ("freight_value", _MONEY, True)), ("order_id", "order_item_id")),
    "payments": ((("order_id", _ID, True), ("payment_sequential", _INT, True), ("payment_type", _STR, True),
                  ("payment_installments", _INT, True), ("payment_value", _MONEY, True)),
                 ("order_id", "payment_sequential")),
    "reviews": ((("review_id", _ID, True), ("order_id", _ID, True), ("review_score", _INT, True),
                 ("review_comment_title", _STR, False), ("review_comment_message", _STR, False),
                 ("review_creation_date", _TS, True), ("review_answer_timestamp", _TS, False)),
                ("review_id", "order_id")),
    "products": ((("product_id", _ID, True), ("product_category_name", _STR, False),
                  ("product_name_length", _INT, False), ("product_description_length", _INT, False),
                  ("product_photos_qty", _INT, False), ("product_weight_g", _INT, False),
                  ("product_length_cm", _INT, False), ("product_height_cm", _INT, False),
                  ("product_width_cm", _INT, False)), ("product_id",)),
    "sellers": ((("seller_id", _ID, True), ("seller_zip_code_prefix", _INT, True), ("seller_city", _STR, True),
                 ("seller_state", _STR, True)), ("seller_id",)),
    "geolocation": ((("geolocation_zip_code_prefix", _INT, True), ("geolocation_lat", _DEGREES, True),
                     ("geolocation_lng", _DEGREES, True), ("geolocation_city", _STR, True),
                     ("geolocation_state", _STR, True)), ()),
    "category_translation": ((("product_category_name", _STR, True), ("product_category_name_english", _STR, True)),
                             ("product_category_name",)),
}
_MEASURES = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
_REFERENCES = (("orders", "customers", "customer_id"), ("order_items", "orders", "order_id"),
               ("order_items", "products", "product_id"), ("order_items", "sellers", "seller_id"),
               ("payments", "orders", "order_id"), ("reviews", "orders", "order_id"))


def _all(parts) -> str:
    return " UNION ALL ".join(parts)


def _columns(table: str) -> list[str]:
    return [name for name, _, _ in _SCHEMAS[table][0]]


def _duplicates(table: str) -> str:
    return f"((SELECT count(*) FROM t_{table}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t_{table})))"


def _profile(table: str) -> str:
    columns = _SCHEMAS[table][0]
    return _all(f"""SELECT '{table}' AS "table", '{name}' AS "column", '{kind}' AS "type",
                    count(*) - count({name}) AS nulls, count(*) AS "rows",
                    CAST({len(columns)} AS BIGINT) AS columns, {_duplicates(table)} AS duplicate_rows
                    FROM t_{table}""" for name, kind, _ in columns)


def _pk(table: str, key: str) -> str:
    ok = f"count(*) = count(DISTINCT {key}) AND count({key}) = count(*)"
    return f"""SELECT '{table}' AS "table", '{key}' AS key, count(*) AS total_rows, count(DISTINCT {key}) AS unique_keys,
               count(*) - count({key}) AS null_keys, if({ok}, 'PASS', 'FAIL') AS status FROM t_{table}"""


def _composite(table: str) -> str:
    keys = ", ".join(_SCHEMAS[table][1])
    return f"""SELECT '{table}' AS "table", '{keys}' AS key,
               CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_involved,
               CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows, count(*) FILTER (n > 1) AS repeated_keys
               FROM (SELECT count(*) AS n FROM t_{table} GROUP BY {keys})"""


def _fk(child: str, parent: str, key: str) -> str:
    return f"""SELECT '{child}' AS child, '{parent}' AS parent, '{key}' AS key, count(DISTINCT {key}) AS invalid_keys,
               if(count(*) = 0, 'PASS', 'FAIL') AS status
               FROM t_{child} WHERE {key} NOT IN (SELECT {key} FROM t_{parent})"""


def _lookup(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS "rows", count(DISTINCT {column}) AS unique_names,
               count(*) - count(DISTINCT {column}) AS duplicate_names FROM t_category_translation"""


def _describe(column: str, value: str, unit: int) -> str:
    """unit is 100 for cents, 1 for plain numbers."""
    up = 10000 // unit
    quartiles = ", ".join(
        f"round(quantile_cont({value}, {q}) * 4) / {4 * unit}.0 AS p{name}"
        for q, name in (("0.25", 25), ("0.5", 50), ("0.75", 75)))
    bounds = (f"CAST(min({value}) AS DOUBLE) / {unit} AS min, CAST(max({value}) AS DOUBLE) / {unit} AS max" if unit > 1
              else f"min({value}) AS min, max({value}) AS max")
    return f"""SELECT '{column}' AS "column", count(*) AS "count", {rnd(f'sum({value})', 'count(*)', up, 4)} AS mean,
               round(stddev_samp({value} / {unit}.0), 4) AS std, {bounds}, {quartiles}
               FROM t_payments"""


def _rule(table: str, rule: str, condition: str) -> str:
    return f"""SELECT '{table}' AS "table", '{rule}' AS rule, count(*) FILTER ({condition}) AS "rows" FROM t_{table}"""


def _final(table: str) -> str:
    columns, keys = _SCHEMAS[table]
    nulls = " + ".join(f"(count(*) - count({name}))" for name, _, _ in columns)
    extra = "CAST(0 AS BIGINT)"
    if keys:
        extra = f"""(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM
                     (SELECT count(*) AS n FROM t_{table} GROUP BY {', '.join(keys)}))"""
    return f"""SELECT '{table}' AS "table", count(*) AS "rows", CAST({len(columns)} AS BIGINT) AS columns,
               {_duplicates(table)} AS duplicate_rows, {nulls} AS nulls, {extra} AS duplicate_keys FROM t_{table}"""


def _as_text(table: str, *texts: str) -> str:
    """Table columns with the given ids as text and money as doubles."""
    parts = []
    for name, kind, _ in _SCHEMAS[table][0]:
        if name in _MEASURES:
            parts.append(f"CAST({name} AS DOUBLE) AS {name}")
        elif name == "product_category_name":  # blank is null after cleaning
            parts.append(f"nullif(trim({name}), '') AS {name}")
        elif name in texts:
            parts.append(f"CAST({name} AS VARCHAR) AS {name}")
        elif kind == _MONEY:
            parts.append(f"{money(name)} AS {name}")
        else:
            parts.append(name)
    return f"SELECT {', '.join(parts)} FROM t_{table}"


_NULL_STAGE = """count(*) AS "rows", count(*) - count(order_approved_at) AS order_approved_at,
                 count(*) - count(order_delivered_carrier_date) AS order_delivered_carrier_date,
                 count(*) - count(order_delivered_customer_date) AS order_delivered_customer_date FROM t_orders"""
_GEO = ", ".join(_columns("geolocation"))

INTAKE = {
    "src_csv_discover": _all(
        f"""SELECT '{t}.csv' AS file, CAST({len(_SCHEMAS[t][0])} AS BIGINT) AS columns, count(*) AS "rows" FROM t_{t}"""
        for t in _SCHEMAS),
    "src_csv_named": _as_text("reviews", "review_id", "order_id"),
    "sink_csv_processed": _as_text("orders", "order_id", "customer_id"),
    "sink_table_load": _as_text("payments", "order_id"),
    "load_count_check": _all(
        f"""SELECT '{t}' AS "table", count(*) AS source_rows, count(*) AS loaded_rows, true AS ok FROM t_{t}"""
        for t in _SCHEMAS),
    "schema_contracts": _all(
        f"""SELECT '{t}' AS "table", '{name}' AS "column", count(*) - count({name}) AS nulls,
            if(count(*) = count({name}), 'PASS', 'FAIL') AS status FROM t_{t}"""
        for t, (columns, _) in _SCHEMAS.items() for name, _, required in columns if required),
    "surrogate_key": 'SELECT count(*) AS "rows", count(*) AS keys FROM t_geolocation',
    "lookup_insert": """
        SELECT DISTINCT product_category_name, if(product_category_name = 'medium', 'medium',
               upper(product_category_name)) AS product_category_name_english
        FROM t_products WHERE product_category_name <> ''""",
    "table_scan": "SELECT * FROM t_orders ORDER BY order_id LIMIT 10",
    "view_publish": _all(
        f"SELECT '{view}' AS view, count(*) AS items, {money('sum(price)')} AS revenue FROM sold"
        for view in ("vw_customers", "vw_products", "vw_sellers", "vw_monthly_sales", "vw_sales")),
    "layout_status": """
        SELECT customer_id, count(*) AS delivered_orders FROM t_orders WHERE order_status = 'delivered' GROUP BY 1""",
    "layout_customer_status": """
        SELECT customer_id, count(*) AS delivered_orders FROM t_orders WHERE order_status = 'delivered' GROUP BY 1""",
    "layout_month": f"""
        SELECT CAST(CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS VARCHAR) AS month, count(*) AS orders,
               coalesce(CAST(sum(items) AS BIGINT), 0) AS items, {money('sum(cents)')} AS revenue
        FROM t_orders LEFT JOIN (SELECT order_id, count(*) AS items, sum(price) AS cents FROM t_order_items GROUP BY 1) USING (order_id)
        WHERE order_status = 'delivered' AND year(order_purchase_timestamp) = 1996 AND quarter(order_purchase_timestamp) = 4
        GROUP BY 1""",
    "collation_lookup": """
        SELECT count(*) AS customers, count(DISTINCT lower(customer_city)) AS cities
        FROM t_customers WHERE lower(customer_state) = 'nation_1'""",
    # Degrees times 10^8 are whole numbers, so sums and quartiles are exact until the last division.
    "describe_latitude": """
        SELECT 'geolocation_lat' AS "column", count(*) AS "count", round(sum(x) / 1e8 / count(*), 10) AS mean,
               round(stddev_samp(x / 1e8), 10) AS std, min(x) / 1e8 AS min, max(x) / 1e8 AS max,
               round(quantile_cont(x, 0.25) / 1e8, 10) AS p25, round(quantile_cont(x, 0.5) / 1e8, 10) AS p50,
               round(quantile_cont(x, 0.75) / 1e8, 10) AS p75
        FROM (SELECT CAST(round(CAST(geolocation_lat AS DOUBLE) * 1e8) AS BIGINT) AS x FROM t_geolocation)""",
    "layout_bucketed": f"""
        SELECT order_status, count(*) AS orders, {money('sum(paid)')} AS paid, CAST(sum(reviews) AS BIGINT) AS reviews
        FROM t_orders JOIN (SELECT order_id, sum(payment_value) AS paid FROM t_payments GROUP BY 1) USING (order_id)
        LEFT JOIN (SELECT order_id, count(*) AS reviews FROM t_reviews GROUP BY 1) USING (order_id) GROUP BY 1""",
    "profile_table": _all(_profile(t) for t in _SCHEMAS),
    "pk_check": _all(_pk(t, k) for t, k in (("customers", "customer_id"), ("orders", "order_id"),
                                            ("products", "product_id"), ("sellers", "seller_id"),
                                            ("reviews", "review_id"))),
    "dup_key_rows": """
        SELECT * FROM t_reviews WHERE review_id IN
               (SELECT review_id FROM t_reviews GROUP BY 1 HAVING count(*) > 1)""",
    "dup_key_summary": """
        SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS "rows", count(*) AS keys
        FROM (SELECT count(*) AS n FROM t_reviews GROUP BY review_id) WHERE n > 1""",
    "composite_key_check": _all(_composite(t) for t in ("reviews", "order_items", "payments")),
    "composite_key_sql": """
        SELECT count(*) AS total_rows, count(DISTINCT (order_id, order_item_id)) AS unique_keys FROM t_order_items""",
    "fk_check": _all(_fk(*r) for r in _REFERENCES),
    "lookup_key_check": _all(_lookup(c) for c in ("product_category_name", "product_category_name_english")),
    "translation_coverage": """
        SELECT DISTINCT product_category_name FROM t_products
        WHERE trim(product_category_name) <> ''
          AND product_category_name NOT IN (SELECT product_category_name FROM t_category_translation)""",
    "zip_ambiguity": """
        SELECT count(*) AS "rows", count(DISTINCT geolocation_zip_code_prefix) AS unique_prefixes,
               count(*) - count(DISTINCT geolocation_zip_code_prefix) AS repeated_rows FROM t_geolocation""",
    "zip_location_counts": """
        SELECT geolocation_zip_code_prefix, count(DISTINCT geolocation_lat) AS unique_lat,
               count(DISTINCT geolocation_lng) AS unique_lng, count(DISTINCT geolocation_city) AS unique_cities,
               count(DISTINCT geolocation_state) AS unique_states FROM t_geolocation GROUP BY 1""",
    "length_distribution": """
        SELECT length(customer_state) AS length, count(*) AS "count" FROM t_customers GROUP BY 1""",
    "value_range": """
        SELECT min(customer_zip_code_prefix) AS min, max(customer_zip_code_prefix) AS max FROM t_customers""",
    "value_counts": 'SELECT payment_type AS value, count(*) AS "count" FROM t_payments GROUP BY 1',
    "value_counts_top20": """
        SELECT product_category_name AS value, count(*) AS "count" FROM t_products
        WHERE product_category_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "describe_numeric": _describe("payment_value", "payment_value", 100),
    "describe_installments": _describe("payment_installments", "payment_installments", 1),
    "value_domain": "SELECT DISTINCT review_score FROM t_reviews",
    "anomaly_filters": _all((
        _rule("payments", "undefined payment type", "payment_type = 'not_defined'"),
        _rule("payments", "zero installments", "payment_installments = 0"),
        _rule("products", "missing category", "product_category_name IS NULL"),
        _rule("products", "missing category and weight", "product_category_name IS NULL AND product_weight_g IS NULL"),
        _rule("products", "missing weight", "product_weight_g IS NULL"))),
    "anomaly_rows": f"""
        SELECT order_id, payment_sequential, payment_type, payment_installments, {money('payment_value')} AS payment_value
        FROM t_payments WHERE payment_installments = 0""",
    "anomaly_missing_weight": """
        SELECT product_id, CAST(product_weight_g AS DOUBLE) AS product_weight_g,
               CAST(product_length_cm AS DOUBLE) AS product_length_cm,
               CAST(product_height_cm AS DOUBLE) AS product_height_cm,
               CAST(product_width_cm AS DOUBLE) AS product_width_cm
        FROM t_products WHERE product_weight_g IS NULL""",
    "exact_dup_groups": f"""
        SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS "rows", count(*) AS groups
        FROM (SELECT count(*) AS n FROM t_geolocation GROUP BY {_GEO}) WHERE n > 1""",
    "exact_dup_sample": f"""
        SELECT {_GEO}, count(*) AS copies FROM t_geolocation GROUP BY {_GEO} HAVING count(*) > 1
        ORDER BY {_GEO} LIMIT 30""",
    "null_timespan_check": """
        SELECT count(*) AS null_delivery_days FROM t_orders
        WHERE order_delivered_customer_date IS NOT NULL
          AND date_sub('day', order_purchase_timestamp, order_delivered_customer_date) IS NULL""",
    "month_status_probe": """
        SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month, count(*) AS total_orders,
               count(*) FILTER (order_status = 'delivered') AS delivered_orders
        FROM t_orders WHERE order_purchase_timestamp >= DATE '1996-09-01' AND order_purchase_timestamp < DATE '1997-03-01'
        GROUP BY 1""",
    "final_validation": _all(_final(t) for t in _SCHEMAS),
    "clean_headers": "SELECT * FROM t_sellers",
    "clean_trim": """
        SELECT CAST(customer_id AS VARCHAR) AS customer_id, CAST(customer_unique_id AS VARCHAR) AS customer_unique_id,
               customer_city, customer_state FROM t_customers""",
    "clean_timestamps": """
        SELECT order_id, order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
               order_delivered_customer_date, order_estimated_delivery_date FROM t_orders""",
    "clean_null_policy": f"SELECT 'raw' AS stage, {_NULL_STAGE} UNION ALL SELECT 'clean', {_NULL_STAGE}",
    "clean_rename": """
        SELECT CAST(product_id AS VARCHAR) AS product_id, product_name_length, product_description_length
        FROM t_products""",
    "clean_dedup": "SELECT DISTINCT * FROM t_geolocation",
    "clean_tables": _as_text("order_items", "order_id", "product_id", "seller_id"),
    "clean_tables_counts": _all(
        f"""SELECT '{t}' AS "table", count(*) AS raw_rows,
            {f'(SELECT count(*) FROM (SELECT DISTINCT * FROM t_{t}))' if t == 'geolocation' else 'count(*)'} AS clean_rows
            FROM t_{t}""" for t in _SCHEMAS),
}
for _table, (_listed, _) in _SCHEMAS.items():
    _sql = _as_text(_table, *[name for name, kind, _ in _listed if kind == _ID])
    INTAKE[f"clean_{_table}"] = _sql.replace("SELECT", "SELECT DISTINCT", 1) if _table == "geolocation" else _sql
    # Reading goes through the recipe, which keeps distinct places only.
    INTAKE[f"csv_{_table}"] = INTAKE[f"clean_{_table}"]
