"""Reporting marts over delivered orders, each with its grain and control totals.

Revenue is item price without freight; freight is a column of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import (
    blank_to_null, calendar_days, count_when, delivery_status, mean, money, money_total, month_start,
    pct, ratio,
)
from orderlens.operators.ranking import top_n
from orderlens.operators.rollups import delivered_hub, item_totals, people_totals
from orderlens.warehouse import Warehouse

UNCATEGORIZED = "Uncategorized"
REPEAT, ONE_TIME = "Repeat Customer", "One-Time Customer"

_PURCHASED = "order_purchase_timestamp"


def product_categories(w: Warehouse) -> DataFrame:
    """Display name per product: translated, else its own name, else Uncategorized."""
    named = w.products.select("product_id", "product_category_name")
    return named.join(w.category_translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", blank_to_null("product_category_name"),
                   F.lit(UNCATEGORIZED)).alias("product_category"),
    )


def sales(w: Warehouse) -> DataFrame:
    """Grain: order item."""
    hub = delivered_hub(
        w, "order_id", "customer_id", "customer_unique_id", "order_status", "order_purchase_timestamp",
        F.to_date(_PURCHASED).alias("order_purchase_date"), "order_delivered_customer_date",
        "customer_city", "customer_state")
    items = w.order_items.select(
        "order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
    named = items.join(hub, "order_id").join(product_categories(w), "product_id", "left")
    return named.select(
        "order_id", "customer_id", "customer_unique_id", "order_status", "order_purchase_timestamp",
        "order_purchase_date", "order_delivered_customer_date", "order_item_id", "product_id", "seller_id",
        "price", "freight_value",
        F.coalesce("product_category", F.lit(UNCATEGORIZED)).alias("product_category"),
        "customer_city", "customer_state")


def sales_checks(w: Warehouse) -> DataFrame:
    """Control totals; orders and people are counted at order grain."""
    hub = delivered_hub(w, "order_id", "customer_unique_id", F.to_date(_PURCHASED).alias("day"))
    orders = item_totals(w.order_items, "order_id").join(hub, "order_id")
    sold = w.order_items.join(hub.select("order_id"), "order_id", "left_semi")
    return orders.agg(
        F.sum("items").alias("total_rows"),
        F.count("*").alias("total_orders"),
        F.count_distinct("customer_unique_id").alias("total_customers"),
        money_total("revenue_cents").alias("total_revenue"),
        F.min("day").alias("first_date"),
        F.max("day").alias("last_date"),
    ).select(
        "total_rows", "total_orders", "total_customers",
        sold.agg(F.count_distinct("product_id")).scalar().alias("total_products"),
        sold.agg(F.count_distinct("seller_id")).scalar().alias("total_sellers"),
        "total_revenue", "first_date", "last_date")


def customers(w: Warehouse, latest_place: bool = False) -> DataFrame:
    """Grain: person (customer_unique_id). City and state are independent maxima, so they
    may stem from different records; with ``latest_place`` both belong to the last purchase."""
    return people_totals(w, delivered_only=True, place=True, latest_place=latest_place).select(
        "customer_unique_id", "customer_city", "customer_state",
        F.col("orders").alias("total_orders"),
        F.col("items").alias("total_items"),
        F.col("revenue").alias("total_revenue"),
        F.col("freight").alias("total_freight"),
        "first_purchase_date", "last_purchase_date",
        month_start("first_purchase_date").alias("first_purchase_month"),
        customer_type(F.col("orders")).alias("customer_type"))


def customer_type(orders: Column) -> Column:
    return F.when(orders > 1, REPEAT).otherwise(ONE_TIME)


def customers_checks(w: Warehouse) -> DataFrame:
    repeat = F.col("customer_type") == REPEAT
    return customers(w).agg(
        F.count("*").alias("total_customers"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
        F.sum("total_orders").alias("total_orders"),
        F.sum("total_items").alias("total_items"),
        F.sum("total_revenue").alias("total_revenue"),
        count_when(repeat).alias("repeat_customers"),
        count_when(~repeat).alias("one_time_customers"))


def _mart_totals(per_buyer: DataFrame, key: str) -> DataFrame:
    """From (key, buyer) rows to the key; each buyer is one row, so counting rows counts buyers."""
    return per_buyer.groupBy(key).agg(
        F.sum("items").alias("units_sold"),
        F.sum("orders").alias("total_orders"),
        F.count("*").alias("unique_customers"),
        money(F.sum("revenue_cents")).alias("total_revenue"),
        money(F.sum("freight_cents")).alias("total_freight"),
        ratio(money(F.sum("revenue_cents")), F.sum("items"), 6).alias("average"))


def _per_buyer(w: Warehouse, key: str, hub: DataFrame, buyer: str) -> DataFrame:
    """Item totals per (key, order), then per (key, buyer). Two distinct counts come
    out of plain sums, and a hot key is combined before each shuffle."""
    return item_totals(w.order_items, key, "order_id").join(hub, "order_id").groupBy(key, buyer).agg(
        F.count("*").alias("orders"),
        F.sum("items").alias("items"),
        F.sum("revenue_cents").alias("revenue_cents"),
        F.sum("freight_cents").alias("freight_cents"))


def products(w: Warehouse) -> DataFrame:
    """Grain: product. Buyers are counted by customer_id here, by person in ``sellers``."""
    hub = w.orders.filter(F.col("order_status") == "delivered").select("order_id", "customer_id")
    totals = _mart_totals(_per_buyer(w, "product_id", hub, "customer_id"), "product_id")
    named = w.products.select(
        "product_id", blank_to_null("product_category_name").alias("product_category"))
    return totals.join(named, "product_id").select(
        "product_id", "product_category", "units_sold", "total_orders", "total_revenue", "total_freight",
        F.col("average").alias("average_price"), "unique_customers")


def products_checks(w: Warehouse) -> DataFrame:
    """``total_order_product_combinations`` counts an order once per product in it."""
    return products(w).agg(
        F.count("*").alias("total_products"),
        F.sum("units_sold").alias("total_units_sold"),
        F.sum("total_orders").alias("total_order_product_combinations"),
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("total_freight").alias("total_freight"))


def sellers(w: Warehouse) -> DataFrame:
    """Grain: seller, with its place where the seller is known."""
    hub = delivered_hub(w, "order_id", "customer_unique_id")
    totals = _mart_totals(_per_buyer(w, "seller_id", hub, "customer_unique_id"), "seller_id")
    places = w.sellers.select("seller_id", "seller_city", "seller_state")
    return totals.join(places, "seller_id", "left").select(
        "seller_id", "seller_city", "seller_state", "units_sold", "total_orders", "unique_customers",
        "total_revenue", "total_freight", F.col("average").alias("average_item_price"))


def sellers_checks(w: Warehouse) -> DataFrame:
    return sellers(w).agg(
        F.count("*").alias("total_sellers"),
        F.sum("units_sold").alias("total_units_sold"),
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("total_freight").alias("total_freight"),
        count_when(F.col("seller_state").isNull()).alias("missing_state"))


def sellers_by_state(w: Warehouse) -> DataFrame:
    return sellers(w).groupBy("seller_state").agg(F.count("*").alias("sellers")).orderBy(
        F.col("sellers").desc(), "seller_state")


def payments(w: Warehouse) -> DataFrame:
    """Grain: payment record."""
    hub = delivered_hub(w, "order_id", "customer_unique_id", "order_purchase_timestamp")
    return w.payments.join(hub, "order_id").select(
        "order_id", "customer_unique_id", "order_purchase_timestamp", "payment_sequential",
        "payment_type", "payment_installments", "payment_value")


def payments_checks(w: Warehouse) -> DataFrame:
    hub = delivered_hub(w, "order_id", "customer_unique_id")
    per_order = w.payments.groupBy("order_id").agg(
        F.count("*").alias("n"), F.sum("payment_value").alias("value")).join(hub, "order_id")
    return per_order.agg(
        F.sum("n").alias("total_payment_records"),
        F.count("*").alias("total_orders"),
        F.count_distinct("customer_unique_id").alias("total_customers"),
        F.sum("value").alias("total_payment_value"))


def payments_by_type(w: Warehouse) -> DataFrame:
    return payments(w).groupBy("payment_type").agg(
        F.count("*").alias("payment_records"),
        F.count_distinct("order_id").alias("orders"),
        F.sum("payment_value").alias("total_payment_value"),
        mean("payment_value").alias("average_payment_value"),
    ).orderBy(F.col("total_payment_value").desc(), "payment_type")


def delivery(w: Warehouse) -> DataFrame:
    """Grain: delivered order with a delivery date. Days are calendar days."""
    arrived = F.col("order_delivered_customer_date")
    hub = delivered_hub(
        w, "order_id", "customer_unique_id", "customer_city", "customer_state", "order_purchase_timestamp",
        "order_estimated_delivery_date", "order_delivered_customer_date")
    return hub.filter(arrived.isNotNull()).select(
        "*",
        calendar_days(_PURCHASED, arrived).alias("delivery_days"),
        calendar_days("order_estimated_delivery_date", arrived).alias("delivery_delay_days"),
        delivery_status(missing_is_late=True).alias("delivery_status"))


def delivery_checks(w: Warehouse) -> DataFrame:
    days, delay = F.col("delivery_days"), F.col("delivery_delay_days")
    return delivery(w).agg(
        F.count("*").alias("total_delivered_orders"),
        F.count_distinct("order_id").alias("unique_orders"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
        mean(days).alias("avg_delivery_days"),
        F.min(days).alias("min_delivery_days"),
        F.max(days).alias("max_delivery_days"),
        mean(delay).alias("avg_delivery_delay_days"))


def _shares(groups: DataFrame, count: str, share: str) -> DataFrame:
    """Share of each group, the total taken as a scalar subquery over the groups."""
    total = groups.agg(F.sum(count)).scalar()
    return groups.withColumn(share, pct(F.col(count), total))


def delivery_by_status(w: Warehouse) -> DataFrame:
    groups = delivery(w).groupBy("delivery_status").agg(F.count("*").alias("orders"))
    return _shares(groups, "orders", "percentage")


def reviews(w: Warehouse) -> DataFrame:
    """Grain: review, keyed by (review_id, order_id)."""
    hub = delivered_hub(w, "order_id", "customer_unique_id", "customer_city", "customer_state",
                        "order_purchase_timestamp")
    return w.reviews.join(hub, "order_id").select(
        "review_id", "order_id", "customer_unique_id", "customer_city", "customer_state",
        "order_purchase_timestamp", "review_score", "review_comment_title", "review_comment_message",
        "review_creation_date", "review_answer_timestamp")


def reviews_checks(w: Warehouse) -> DataFrame:
    """Reviews are first counted per (order, review), so the pair count is a row count."""
    hub = delivered_hub(w, "order_id", "customer_unique_id")
    score = F.col("review_score")
    pairs = w.reviews.groupBy("order_id", "review_id").agg(
        F.count("*").alias("n"), F.count(score).alias("scores"), F.sum(score).alias("score"),
        F.min(score).alias("low"), F.max(score).alias("high"))
    orders = pairs.groupBy("order_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("pairs"), F.sum("scores").alias("scores"),
        F.sum("score").alias("score"), F.min("low").alias("low"), F.max("high").alias("high"))
    return orders.join(hub, "order_id").agg(
        F.sum("n").alias("total_review_records"),
        F.sum("pairs").alias("unique_review_order_records"),
        F.count("*").alias("reviewed_orders"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
        F.min("low").alias("min_score"),
        F.max("high").alias("max_score"),
        ratio(F.sum("score"), F.sum("scores")).alias("average_score"))


def reviews_by_score(w: Warehouse) -> DataFrame:
    groups = reviews(w).groupBy("review_score").agg(F.count("*").alias("review_records"))
    return _shares(groups, "review_records", "percentage").orderBy("review_score")


def monthly_sales(w: Warehouse) -> DataFrame:
    """Grain: month with sales. One row per (month, person) counts the people of a month."""
    hub = delivered_hub(w, "order_id", "customer_unique_id", month_start(_PURCHASED).alias("sales_month"))
    people = item_totals(w.order_items, "order_id").join(hub, "order_id").groupBy(
        "sales_month", "customer_unique_id").agg(
        F.count("*").alias("orders"), F.sum("items").alias("items"),
        F.sum("revenue_cents").alias("revenue_cents"), F.sum("freight_cents").alias("freight_cents"))
    revenue = money_total("revenue_cents")
    return people.groupBy("sales_month").agg(
        F.sum("orders").alias("total_orders"),
        F.sum("items").alias("total_items"),
        F.count("*").alias("unique_customers"),
        revenue.alias("total_revenue"),
        money_total("freight_cents").alias("total_freight"),
        ratio(revenue, F.sum("orders")).alias("average_order_value"))


def monthly_sales_first(w: Warehouse, n: int = 10) -> DataFrame:
    return top_n(monthly_sales(w), n, F.col("sales_month"))


def monthly_sales_checks(w: Warehouse) -> DataFrame:
    """A person buying in two months counts twice in ``sum_monthly_customers``."""
    return monthly_sales(w).agg(
        F.count("*").alias("total_months"),
        F.sum("total_orders").alias("total_orders"),
        F.sum("total_items").alias("total_items"),
        F.sum("unique_customers").alias("sum_monthly_customers"),
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("total_freight").alias("total_freight"))


def orders(w: Warehouse) -> DataFrame:
    """Grain: delivered order, the hub of the semantic model."""
    return delivered_hub(w, "order_id", F.to_date(_PURCHASED).alias("order_purchase_date"),
                         "customer_state", "customer_city")


def orders_checks(w: Warehouse) -> DataFrame:
    return orders(w).agg(
        F.count("*").alias("total_rows"), F.count_distinct("order_id").alias("distinct_orders"))


MARTS = {
    "vw_sales": sales,
    "vw_customers": customers,
    "vw_products": products,
    "vw_sellers": sellers,
    "vw_payments": payments,
    "vw_delivery": delivery,
    "vw_reviews": reviews,
    "vw_monthly_sales": monthly_sales,
    "vw_orders": orders,
}
