"""Executive KPIs.

The first two take delivered orders and count freight into revenue; the payment,
review, repeat and cancellation KPIs take every order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions import (
    CANCELED, count_when, full_days, is_delivered, is_late, mean, money_total, month_start, pct,
    ratio,
)
from orderlens.operators.calendar import month_calendar
from orderlens.operators.ranking import top_n
from orderlens.operators.rollups import item_totals, order_totals, to_people
from orderlens.warehouse import Warehouse

_PURCHASED = "order_purchase_timestamp"
_DELIVERED_AT = "order_delivered_customer_date"


def _gross() -> Column:
    return money_total(F.col("revenue_cents") + F.col("freight_cents"))


def overall(w: Warehouse) -> DataFrame:
    """Headline totals, customers counted by customer_id."""
    gross, orders = _gross(), F.count("*")
    return order_totals(w, delivered_only=True).agg(
        orders.alias("total_orders"),
        F.count_distinct("customer_id").alias("total_customers"),
        F.sum("items").alias("total_items_sold"),
        gross.alias("total_revenue"),
        ratio(gross, orders).alias("average_order_value"),
    )


def _monthly(w: Warehouse) -> DataFrame:
    return (
        order_totals(w, delivered_only=True)
        .groupBy(month_start(_PURCHASED).alias("month_start"))
        .agg(F.count("*").alias("total_orders"), _gross().alias("revenue"))
    )


def _with_growth(monthly: DataFrame) -> DataFrame:
    """Order value and month-over-month growth; the rows are one per month."""
    previous = F.lag("revenue").over(Window.orderBy("month_start"))
    return monthly.withColumn("previous", previous).select(
        F.date_format("month_start", "yyyy-MM").alias("sales_month"),
        "total_orders",
        "revenue",
        ratio("revenue", "total_orders").alias("average_order_value"),
        pct(F.col("revenue") - F.col("previous"), F.col("previous")).alias("mom_growth_pct"),
    ).orderBy("sales_month")


def _filled(w: Warehouse) -> DataFrame:
    """Every calendar month of all orders, months without delivered orders as zero."""
    return month_calendar(w.orders).join(_monthly(w), "month_start", "left").select(
        "month_start",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("revenue", F.lit(0)).alias("revenue"),
    )


def monthly_growth(w: Warehouse) -> DataFrame:
    """Growth between the months that have sales."""
    return _with_growth(_monthly(w))


def months(w: Warehouse) -> DataFrame:
    return month_calendar(w.orders).select(
        F.date_format("month_start", "yyyy-MM").alias("sales_month")).orderBy("sales_month")


def monthly_filled(w: Warehouse) -> DataFrame:
    return _filled(w).select(
        F.date_format("month_start", "yyyy-MM").alias("sales_month"), "total_orders", "revenue",
    ).orderBy("sales_month")


def monthly_full(w: Warehouse) -> DataFrame:
    """Growth over the gap-free calendar; null after a month without revenue."""
    return _with_growth(_filled(w))


def _person_orders(w: Warehouse) -> DataFrame:
    per_customer = w.orders.groupBy("customer_id").agg(F.count("*").alias("n"))
    return to_people(w, per_customer, F.sum("n").alias("order_count"))


def most_orders(w: Warehouse, n: int = 20) -> DataFrame:
    return top_n(_person_orders(w), n, F.col("order_count").desc(), F.col("customer_unique_id"))


def order_frequency(w: Warehouse, n: int = 5) -> DataFrame:
    counts = _person_orders(w).groupBy("order_count").agg(F.count("*").alias("customer_count"))
    return top_n(counts, n, F.col("order_count"))


def repeat_rate(w: Warehouse) -> DataFrame:
    repeat, people = count_when(F.col("order_count") >= 2), F.count("*")
    return _person_orders(w).agg(
        people.alias("total_customers"),
        repeat.alias("repeat_customers"),
        pct(repeat, people).alias("repeat_customer_rate_pct"),
    )


def _per_order(orders: DataFrame, condition: Column, *sums: Column) -> DataFrame:
    """One row per order, as keys are not enforced: whether any of its rows meets the condition, and sums over its rows."""
    return orders.groupBy("order_id").agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("met"), *sums)


def cancellation(w: Warehouse) -> DataFrame:
    orders, canceled = F.count("*"), count_when(F.col("met"))
    return _per_order(w.orders, F.col("order_status") == CANCELED).agg(
        orders.alias("total_orders"),
        canceled.alias("cancelled_orders"),
        pct(canceled, orders).alias("cancellation_rate_pct"),
    )


def _arrived(w: Warehouse, with_estimate: bool) -> DataFrame:
    arrived = w.orders.filter(is_delivered() & F.col(_DELIVERED_AT).isNotNull())
    if with_estimate:
        arrived = arrived.filter(F.col("order_estimated_delivery_date").isNotNull())
    return arrived


def delivery_days(w: Warehouse) -> DataFrame:
    return _arrived(w, with_estimate=False).agg(
        F.count("*").alias("delivered_orders"),
        mean(full_days(_PURCHASED, _DELIVERED_AT), 0).alias("avg_delivery_days"),
    )


def late_rate(w: Warehouse) -> DataFrame:
    orders, late = F.count("*"), count_when(F.col("met"))
    return _per_order(_arrived(w, with_estimate=True), is_late()).agg(
        orders.alias("delivered_orders"),
        late.alias("late_orders"),
        pct(late, orders).alias("late_delivery_rate_pct"),
    )


def delivery_combined(w: Warehouse) -> DataFrame:
    orders, late, days = F.count("*"), count_when(F.col("met")), full_days(_PURCHASED, _DELIVERED_AT)
    arrived = _per_order(_arrived(w, with_estimate=True), is_late(), F.sum(days).alias("days"), F.count(days).alias("n"))
    return arrived.agg(
        orders.alias("delivered_orders"),
        ratio(F.sum("days"), F.sum("n")).alias("avg_delivery_days"),
        late.alias("late_orders"),
        pct(late, orders).alias("late_delivery_rate_pct"),
    )


def satisfaction(w: Warehouse) -> DataFrame:
    score, reviews = F.col("review_score"), F.count("*")
    positive, negative = count_when(score.isin(4, 5)), count_when(score.isin(1, 2))
    return w.reviews.agg(
        reviews.alias("total_reviews"),
        mean(score).alias("avg_review_score"),
        positive.alias("positive_reviews"),
        pct(positive, reviews).alias("positive_review_rate_pct"),
        negative.alias("negative_reviews"),
        pct(negative, reviews).alias("negative_review_rate_pct"),
    )


def payment_types(w: Warehouse) -> DataFrame:
    return w.payments.groupBy("payment_type").agg(
        F.count_distinct("order_id").alias("orders"),
        F.sum("payment_value").alias("total_payment_value"),
        mean("payment_value").alias("avg_payment_value"),
    ).orderBy(F.col("total_payment_value").desc(), "payment_type")


def average_order_value(w: Warehouse) -> DataFrame:
    orders, sales = F.count("*"), money_total("revenue_cents")
    return item_totals(w.order_items, "order_id").agg(
        orders.alias("total_orders"),
        sales.alias("total_product_sales"),
        ratio(sales, orders).alias("average_order_value"),
    )
