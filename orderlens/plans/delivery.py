"""Delivery analytics: every order with a delivery date, whatever its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import count_when, delivery_status, full_days, is_late, mean, ratio
from orderlens.operators.rollups import review_totals
from orderlens.plans.customers import with_share
from orderlens.warehouse import Warehouse

# Groups of delivery days.
TIME_GROUPS = ((0, 3, "0-3 days"), (4, 7, "4-7 days"), (8, 14, "8-14 days"), (15, 30, "15-30 days"))
SLOWEST_GROUP = "30+ days"


def _days() -> Column:
    return full_days("order_purchase_timestamp", "order_delivered_customer_date")


def _arrived(w: Warehouse) -> DataFrame:
    return w.orders.filter(F.col("order_delivered_customer_date").isNotNull())


def _estimated(w: Warehouse) -> DataFrame:
    return _arrived(w).filter(F.col("order_estimated_delivery_date").isNotNull())


def time_stats(w: Warehouse) -> DataFrame:
    return _arrived(w).agg(
        F.count("*").alias("delivered_orders"),
        mean(_days()).alias("avg_delivery_days"),
        F.min(_days()).alias("fastest_delivery_days"),
        F.max(_days()).alias("slowest_delivery_days"),
    )


def time_groups(w: Warehouse) -> DataFrame:
    """Negative days fall into a null group, listed first."""
    days, rank, label = F.col("days"), F, F
    for position, (low, high, name) in enumerate(TIME_GROUPS, 1):
        rank = rank.when(days.between(low, high), position)
        label = label.when(days.between(low, high), name)
    rank = rank.when(days > TIME_GROUPS[-1][1], len(TIME_GROUPS) + 1)
    label = label.when(days > TIME_GROUPS[-1][1], SLOWEST_GROUP)
    groups = _arrived(w).select(_days().alias("days")).groupBy(
        rank.alias("rank"), label.alias("delivery_time_group")).agg(F.count("*").alias("order_count"))
    return with_share(groups, "order_count", "order_share_pct").orderBy(
        F.col("rank").asc_nulls_first()).drop("rank")


def ontime_late(w: Warehouse) -> DataFrame:
    groups = _estimated(w).groupBy(delivery_status(missing_is_late=False).alias("delivery_status")).agg(
        F.count("*").alias("order_count"))
    return with_share(groups, "order_count", "order_share_pct").orderBy(
        F.col("order_count").desc(), "delivery_status")


def days_late(w: Warehouse) -> DataFrame:
    days = full_days("order_estimated_delivery_date", "order_delivered_customer_date")
    return w.orders.filter(is_late()).agg(
        F.count("*").alias("late_orders"),
        mean(days).alias("avg_days_late"),
        F.min(days).alias("min_days_late"),
        F.max(days).alias("max_days_late"),
    )


def reviews(w: Warehouse) -> DataFrame:
    scored = _estimated(w).select(
        "order_id", delivery_status(missing_is_late=False).alias("delivery_status"),
    ).join(review_totals(w.reviews).filter(F.col("reviews") > 0), "order_id")
    return scored.groupBy("delivery_status").agg(
        F.count("*").alias("order_count"),
        ratio(F.sum("score"), F.sum("reviews")).alias("avg_review_score"),
    ).orderBy(F.col("order_count").desc(), "delivery_status")


def null_timespan(w: Warehouse) -> DataFrame:
    """Orders with a delivery date but no day difference; none in a typed load."""
    return _arrived(w).agg(count_when(_days().isNull()).alias("null_delivery_days"))
