"""Customer analytics over all order statuses, for people whose orders have items."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions import calendar_days, pct, ratio
from orderlens.operators.ranking import ntile_distributed
from orderlens.operators.rollups import people_totals
from orderlens.session import materialize
from orderlens.warehouse import Warehouse

_ID = "customer_unique_id"

# Frequency scores by number of orders (from, to, score).
FREQUENCY_STEPS = ((1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 5, 4), (6, None, 5))
# Segments by recency, frequency and monetary score (from, to); the first that fits counts.
SEGMENTS = (
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal Customers", (4, 5), (4, 5), (1, 5)),
    ("Big Spenders", (4, 5), (1, 5), (4, 5)),
    ("Recent Customers", (4, 5), (1, 2), (1, 5)),
    ("At Risk", (1, 2), (3, 5), (1, 5)),
    ("At Risk", (1, 2), (1, 5), (3, 5)),
)
OTHER_SEGMENT = "Lost / Low Value"

# Segment names and limits.
RECENCY_SEGMENTS = (("0-90 days", 90), ("91-180 days", 180), ("181-365 days", 365), ("366-730 days", 730))
OLDEST_SEGMENT = "731+ days"
RECENT_DAYS = 180


def profile(w: Warehouse) -> DataFrame:
    return _profile(w).orderBy(F.col("order_count").desc(), _ID)


def _profile(w: Warehouse) -> DataFrame:
    return people_totals(w, delivered_only=False).select(
        _ID,
        F.col("orders").alias("order_count"),
        F.col("revenue").alias("total_spent"),
        ratio("revenue", "orders").alias("avg_order_value"),
        "first_purchase_date",
        "last_purchase_date",
    )


def order_frequency(w: Warehouse) -> DataFrame:
    return _profile(w).groupBy("order_count").agg(
        F.count("*").alias("customer_count")).orderBy("order_count")


def latest_date(w: Warehouse) -> DataFrame:
    return w.orders.agg(F.max("order_purchase_timestamp").alias("latest_date"))


def _recency(w: Warehouse, anchor: datetime.date | None) -> Column:
    """Days from the last purchase to the anchor, by default the day of the latest order."""
    day = F.lit(anchor) if anchor else F.to_date(latest_date(w).scalar())
    return calendar_days("last_purchase_date", day).alias("recency_days")


def recency(w: Warehouse, anchor: datetime.date | None = None) -> DataFrame:
    return _profile(w).select("*", _recency(w, anchor)).orderBy("recency_days", _ID)


def with_share(groups: DataFrame, count: str, share: str) -> DataFrame:
    """Share of each group in the total. For results of a handful of groups only."""
    return groups.withColumn(share, pct(F.col(count), F.sum(count).over(Window.partitionBy())))


def recency_segments(w: Warehouse, anchor: datetime.date | None = None) -> DataFrame:
    days, rank, label = F.col("recency_days"), F, F
    for position, (name, limit) in enumerate(RECENCY_SEGMENTS, 1):
        rank = rank.when(days <= limit, position)
        label = label.when(days <= limit, name)
    groups = (
        _profile(w).select(_recency(w, anchor))
        .groupBy(rank.otherwise(len(RECENCY_SEGMENTS) + 1).alias("rank"),
                 label.otherwise(OLDEST_SEGMENT).alias("recency_segment"))
        .agg(F.count("*").alias("customer_count"))
    )
    return with_share(groups, "customer_count", "customer_share_pct").orderBy("rank").drop("rank")


def recency_frequency(w: Warehouse, anchor: datetime.date | None = None) -> DataFrame:
    age = F.when(F.col("recency_days") <= RECENT_DAYS, "Recent").otherwise("Old")
    habit = F.when(F.col("order_count") > 1, "Repeat").otherwise("One-time")
    groups = (
        _profile(w).select("order_count", _recency(w, anchor))
        .groupBy(F.concat_ws(" + ", age, habit).alias("customer_segment"))
        .agg(F.count("*").alias("customer_count"))
    )
    return with_share(groups, "customer_count", "customer_share_pct").orderBy(
        F.col("customer_count").desc(), "customer_segment")


def monetary(w: Warehouse) -> DataFrame:
    return _profile(w).select(_ID, "order_count", "total_spent").orderBy(F.col("total_spent").desc(), _ID)


def rfm_scores(w: Warehouse, anchor: datetime.date | None = None) -> DataFrame:
    """Recency and spend in fifths (best is 5), frequency by fixed steps.

    Each score is numbered over what it needs alone; both are joined once.
    """
    people = materialize(_profile(w).select(
        _ID, _recency(w, anchor), F.col("order_count").alias("frequency"), F.col("total_spent").alias("monetary")), "rfm-people")
    recency = ntile_distributed(people.select(_ID, "recency_days"), [F.col("recency_days").desc(), F.col(_ID)], 5, "r_score")
    spend = ntile_distributed(people.select(_ID, "frequency", "monetary"), [F.col("monetary").asc(), F.col(_ID)], 5, "m_score")
    orders, steps = F.col("frequency"), F
    for low, high, score in FREQUENCY_STEPS:
        steps = steps.when(orders.between(low, high) if high else orders >= low, score)
    return recency.join(spend, _ID).select(
        _ID, "recency_days", "frequency", "monetary", "r_score", steps.cast("int").alias("f_score"), "m_score")


def _segment() -> Column:
    segment = F
    for name, *limits in SEGMENTS:
        fits = [F.col(score).between(*limit) for score, limit in zip(("r_score", "f_score", "m_score"), limits)]
        segment = segment.when(fits[0] & fits[1] & fits[2], name)
    return segment.otherwise(OTHER_SEGMENT)


def rfm_segments(w: Warehouse, anchor: datetime.date | None = None) -> DataFrame:
    return rfm_scores(w, anchor).withColumn("customer_segment", _segment())


def rfm_segment_summary(w: Warehouse, anchor: datetime.date | None = None) -> DataFrame:
    groups = rfm_segments(w, anchor).groupBy("customer_segment").agg(F.count("*").alias("customer_count"))
    return with_share(groups, "customer_count", "customer_share_pct").orderBy(
        F.col("customer_count").desc(), "customer_segment")
