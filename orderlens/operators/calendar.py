"""Gap-free calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import month_start


def month_calendar(orders: DataFrame, name: str = "month_start") -> DataFrame:
    """Every month from the first to the last order, as first-of-month dates."""
    when = F.col("order_purchase_timestamp")
    span = orders.agg(month_start(F.min(when)).alias("lo"), month_start(F.max(when)).alias("hi"))
    return span.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias(name))


def date_dim(orders: DataFrame) -> DataFrame:
    """One row per day from the first to the last order."""
    day = F.to_date("order_purchase_timestamp")
    span = orders.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date")).select(
        "date", month_start(F.col("date")).alias("month_start"))
