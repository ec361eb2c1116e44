"""Cohorts, concentration, rankings and running totals over delivered orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions import (
    is_delivered, mean, money, money_total, month_start, months_between_starts, pct, ratio,
)
from orderlens.operators.calendar import month_calendar
from orderlens.operators.ranking import ntile_distributed, top_n, top_ranks
from orderlens.operators.rollups import item_totals, order_totals, people_totals, to_people
from orderlens.warehouse import Warehouse

_ID = "customer_unique_id"
_PURCHASED = "order_purchase_timestamp"


def first_purchase(w: Warehouse) -> DataFrame:
    """Per customer_id, which stands for a single order in the original data."""
    return w.orders.filter(is_delivered()).groupBy("customer_id").agg(
        F.min(_PURCHASED).alias("first_purchase_date"))


def cohort_retention(w: Warehouse) -> DataFrame:
    """Share of each monthly cohort active k months after its first purchase.

    A person is reduced to the set of months with a purchase, which is bounded by
    the calendar, so no person's orders are gathered. The cohort size is the
    activity in month 0.
    """
    per_customer = w.orders.filter(is_delivered()).groupBy("customer_id").agg(
        F.collect_set(month_start(_PURCHASED)).alias("months"))
    by_month = per_customer.select("customer_id", F.explode("months").alias("month"))
    people = to_people(w, by_month, F.collect_set("month").alias("months"))
    active = people.select(F.array_min("months").alias("cohort_month"), F.explode("months").alias("month"))
    counts = active.groupBy(
        "cohort_month",
        months_between_starts(F.col("month"), F.col("cohort_month")).alias("months_since_first_purchase"),
    ).agg(F.count("*").alias("active_customers"))
    size = F.max(F.when(F.col("months_since_first_purchase") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month"))
    return counts.select("*", size.alias("cohort_size")).withColumn(
        "retention_rate_pct", pct("active_customers", "cohort_size"),
    ).orderBy("cohort_month", "months_since_first_purchase")


def _revenue_buckets(w: Warehouse, buckets: int, name: str) -> DataFrame:
    people = people_totals(w, delivered_only=True).select(_ID, "revenue")
    return ntile_distributed(people, [F.col("revenue").asc(), F.col(_ID)], buckets, name)


def _revenue_share(revenue: Column) -> Column:
    return pct(revenue, F.sum(revenue).over(Window.partitionBy())).alias("revenue_share_pct")


def pareto_deciles(w: Warehouse) -> DataFrame:
    groups = _revenue_buckets(w, 10, "revenue_decile").groupBy("revenue_decile").agg(
        F.count("*").alias("customer_count"), F.sum("revenue").alias("decile_revenue"))
    return groups.select("*", _revenue_share(F.col("decile_revenue"))).orderBy("revenue_decile")


def value_quartiles(w: Warehouse) -> DataFrame:
    groups = _revenue_buckets(w, 4, "revenue_quartile").groupBy("revenue_quartile").agg(
        F.count("*").alias("customer_count"),
        F.sum("revenue").alias("total_revenue"),
        mean("revenue").alias("avg_customer_revenue"),
    )
    return groups.select("*", _revenue_share(F.col("total_revenue"))).orderBy("revenue_quartile")


def seller_rank_in_category(w: Warehouse, ranks: int = 3) -> DataFrame:
    delivered = w.orders.filter(is_delivered()).select("order_id")
    sold = item_totals(w.order_items.join(delivered, "order_id", "left_semi"), "seller_id", "product_id")
    named = w.products.filter(F.col("product_category_name").isNotNull()).select(
        "product_id", F.col("product_category_name").alias("category"))
    pairs = sold.join(named, "product_id").groupBy("seller_id", "category").agg(
        money(F.sum("revenue_cents")).alias("total_revenue"))
    ranked = top_ranks(pairs, "category", "total_revenue", "seller_id", ranks, "seller_rank")
    return ranked.select("seller_id", "category", "total_revenue", "seller_rank").orderBy(
        "category", "seller_rank", "seller_id")


def _monthly_revenue(w: Warehouse) -> DataFrame:
    return order_totals(w, delivered_only=True).groupBy(month_start(_PURCHASED).alias("month")).agg(
        money_total("revenue_cents").alias("monthly_revenue"))


def _running(monthly: DataFrame) -> DataFrame:
    """Windows over one row per month."""
    months = Window.orderBy("month")
    recent = months.rowsBetween(-2, 0)
    return monthly.select(
        "month",
        "monthly_revenue",
        F.sum("monthly_revenue").over(months.rowsBetween(Window.unboundedPreceding, 0)).alias("running_revenue"),
        ratio(F.sum("monthly_revenue").over(recent), F.count("*").over(recent)).alias("moving_avg_3_months"),
    ).orderBy("month")


def running_and_moving(w: Warehouse) -> DataFrame:
    """The average runs over the last three months that have revenue."""
    return _running(_monthly_revenue(w))


def running_and_moving_gapsafe(w: Warehouse) -> DataFrame:
    """The average runs over the last three calendar months."""
    filled = month_calendar(w.orders, "month").join(_monthly_revenue(w), "month", "left")
    return _running(filled.select("month", F.coalesce("monthly_revenue", F.lit(0)).alias("monthly_revenue")))


def _customer_revenue(w: Warehouse) -> DataFrame:
    return people_totals(w, delivered_only=True).select(_ID, F.col("revenue").alias("total_revenue"))


def customer_revenue(w: Warehouse) -> DataFrame:
    return _customer_revenue(w).orderBy(F.col("total_revenue").desc(), _ID)


def customer_revenue_top10(w: Warehouse, n: int = 10) -> DataFrame:
    return top_n(_customer_revenue(w), n, F.col("total_revenue").desc(), F.col(_ID))
