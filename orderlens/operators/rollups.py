"""Aggregates that shrink a fact to the grain of its join key before the join.

Each is a map-side combined groupBy, so a key holding a large part of all rows
turns into one row per map task instead of one oversized join partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import cents_sum, is_delivered, money, ratio
from orderlens.warehouse import Warehouse


def item_totals(items: DataFrame, *keys: str) -> DataFrame:
    """Items, revenue and freight per key, the amounts in cents."""
    return items.groupBy(*keys).agg(
        F.count("*").alias("items"),
        cents_sum("price").alias("revenue_cents"),
        cents_sum("freight_value").alias("freight_cents"),
    )


def review_totals(reviews: DataFrame) -> DataFrame:
    """Per order: number of reviews, score sum and average with four decimals."""
    return (
        reviews.groupBy("order_id")
        .agg(F.count("review_score").alias("reviews"), F.sum("review_score").alias("score"))
        .withColumn("order_review", ratio(F.col("score"), F.col("reviews"), 4).cast("decimal(14,4)"))
    )


def order_totals(w: Warehouse, delivered_only: bool) -> DataFrame:
    """One row per order that has items: customer, purchase time and item totals."""
    orders = w.orders.filter(is_delivered()) if delivered_only else w.orders
    return item_totals(w.order_items, "order_id").join(
        orders.select("order_id", "customer_id", "order_purchase_timestamp"), "order_id")


def to_people(w: Warehouse, per_customer: DataFrame, *aggregates: Column, place: bool = False) -> DataFrame:
    """Sum per-customer_id rows up to the person behind them."""
    columns = ["customer_id", "customer_unique_id"] + (["customer_city", "customer_state"] if place else [])
    return per_customer.join(w.customers.select(*columns), "customer_id").groupBy(
        "customer_unique_id").agg(*aggregates)


def people_totals(w: Warehouse, delivered_only: bool, place: bool = False,
                  latest_place: bool = False) -> DataFrame:
    """Per person: orders, items, revenue, freight, first and last purchase.

    With ``place`` also city and state: each the maximum on its own, or with
    ``latest_place`` both from the customer record used for the last purchase.
    """
    per_customer = order_totals(w, delivered_only).groupBy("customer_id").agg(
        F.count("*").alias("orders"),
        F.sum("items").alias("items"),
        F.sum("revenue_cents").alias("revenue_cents"),
        F.sum("freight_cents").alias("freight_cents"),
        F.min("order_purchase_timestamp").alias("first"),
        F.max("order_purchase_timestamp").alias("last"),
    )
    where = []
    if latest_place:
        latest = F.max(F.struct("last", "customer_city", "customer_state"))
        where = [latest[name].alias(name) for name in ("customer_city", "customer_state")]
    elif place:
        where = [F.max(name).alias(name) for name in ("customer_city", "customer_state")]
    return to_people(
        w, per_customer, *where,
        F.sum("orders").alias("orders"),
        F.sum("items").alias("items"),
        money(F.sum("revenue_cents")).alias("revenue"),
        money(F.sum("freight_cents")).alias("freight"),
        F.min("first").alias("first_purchase_date"),
        F.max("last").alias("last_purchase_date"),
        place=place or latest_place,
    )


def delivered_hub(w: Warehouse, *columns: str) -> DataFrame:
    """Delivered orders with their customer: the register all facts join to."""
    return w.orders.filter(is_delivered()).join(w.customers, "customer_id").select(*columns)
