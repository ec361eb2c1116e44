"""Seller analytics over all order statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import money, money_sum, pct, ratio, wide
from orderlens.operators.joins import splittable_join
from orderlens.operators.ranking import top_n
from orderlens.operators.rollups import item_totals, review_totals
from orderlens.plans.products import total_revenue
from orderlens.warehouse import Warehouse

_CATEGORY = "product_category_name"


def _sales(w: Warehouse) -> DataFrame:
    return item_totals(w.order_items, "seller_id", "order_id").groupBy("seller_id").agg(
        F.count("*").alias("orders_handled"),
        F.sum("items").alias("units_sold"),
        money(F.sum("revenue_cents")).alias("revenue"),
    )


def top10(w: Warehouse, n: int = 10) -> DataFrame:
    return top_n(_sales(w), n, F.col("revenue").desc(), F.col("seller_id"))


def avg_price(w: Warehouse) -> DataFrame:
    return _sales(w).withColumn(
        "avg_selling_price", ratio("revenue", "units_sold"),
    ).orderBy(F.col("revenue").desc(), "seller_id")


def reviews(w: Warehouse) -> DataFrame:
    """Reviewed orders only, each item weighted with its order's average review."""
    reviewed = splittable_join(item_totals(w.order_items, "seller_id", "order_id"), review_totals(w.reviews), "order_id")
    return reviewed.groupBy("seller_id").agg(
        F.count("*").alias("orders_handled"),
        F.sum("items").alias("units_sold"),
        money(F.sum("revenue_cents")).alias("revenue"),
        ratio(F.sum(wide("items") * F.col("order_review")), F.sum("items")).alias("avg_review_score"),
    ).orderBy(F.col("revenue").desc(), "seller_id")


def _revenue(w: Warehouse) -> DataFrame:
    return w.order_items.groupBy("seller_id").agg(money_sum("price").alias("revenue"))


def revenue_top10(w: Warehouse, n: int = 10) -> DataFrame:
    return top_n(_revenue(w), n, F.col("revenue").desc(), F.col("seller_id"))


def top10_share(w: Warehouse, n: int = 10) -> DataFrame:
    top = revenue_top10(w, n).agg(F.sum("revenue").alias("top"))
    return top.select(pct("top", total_revenue(w).scalar()).alias("top_10_revenue_share_pct"))


def _by_category(w: Warehouse) -> DataFrame:
    pairs = item_totals(w.order_items, "seller_id", "product_id")
    return pairs.join(w.products.select("product_id", _CATEGORY), "product_id").groupBy(
        "seller_id", _CATEGORY).agg(
        F.sum("items").alias("units_sold"), money(F.sum("revenue_cents")).alias("revenue"))


def by_category(w: Warehouse) -> DataFrame:
    return _by_category(w).orderBy(F.col("revenue").desc(), "seller_id", _CATEGORY)


def specialisation(w: Warehouse) -> DataFrame:
    """Share of each category in its seller's revenue.

    Seller totals come from a second aggregate rather than a window, so a seller
    with very many rows is never sorted inside one task.
    """
    pairs = _by_category(w).drop("units_sold")
    totals = pairs.groupBy("seller_id").agg(F.sum("revenue").alias("total_revenue"))
    return pairs.join(totals, "seller_id").select(
        "seller_id", _CATEGORY,
        F.col("revenue").alias("category_revenue"),
        "total_revenue",
        pct("revenue", "total_revenue").alias("category_revenue_share"),
    ).orderBy(F.col("category_revenue_share").desc(), "seller_id", _CATEGORY)
