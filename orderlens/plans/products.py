"""Product and category analytics over all order statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import mean, money, money_sum, pct, ratio, wide
from orderlens.operators.joins import splittable_join
from orderlens.operators.ranking import top_n
from orderlens.operators.rollups import item_totals, review_totals
from orderlens.warehouse import Warehouse

_CATEGORY = "product_category_name"


def _categories(w: Warehouse) -> DataFrame:
    return w.products.select("product_id", _CATEGORY)


def _per_product(w: Warehouse) -> DataFrame:
    return item_totals(w.order_items, "product_id").select(
        "product_id", F.col("items").alias("units_sold"), money("revenue_cents").alias("revenue"))


def _price() -> Column:
    return ratio("revenue", "units_sold").alias("avg_selling_price")


def _by_revenue(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(F.col("revenue").desc(), *keys)


def units(w: Warehouse) -> DataFrame:
    return w.order_items.groupBy("product_id").agg(F.count("*").alias("units_sold")).orderBy(
        F.col("units_sold").desc(), "product_id")


def units_with_category(w: Warehouse) -> DataFrame:
    per_product = w.order_items.groupBy("product_id").agg(F.count("*").alias("units_sold"))
    return per_product.join(_categories(w), "product_id").select(
        "product_id", _CATEGORY, "units_sold").orderBy(F.col("units_sold").desc(), "product_id")


def revenue_top10(w: Warehouse, n: int = 10) -> DataFrame:
    per_product = w.order_items.groupBy("product_id").agg(money_sum("price").alias("revenue"))
    return top_n(per_product, n, F.col("revenue").desc(), F.col("product_id"))


def units_revenue_price(w: Warehouse) -> DataFrame:
    return _by_revenue(_per_product(w).select("product_id", "units_sold", "revenue", _price()), "product_id")


def category_sales(w: Warehouse) -> DataFrame:
    per_category = _per_product(w).join(_categories(w), "product_id").groupBy(_CATEGORY).agg(
        F.sum("units_sold").alias("units_sold"), F.sum("revenue").alias("revenue"))
    return _by_revenue(per_category.select(_CATEGORY, "units_sold", "revenue", _price()), _CATEGORY)


def _reviewed(w: Warehouse, how: str = "inner") -> DataFrame:
    """Item totals per (order, product) beside the review totals of the order.

    One review row per order meets the items, so the pairs an order's reviews and
    items would form are never built; their sums follow by multiplication.
    """
    return splittable_join(item_totals(w.order_items, "order_id", "product_id"), review_totals(w.reviews), "order_id", how)


def category_reviews_fanout(w: Warehouse) -> DataFrame:
    """Items counted once per review of their order, as a plain join on the order does."""
    per_product = _reviewed(w).groupBy("product_id").agg(
        F.sum(wide("items") * F.col("reviews")).alias("units_sold"),
        money(F.sum(F.col("revenue_cents") * F.col("reviews"))).alias("revenue"),
        F.sum(wide("items") * F.col("score")).alias("score"),
    )
    per_category = per_product.join(_categories(w), "product_id").groupBy(_CATEGORY).agg(
        F.sum("units_sold").cast("long").alias("units_sold"),
        F.sum("revenue").alias("revenue"),
        ratio(F.sum("score"), F.sum("units_sold")).alias("avg_review_score"),
    )
    return _by_revenue(per_category, _CATEGORY)


def category_reviews(w: Warehouse) -> DataFrame:
    """Items of reviewed orders counted once, weighted with the order's average review."""
    per_product = _reviewed(w).groupBy("product_id").agg(
        F.sum("items").alias("units_sold"),
        money(F.sum("revenue_cents")).alias("revenue"),
        F.sum(wide("items") * F.col("order_review")).alias("score"),
    )
    per_category = per_product.join(_categories(w), "product_id").groupBy(_CATEGORY).agg(
        F.sum("units_sold").alias("units_sold"),
        F.sum("revenue").alias("revenue"),
        ratio(F.sum("score"), F.sum("units_sold")).alias("avg_review_score"),
    )
    return _by_revenue(per_category, _CATEGORY)


def top10_units_revenue(w: Warehouse, n: int = 10) -> DataFrame:
    return top_n(_per_product(w).select("product_id", "units_sold", "revenue"), n,
                 F.col("revenue").desc(), F.col("product_id"))


def total_revenue(w: Warehouse) -> DataFrame:
    return w.order_items.agg(F.sum("price").alias("total_revenue"))


def top10_share(w: Warehouse, n: int = 10) -> DataFrame:
    top = revenue_top10(w, n).agg(F.sum("revenue").alias("top_10_revenue"))
    return top.select(
        "top_10_revenue", total_revenue(w).scalar().alias("total_revenue"),
    ).withColumn("top_10_revenue_share_pct", pct("top_10_revenue", "total_revenue"))


def _performance(w: Warehouse) -> DataFrame:
    """Units, revenue and reviews per product; items repeat per review, and items
    of orders without a review count once."""
    reviews = F.coalesce("reviews", F.lit(0))
    times = F.greatest(reviews, F.lit(1))
    return _reviewed(w, "left").groupBy("product_id").agg(
        F.sum(wide("items") * times).alias("units_sold"),
        money(F.sum(F.col("revenue_cents") * times)).alias("revenue"),
        F.sum(wide("items") * F.coalesce("score", F.lit(0))).alias("score"),
        F.sum(wide("items") * reviews).alias("scores"),
    ).select(
        "product_id",
        F.col("units_sold").cast("long").alias("units_sold"),
        "revenue",
        ratio("score", "scores").alias("avg_review_score"),
        ratio("score", "scores", 4).alias("review"),
    )


def reviews_left(w: Warehouse) -> DataFrame:
    return _by_revenue(_performance(w).drop("review"), "product_id")


def baseline(w: Warehouse) -> DataFrame:
    """Averages over products."""
    return _performance(w).agg(
        mean("units_sold").alias("avg_units_sold"),
        mean("revenue").alias("avg_revenue"),
        mean("review").alias("avg_review_score"),
    )


def _against_baseline(w: Warehouse) -> tuple[DataFrame, Column, Column, Column]:
    """Products with three tests against the unrounded averages, taken as one scalar row."""
    products = _performance(w)
    base = products.agg(F.struct(
        mean("units_sold", 12).alias("units"),
        mean("revenue", 12).alias("revenue"),
        mean("review", 12).alias("review"),
    ).alias("base"))
    compared = products.withColumn("base", base.scalar())
    return (
        compared,
        F.col("units_sold") > F.col("base.units"),
        F.col("revenue") > F.col("base.revenue"),
        F.col("review") >= F.col("base.review"),
    )


def labels(w: Warehouse) -> DataFrame:
    """Each product above or below the averages; no review counts as weak."""
    compared, volume, revenue, reviews = _against_baseline(w)
    return _by_revenue(compared.select(
        "product_id", "units_sold", "revenue", "avg_review_score",
        F.when(volume, "High Volume").otherwise("Low Volume").alias("volume_category"),
        F.when(revenue, "High Revenue").otherwise("Low Revenue").alias("revenue_category"),
        F.when(reviews, "Strong Reviews").otherwise("Weak Reviews").alias("review_category"),
    ), "product_id")


def performance(w: Warehouse) -> DataFrame:
    """One class per product. Products without a review match no review test."""
    compared, volume, revenue, reviews = _against_baseline(w)
    both = F.when(reviews, "Best Performer").when(~reviews, "Revenue & Review Concern")
    neither = F.when(~reviews, "Potential Underperformer")
    label = (
        F.when(volume & revenue, both)
        .when(volume, F.lit("High Volume / Low Revenue"))
        .when(revenue, F.lit("Low Volume / High Revenue"))
        .otherwise(neither)
    )
    return _by_revenue(compared.select(
        "product_id", "units_sold", "revenue", "avg_review_score",
        F.coalesce(label, F.lit("Average Performer")).alias("performance_category"),
    ), "product_id")
