"""The nine contract tables derived from an order/line-item star schema in Parquet.

All columns are projections of the given tables, so a query that needs three of
them reads three of them. Whole tables are used: no row is left out, except that
some orders have no review and some have no delivery date, as in a real shop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.warehouse import Warehouse

_MONEY = "decimal(12,2)"


# The given tables' columns. Stating them saves a footer-reading job per table.
_GIVEN = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


def read_star_schema(spark: SparkSession, folder: str) -> Warehouse:
    def read(name: str) -> DataFrame:
        return spark.read.schema(_GIVEN[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")

    return Warehouse(spark, lambda name: _TABLES[name](read))


def _after(base: Column, days: Column | int = 0, hours: Column | int = 0) -> Column:
    def as_int(value: Column | int) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast("int")

    return base + F.make_dt_interval(as_int(days), as_int(hours))


def _customers(read) -> DataFrame:
    key = F.col("c_custkey")
    return (
        read("customer")
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("customer_id"),
            (key - key % 2).alias("customer_unique_id"),
            (key % 97).cast("int").alias("customer_zip_code_prefix"),
            F.lower("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def _orders(read) -> DataFrame:
    key, day, status = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    purchase = _after(day, hours=key % 24)
    arrived = (status == "F") & (F.dayofmonth(day) != 31)
    return read("orders").select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        # Null-safe and nested rather than chained, so that a filter on one status reaches the scan.
        F.when(status.eqNullSafe("F"), "delivered").otherwise(
            F.when(status.eqNullSafe("O"), "shipped").otherwise("canceled")).alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        F.when(status != "P", _after(purchase, hours=1)).alias("order_approved_at"),
        F.when(status != "P", _after(day, days=2)).alias("order_delivered_carrier_date"),
        F.when(arrived, _after(day, hours=key % 24 + (key * 37) % 800))
        .alias("order_delivered_customer_date"),
        _after(day, days=30).alias("order_estimated_delivery_date"),
    )


def _order_items(read) -> DataFrame:
    return read("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast(_MONEY).alias("price"),
        (F.col("l_quantity") * 25).cast(_MONEY).alias("freight_value"),
    )


def _payments(read) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    kind = (
        F.when(priority == "4-NOT SPECIFIED", "boleto")
        .when((priority == "5-LOW") & (F.col("o_orderstatus") == "P"), "not_defined")
        .when(priority == "5-LOW", "voucher")
        .otherwise("credit_card")
    )
    first = F.col("payment_sequential") == 1
    # Orders of the fifteenth of a month also use a voucher.
    parts = F.when(F.dayofmonth("o_orderdate") == 15, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        read("orders")
        .select("*", F.explode(parts).alias("payment_sequential"))
        .select(
            key.alias("order_id"),
            "payment_sequential",
            F.when(first, kind).otherwise("voucher").alias("payment_type"),
            F.when(first & (kind == "credit_card"), key % 13).otherwise(1).cast("int")
            .alias("payment_installments"),
            F.when(first, F.col("o_totalprice").cast(_MONEY)).otherwise(F.lit(10).cast(_MONEY))
            .alias("payment_value"),
        )
    )


def _reviews(read) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    # Sunday's orders get no review; those of the first of a month get a late one as well.
    which = F.array_compact(F.array(
        F.when(F.dayofweek(day) != 1, F.lit(1)),
        F.when(F.dayofmonth(day) == 1, F.lit(2)),
    ))
    first = F.col("n") == 1
    score = F.when(first, 1 + (key * 7) % 5).otherwise(1).cast("int")
    return (
        read("orders")
        .select("*", F.explode(which).alias("n"))
        .select(
            F.when(first, key - key % 2).otherwise(key + 1_000_000_000).alias("review_id"),
            key.alias("order_id"),
            score.alias("review_score"),
            F.when(score == 1, "bad").alias("review_comment_title"),
            F.when(score != 3, F.concat(F.lit('says "'), "o_orderpriority", F.lit('",\nscore '), score))
            .alias("review_comment_message"),
            _after(day, days=15).alias("review_creation_date"),
            _after(day, days=17).alias("review_answer_timestamp"),
        )
    )


def _products(read) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    measured = F.when(size > 1, size)
    return read("part").select(
        key.alias("product_id"),
        F.when(key % 40 == 1, "").when(key % 40 != 0, F.lower("p_type")).alias("product_category_name"),
        F.length("p_name").alias("product_name_length"),
        (size * 10).alias("product_description_length"),
        (size % 5).alias("product_photos_qty"),
        (measured * 100).alias("product_weight_g"),
        measured.alias("product_length_cm"),
        (measured + 1).alias("product_height_cm"),
        (measured + 2).alias("product_width_cm"),
    )


def _sellers(read) -> DataFrame:
    return (
        read("supplier")
        .join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("seller_id"),
            (F.col("s_suppkey") % 97).cast("int").alias("seller_zip_code_prefix"),
            F.lower("n_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )
    )


def _geolocation(read) -> DataFrame:
    prefix = F.col("customer_zip_code_prefix")
    return _customers(read).select(
        prefix.alias("geolocation_zip_code_prefix"),
        (-10 - prefix % 20).cast("decimal(11,8)").alias("geolocation_lat"),
        (-40 - prefix % 10).cast("decimal(11,8)").alias("geolocation_lng"),
        F.col("customer_city").alias("geolocation_city"),
        F.col("customer_state").alias("geolocation_state"),
    )


def _category_translation(read) -> DataFrame:
    """Every category in use but ``medium``, which stays untranslated."""
    name = F.col("product_category_name")
    return (
        _products(read).filter((name != "") & (name != "medium"))
        .groupBy(name)
        .agg(F.upper(F.first(name)).alias("product_category_name_english"))
    )


_TABLES = {
    "customers": _customers,
    "orders": _orders,
    "order_items": _order_items,
    "payments": _payments,
    "reviews": _reviews,
    "products": _products,
    "sellers": _sellers,
    "geolocation": _geolocation,
    "category_translation": _category_translation,
}
