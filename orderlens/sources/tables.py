"""Warehouse tables, lookups, views and physical layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.contracts import CONTRACTS
from orderlens.functions import month_start
from orderlens.plans.marts import MARTS
from orderlens.warehouse import Warehouse

# Facts that meet on the order are bucketed by it, so their joins need no shuffle.
SPREAD = 4
ORDER_BUCKETED = ("orders", "order_items", "payments", "reviews")


def load_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """Save as a catalog table with its files below ``path`` and open it."""
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def load_count_check(source: DataFrame, loaded: DataFrame, table: str) -> DataFrame:
    return source.agg(F.count("*").alias("source_rows")).select(
        F.lit(table).alias("table"), "source_rows",
        loaded.agg(F.count("*")).scalar().alias("loaded_rows"),
    ).withColumn("ok", F.col("source_rows") == F.col("loaded_rows"))


def surrogate_key(df: DataFrame, name: str, stable: bool = False) -> DataFrame:
    """A unique long per row; with ``stable`` a hash of all columns that is the same in
    every run, equal for equal rows."""
    key = F.xxhash64(*df.columns) if stable else F.monotonically_increasing_id()
    return df.select(key.alias(name), "*")


def lookup_insert(lookup: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The lookup with the rows whose key it lacks; running it again adds nothing."""
    return lookup.unionByName(rows.dropDuplicates([key]).join(lookup, key, "left_anti"))


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def publish_views(w: Warehouse) -> list[str]:
    """Create or replace a temporary view per mart."""
    for name, mart in MARTS.items():
        mart(w).createOrReplaceTempView(name)
    return list(MARTS)


def save_marts(w: Warehouse, folder: str) -> None:
    """A snapshot of every mart as Parquet, for tools that import finished tables."""
    for name, mart in MARTS.items():
        mart(w).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}.parquet")


def save_months(w: Warehouse, folder: str) -> dict[str, DataFrame]:
    """The sales and order marts in one folder per month of purchase, ``SPREAD`` files in each at most. A filter on the months, or
    on the date dimension that is joined by month, reads the folders of these months only."""
    stored = {}
    for name in ("vw_sales", "vw_orders"):
        path = f"{folder.rstrip('/')}/{name}"
        dated = MARTS[name](w).withColumn("month", month_start("order_purchase_date"))
        dealt = dated.repartition("month", F.pmod(F.xxhash64("order_id"), F.lit(SPREAD)))
        dealt.write.mode("errorifexists").partitionBy("month").parquet(path)
        stored[name] = w.spark.read.parquet(path)
    return stored


def _folder_status(orders: DataFrame) -> DataFrame:
    """Folders are named by the bytes of a status, so it gives up its collation."""
    return orders.withColumn("order_status", F.collate("order_status", "UTF8_BINARY"))


def write_by_status(orders: DataFrame, path: str) -> None:
    """Orders in one folder per status, so that a status filter prunes folders."""
    _folder_status(orders).write.mode("errorifexists").partitionBy("order_status").parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "order_id") -> DataFrame:
    """``SPREAD`` files per bucket at most: rows are brought together by bucket before they are written, the rows
    of one bucket, and so of a hot key, by that many tasks."""
    bucket = F.pmod(F.hash(key), F.lit(buckets))  # as the writer deals rows out
    part = F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD))
    df.repartition(buckets * SPREAD, bucket, part).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def save_by_customer_status(orders: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Orders in one folder per status, in it bucketed by customer: a status filter prunes folders, and a
    roll-up per customer needs no shuffle."""
    _folder_status(orders).repartition(buckets, F.pmod(F.hash("customer_id"), F.lit(buckets))).write.mode("overwrite").partitionBy(
        "order_status").bucketBy(buckets, "customer_id").sortBy("customer_id").option("path", path).saveAsTable(name)
    return orders.sparkSession.table(name)


def save_order_layout(w: Warehouse, folder: str, names: dict[str, str], buckets: int) -> Warehouse:
    """The warehouse with its order facts bucketed by order under the given catalog names; other tables stay as they are."""
    saved = {name: save_bucketed(w.table(name), names[name], f"{folder}/{name}", buckets) for name in ORDER_BUCKETED}
    return Warehouse(w.spark, lambda name: saved[name] if name in saved else w.table(name))


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def conformed(df: DataFrame, name: str) -> DataFrame:
    """A stored table in the types of its contract.

    Amounts stored as doubles or with more decimals are rounded to the contract's scale. Ids may be whole numbers
    instead of text, whole numbers of another width. A missing column or any other type raises.
    """
    stored = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for column, kind, _ in CONTRACTS[name].columns:
        if column not in stored:
            raise ValueError(f"{name}.{column} is missing")
        found = stored[column]
        amount = isinstance(kind, T.DecimalType) and isinstance(found, (T.DecimalType, T.DoubleType, T.FloatType, *_NUMBERS))
        whole = isinstance(kind, T.IntegerType) and isinstance(found, _NUMBERS)
        number_id = isinstance(kind, T.StringType) and isinstance(found, _NUMBERS) and column.endswith("_id")
        if amount and isinstance(found, T.DecimalType) and found.scale == kind.scale:
            columns.append(F.col(column))
        elif amount:
            columns.append(F.round(F.col(column).cast("decimal(38,18)"), kind.scale).cast(kind).alias(column))
        elif whole:
            columns.append(F.col(column).cast(kind))
        elif number_id or found == kind:
            columns.append(F.col(column))
        elif isinstance(kind, T.TimestampNTZType) and isinstance(found, (T.TimestampType, T.DateType)):
            columns.append(F.col(column).cast(kind))
        else:
            raise TypeError(f"{name}.{column} is {found.simpleString()}, not {kind.simpleString()}")
    return df.select(columns)


def read_parquet_warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """Contract tables stored as ``<name>.parquet`` or as Parquet folders of that name."""
    return Warehouse(spark, lambda name: conformed(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"), name))


def read_catalog_warehouse(spark: SparkSession, database: str) -> Warehouse:
    """Contract tables of a catalog database."""
    return Warehouse(spark, lambda name: conformed(spark.table(f"{database}.{name}"), name))
