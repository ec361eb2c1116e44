"""Intake reports: sources, sinks, cleaning and profiling run over a whole warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.contracts import CONTRACTS
from orderlens.operators import cleaning, quality
from orderlens.operators.calendar import date_dim
from orderlens.session import materialize, scratch_path, scratch_table
from orderlens.sources import csv, tables
from orderlens.warehouse import Warehouse


def as_raw_text(w: Warehouse, name: str) -> DataFrame:
    """A table as an untidy text file would deliver it: padded values and headers,
    misspelt names, whole numbers written as decimals."""
    contract, df = CONTRACTS[name], w.table(name)
    old = {new: raw for raw, new in contract.renames.items()}
    columns = []
    for field in df.schema.fields:
        text = F.col(field.name).cast("string")
        if field.name in contract.text_columns:
            text = F.concat(F.lit("\t  "), text, F.lit("  "))
        elif field.dataType.typeName() == "integer":
            text = F.concat(text, F.lit(".0"))
        columns.append(text.alias(f" {old.get(field.name, field.name).upper()} "))
    return df.select(columns)


def cleaned(w: Warehouse, name: str) -> DataFrame:
    return cleaning.clean_table(as_raw_text(w, name), CONTRACTS[name])


# --- Sources and sinks ------------------------------------------------------------------------

def csv_round_trip(w: Warehouse, name: str) -> DataFrame:
    """Write a table as CSV into the shared folder and read it back through its contract."""
    folder = scratch_path(w.spark, "csv")
    csv.write_csv_warehouse(w, folder, name)
    return csv.read_csv_warehouse(w.spark, folder).table(name)


def discover_report(w: Warehouse) -> DataFrame:
    """Every CSV data set of a folder with its columns and rows, types inferred."""
    folder = scratch_path(w.spark, "discover")
    csv.write_csv_warehouse(w, folder)
    reports = [
        (path, csv.read_inferred(w.spark, path)) for path in csv.discover(w.spark, folder)]
    return quality.union(
        df.agg(F.count("*").alias("rows")).select(
            F.lit(path.rsplit("/", 1)[-1]).alias("file"), F.lit(len(df.columns)).alias("columns"), "rows")
        for path, df in reports)


def _load(w: Warehouse, source: DataFrame, name: str) -> DataFrame:
    return tables.load_table(source, scratch_table(w.spark, name), scratch_path(w.spark, name))


def table_load(w: Warehouse) -> DataFrame:
    """Payments from processed CSV into a catalog table."""
    return _load(w, csv_round_trip(w, "payments"), "payments")


def load_counts(w: Warehouse) -> DataFrame:
    """Source against loaded rows, parents before children."""
    return quality.union(
        tables.load_count_check(w.table(name), _load(w, w.table(name), name), name)
        for name in ("customers", "sellers", "products", "category_translation", "orders", "order_items",
                     "payments", "reviews", "geolocation"))


def surrogate_keys(w: Warehouse) -> DataFrame:
    """A key per geolocation row: as many distinct keys as rows."""
    keyed = tables.surrogate_key(w.geolocation, "geolocation_id")
    return keyed.agg(F.count("*").alias("rows"), F.count_distinct("geolocation_id").alias("keys"))


def completed_lookup(w: Warehouse) -> DataFrame:
    """The translation with the missing names added under their own name."""
    missing = quality.translation_coverage(w).select(
        "product_category_name", F.col("product_category_name").alias("product_category_name_english"))
    return tables.lookup_insert(w.category_translation, missing, "product_category_name")


def order_preview(w: Warehouse, n: int = 10) -> DataFrame:
    return tables.preview(w.orders, n, "order_id")


def published_totals(w: Warehouse) -> DataFrame:
    """Control totals read with SQL from the published views: item grains agree."""
    tables.publish_views(w)
    return w.spark.sql("""
        SELECT 'vw_customers' AS view, sum(total_items) AS items, sum(total_revenue) AS revenue FROM vw_customers
        UNION ALL SELECT 'vw_products', sum(units_sold), sum(total_revenue) FROM vw_products
        UNION ALL SELECT 'vw_sellers', sum(units_sold), sum(total_revenue) FROM vw_sellers
        UNION ALL SELECT 'vw_monthly_sales', sum(total_items), sum(total_revenue) FROM vw_monthly_sales
        UNION ALL SELECT 'vw_sales', count(*), sum(price) FROM vw_sales""")


def status_layout(w: Warehouse) -> DataFrame:
    """Delivered orders per customer, read from orders stored by status."""
    path = scratch_path(w.spark, "orders-by-status")
    tables.write_by_status(w.orders, path)
    stored = w.spark.read.parquet(path)
    return stored.filter(F.col("order_status") == "delivered").groupBy("customer_id").agg(
        F.count("*").alias("delivered_orders"))


def month_layout(w: Warehouse, year: int, quarter: int) -> DataFrame:
    """Orders and revenue of the months of a quarter, from marts stored by month. The quarter is chosen in the date dimension."""
    stored = tables.save_months(w, scratch_path(w.spark, "months"))
    days = materialize(date_dim(w.orders), "date-dimension")
    chosen = days.filter((F.year("month_start") == year) & (F.quarter("month_start") == quarter)).select(F.col("month_start").alias("month")).distinct()
    sold = stored["vw_sales"].join(chosen, "month").groupBy("month").agg(F.count("*").alias("items"), F.sum("price").alias("revenue"))
    placed = stored["vw_orders"].join(chosen, "month").groupBy("month").agg(F.count("*").alias("orders"))
    return placed.join(sold, "month", "left").select("month", "orders", F.coalesce("items", F.lit(0)).alias("items"), "revenue")


def customer_status_layout(w: Warehouse, buckets: int | None = None) -> DataFrame:
    """Delivered orders per customer, read from orders stored by status and bucketed by customer."""
    buckets = buckets or int(w.spark.conf.get("spark.sql.shuffle.partitions"))
    stored = tables.save_by_customer_status(
        w.orders, scratch_table(w.spark, "orders_by_customer"), scratch_path(w.spark, "orders-by-customer"), buckets)
    return stored.filter(F.col("order_status") == "delivered").groupBy("customer_id").agg(F.count("*").alias("delivered_orders"))


def collated_lookup(w: Warehouse) -> DataFrame:
    """Customers of a state that is spelt in another case, under a collation that ignores case and accents."""
    found = w.collated("UNICODE_CI_AI").customers.filter(F.col("customer_state") == "Nàtion_1")
    return found.agg(F.count("*").alias("customers"), F.count_distinct("customer_city").alias("cities"))


def bucketed_layout(w: Warehouse, buckets: int | None = None) -> DataFrame:
    """Reviews and payments per order status from facts bucketed by order: the joins on
    the order need no shuffle. As many buckets as shuffles have partitions, unless given."""
    folder = scratch_path(w.spark, "bucketed")
    buckets = buckets or int(w.spark.conf.get("spark.sql.shuffle.partitions"))
    names = {name: scratch_table(w.spark, name) for name in tables.ORDER_BUCKETED}
    stored = tables.save_order_layout(w, folder, names, buckets)
    paid = stored.payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    scored = stored.reviews.groupBy("order_id").agg(F.count("*").alias("reviews"))
    return stored.orders.join(paid, "order_id").join(scored, "order_id", "left").groupBy("order_status").agg(
        F.count("*").alias("orders"), F.sum("paid").alias("paid"), F.sum("reviews").alias("reviews"))


# --- Cleaning ---------------------------------------------------------------------------------

def headers_cleaned(w: Warehouse) -> DataFrame:
    return cleaning.clean_headers(w.sellers.toDF(*[f" {c.upper()} " for c in w.sellers.columns]))


def trimmed(w: Warehouse) -> DataFrame:
    raw = cleaning.clean_headers(as_raw_text(w, "customers"))
    return cleaning.clean_trim(raw, *CONTRACTS["customers"].text_columns).select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state")


def timestamps_parsed(w: Warehouse) -> DataFrame:
    stamps = [c for c in w.orders.columns if c not in CONTRACTS["orders"].text_columns]
    text = w.orders.select("order_id", *[F.col(c).cast("string").alias(c) for c in stamps])
    return cleaning.clean_timestamps(text, *stamps)


def nulls_kept(w: Warehouse) -> DataFrame:
    """Missing order dates before and after cleaning."""
    def nulls(stage: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("rows"), *[
            F.count_if(F.col(c).isNull()).alias(c) for c in
            ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date")
        ]).select(F.lit(stage).alias("stage"), "*")
    return quality.union([nulls("raw", w.orders), nulls("clean", cleaned(w, "orders"))])


def renamed(w: Warehouse) -> DataFrame:
    raw = cleaning.clean_headers(as_raw_text(w, "products"))
    return raw.withColumnsRenamed(CONTRACTS["products"].renames).select(
        cleaning.strip_all(F.col("product_id")).alias("product_id"),
        *[cleaning.whole_number(F.col(c), T.IntegerType()).alias(c)
          for c in ("product_name_length", "product_description_length")])


def geolocation_places(w: Warehouse) -> DataFrame:
    return cleaning.clean_dedup(w.geolocation)


def cleaned_items(w: Warehouse) -> DataFrame:
    return cleaned(w, "order_items")


def cleaned_counts(w: Warehouse) -> DataFrame:
    """Rows of every table before and after its cleaning recipe."""
    return quality.union(
        w.table(name).agg(F.count("*").alias("raw_rows")).select(
            F.lit(name).alias("table"), "raw_rows",
            cleaned(w, name).agg(F.count("*")).scalar().alias("clean_rows"))
        for name in CONTRACTS)
