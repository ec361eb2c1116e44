"""Profiling and data quality checks. Every result is a small report or the offending rows."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.contracts import CONTRACTS, TableContract
from orderlens.functions import blank_to_null, count_when, mean
from orderlens.operators.joins import splittable_join
from orderlens.operators.ranking import top_n
from orderlens.session import materialize
from orderlens.warehouse import Warehouse

PASS, FAIL = "PASS", "FAIL"

# The tables whose single key is checked. Reviews are checked on review_id alone,
# which fails and shows that their key needs the order as well.
SINGLE_KEYS = (("customers", "customer_id"), ("orders", "order_id"), ("products", "product_id"),
               ("sellers", "seller_id"), ("reviews", "review_id"))
COMPOSITE_KEYS = (("reviews", ("review_id", "order_id")), ("order_items", ("order_id", "order_item_id")),
                  ("payments", ("order_id", "payment_sequential")))


MEASURES = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")


def union(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionAll(frame)
    return result


def _status(ok: Column) -> Column:
    return F.when(ok, PASS).otherwise(FAIL).alias("status")


def _weighted(condition: Column, weight: str = "_n") -> Column:
    """Rows of groups of equal rows that meet a condition."""
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def profile_table(df: DataFrame, table: str) -> DataFrame:
    """One row per column: type and nulls, beside rows, columns and duplicate rows of the table.

    Equal rows, nulls equal, are grouped once; everything else follows from the groups and their sizes.
    """
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    counts = groups.agg(_weighted(F.lit(True)).alias("_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_more"),
                        *[_weighted(F.col(c).isNull()).alias(c) for c in df.columns])
    columns = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                                 F.col(f.name).alias("nulls")) for f in df.schema.fields])
    return counts.select("_rows", "_more", F.explode(columns).alias("_of")).select(
        F.lit(table).alias("table"), "_of.column", "_of.type", "_of.nulls",
        F.col("_rows").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.col("_more").alias("duplicate_rows"))


def profile_all(w: Warehouse) -> DataFrame:
    return union(profile_table(df, name) for name, df in w.tables().items())


def key_check(df: DataFrame, table: str, key: str) -> DataFrame:
    total, unique = F.count("*"), F.count_distinct(key)
    nulls = count_when(F.col(key).isNull())
    return df.agg(total.alias("total_rows"), unique.alias("unique_keys"), nulls.alias("null_keys")).select(
        F.lit(table).alias("table"), F.lit(key).alias("key"), "total_rows", "unique_keys", "null_keys",
        _status((F.col("total_rows") == F.col("unique_keys")) & (F.col("null_keys") == 0)))


def pk_check(w: Warehouse) -> DataFrame:
    return union(key_check(w.table(table), table, key) for table, key in SINGLE_KEYS)


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dup_key_rows(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key occurs more than once, sorted by key. The repeated keys are
    found by an aggregate and joined back by a join that splits a hot key, and the sort goes on
    over the other columns, so the rows of one key spread over many tasks."""
    others = [c for c in df.columns if c != key]
    return splittable_join(df, _repeated(df, key).select(key), key, "left_semi").orderBy(key, *others)


def dup_key_summary(df: DataFrame, key: str) -> DataFrame:
    return _repeated(df, key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"))


def composite_key_check(w: Warehouse) -> DataFrame:
    """Rows involved in repeated keys, rows beyond the first, and the repeated keys."""
    def check(table: str, keys: tuple[str, ...]) -> DataFrame:
        return _repeated(w.table(table), *keys).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_involved"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
            F.count("*").alias("repeated_keys"),
        ).select(F.lit(table).alias("table"), F.lit(", ".join(keys)).alias("key"),
                 "rows_involved", "extra_rows", "repeated_keys")
    return union(check(table, keys) for table, keys in COMPOSITE_KEYS)


def composite_key_totals(df: DataFrame, *keys: str) -> DataFrame:
    """Rows against distinct keys; a key with a null part is not counted."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return groups.agg(F.sum("n").alias("total_rows"), count_when(complete).alias("unique_keys"))


def fk_check(w: Warehouse) -> DataFrame:
    """Distinct child keys without a parent, for every reference of the contracts."""
    def check(child: str, column: str, parent: str, parent_column: str) -> DataFrame:
        keys = w.table(child).select(F.col(column).alias("key")).filter(F.col("key").isNotNull()).distinct()
        parents = w.table(parent).select(F.col(parent_column).alias("key"))
        return keys.join(parents, "key", "left_anti").agg(F.count("*").alias("invalid_keys")).select(
            F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.lit(column).alias("key"),
            "invalid_keys", _status(F.col("invalid_keys") == 0))
    return union(check(c.name, fk.column, fk.parent, fk.parent_column)
                  for c in CONTRACTS.values() for fk in c.references)


def lookup_key_check(w: Warehouse) -> DataFrame:
    """Rows, distinct and duplicate names of the translation in both languages."""
    def check(column: str) -> DataFrame:
        return w.category_translation.agg(F.count("*").alias("rows"), F.count_distinct(column).alias("unique_names")
                                          ).select(F.lit(column).alias("column"), "rows", "unique_names",
                                                   (F.col("rows") - F.col("unique_names")).alias("duplicate_names"))
    return union(check(c) for c in w.category_translation.columns)


def translation_coverage(w: Warehouse) -> DataFrame:
    """Category names in use that have no translation, blanks left aside."""
    name = "product_category_name"
    used = w.products.filter(blank_to_null(name).isNotNull()).select(name).distinct()
    return used.join(w.category_translation, name, "left_anti").orderBy(name)


def zip_ambiguity(w: Warehouse) -> DataFrame:
    prefix = "geolocation_zip_code_prefix"
    return w.geolocation.groupBy(prefix).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("rows"), F.count(prefix).alias("unique_prefixes"),
        (F.sum("n") - F.count(prefix)).alias("repeated_rows"))


def zip_location_counts(w: Warehouse) -> DataFrame:
    """Distinct coordinates, cities and states per zip prefix: for each column the distinct (prefix, value)
    pairs are counted, so there is no row per place and column."""
    prefix = "geolocation_zip_code_prefix"
    parts = []
    for column, name in (("lat", "unique_lat"), ("lng", "unique_lng"), ("city", "unique_cities"), ("state", "unique_states")):
        pairs = w.geolocation.groupBy(prefix, f"geolocation_{column}").agg(F.lit(1))
        parts.append(pairs.groupBy(prefix).agg(F.count(f"geolocation_{column}").alias(name)))
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.join(part, prefix)
    return counts.orderBy(prefix)


def length_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.length(column).alias("length")).agg(F.count("*").alias("count")).orderBy("length")


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Frequency of each value but null, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("count"))
    order = [F.col("count").desc(), F.col("value")]
    return top_n(counts, n, *order) if n else counts.orderBy(*order)


def value_domain(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def _value_positions(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the first and last 0-based position of each in sorted order.

    Equal values are merged before the range shuffle, so a frequent value is one row.
    Counts are accumulated inside each range partition, then shifted by the sums of
    the partitions before it.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = materialize(
        counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "positions")
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n"))  # one row per partition
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
                          F.sum("n").over(Window.partitionBy()).alias("total"))
    running = ranged.withColumn("running", F.sum("n").over(inside)).join(F.broadcast(offsets), "part")
    return running.select(
        "value", "n", "total",
        (F.col("offset") + F.col("running") - F.col("n")).alias("first"),
        (F.col("offset") + F.col("running") - 1).alias("last"))


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """count, mean, standard deviation, minimum, exact quartiles, maximum.

    Quartiles interpolate between the two nearest ranks, at the column's own scale: two decimals
    more than the column has, as doubles for a column of doubles.
    """
    kind = df.schema[column].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    exact = "double" if floating else f"decimal(30,{max(2, scale)})"
    digits = max(2, scale) + 2
    positions = _value_positions(df, column)

    def quartile(quarter: int) -> Column:
        at = (F.col("total") - 1) * quarter  # position in quarters of a row
        low, part = F.floor(at / 4), at % 4
        lower = F.max(F.when((F.col("first") <= low) & (low <= F.col("last")), F.col("value")))
        high = F.when(part > 0, low + 1).otherwise(low)
        upper = F.max(F.when((F.col("first") <= high) & (high <= F.col("last")), F.col("value")))
        share = (F.max(part) / 4).cast("double" if floating else "decimal(3,2)")
        value = lower.cast(exact) + (upper - lower).cast(exact) * share
        return value if floating else F.round(value, digits)

    # Sums of up to four decimals are exact in ``mean``; finer ones are averaged at their own scale.
    average = mean(column, 4) if not floating and scale <= 2 else F.avg(column)
    average = F.round(average, digits) if not floating and scale > 2 else average
    deviation = F.stddev_samp(F.col(column).cast("double"))
    quartiles = positions.agg(F.struct(
        quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3"))).scalar()
    return df.agg(
        F.count(column).alias("count"),
        average.alias("mean"),
        (deviation if floating else F.round(deviation, digits)).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    ).withColumn("q", quartiles).select(
        F.lit(column).alias("column"), "count", "mean", "std", "min",
        F.col("q.q1").alias("p25"), F.col("q.q2").alias("p50"), F.col("q.q3").alias("p75"), "max")


def anomaly_rules() -> tuple[tuple[str, str, Column], ...]:
    return (
        ("undefined payment type", "payments", F.col("payment_type") == "not_defined"),
        ("zero installments", "payments", F.col("payment_installments") == 0),
        ("missing category", "products", F.col("product_category_name").isNull()),
        ("missing category and weight", "products",
         F.col("product_category_name").isNull() & F.col("product_weight_g").isNull()),
        ("missing weight", "products", F.col("product_weight_g").isNull()),
    )


def anomaly_counts(w: Warehouse) -> DataFrame:
    """Rows per rule; each table is read once for all its rules."""
    by_table: dict[str, list[tuple[str, Column]]] = {}
    for rule, table, condition in anomaly_rules():
        by_table.setdefault(table, []).append((rule, condition))
    return union(
        w.table(table).agg(*[count_when(condition).alias(rule) for rule, condition in rules])
        .select(F.lit(table).alias("table"), "*")
        .unpivot("table", [rule for rule, _ in rules], "rule", "rows")
        for table, rules in by_table.items())


def anomaly_rows(w: Warehouse, rule: str) -> DataFrame:
    table, condition = next((t, c) for name, t, c in anomaly_rules() if name == rule)
    return w.table(table).filter(condition)


def missing_weight_rows(w: Warehouse) -> DataFrame:
    return anomaly_rows(w, "missing weight").select("product_id", *MEASURES)


def _duplicate_groups(df: DataFrame) -> DataFrame:
    return _repeated(df, *df.columns)


def exact_dup_groups(df: DataFrame) -> DataFrame:
    return _duplicate_groups(df).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("groups"))


def exact_dup_sample(df: DataFrame, n: int = 30) -> DataFrame:
    """The first duplicate groups in column order, with the number of copies."""
    return top_n(_duplicate_groups(df).withColumnRenamed("n", "copies"), n, *[F.col(c) for c in df.columns])


def month_status(w: Warehouse, start: datetime.date, end: datetime.date) -> DataFrame:
    """Orders and delivered orders per month in [start, end)."""
    when = F.col("order_purchase_timestamp")
    inside = (when >= F.lit(start).cast("timestamp_ntz")) & (when < F.lit(end).cast("timestamp_ntz"))
    return w.orders.filter(inside).groupBy(F.date_format(when, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("total_orders"),
        count_when(F.col("order_status") == "delivered").alias("delivered_orders"),
    ).orderBy("month")


def required_columns(w: Warehouse) -> DataFrame:
    """Nulls in each required column of the contracts."""
    def check(contract: TableContract) -> DataFrame:
        df = w.table(contract.name)
        counts = df.agg(*[count_when(F.col(c).isNull()).alias(c) for c in contract.required])
        return counts.select(F.lit(contract.name).alias("table"), "*").unpivot(
            "table", list(contract.required), "column", "nulls").select(
            "table", "column", "nulls", _status(F.col("nulls") == 0))
    return union(check(c) for c in CONTRACTS.values())


def final_validation(w: Warehouse) -> DataFrame:
    """Per table: rows, columns, duplicate rows, nulls and duplicate keys in one report.

    A table is read once: equal rows are grouped, then groups of one key, then these are summed up.
    """
    def check(contract: TableContract) -> DataFrame:
        df = w.table(contract.name)
        groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
        empty = sum((F.col(c).isNull().cast("long") for c in df.columns[1:]), F.col(df.columns[0]).isNull().cast("long"))
        groups = groups.select(*(contract.key or ()), "_n", (F.col("_n") - 1).alias("_more"), (empty * F.col("_n")).alias("_nulls"))
        if contract.key:
            groups = groups.groupBy(*contract.key).agg(*[F.sum(c).alias(c) for c in ("_n", "_more", "_nulls")])

        def total(value: Column) -> Column:
            return F.coalesce(F.sum(value), F.lit(0).cast("long"))

        keys = total(F.col("_n") - 1) if contract.key else F.lit(0).cast("long")
        return groups.agg(
            total(F.col("_n")).alias("rows"), total(F.col("_more")).alias("duplicate_rows"),
            total(F.col("_nulls")).alias("nulls"), keys.alias("duplicate_keys")).select(
            F.lit(contract.name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"),
            "duplicate_rows", "nulls", "duplicate_keys")
    return union(check(c) for c in CONTRACTS.values())


