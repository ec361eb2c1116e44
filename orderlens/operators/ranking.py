"""Global numbering, buckets and top-k without pulling a whole order into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.operators.joins import splittable_join
from orderlens.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in its lower 33 bits


def global_row_number(df: DataFrame, order: list[Column], number: str = "row_number",
                      total: str | None = None) -> DataFrame:
    """Number all rows from 1 in the given order, which must be total (end it with the key).

    One range shuffle sorts the rows over all partitions. The row index inside its
    partition comes with ``monotonically_increasing_id``; only one count per
    partition is summed up and joined back, so no task ever sees the whole order.
    The range bounds are sampled, hence the indexed rows are written to a table
    before the counts are taken from them.
    """
    indexed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id())
    ranged = materialize(indexed, "numbered").withColumns({
        "_part": F.shiftright("_at", _ROW_BITS),
        "_index": F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1),
    })
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(  # one row per partition: bounded by the partition count
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    numbered = ranged.join(F.broadcast(offsets), "_part").withColumn(
        number, F.col("_offset") + F.col("_index") + 1)
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_at", "_part", "_index", "_offset", "_total")


def ntile_distributed(df: DataFrame, order: list[Column], buckets: int, name: str) -> DataFrame:
    """``NTILE(buckets)`` over the whole frame: the first ``total % buckets`` buckets
    hold one row more than the others."""
    numbered = global_row_number(df, order, "_row", "_rows")
    position = F.col("_row") - 1
    small = F.floor(F.col("_rows") / buckets)
    extra = F.col("_rows") % buckets
    in_large = extra * (small + 1)
    bucket = F.when(position < in_large, F.floor(position / (small + 1))).otherwise(
        extra + F.floor(F.try_divide(position - in_large, small)))
    return numbered.withColumn(name, (bucket + 1).cast("int")).drop("_row", "_rows")


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; planned as per-partition top n and one merge."""
    return df.orderBy(*order).limit(n)


def top_ranks(df: DataFrame, group: str, value: str, key: str, ranks: int, name: str) -> DataFrame:
    """Rows with ``RANK() <= ranks`` by value descending inside each group, ties kept.

    ``row_number <= ranks`` is cut on the map side, so at most ``ranks`` rows per
    group and map task are shuffled however large a group is. They give each group
    its leading values; rows are then ranked by comparing with these, so even a
    tie of many rows is never brought into one task.
    """
    window = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(key))
    leaders = (
        df.select(group, value, key)
        .withColumn("_row", F.row_number().over(window))
        .filter(F.col("_row") <= ranks)
        .groupBy(group)
        .agg(F.sort_array(F.collect_list(value), asc=False).alias("_leading"))
    )
    rank = 1 + F.size(F.filter("_leading", lambda lead: lead > F.col(value)))
    return (
        splittable_join(df, leaders, group)
        .filter(F.col(value) >= F.element_at("_leading", -1))
        .withColumn(name, rank)
        .drop("_leading")
    )
