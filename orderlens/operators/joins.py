"""Joins that adaptive execution can split at a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def splittable_join(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a side that is unique on ``key``, so that a hot key of ``rows`` may be split.

    Adaptive execution splits a partition only where both inputs of the join are shuffled for it. A side that
    was just aggregated by the key is not, so it is joined under a name that the planner does not
    recognise as the key: it is shuffled once more, which is little, as it has one row for each key.
    """
    kind = rows.schema[key].dataType
    if isinstance(kind, T.StringType):
        again = F.concat(F.col(key), F.lit(""))
    elif isinstance(kind, T.IntegralType):
        again = F.col(key).bitwiseXOR(F.lit(0)).cast(kind)
    else:
        raise TypeError(f"{key} must be text or a whole number")
    other = unique.withColumn("_again", again).drop(key)
    return rows.join(other, F.col(key) == F.col("_again"), how).select(
        *rows.columns, *([] if how in ("left_semi", "left_anti") else [c for c in unique.columns if c != key]))
