"""Payment analytics over all order statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions import mean, pct
from orderlens.warehouse import Warehouse

CREDIT_CARD = "credit_card"
# Installment groups (from, to, name).
INSTALLMENT_GROUPS = (
    (1, 1, "1 installment"), (2, 3, "2-3 installments"), (4, 6, "4-6 installments"),
    (7, 9, "7-9 installments"), (10, None, "10+ installments"),
)


def counts(w: Warehouse) -> DataFrame:
    return w.payments.groupBy("payment_type").agg(F.count("*").alias("payment_count")).orderBy(
        F.col("payment_count").desc(), "payment_type")


def _by_type(w: Warehouse) -> DataFrame:
    return w.payments.groupBy("payment_type").agg(
        F.count("*").alias("payment_count"),
        F.sum("payment_value").alias("total_payment_value"),
        mean("payment_value").alias("avg_payment_value"),
    )


def totals(w: Warehouse) -> DataFrame:
    return _by_type(w).drop("avg_payment_value").orderBy(F.col("total_payment_value").desc(), "payment_type")


def averages(w: Warehouse) -> DataFrame:
    return _by_type(w).orderBy(F.col("avg_payment_value").desc(), "payment_type")


def _card(w: Warehouse) -> DataFrame:
    return w.payments.filter(F.col("payment_type") == CREDIT_CARD)


def installments(w: Warehouse) -> DataFrame:
    return _card(w).groupBy("payment_installments").agg(
        F.count("*").alias("payment_count"),
        F.sum("payment_value").alias("total_payment_value"),
        mean("payment_value").alias("avg_payment_value"),
    ).orderBy("payment_installments")


def installment_groups(w: Warehouse) -> DataFrame:
    number, label = F.col("payment_installments"), F
    for low, high, name in INSTALLMENT_GROUPS:
        label = label.when(number.between(low, high) if high else number >= low, name)
    return _card(w).filter(number > 0).groupBy(label.alias("installment_group")).agg(
        F.count("*").alias("payment_count"),
        mean("payment_value").alias("avg_payment_value"),
    ).orderBy("avg_payment_value", "installment_group")


def installment_share(w: Warehouse) -> DataFrame:
    """One payment against several: two rows, so the totals over them are cheap."""
    number, everything = F.col("payment_installments"), Window.partitionBy()
    kind = F.when(number == 1, "1 installment").otherwise("2+ installments")
    groups = _card(w).filter(number > 0).groupBy(kind.alias("installment_type")).agg(
        F.count("*").alias("payment_count"), F.sum("payment_value").alias("total_payment_value"))
    return groups.select(
        "*",
        pct("payment_count", F.sum("payment_count").over(everything)).alias("payment_share_pct"),
        pct("total_payment_value", F.sum("total_payment_value").over(everything)).alias("value_share_pct"),
    ).orderBy(F.col("payment_count").desc(), "installment_type")
