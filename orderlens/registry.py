"""Query keys and the functions behind them."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.contracts import CONTRACTS
from orderlens.operators import quality
from orderlens.operators.calendar import date_dim
from orderlens.plans import (
    advanced, customers, delivery, intake, kpi, marts, payments, products, sellers, semantic,
)
from orderlens.plans.semantic import Context, Model
from orderlens.sources.star_schema import read_star_schema
from orderlens.warehouse import Warehouse

# The given orders run from 1995 to 2001; trend charts leave out their first year, as the
# report pages leave out theirs, and the month probe looks at the same months of another year.
TREND_START = datetime.date(1996, 1, 1)
PROBE = (datetime.date(1996, 9, 1), datetime.date(1997, 3, 1))

INTAKE: dict[str, Callable[[Warehouse], DataFrame]] = {
    "src_csv_discover": intake.discover_report,
    "src_csv_named": partial(intake.csv_round_trip, name="reviews"),
    "sink_csv_processed": partial(intake.csv_round_trip, name="orders"),
    "sink_table_load": intake.table_load,
    "load_count_check": intake.load_counts,
    "schema_contracts": quality.required_columns,
    "surrogate_key": intake.surrogate_keys,
    "lookup_insert": intake.completed_lookup,
    "table_scan": intake.order_preview,
    "view_publish": intake.published_totals,
    "layout_status": intake.status_layout,
    "layout_customer_status": intake.customer_status_layout,
    "layout_month": lambda w: intake.month_layout(w, PROBE[0].year, 4),
    "layout_bucketed": intake.bucketed_layout,
    "collation_lookup": intake.collated_lookup,
    "describe_latitude": lambda w: quality.describe_numeric(w.geolocation, "geolocation_lat"),
    "profile_table": quality.profile_all,
    "pk_check": quality.pk_check,
    "dup_key_rows": lambda w: quality.dup_key_rows(w.reviews, "review_id"),
    "dup_key_summary": lambda w: quality.dup_key_summary(w.reviews, "review_id"),
    "composite_key_check": quality.composite_key_check,
    "composite_key_sql": lambda w: quality.composite_key_totals(w.order_items, "order_id", "order_item_id"),
    "fk_check": quality.fk_check,
    "lookup_key_check": quality.lookup_key_check,
    "translation_coverage": quality.translation_coverage,
    "zip_ambiguity": quality.zip_ambiguity,
    "zip_location_counts": quality.zip_location_counts,
    "length_distribution": lambda w: quality.length_distribution(w.customers, "customer_state"),
    "value_range": lambda w: quality.value_range(w.customers, "customer_zip_code_prefix"),
    "value_counts": lambda w: quality.value_counts(w.payments, "payment_type"),
    "value_counts_top20": lambda w: quality.value_counts(w.products, "product_category_name", 20),
    "describe_numeric": lambda w: quality.describe_numeric(w.payments, "payment_value"),
    "describe_installments": lambda w: quality.describe_numeric(w.payments, "payment_installments"),
    "value_domain": lambda w: quality.value_domain(w.reviews, "review_score"),
    "anomaly_filters": quality.anomaly_counts,
    "anomaly_rows": lambda w: quality.anomaly_rows(w, "zero installments"),
    # Columns that are null throughout go out as doubles, the type both engines show nulls in alike.
    "anomaly_missing_weight": lambda w: quality.missing_weight_rows(w).select(
        "product_id", *[F.col(c).cast("double").alias(c) for c in quality.MEASURES]),
    "exact_dup_groups": lambda w: quality.exact_dup_groups(w.geolocation),
    "exact_dup_sample": lambda w: quality.exact_dup_sample(w.geolocation),
    "null_timespan_check": delivery.null_timespan,
    "month_status_probe": lambda w: quality.month_status(w, *PROBE),
    "final_validation": quality.final_validation,
    "clean_headers": intake.headers_cleaned,
    "clean_trim": intake.trimmed,
    "clean_timestamps": intake.timestamps_parsed,
    "clean_null_policy": intake.nulls_kept,
    "clean_rename": intake.renamed,
    "clean_dedup": intake.geolocation_places,
    "clean_tables": intake.cleaned_items,
    "clean_tables_counts": intake.cleaned_counts,
}

def _measures_as_double(df: DataFrame) -> DataFrame:
    """Measures that the star schema leaves empty, as doubles (see above)."""
    return df.select([F.col(c).cast("double").alias(c) if c in quality.MEASURES else F.col(c) for c in df.columns])


# Every table through its cleaning recipe, and written as CSV and read back, value by value.
INTAKE |= {f"clean_{name}": lambda w, name=name: _measures_as_double(intake.cleaned(w, name)) for name in CONTRACTS}
INTAKE |= {f"csv_{name}": lambda w, name=name: _measures_as_double(intake.csv_round_trip(w, name)) for name in CONTRACTS}

ANALYSES: dict[str, Callable[[Warehouse], DataFrame]] = {
    "kpi_overall": kpi.overall,
    "kpi_monthly_mom": kpi.monthly_growth,
    "month_calendar": kpi.months,
    "kpi_monthly_filled": kpi.monthly_filled,
    "kpi_monthly_full": kpi.monthly_full,
    "kpi_customer_orders_top20": kpi.most_orders,
    "kpi_order_frequency": kpi.order_frequency,
    "kpi_repeat_rate": kpi.repeat_rate,
    "kpi_cancellation": kpi.cancellation,
    "kpi_delivery_days": kpi.delivery_days,
    "kpi_late_rate": kpi.late_rate,
    "kpi_delivery_combined": kpi.delivery_combined,
    "kpi_satisfaction": kpi.satisfaction,
    "kpi_payment_types": kpi.payment_types,
    "kpi_aov": kpi.average_order_value,
    "cust_profile": customers.profile,
    "cust_order_frequency": customers.order_frequency,
    "cust_latest_date": customers.latest_date,
    "cust_recency": customers.recency,
    "cust_recency_segments": customers.recency_segments,
    "cust_recency_frequency": customers.recency_frequency,
    "cust_monetary": customers.monetary,
    "rfm_scores": customers.rfm_scores,
    "rfm_segments": customers.rfm_segments,
    "rfm_segment_summary": customers.rfm_segment_summary,
    "prod_units": products.units,
    "prod_units_category": products.units_with_category,
    "prod_revenue_top10": products.revenue_top10,
    "prod_units_revenue_price": products.units_revenue_price,
    "category_sales": products.category_sales,
    "category_reviews_fanout": products.category_reviews_fanout,
    "category_reviews": products.category_reviews,
    "prod_top10_units_revenue": products.top10_units_revenue,
    "prod_total_revenue": products.total_revenue,
    "prod_top10_share": products.top10_share,
    "prod_reviews_left": products.reviews_left,
    "prod_baseline": products.baseline,
    "prod_labels": products.labels,
    "prod_performance": products.performance,
    "seller_top10": sellers.top10,
    "seller_avg_price": sellers.avg_price,
    "seller_reviews": sellers.reviews,
    "seller_revenue_top10": sellers.revenue_top10,
    "seller_top10_share": sellers.top10_share,
    "seller_category": sellers.by_category,
    "seller_specialisation": sellers.specialisation,
    "pay_counts": payments.counts,
    "pay_totals": payments.totals,
    "pay_averages": payments.averages,
    "pay_installments": payments.installments,
    "pay_installment_groups": payments.installment_groups,
    "pay_installment_share": payments.installment_share,
    "deliv_time_stats": delivery.time_stats,
    "deliv_time_groups": delivery.time_groups,
    "deliv_ontime_late": delivery.ontime_late,
    "deliv_days_late": delivery.days_late,
    "deliv_reviews": delivery.reviews,
    "adv_first_purchase": advanced.first_purchase,
    "cohort_retention": advanced.cohort_retention,
    "pareto_deciles": advanced.pareto_deciles,
    "seller_rank_in_category": advanced.seller_rank_in_category,
    "running_and_moving": advanced.running_and_moving,
    "running_and_moving_gapsafe": advanced.running_and_moving_gapsafe,
    "value_quartiles": advanced.value_quartiles,
    "customer_revenue": advanced.customer_revenue,
    "customer_revenue_top10": advanced.customer_revenue_top10,
    **marts.MARTS,
    "vw_sales_checks": marts.sales_checks,
    "vw_customers_checks": marts.customers_checks,
    "vw_products_checks": marts.products_checks,
    "vw_sellers_checks": marts.sellers_checks,
    "vw_sellers_by_state": marts.sellers_by_state,
    "vw_payments_checks": marts.payments_checks,
    "vw_payments_by_type": marts.payments_by_type,
    "vw_delivery_checks": marts.delivery_checks,
    "vw_delivery_by_status": marts.delivery_by_status,
    "vw_reviews_checks": marts.reviews_checks,
    "vw_reviews_by_score": marts.reviews_by_score,
    "vw_monthly_sales_first": marts.monthly_sales_first,
    "vw_monthly_sales_checks": marts.monthly_sales_checks,
    "vw_orders_checks": marts.orders_checks,
}


# Contexts in which measures are also registered, one per way a slicer travels.
SLICED = Context(
    date_from=datetime.date(1996, 1, 1), date_to=datetime.date(2000, 12, 31),
    states=tuple(f"NATION_{n}" for n in range(10)), categories=("ECONOMY", "PROMO", marts.UNCATEGORIZED))
SLICED_ORDERS = Context(date_from=SLICED.date_from, date_to=SLICED.date_to, states=SLICED.states)
LATE_ONLY = Context(delivery_statuses=("Late",))
REPEAT_ONLY = Context(customer_types=(marts.REPEAT,))

_TRENDS = {"m_new_customers_month", "m_review_trend", "m_monthly_revenue"}


def _measure(function: Callable, context: Context = Context(), **options) -> Callable[[Warehouse], DataFrame]:
    return lambda w: function(Model(w, context), **options)


MEASURES: dict[str, Callable[[Warehouse], DataFrame]] = {
    "date_dim": lambda w: date_dim(w.orders),
    "star_relationships": semantic.star_relationships,
    "slicer_filter": _measure(semantic.core, SLICED),
    "slicer_filter_payments": _measure(semantic.payment_mix, SLICED),
    "slicer_filter_status": _measure(semantic.ontime_pct, LATE_ONLY),
    "slicer_filter_type": _measure(semantic.revenue_share_by_type, REPEAT_ONLY),
    **{f"{key}_sliced": _measure(semantic.MEASURES[key], SLICED_ORDERS) for key in (
        "m_avg_review_score", "m_review_count", "m_total_payment_value", "m_cc_payments")},
    **{key: _measure(function, **({"start": TREND_START} if key in _TRENDS else {}))
       for key, function in semantic.MEASURES.items()},
}


def portable(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, counts as longs and dates as ISO text, so that
    results compare across engines by value."""
    def convert(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return column.cast("long").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return column.cast("string").alias(field.name)
        return column
    return df.select([convert(f) for f in df.schema.fields])


def _on_star_schema(analysis: Callable[[Warehouse], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return portable(analysis(read_star_schema(spark, folder)))
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _on_star_schema(analysis) for key, analysis in {**INTAKE, **ANALYSES, **MEASURES}.items()}
