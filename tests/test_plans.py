"""What the plans must and must not contain."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from orderlens import registry
from orderlens.plans import advanced, intake, semantic
from orderlens.session import scratch_path, scratch_table
from orderlens.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", list(registry.queries()))
def test_no_python_and_no_pairs(answers, key):
    *_, text = answers[key].result()
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(registry.queries()["kpi_aov"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>|"
                     r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>", text)


def test_status_filter_reaches_the_scan(spark):
    text = plan(registry.queries()["adv_first_purchase"](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*o_orderstatus,F", text)


def test_rank_is_cut_before_the_shuffle(spark, warehouse):
    text = plan(advanced.seller_rank_in_category(warehouse))
    assert re.search(r"WindowGroupLimit .*row_number\(\), 3, Partial", text)


def test_top_lists_need_no_global_sort(spark):
    assert "TakeOrderedAndProject" in plan(registry.queries()["seller_revenue_top10"](spark, SMALL))


def test_status_folders_are_pruned(spark, warehouse):
    path = scratch_path(spark, "layout")
    tables.write_by_status(warehouse.orders, path)
    text = plan(spark.read.parquet(path).filter(F.col("order_status") == "delivered"))
    assert re.search(r"PartitionFilters: \[[^\]]*order_status[^\]]*delivered", text)


def test_bucketed_facts_join_without_a_shuffle(spark, warehouse):
    stored = tables.save_order_layout(
        warehouse, scratch_path(spark, "buckets"), {n: scratch_table(spark, n) for n in tables.ORDER_BUCKETED}, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_order = stored.order_items.groupBy("order_id").agg(F.sum("price").alias("paid"))
        text = plan(stored.orders.join(per_order, "order_id").select("order_id", "order_status", "paid"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_single_task_windows_only_see_reports(spark, warehouse):
    """Numbering customers must not bring them into one partition; only counts may go there."""
    numbered = advanced.pareto_deciles(warehouse)
    for line in plan(numbered).splitlines():
        assert "ntile" not in line.lower()


def test_published_views_agree(spark, warehouse):
    totals = {(r["items"], r["revenue"]) for r in intake.published_totals(warehouse).collect()}
    assert len(totals) == 1


def test_customer_status_layout_prunes_folders_and_needs_no_shuffle(warehouse):
    text = plan(intake.customer_status_layout(warehouse, 4))
    assert re.search(r"PartitionFilters: \[[^\]]*order_status[^\]]*delivered", text) and "Exchange" not in text


@pytest.mark.parametrize("report", [semantic.star_relationships, lambda w: semantic.takeaways(semantic.Model(w))])
def test_reports_of_many_parts_share_their_frames(warehouse, report):
    """The result reads frames that were written once, and the facts a few times; nothing is expanded."""
    plan = report(warehouse)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 12 and "Expand " not in plan


def test_the_date_dimension_prunes_month_folders_at_run_time(warehouse):
    found = intake.month_layout(warehouse, 1996, 4)
    assert len(found.collect()) <= 3
    text = plan(found)
    assert len(re.findall(r"PartitionFilters: \[[^\]]*dynamicpruning", text)) >= 2
    months = warehouse.orders.filter("order_status = 'delivered'").select(F.trunc("order_purchase_timestamp", "MM")).distinct().count()
    stored = tables.save_months(warehouse, scratch_path(warehouse.spark, "months"))
    every = len(stored["vw_orders"].inputFiles())
    one = stored["vw_orders"].filter("month = DATE'1996-10-01'")
    assert months > 12 and every >= months
    assert 0 < one.select("_metadata.file_path").distinct().count() < every / 6
