"""Cleaning, CSV, tables and checks on small inputs."""

import datetime
from decimal import Decimal

import pytest
from builders import build, one, rows
from conftest import ROOT  # noqa: F401
from pyspark.sql import functions as F

from orderlens.contracts import CONTRACTS
from orderlens.operators import cleaning, quality
from orderlens.plans import intake, marts
from orderlens.session import scratch_path, shared_dir
from orderlens.sources import csv, tables


def test_every_white_space_is_stripped(spark):
    df = spark.createDataFrame([("\t a b  ",), ("　x\n",), (None,), ("   ",)], "t string")
    assert [r.t for r in cleaning.clean_trim(df, "t").collect()] == ["a b", "x", None, ""]


def test_headers(spark):
    assert cleaning.clean_headers(spark.createDataFrame([(1, 2)], " A_b int, `C ` int")).columns == ["a_b", "c"]


@pytest.mark.parametrize(("text", "value"), [
    ("2018-01-02 03:04:05", datetime.datetime(2018, 1, 2, 3, 4, 5)), ("", None), ("  ", None), (None, None)])
def test_timestamps(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert cleaning.clean_timestamps(df, "t").first().t == value


@pytest.mark.parametrize("text", ["0000-00-00 00:00:00", "yesterday", "2018-13-01 00:00:00"])
def test_bad_timestamp_raises(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    with pytest.raises(Exception, match="(?i)parse|cast|DATETIME|CAST_INVALID"):
        cleaning.clean_timestamps(df, "t").collect()


def _raw(spark, name, **values):
    contract = CONTRACTS[name]
    return spark.createDataFrame([tuple(values.get(f.name) for f in contract.raw_schema)], contract.raw_schema)


def test_missing_required_value_raises(spark):
    raw = _raw(spark, "sellers", seller_id="s1", seller_zip_code_prefix="1", seller_city=" ", seller_state="AA")
    with pytest.raises(Exception, match="sellers.seller_city must not be null"):
        cleaning.clean_table(raw, CONTRACTS["sellers"]).collect()


def test_whole_numbers_written_as_decimals_and_misspelt_names(spark):
    raw = _raw(spark, "products", product_id=" p1 ", product_name_lenght="40.0", product_weight_g="")
    clean = one(cleaning.clean_table(raw, CONTRACTS["products"]))
    assert (clean["product_id"], clean["product_name_length"], clean["product_weight_g"]) == ("p1", 40, None)


def test_longitudes_beyond_one_hundred_fit(spark):
    raw = _raw(spark, "geolocation", geolocation_zip_code_prefix="1", geolocation_lat="-23.54562128",
               geolocation_lng="-121.10553381", geolocation_city="x", geolocation_state="AA")
    assert str(one(cleaning.clean_table(raw, CONTRACTS["geolocation"]))["geolocation_lng"]) == "-121.10553381"


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_recipe_restores_untidy_tables(spark, warehouse, name):
    clean = intake.cleaned(warehouse, name)
    assert [(f.name, f.dataType) for f in clean.schema] == [(f.name, f.dataType) for f in CONTRACTS[name].schema]
    source = warehouse.table(name)
    expected = source.select([F.col(c).cast(CONTRACTS[name].schema[c].dataType).alias(c) for c in source.columns])
    if CONTRACTS[name].distinct_rows:
        expected = expected.distinct()
    blank = F.when(F.col("product_category_name") != "", F.col("product_category_name"))
    if name == "products":  # blank categories become null
        expected = expected.withColumn("product_category_name", blank)
    assert clean.count() == expected.count()
    assert clean.exceptAll(expected).count() == 0


def test_csv_with_bom_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "category_translation.csv").write_bytes(
        "﻿product_category_name,product_category_name_english\r\nbeleza,beauty\r\n".encode())
    (tmp_path / "reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"line one\nsays ""fine"", really",2018-01-02 00:00:00,\n')
    w = csv.read_csv_warehouse(spark, str(tmp_path))
    assert rows(w.category_translation) == [
        {"product_category_name": "beleza", "product_category_name_english": "beauty"}]
    review = one(w.reviews)
    assert review["review_comment_message"] == 'line one\nsays "fine", really'
    assert review["review_comment_title"] is None and review["review_answer_timestamp"] is None


def test_discovery_lists_files_and_folders(spark, warehouse, tmp_path):
    (tmp_path / "loose.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "notes.txt").write_text("not a table")
    csv.write_csv_warehouse(warehouse, str(tmp_path), "sellers")
    found = csv.discover(spark, str(tmp_path))
    assert [path.rsplit("/", 1)[-1] for path in found] == ["loose.csv", "sellers.csv"]
    assert csv.read_inferred(spark, found[0]).dtypes == [("a", "int"), ("b", "string")]


def test_csv_is_never_overwritten(spark, warehouse):
    folder = scratch_path(spark, "once")
    csv.write_csv_warehouse(warehouse, folder, "sellers")
    with pytest.raises(Exception, match="(?i)exists"):
        csv.write_csv_warehouse(warehouse, folder, "sellers")


def test_shared_folder_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_lookup_insert_twice_adds_once(spark):
    lookup = spark.createDataFrame([("a", "A")], "k string, v string")
    new = spark.createDataFrame([("a", "other"), ("b", "B")], "k string, v string")
    once = tables.lookup_insert(lookup, new, "k")
    assert sorted(map(tuple, tables.lookup_insert(once, new, "k").collect())) == [("a", "A"), ("b", "B")]


def test_snapshots_and_catalog(spark, warehouse):
    folder = scratch_path(spark, "marts")
    tables.save_marts(warehouse, folder)
    assert spark.read.parquet(f"{folder}/vw_orders.parquet").count() == marts.orders(warehouse).count()
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    tables.load_table(warehouse.sellers, "shop.sellers", scratch_path(spark, "sellers"))
    assert tables.read_catalog_warehouse(spark, "shop").sellers.count() == warehouse.sellers.count()


def test_surrogate_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "x int").repartition(3)
    assert tables.surrogate_key(df, "id").select("id").distinct().count() == 3
    stable = tables.surrogate_key(df, "id", stable=True)
    assert stable.select("id").distinct().count() == 2


def test_key_checks_fail_where_they_should(spark):
    w = build(spark, customers=[{"customer_id": "c1"}, {"customer_id": "c1"}],
              orders=[{"order_id": "o1", "customer_id": "nobody"}],
              reviews=[{"review_id": "r1", "order_id": "o1"}, {"review_id": "r1", "order_id": "o2"},
                       {"review_id": "r1", "order_id": "o2"}])
    status = {r["table"]: r["status"] for r in rows(quality.pk_check(w))}
    assert status == {"customers": "FAIL", "orders": "PASS", "products": "PASS", "sellers": "PASS",
                      "reviews": "FAIL"}
    broken = {(r["child"], r["key"]): r["invalid_keys"] for r in rows(quality.fk_check(w)) if r["status"] == "FAIL"}
    assert broken == {("orders", "customer_id"): 1, ("reviews", "order_id"): 1}
    composite = {r["table"]: r for r in rows(quality.composite_key_check(w))}
    assert (composite["reviews"]["rows_involved"], composite["reviews"]["extra_rows"]) == (2, 1)
    assert quality.dup_key_rows(w.reviews, "review_id").count() == 3


def test_composite_totals_skip_incomplete_keys(spark):
    df = spark.createDataFrame([("1", "11"), ("11", "1"), ("1", None)], "a string, b string")
    assert tuple(quality.composite_key_totals(df, "a", "b").first()) == (3, 2)


def test_profile_counts_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    profile = {r["column"]: r for r in rows(quality.profile_table(df, "t"))}
    assert (profile["b"]["nulls"], profile["b"]["duplicate_rows"], profile["a"]["type"]) == (2, 1, "int")


def test_csv_keeps_outer_white_space(spark, tmp_path):
    df = spark.createDataFrame([("  hello  ",), ("\ttab",)], "a string")
    csv.write_csv(df, str(tmp_path / "x.csv"))
    back = spark.read.options(header="true", quote='"', escape='"').csv(str(tmp_path / "x.csv"))
    assert sorted(r.a for r in back.collect()) == ["\ttab", "  hello  "]


@pytest.mark.parametrize("form", ["file://{}", "{}", "relative"])
def test_discovery_on_any_uri(spark, tmp_path, form, monkeypatch):
    folder = tmp_path / "raw data" / "raw data"
    folder.mkdir(parents=True)
    (folder / "loose.csv").write_text('a,b\n1,"x\ny"\n')
    (folder / "plain.csv").write_text("a,b\n1,x\n2,y\n")
    (folder / "notes.txt").write_text("no")
    import os
    named = os.path.relpath(folder, os.getcwd()) if form == "relative" else form.format(folder)
    if form == "relative" and not os.path.exists(named):
        pytest.skip("no relative path")
    found = csv.discover(spark, named)
    assert [p.rsplit("/", 1)[-1] for p in found] == ["loose.csv", "plain.csv"]
    assert [csv.read_inferred(spark, p).count() for p in found] == [1, 2]
    assert [csv.has_line_breaks(spark, p) for p in found] == [True, False]


def test_fractions_do_not_become_whole_numbers(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([("40.0",), ("7",), (None,)], "a string")
    assert [r[0] for r in df.select(cleaning.whole_number(F.col("a"), T.IntegerType())).collect()] == [40, 7, None]
    bad = spark.createDataFrame([("40.7",)], "a string").select(cleaning.whole_number(F.col("a"), T.IntegerType()))
    with pytest.raises(Exception, match="not a whole number: 40.7"):
        bad.collect()


def test_describe_keeps_the_scale_of_the_column(spark):
    from orderlens.operators import quality
    fine = spark.createDataFrame([(Decimal(f"0.00{i}"),) for i in range(1, 6)], "x decimal(11,8)")
    row = quality.describe_numeric(fine, "x").first()
    assert (row.p25, row.p50, row.p75) == (Decimal("0.002"), Decimal("0.003"), Decimal("0.004"))
    assert row["mean"] == Decimal("0.003")
    doubles = quality.describe_numeric(spark.createDataFrame([(0.001 * i,) for i in range(1, 6)], "x double"), "x").first()
    assert doubles.p50 == pytest.approx(0.003) and doubles["mean"] == pytest.approx(0.003)


def test_stored_tables_take_the_types_of_their_contract(spark, tmp_path):
    from orderlens.functions import cents_sum
    prices = spark.createDataFrame([("p", 0.29), ("p", 1.15)], "k string, price double")
    assert prices.agg(cents_sum("price")).first()[0] == 144
    row = ("o", 1, "credit_card", 1, 10.005)
    kinds = "order_id string, payment_sequential int, payment_type string, payment_installments int"
    spark.createDataFrame([row], f"{kinds}, payment_value double").write.parquet(str(tmp_path / "payments.parquet"))
    stored = tables.read_parquet_warehouse(spark, str(tmp_path)).payments
    assert dict(stored.dtypes)["payment_value"] == "decimal(10,2)"
    with pytest.raises(TypeError, match="payment_value is string"):
        tables.conformed(spark.createDataFrame([(*row[:4], "x")], f"{kinds}, payment_value string"), "payments")
    with pytest.raises(ValueError, match="payment_value is missing"):
        tables.conformed(spark.createDataFrame([row[:4]], kinds), "payments")


def test_a_hot_key_is_split(spark):
    """Half of all rows have one key; the join must split its partition."""
    from orderlens.operators.joins import splittable_join
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                      F.col("id").alias("v"))
    unique = rows.groupBy("k").agg(F.count("*").alias("n"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = splittable_join(rows.repartition(16), unique, "k")
        assert joined.agg(F.sum("n")).first()[0] == 20_000 * 20_000 + 20_000
        joined.write.format("noop").mode("overwrite").save()
        kept = joined.collect()
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(kept) == 40_000 and "skew=true" in text
