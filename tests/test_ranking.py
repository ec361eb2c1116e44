"""Distributed numbering, buckets, ranks and quartiles against plain computations."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.operators.quality import describe_numeric
from orderlens.operators.ranking import global_row_number, ntile_distributed, top_ranks


def _frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value int").repartition(5)


def _order():
    return [F.col("value").asc(), F.col("id").asc()]


@pytest.mark.parametrize("values", [
    [random.Random(1).randrange(1000) for _ in range(503)],
    [7] * 100 + list(range(200)),  # a third of all rows share one value
    [3, 3, 3],
    [],
])
@pytest.mark.parametrize("buckets", [1, 4, 5, 10])
def test_ntile(spark, values, buckets):
    df = _frame(spark, values)
    expected = df.withColumn("b", F.ntile(buckets).over(Window.orderBy(*_order())))
    found = ntile_distributed(df, _order(), buckets, "b")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_row_number_is_gap_free_and_ordered(spark):
    values = [random.Random(2).randrange(50) for _ in range(1000)]
    found = global_row_number(_frame(spark, values), _order(), "n", "total").orderBy("n").collect()
    assert [r.n for r in found] == list(range(1, 1001))
    assert [(r.value, r.id) for r in found] == sorted((v, i) for i, v in enumerate(values))
    assert {r.total for r in found} == {1000}


def test_numbering_spreads_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = global_row_number(_frame(spark, range(5000)), _order())
        sizes = numbered.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2500


@pytest.mark.parametrize("seed", range(5))
def test_ranks(spark, seed):
    rng = random.Random(seed)
    # Group 0 holds a third of all rows, most of them tied.
    data = [(rng.choice([0, rng.randrange(1, 8)]), i, rng.randrange(6)) for i in range(300)]
    df = spark.createDataFrame(data, "g int, k int, v int")
    window = Window.partitionBy("g").orderBy(F.col("v").desc())
    expected = df.withColumn("r", F.rank().over(window)).filter("r <= 3").select("g", "k", "v", "r")
    found = top_ranks(df, "g", "v", "k", 3, "r").select("g", "k", "v", "r")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("values", [[5], [1, 2], [4, 4, 4, 9], list(range(101)), [1] * 50 + [2] * 7 + [30] * 43])
def test_quartiles(spark, values):
    import numpy as np

    found = describe_numeric(_frame(spark, values), "value").first()
    assert (found["count"], found["min"], found["max"]) == (len(values), min(values), max(values))
    for name, q in (("p25", 25), ("p50", 50), ("p75", 75)):
        assert float(found[name]) == pytest.approx(np.percentile(values, q))
    if len(values) > 1:
        assert found["std"] == pytest.approx(np.std(values, ddof=1), abs=1e-4)
