"""CSV with line breaks inside quotes, read by many tasks, against the multi-line reader."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.sources import csv, records

NAMES = ("id", "title", "message")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in NAMES])
OPTIONS = {"quote": '"', "escape": '"', "encoding": "UTF-8"}


def quoted(value, always):
    return '"' + value.replace('"', '""') + '"' if always or any(c in value for c in '",\n\r') else value


def file_text(seed, rows, end="\n"):
    pick = random.Random(seed)
    pieces = ["plain", "a, b", 'said "so"', "two\nlines", "\n\n", "é漢", "", " padded ", "x" * 700, '"', "back\\slash", "win\r\ndows"]
    lines = [",".join(NAMES)]
    for i in range(rows):
        cells = [str(i), pick.choice(pieces), "".join(pick.choice(pieces) for _ in range(pick.randint(0, 4)))]
        lines.append(",".join(quoted(c, pick.random() < 0.4) for c in cells[:pick.choice([3, 3, 3, 2])]))
        if pick.random() < 0.05:
            lines.append("")
    return end.join(lines) + end


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def by_multi_line(spark, path):
    return spark.read.options(**OPTIONS, header="true", multiLine="true").schema(SCHEMA).csv(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_values_are_those_of_the_multi_line_reader(spark, tmp_path, small_splits, end):
    folder = tmp_path / "reviews.csv"
    folder.mkdir()
    for i, rows in enumerate((200, 1, 0, 60)):
        (folder / f"part-{i}.csv").write_bytes(file_text(i, rows, end).encode())
    # A value that is longer than several splits, and a file that ends within a quoted value's line.
    (folder / "part-long.csv").write_bytes(f'id,title,message{end}1,"a{chr(10) * 5000}b",c{end}2,x,"y{chr(10)}z"'.encode())
    found = records.read_records(spark, str(folder), SCHEMA, **OPTIONS)
    expected = by_multi_line(spark, str(folder))
    assert found.schema == expected.schema
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))


def test_many_tasks_read_one_file(spark, tmp_path, small_splits):
    path = tmp_path / "reviews.csv"
    path.write_text(file_text(9, 400))
    assert spark.read.text(str(path), lineSep="\n").rdd.getNumPartitions() > 20
    assert by_multi_line(spark, str(path)).rdd.getNumPartitions() == 1
    lines = records.numbered_lines(spark, str(path))
    per_split = lines.groupBy("at").agg(F.max("record").alias("records"), F.min("record").alias("least"))
    assert per_split.count() > 20 and per_split.where("least = 0").count() > 0


def test_types_of_unknown_columns(spark, tmp_path, small_splits):
    path = tmp_path / "unknown.csv"
    path.write_text('n,big,part,when,flag,text,none\n' + "".join(
        f'{i},{i + 5_000_000_000},{i}.5,2024-01-0{i % 9 + 1} 10:00:00,true,"a\nb",\n' for i in range(50)))
    found = csv.read_inferred(spark, str(path))
    assert found.dtypes == [("n", "int"), ("big", "bigint"), ("part", "double"), ("when", "timestamp_ntz"), ("flag", "boolean"),
                            ("text", "string"), ("none", "string")]
    assert found.count() == 50 and found.where("text = 'a\nb'").count() == 50


def test_a_header_alone_gives_no_rows(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("id,title,message\n")
    assert records.read_records(spark, str(path), SCHEMA, **OPTIONS).count() == 0


def test_kinds_are_those_of_the_casts(spark):
    """Texts that a form rules out are not cast at all; none of them could be."""
    odd = ["", " ", "12", " +12 ", "-7\t", "\x009\x7f", "\n3\r\n", "1 2", "1.0", "1e3", "--1", "+", "12a", "９", "99999999999", "9" * 30, "2018-01-02 00:00:00",
           "true", " TRUE ", "yEs\n", "n", "No", "0", "1", "10", "t t", "ſ", "yeſ", "tr ue", "say 5", "\u00a05", "\x1ft", "NaN", None, 'says "1", no']
    table = spark.createDataFrame([(v,) for v in odd], "c string")
    for kind in records._KINDS:
        plain = F.expr(f"c IS NULL OR try_cast(c AS {kind}) IS NOT NULL")
        assert table.where(records.fits("c", kind) != plain).count() == 0
    plan = table.select(records.fits("c", "bigint"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("cast(")


YEARS = ["2024", "02024", "12345", "123456", "290000", "294247", "294248", "299999", "300000", "400000", "1234567", "20240102", "-2024", "+12024-01-02", "-290309",
         "2024-1-2", "2024-01", "2024-13-01", "2024-01-02T10:00:00.123456789Z", "2024-01-02 10:00:00 +01:00", "\t2024-01-02 \x7f", "2024x", "T10:00:00",
         "10:00", "epoch", "now", "x2024", "2024-01-02 00:00:00"]
NUMBERS = [".5", "5.", ".", "1e5", "1E+05", "1e", "1.5f", "2D", "1L", "0x1p3", "0x.8P-1", "0x1", "nan", "-Infinity", "+inf", "infin", " 1.5\t", "1.5\x7f", "1,5",
           "1.5.2", "9" * 400, "2147483647", "2147483648", "-2147483648", "3000000000", "9223372036854775807", "9223372036854775808", "0" * 40 + "7", "-" + "0" * 12 + "7",
           "21", "12", "2t", "t1", "(1)", "\u06613", "1\n", "1\x85", "1\u2028"]


def test_forms_leave_out_no_value_that_a_cast_accepts(spark):
    table = spark.createDataFrame([(v,) for v in YEARS + NUMBERS], "c string")
    for kind in records._KINDS:
        plain = F.expr(f"c IS NULL OR try_cast(c AS {kind}) IS NOT NULL")
        assert [r.c for r in table.where(records.fits("c", kind) != plain).collect()] == []
    # What most often fails is told by the form: numbers are no timestamps, timestamps no numbers, no cast raises for these.
    table = spark.createDataFrame([("1234567",), ("400000",)], "c string")
    assert table.where(F.col("c").rlike(records._FORMS["timestamp_ntz"])).count() == 0
    assert table.where(F.lit("2024-01-02 00:00:00").rlike(records._FORMS["double"])).count() == 0


def test_lines_are_divided_where_they_are_read(spark, tmp_path, small_splits):
    """Lines are numbered without shuffling or sorting them; bytes that are no UTF-8 do no harm."""
    path = tmp_path / "reviews.csv"
    path.write_bytes(file_text(3, 300).encode() + b'7,"\xe9\n\xff",z\n')
    numbered = records.numbered_lines(spark, str(path))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in top and not any(x in top for x in ("Window", "Sort", "Exchange hashpartitioning"))
    assert numbered.where("hex(value) LIKE '%22E9' OR hex(value) LIKE 'FF22%'").count() == 2
    assert records.records(spark, str(path)).where("text LIKE '7,\"%z'").count() == 1
