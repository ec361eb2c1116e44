"""Reading and writing the tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.contracts import CONTRACTS
from orderlens.operators.cleaning import TIMESTAMP_FORMAT, clean_table
from orderlens.sources.records import odd_quotes, read_inferred_records, read_records
from orderlens.warehouse import Warehouse

_OPTIONS = {"header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"'}
# Free text may hold line breaks: such a table is divided into records first.
_FREE_TEXT = {"reviews"}
# The writer would strip text at both ends otherwise.
_WRITE = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_raw(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as text columns, without inference."""
    schema = CONTRACTS[name].raw_schema
    if name in _FREE_TEXT and has_line_breaks(spark, path):
        return read_records(spark, path, schema, **_OPTIONS)
    return spark.read.options(**_OPTIONS).schema(schema).csv(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table read, cleaned and typed by its contract."""
    return clean_table(read_raw(spark, path, name), CONTRACTS[name])


def read_csv_warehouse(spark: SparkSession, folder: str, files: dict[str, str] | None = None) -> Warehouse:
    """The nine tables of a folder, ``<name>.csv`` unless ``files`` names others."""
    files = files or {}
    return Warehouse(spark, lambda name: read_table(
        spark, f"{folder.rstrip('/')}/{files.get(name, name + '.csv')}", name))


def discover(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files and data set folders directly below a folder, by path.

    They are listed by the file system that the folder's URI names, one name for each data set.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(status.getPath().getName() for status in listed)
    return [f"{folder.rstrip('/')}/{name}" for name in names if name.endswith(".csv")]


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value of the data set holds a line break: some line then has an odd number of quotes."""
    return not spark.read.text(path).filter(odd_quotes()).isEmpty()


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A data set with header and inferred types, for profiling unknown files only."""
    if has_line_breaks(spark, path):
        return read_inferred_records(spark, path, **_OPTIONS)
    return spark.read.options(**_OPTIONS, inferSchema="true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").options(**_OPTIONS, **_WRITE, timestampNTZFormat=TIMESTAMP_FORMAT).csv(path)


def write_csv_warehouse(w: Warehouse, folder: str, *names: str) -> None:
    for name in names or CONTRACTS:
        write_csv(w.table(name), f"{folder.rstrip('/')}/{name}.csv")
