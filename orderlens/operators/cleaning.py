"""Cleaning steps and the recipe that turns a raw text table into its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.contracts import TableContract
from orderlens.functions import strip_all

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().lower() for name in df.columns])


def clean_trim(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: strip_all(c) for c in columns})


def to_timestamp(column: Column, pattern: str = TIMESTAMP_FORMAT) -> Column:
    """Blank is null; any other text that does not parse raises."""
    return F.to_timestamp_ntz(F.nullif(strip_all(column), F.lit("")), F.lit(pattern))


def clean_timestamps(df: DataFrame, *columns: str, pattern: str = TIMESTAMP_FORMAT) -> DataFrame:
    """Parse text columns; missing dates stay null, none is filled and no row is dropped."""
    return df.withColumns({c: to_timestamp(F.col(c), pattern) for c in columns})


def clean_dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def whole_number(text: Column, kind: T.DataType) -> Column:
    """Whole numbers may read 40.0; any other fraction raises."""
    number = text.cast("double")
    fraction = F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast(kind)
    return F.when(text.isNull() | (number == F.rint(number)), number.cast(kind)).otherwise(fraction)


def _typed(column: Column, kind: T.DataType, stripped: bool) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return to_timestamp(column)
    if isinstance(kind, T.StringType):
        text = strip_all(column) if stripped else column
        return F.when(F.length(text) > 0, text)
    text = F.nullif(strip_all(column), F.lit(""))
    if isinstance(kind, T.IntegerType):
        return whole_number(text, kind)
    return text.cast(kind)


def _required(column: Column, contract: TableContract, name: str) -> Column:
    """Raise where a required value is missing, inside the same pass over the data."""
    return F.coalesce(column, F.raise_error(F.lit(f"{contract.name}.{name} must not be null")))


def clean_table(raw: DataFrame, contract: TableContract) -> DataFrame:
    """Headers, names, white space, types, required values and, where asked, duplicates."""
    named = clean_headers(raw).withColumnsRenamed(contract.renames)
    columns = []
    for name, kind, nullable in contract.columns:
        value = _typed(F.col(name), kind, name in contract.text_columns)
        columns.append((value if nullable else _required(value, contract, name).cast(kind)).alias(name))
    cleaned = named.select(columns)
    return clean_dedup(cleaned) if contract.distinct_rows else cleaned
