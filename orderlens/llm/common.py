"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that one Arrow batch takes to or from a Python worker. A longer row travels alone.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that no frame has, in any case of its letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: str = "text") -> Column:
    """The bytes of a text; a null text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def bounded_batches(spark: SparkSession) -> None:
    """Let batches to and from Python end by bytes, so that long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def sliced_rows(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 4096,
                most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Pack rows into batches bounded by rows and by the bytes of their binary values."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= most_rows or weight >= most_bytes:
            yield batch(schema, zip(*held))
            held, weight = [], 0
    if held:
        yield batch(schema, zip(*held))


def runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Whole runs of rows with equal integer keys, from batches sorted by them.

    Neighbouring runs come together in one table; no run is ever divided.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= v[0] != held[-1].column(k)[held[-1].num_rows - 1].as_py()
        starts = np.flatnonzero(change)
        if len(starts):
            first, last = int(starts[0]), int(starts[-1])
            if held or last:
                yield pa.Table.from_batches([*held, b.slice(0, last)] if last else held)
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def bounds(columns: Iterable[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin, and the end of the last."""
    columns = list(columns)
    change = np.ones(len(columns[0]), bool)
    change[1:] = False
    for v in columns:
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(columns[0]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) that are not the least of their group, with that least node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow types of a flat DDL schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "binary": pa.binary(), "boolean": pa.bool_(), "short": pa.int16(),
             "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])
