"""CSV whose quoted values hold line breaks, read by many tasks.

A line starts a record if an even number of quotes stands before it in its file. Every split counts its own quotes,
running sums over the splits of a file tell whether a split begins inside a quoted value, and each split then divides
its lines into records by itself, in the task that reads it. The lines at the beginning of a split that still belong to a
record of an earlier one are handed over: one piece of text for each split at most. Only these and the last record of each
split are joined; a row for each split that begins inside a quoted value is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.session import materialize

_SPLIT = ("file", "at")
# Tried in this order on unknown columns; text is what is left.
_KINDS = ("int", "bigint", "double", "timestamp_ntz", "boolean")
# Forms without which a cast fails; most texts are told by them, as a failing cast raises and catches an exception inside.
_FORMS = {
    "int": "^[^0-9A-Za-z]*0*(?:[0-9]{1,9}|[12][0-9]{9})[^0-9A-Za-z]*$",
    "bigint": "^[^0-9A-Za-z]*0*[0-9]{1,19}[^0-9A-Za-z]*$",
    "double": r"^[\x00-\x20]*[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?"
              r"|0[xX][0-9A-Fa-f]*(?:\.[0-9A-Fa-f]*)?[pP][+-]?[0-9]+[fFdD]?|(?i:nan|inf|infinity))[\x00-\x20]*$",
    # It begins with a year; those from 300,000 on are beyond the microseconds of a long.
    "timestamp_ntz": "^[^0-9A-Za-z]*(?:[0-9]{4,5}|[012][0-9]{5})(?![0-9])",
    "boolean": "^[^0-9A-Za-z]*(?i:t|true|y|yes|1|f|false|n|no|0)[^0-9A-Za-z]*$"}


def odd_quotes(value: str = "value") -> Column:
    """Whether a line has an odd number of quotes."""
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"')))
    return F.contains(value, F.lit('"')) & (quotes % 2 == 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the place of their split, in rising order of ``line`` within it, and whether the split begins
    inside a quoted value. The lines of a split stay in the task that reads it, in order."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"), "value")
    in_file = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opened = lines.groupBy(*_SPLIT).agg(F.count_if(odd_quotes()).alias("odd")).select(
        *_SPLIT, (F.sum("odd").over(in_file) % 2 == 1).alias("inside")).where("inside")
    return lines.join(F.broadcast(opened), list(_SPLIT), "left").select(
        *_SPLIT, "line", F.col("value").cast("binary").alias("value"), F.coalesce("inside", F.lit(False)).alias("inside"))


def _divided(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives lines the number of their record, or joins them to ``whole`` records: ``text``, or ``edge`` for a part of a
    record that another split may hold more of."""

    def starts(values: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
        """Which lines start a record, and whether the last one ends inside a quoted value."""
        odd = np.cumsum(pc.count_substring(values, b'"').to_numpy(zero_copy_only=False)) + inside
        return np.concatenate(([inside], odd[:-1])) % 2 == 0, bool(odd[-1] % 2)

    def piece(split: tuple, record: int, text: bytes, edge: bool) -> pa.RecordBatch:
        file, at = split
        return pieces(pa.array([file]), pa.array([at]), np.array([record]), pa.array([None if edge else text], pa.binary()),
                      pa.array([text if edge else None], pa.binary()))

    def pieces(file: pa.Array, at: pa.Array, records: np.ndarray, texts: pa.Array, edges: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([file, at, pa.array(records, pa.int64()), texts, edges], ["file", "at", "record", "text", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, record, held = None, False, 0, []  # held: the lines so far of the record that is not closed
        for rows in batches:
            if not len(rows):
                continue
            files, places = rows["file"], rows["at"]
            new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(places[1:], places[:-1])).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]
            for begin, end in zip(cuts, cuts[1:]):
                here, values = (files[begin].as_py(), places[begin].as_py()), rows["value"].slice(begin, end - begin)
                if here != split:
                    if held:
                        yield piece(split, record, b"\n".join(held), True)
                    split, inside, record, held = here, rows["inside"][begin].as_py(), 0, []
                first, inside = starts(values, inside)
                if not whole:
                    yield pa.RecordBatch.from_arrays(
                        [files.slice(begin, end - begin), places.slice(begin, end - begin), rows["line"].slice(begin, end - begin), values,
                         pa.array(record + np.cumsum(first), pa.int64())], ["file", "at", "line", "value", "record"])
                    record += int(first.sum())
                    continue
                opens = np.flatnonzero(first)
                held += values[:opens[0] if len(opens) else None].to_pylist()
                if len(opens):
                    if held:
                        yield piece(split, record, b"\n".join(held), record == 0)
                    closed = len(opens) - 1
                    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(opens, pa.int32()), values), b"\n")
                    if closed:
                        yield pieces(files.slice(begin, closed), places.slice(begin, closed), record + 1 + np.arange(closed), texts, pa.nulls(closed, pa.binary()))
                    held, record = values[opens[-1]:].to_pylist(), record + len(opens)
        if held:
            yield piece(split, record, b"\n".join(held), True)

    return run


def _joined(name: str) -> Column:
    lines = F.array_sort(F.collect_list(F.struct("line", "value")))
    return F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias(name)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line, value, record): the record within its split that a line belongs to, zero for one of an earlier split."""
    lines = _lines(spark, path).mapInArrow(_divided(whole=False), "file string, at long, line long, value binary, record long")
    return lines.withColumn("value", F.col("value").cast("string"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record, text): every record of a data set, header lines too, blank ones not.

    Quotes stand around values and are doubled inside them, and nowhere else. In a file whose first line ends with a carriage
    return, line breaks inside values lose theirs too. The text is written once below the shared folder.
    """
    divided = _lines(spark, path).select(*_SPLIT, "value", "inside").mapInArrow(
        _divided(whole=True), "file string, at long, record long, text binary, edge binary")
    pieces = materialize(divided.withColumns({c: F.col(c).cast("string") for c in ("text", "edge")}), "csv-records")
    # One row or two for each split.
    edges = pieces.where("edge IS NOT NULL").select(*_SPLIT, "record", F.col("edge").alias("value"))
    in_file = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = edges.groupBy(*_SPLIT).agg(F.max("record").alias("record"))
    owner = F.last(F.when(F.col("record") > 0, F.struct("at", "record")), ignorenulls=True).over(in_file)
    handed = edges.where("record = 0").join(last.select(*_SPLIT, owner.alias("owner")), list(_SPLIT))
    rest = handed.select("file", F.col("owner.at").alias("at"), F.col("owner.record").alias("record"), F.col("at").alias("line"), "value") \
        .groupBy(*_SPLIT, "record").agg(_joined("rest"))
    tails = edges.where("record > 0").join(rest, [*_SPLIT, "record"], "left").select(
        *_SPLIT, "record", F.concat_ws("\n", "value", "rest").alias("text"))
    whole = pieces.where("text IS NOT NULL").select(*_SPLIT, "record", "text").union(tails)
    head = F.coalesce("text", "edge")
    ends = pieces.where("at = 0 AND record = 1").where(F.endswith(head, F.lit("\r")) | F.contains(head, F.lit("\r\n"))).select(
        "file", F.lit(True).alias("returns")).distinct()
    text = F.regexp_replace(F.when(F.col("returns"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text")), r"\r\z", "")
    return whole.join(F.broadcast(ends), "file", "left").select(*_SPLIT, "record", text.alias("text")).where(F.trim("text") != "")


def read_records(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A data set with a header line in every file, as the multi-line reader gives it, but read by as many tasks as it has splits."""
    body = records(spark, path).where("NOT (at = 0 AND record = 1)")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return body.select(F.from_csv("text", ddl, {**options, "multiLine": "true", "header": "false"}).alias("row")).select("row.*")


def fits(name: str, kind: str) -> Column:
    """Whether a text column is null or can be cast."""
    return F.col(name).isNull() | (F.col(name).rlike(_FORMS[kind]) & F.expr(f"try_cast({name} AS {kind}) IS NOT NULL"))


def read_inferred_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A data set whose columns are named by the header and get the first type that all their values have."""
    head = spark.read.options(**{**options, "header": "true", "multiLine": "true"}).csv(path).columns
    text = read_records(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in head]), **options)
    text = text.toDF(*[f"c{i}" for i in range(len(head))])
    told = text.agg(*[F.bool_and(fits(f"c{i}", kind)).alias(f"{kind}{i}")
                      for i in range(len(head)) for kind in _KINDS], *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(head))]).first()
    kinds = [next((k for k in _KINDS if told[f"{k}{i}"] and told[f"n{i}"]), "string") for i in range(len(head))]
    return text.select(*[F.col(f"c{i}").cast(k).alias(name) for i, (k, name) in enumerate(zip(kinds, head))])
