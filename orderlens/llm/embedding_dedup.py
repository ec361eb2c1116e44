"""Near-duplicate vectors: sign hashing in several tables, exact cosines, components.

Every table hashes a vector to the signs of its products with random hyperplanes. The number
of signs follows from the number of vectors, so that a bucket has about ``BUCKET`` of them,
and the number of tables from the chance ``RECALL`` that a pair at the threshold itself shares
a bucket in one of them; closer pairs meet more surely. Equal vectors are one class before
hashing. A bucket of more than ``CHUNK`` classes is divided into chunks, and each pair of chunks
is a cell of its own, so no task holds more than two chunks. A cell counts links and
returns one row per class: a pair that met in an earlier table is left out, so counts add up;
pairs never leave the task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import arrow_schema, batch, bounds, map_arrow, runs, shuffle_partitions
from orderlens.llm.components import components
from orderlens.llm.vectors import by_length, matrix, usable
from orderlens.session import Scratch

THRESHOLD, RECALL, BUCKET, CHUNK, SEED = 0.95, 0.9995, 128, 1024, 11


def layout(count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Signs a table, and tables."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, count) / BUCKET)) if count > BUCKET else 4))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Row by table: the signs as whole numbers."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.int32)


def _cell(rep, size, unit, codes, table, mine, other, threshold):
    """Links of one cell: (links of each row, root of each row within the cell)."""
    n = len(rep)
    count, seen = np.zeros(n, np.int64), []
    rows = np.flatnonzero(mine)
    columns = rows if other is None else np.flatnonzero(other)
    for at in range(0, len(rows), 256):
        r = rows[at:at + 256]
        close = unit[r] @ unit[columns].T >= threshold
        close &= rep[r][:, None] != rep[columns][None, :]
        x, y = np.nonzero(close)
        if not len(x):
            continue
        x, y = r[x], columns[y]
        if table:
            new = ~(codes[x, :table] == codes[y, :table]).any(1)
            x, y = x[new], y[new]
        np.add.at(count, x, size[y])
        if other is not None:
            np.add.at(count, y, size[x])
        seen.append((x, y))
    root = np.arange(n)
    if seen:
        x, y = (np.concatenate(z) for z in zip(*seen))
        while True:
            new = root.copy()
            np.minimum.at(new, x, root[y])
            np.minimum.at(new, y, root[x])
            new = new[new]
            if (new == root).all():
                break
            root = new
    return count, root


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, recall: float = RECALL,
                 id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths do not link. Repeated rows and equal vectors are linked. A null
    id stays null and names no component unless its class has no other id. An empty table gives
    an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_column).cast("long").alias("vec_id"),
                       F.col(vector_column).cast("array<double>").alias("v"))
    ok = usable("v")
    keyed = v.select("vec_id", F.when(ok, F.col("v")).alias("v"),
                     F.when(ok, F.xxhash64("v")).alias("h"), F.when(ok, F.hash("v")).alias("g"))
    slim = scratch.keep(keyed.select("vec_id", "h", "g"), "rows")
    classes = scratch.keep(
        keyed.where("h IS NOT NULL").groupBy("h", "g")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v"))
        .withColumn("rep", F.coalesce("least", F.col("h"))), "classes")
    bits, tables = layout(classes.count(), threshold, recall)

    def sign(batches):
        out = arrow_schema("table int, code int, rep long, size long, length int, vector binary, codes binary")
        for b in batches:
            for rows in by_length(b, "v"):
                part = b.take(rows)
                m = matrix(part.column("v"))
                codes = signatures(m, bits, tables)
                packed = [[x.tobytes() for x in m], [x.tobytes() for x in codes]]
                for t in range(tables):
                    yield batch(out, [np.full(len(m), t, np.int32), codes[:, t], part.column("rep"), part.column("size"),
                                      np.full(len(m), m.shape[1], np.int32), *packed])

    signed = map_arrow(classes.select("rep", "size", "v"), sign,
                       "table int, code int, rep long, size long, length int, vector binary, codes binary")
    hot = scratch.keep(signed.groupBy("table", "length", "code").count().where(F.col("count") > CHUNK)
                       .withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count"), "hot")
    chunked = (signed.join(hot, ["table", "length", "code"], "left")
               .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
               .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
               .withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")))
    keys = ("table", "length", "code", "low", "high")

    def compare(batches):
        out = arrow_schema("rep long, links long, root long")
        for t in runs(batches, keys):
            c = {k: t.column(k).to_numpy() for k in (*keys, "mine", "rep", "size")}
            edges = bounds([c[k] for k in keys])
            vector, codes = t.column("vector").combine_chunks(), t.column("codes").combine_chunks()
            for s, e in zip(edges, edges[1:]):
                if e - s < 2:
                    continue
                m = np.frombuffer(b"".join(vector.slice(s, e - s).to_pylist())).reshape(e - s, -1)
                unit = m / np.linalg.norm(m, axis=1)[:, None]
                code = np.frombuffer(b"".join(codes.slice(s, e - s).to_pylist()), np.int32).reshape(e - s, -1)
                rep, size, mine = (c[k][s:e] for k in ("rep", "size", "mine"))
                low, high = c["low"][s], c["high"][s]
                count, root = _cell(rep, size, unit, code, int(c["table"][s]), mine == low,
                                    None if low == high else mine == high, threshold)
                at = np.flatnonzero((count > 0) | (root != np.arange(e - s)))
                if len(at):
                    yield batch(out, [rep[at], count[at], rep[root[at]]])

    dealt = chunked.drop("other", "chunks").repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    met = scratch.keep(map_arrow(dealt, compare, "rep long, links long, root long"), "met")
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    placed = scratch.keep(
        classes.select("h", "g", "rep", "least", "size").join(counts, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h", "g", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                F.coalesce("component", "rep").alias("component")), "placed")
    least = scratch.keep(placed.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = scratch.keep(placed.join(least, "component").select("h", "g", "links", "component_id"), "named")
    return slim.join(named, ["h", "g"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
