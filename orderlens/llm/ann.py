"""Largest inner products by a hash-prefix forest (an LSH forest).

Inner products become angles by one added component: a stored vector gets
``sqrt(top^2 - |x|^2)``, where ``top`` is the greatest length of any, a query gets zero. Each tree
hashes a vector to a long string of signs and is nothing but the sorted array of these
strings. A query descends each tree to its longest matching prefix by binary search and then
ascends in all trees at once, one sign at a time, until the prefix ranges hold ``reach`` times
the shard's rows (a row counts in each tree that offers it). All rows of these ranges are
scored by their exact product; ties in a range come along whole.

Rows are dealt to shards by id, queries to blocks; each (shard, block) is one cell with a forest
of its own, and the nearest of every cell are merged per query in two steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import batch, bounds, map_arrow, runs, shuffle_partitions
from orderlens.llm.vectors import usable

TREES, SIGNS, REACH, SHARD, QUERIES, SEED = 48, 24, 1.0, 2048, 4096, 6
#: Shards whose results are merged in the first step.
GROUP = 64


class Forest:
    """Sorted sign strings of the rows of one shard."""

    def __init__(self, vectors: np.ndarray, top: float, trees: int = TREES, signs: int = SIGNS, seed: int = SEED):
        self.vectors, self.signs = vectors, signs
        rest = np.sqrt(np.maximum(0.0, top * top - (vectors * vectors).sum(1)))
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees, signs))
        strings = self._strings(np.column_stack([vectors, rest]))
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 0)

    def _strings(self, vectors: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.signs - 1, -1, -1)
        return np.stack([(vectors @ self.planes[:, t] > 0) @ weights for t in range(self.planes.shape[1])], 1)

    def ranges(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree, the range of rows that share the prefix at which the ascent ends."""
        strings = self._strings(np.column_stack([queries, np.zeros(len(queries))]))
        low, high = np.zeros_like(strings), np.zeros_like(strings)
        waiting = np.arange(len(queries))
        for drop in range(self.signs + 1):
            for t in range(strings.shape[1]):
                prefix = strings[waiting, t] >> drop
                low[waiting, t] = np.searchsorted(self.sorted[:, t], prefix << drop)
                high[waiting, t] = np.searchsorted(self.sorted[:, t], (prefix + 1) << drop)
            waiting = waiting[(high[waiting] - low[waiting]).sum(1) < least]
            if not len(waiting):
                break
        return low, high

    def nearest(self, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, reach: float):
        """(ids, scores) of each query's nearest candidates, its own id left out."""
        low, high = self.ranges(queries, max(k + 1, reach * len(ids)))
        taken = np.empty(len(ids), bool)
        for q in range(len(queries)):
            taken[:] = False
            for t in range(low.shape[1]):
                taken[self.order[low[q, t]:high[q, t], t]] = True
            rows = np.flatnonzero(taken & (ids != query_ids[q]))
            scores = self.vectors[rows] @ queries[q]
            if len(rows) > k:
                rows_in = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[rows_in], scores[rows_in]
            best = np.lexsort((ids[rows], -scores))[:k]
            yield ids[rows[best]], scores[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, reach: float = REACH,
            id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part on
    either side, nor do null ids; a query meets vectors of its own length only. A row is a query's
    own if it has its id. Repeated ids are repeated candidates; repeated queries of an id are asked once.
    Empty tables give an empty result; other columns are not read.
    """
    spark = vectors.sparkSession

    def prepared(df):
        slim = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
        return slim.where(usable("v") & F.col("id").isNotNull()).withColumn("length", F.size("v"))

    rows, asked = prepared(vectors), prepared(queries).dropDuplicates(["id"])
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).first()
    top = math.sqrt(facts.top or 0.0)
    shards = max(1, math.ceil(facts.n / SHARD))
    blocks = max(1, math.ceil(asked.count() / QUERIES))

    def dealt(df, own, own_count, other, other_count, question):
        return (df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_count)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_count - 1))))
                .select("length", F.col("shard"), F.col("block"), F.lit(question).alias("question"), "id", "v"))

    keys = ("length", "shard", "block")
    cells = (dealt(rows, "shard", shards, "block", blocks, 0).union(dealt(asked, "block", blocks, "shard", shards, 1))
             .repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, "question", "id"))
    schema = "query_id long, shard int, ids array<long>, scores array<double>"

    def search(batches):
        import pyarrow as pa
        out = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("ids", pa.list_(pa.int64())),
                         ("scores", pa.list_(pa.float64()))])
        for t in runs(batches, keys):
            c = {name: t.column(name).to_numpy() for name in (*keys, "question", "id")}
            edges = bounds([c[name] for name in keys])
            v = t.column("v").combine_chunks()
            for s, e in zip(edges, edges[1:]):
                first = s + int(np.searchsorted(c["question"][s:e], 1))
                if first in (s, e):
                    continue
                m = v.slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)
                ids, query_ids = c["id"][s:first], c["id"][first:e]
                found = Forest(m[:first - s], top).nearest(ids, query_ids, m[first - s:], k, reach)
                near, scores = zip(*found)
                yield batch(out, [query_ids, np.full(len(query_ids), c["shard"][s], np.int32),
                                  pa.array([x.tolist() for x in near], pa.list_(pa.int64())),
                                  pa.array([x.tolist() for x in scores], pa.list_(pa.float64()))])

    found = map_arrow(cells, search, schema).select(
        "query_id", F.col("shard"),
        F.transform(F.arrays_zip("ids", "scores"),
                    lambda x: F.struct((-x["scores"]).alias("order"), x["ids"].alias("vec_id"))).alias("best"))

    def merged(df, *by):
        return df.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))

    grouped = found.withColumn("part", F.expr(f"shard div {GROUP}"))
    best = merged(merged(grouped, "query_id", "part"), "query_id")
    return best.select("query_id", F.posexplode("best").alias("place", "near")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"),
        (-F.col("near.order")).alias("score"))
