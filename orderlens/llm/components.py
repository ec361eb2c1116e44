"""Connected components of a link table, without gathering links or groups anywhere.

Rounds of contraction: every node hooks to its least smaller neighbour, hooks are followed
to their end by pointer jumping, and the links are redrawn between the ends. Each round at
least halves the nodes of a group. Tables between steps are written to the shared folder, so
lineage stays short and joins on a hot node are plain exchanges that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.session import Scratch


def _jumped(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """Follow node -> target until every target is an end."""
    while True:
        onward = hooks.select(F.col("node").alias("target"), F.col("target").alias("further"))
        moved = hooks.join(onward, "target", "left").select(
            "node", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved"))
        kept = scratch.keep(moved, "hooks")
        if kept.where("moved").isEmpty():
            return kept.select("node", "target")
        hooks = kept.select("node", "target")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (long columns a, b).

    The component is the least node of the group. Repeated links, links of a node with
    itself and links in either direction are fine; rows with a null end are left out; no
    links give no rows.
    """
    rest = scratch.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(),
        "links")
    nodes = rest.select(F.col("high").alias("node")).union(rest.select("low")).distinct()
    nodes = scratch.keep(nodes.select("node", F.col("node").alias("component")), "nodes")
    while not rest.isEmpty():
        hooks = _jumped(scratch.keep(rest.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("target")),
                                     "hooks"), scratch)
        ends = [hooks.select(F.col("node").alias(x), F.col("target").alias(f"{x}_end")) for x in ("high", "low")]
        drawn = (rest.join(ends[0], "high").join(ends[1], "low", "left")
                 .select(F.col("high_end").alias("x"), F.coalesce("low_end", "low").alias("y")).where("x <> y")
                 .select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct())
        rest = scratch.keep(drawn, "links")
        nodes = scratch.keep(
            nodes.join(hooks.select(F.col("node").alias("component"), "target"), "component", "left")
            .select("node", F.coalesce("target", "component").alias("component")), "nodes")
    return nodes
