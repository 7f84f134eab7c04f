"""Connected components of a graph, by joins that a node with very many links doesn't burden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilecairn.llm.common import Scratch


def connect(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, component) for the ends of links (a, b): the smallest node reachable.

    Each round gives every node the least label around it and then the label of its label, so that labels
    travel ever further; it ends when none changes. Least labels are partial sums, and a node with very
    many links has one row a task in them.
    """
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("near"))
    ends = scratch.cut(links.where("a <> b").select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*").distinct())
    labels = table = scratch.cut(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        around = ends.join(labels.select(F.col("node").alias("near"), "component"), "near").groupBy("node").agg(F.min("component").alias("least"))
        lower = labels.join(around, "node").select("node", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = scratch.cut(lower.join(of, "component", "left").select("node", F.coalesce("next", "component").alias("component"), "old"))
        done = not moved.where("component <> old").limit(1).count()
        scratch.drop(table)
        labels, table = moved.select("node", "component"), moved
        if done:
            scratch.drop(ends)
            return labels


def joined(component: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, component) with more links (a, b): only the components that these join are connected anew."""
    of = lambda end: component.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    roots = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    top = connect(roots, scratch).select(F.col("node").alias("component"), F.col("component").alias("_top"))
    alone = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(component, "node", "left_anti").select("node", F.col("node").alias("component"))
    return component.unionByName(alone).join(top, "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
