"""Connected components of a link table, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b); the component is its smallest node.

    First every node takes its smallest neighbour's label and links become links between
    labels, so a dense group of n nodes with many times n links is a few rows from then on.
    Then every round gives each node the smallest label among its neighbours and its
    own, then follows the label of the label.  A star is done in one round and a
    chain of n in about log n.  Labels are written out each round, so a lost
    executor costs one round, and the driver only sees a count.  A node with very
    many links is met by a map-side minimum and by a join that can be split.
    """
    both = materialize(_both_ways(links), "links")
    first = materialize(_lowest(both), "labels")
    ends = [first.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab"]
    short = both.filter("a < b").join(ends[0], "a").join(ends[1], "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    joined = _rounds(materialize(_both_ways(short), "links"))
    return first.join(joined.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()


def _lowest(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label")


def _rounds(both: DataFrame) -> DataFrame:
    labels = materialize(_lowest(both), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        new = materialize(low.join(jump, low.label == jump["__n"], "left").select(
            "node", "old", F.least("label", F.coalesce("__l", "label")).alias("label")), "labels")
        changed = not new.filter("label <> old").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
