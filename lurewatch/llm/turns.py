"""Conversations as rows in one global order, cut into range partitions.

A conversation of any length may span several partitions; its rows in one partition are a
piece.  Only the first and the last conversation of a partition can go on elsewhere, so
what passes between pieces is at most two rows per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_turns(conversations: DataFrame, fill: str = "") -> DataFrame:
    """(conv_id, turn, role, text); null role and text become ``fill``; other columns are left out."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) for c in ("role", "text")])


def in_order(turns: DataFrame) -> DataFrame:
    """Rows by conv_id, turn (nulls first), role and text, in range partitions.

    The partitioner samples its keys to the driver, so those hold short prefixes only; rows
    that agree in them share a partition, where the whole texts decide.
    """
    return turns.repartitionByRange(
        "conv_id", F.asc_nulls_first("turn"), F.substring("role", 1, 16), F.substring("text", 1, 64)
    ).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def spanning(rows: DataFrame) -> DataFrame:
    """conv_id of the conversations that lie in several partitions (column part): at most one per partition."""
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
    return edges.select("part", F.explode(F.array_distinct(F.array("first", "last"))).alias("conv_id")).groupBy("conv_id").agg(
        F.count("*").alias("n")).filter("n > 1").select("conv_id")
