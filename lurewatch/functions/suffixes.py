"""Public-suffix rules as a table: a trie over reversed labels, joined by host tails.

A rule is a node of the trie, named by its path from the top-level domain: ``uk``, ``co.uk``,
``*.ck`` (any label below ck) or the exception ``!www.ck``.  A host walks down the trie by joining
each of its tails, once as it is and once with the front label replaced by ``*``; an exception wins,
then the deepest node.  Hosts are made distinct first, so the work follows the number of hosts, not of rows,
and the rule table may be of any length: it is joined, never collected or turned into literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions.common import col


def suffix_rules(lines: DataFrame, line="value") -> DataFrame:
    """(node, depth, exception) from lines of a public-suffix file; comments and blanks are left out."""
    rule = F.lower(F.regexp_extract(F.trim(col(line)), r"^(\S+)", 1))
    rows = lines.select(rule.alias("rule")).filter("rule <> '' and not startswith(rule, '//') and not startswith(rule, '#')")
    node = F.ltrim("rule", F.lit("!."))
    return rows.select(node.alias("node"), F.size(F.split(node, r"\.")).alias("depth"),
                       F.startswith("rule", F.lit("!")).alias("exception")).distinct()


def read_suffix_rules(spark: SparkSession, path) -> DataFrame:
    """Rule table of a public-suffix file, read by Spark."""
    return suffix_rules(spark.read.text(path))


def suffix_sizes(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, suffix_n) of the distinct hosts that meet a rule; column ``host`` in lower case."""
    depth = rules.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))          # one row
    deepest = F.col("deepest")
    labels = F.split("host", r"\.")
    tail = lambda k: F.when(k > 0, F.array_join(F.slice("labels", F.size("labels") - k + 1, k), ".")).otherwise("")
    steps = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), deepest)), lambda k: F.array(
        tail(k), F.when(k > 1, F.concat(F.lit("*."), tail(k - 1))).otherwise("*")))
    walked = hosts.select("host").filter("host <> ''").distinct().withColumn("labels", labels).crossJoin(F.broadcast(depth)).select(
        "host", F.explode(F.flatten(F.when(deepest > 0, steps).otherwise(F.array()))).alias("node"))
    return walked.join(rules, "node").groupBy("host").agg(
        F.coalesce(F.max(F.when(F.col("exception"), F.col("depth") - 1)), F.max("depth")).alias("suffix_n"))


def with_suffix_size(df: DataFrame, host, out, rules: DataFrame, default) -> DataFrame:
    """Add the number of suffix labels of a host; ``default`` where no rule applies."""
    rows = df.withColumn("_sx_host", F.lower(col(host)))
    sizes = suffix_sizes(rows.select(F.col("_sx_host").alias("host")), rules).select(
        F.col("host").alias("_sx_key"), F.col("suffix_n").alias("_sx_n"))
    return rows.join(sizes, F.col("_sx_host") == F.col("_sx_key"), "left").withColumn(
        out, F.coalesce("_sx_n", default)).drop("_sx_host", "_sx_key", "_sx_n")
