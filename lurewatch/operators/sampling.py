"""Samples, splits, quotas and set operations.

Every random choice is an MD5 hash of a key and a seed: the same rows are
chosen whatever the partitioning, and after a lost executor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurewatch import fixed
from lurewatch.functions import urls as U
from lurewatch.functions.common import col
from lurewatch.operators.ranks import hash_rank, ordinal, seeded_hash


# ------------------------------------------------------------------ sampling
def sample_n(df: DataFrame, key, n, seed=42) -> DataFrame:
    """Exactly n rows (all, if there are fewer) by a unique key."""
    return hash_rank(df, key, seed, out="_r", limit=n).drop("_r")


def shuffle(df: DataFrame, key, seed=42) -> DataFrame:
    """All rows in reproducible random order (a range-partitioned sort)."""
    return df.withColumn("_h", seeded_hash(key, seed)).orderBy("_h", col(key)).drop("_h")


def cap_random(df: DataFrame, group, key, cap, seed=42) -> DataFrame:
    """At most ``cap`` random rows per group.

    The literal bound on ``row_number`` lets Spark keep only ``cap`` rows per
    group and input partition before the shuffle.
    """
    w = W.partitionBy(group).orderBy("_h", col(key))
    return (df.withColumn("_h", seeded_hash(key, seed))
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_h", "_r"))


def oversample(df: DataFrame, times, where=None) -> DataFrame:
    """Repeat the rows that match ``where`` (default all) ``times`` times."""
    n = F.lit(times) if where is None else F.when(where, F.lit(times)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def cycle_to(pool: DataFrame, n, order) -> DataFrame:
    """n rows ``i, ...`` taken from the pool in turn: row i is pool[i mod size].

    Each pool row produces its own copies, so nothing is joined to the output.
    ``order`` is a unique numeric column.
    """
    size = pool.agg(F.count("*").alias("size")).scalar()
    ranked = ordinal(pool, order, "_pos").withColumn("_size", size).filter(F.col("_pos") < n)
    turns = F.floor((F.lit(n) - 1 - F.col("_pos")) / F.col("_size"))
    return (ranked.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), turns)))
            .withColumn("i", F.col("_turn") * F.col("_size") + F.col("_pos"))
            .drop("_pos", "_size", "_turn"))


# -------------------------------------------------------------------- splits
def domain_split(df: DataFrame, url="url", frac=0.25, seed=42, exact=False,
                 suffixes=fixed.MULTI_SUFFIXES) -> DataFrame:
    """Add ``domain`` and ``split`` so that no registered domain is on both sides.

    Default: a domain goes to ``test`` if its hash lies in the last ``frac`` of
    the hash range - decided in the row, without a shuffle.  ``exact`` puts
    exactly ``int(n * (1 - frac))`` domains into ``train``; only the distinct
    domains are ranked for that.
    """
    df = U.registered_domain(df, url, "domain", suffixes)
    df = df.withColumn("domain", F.when(F.col("domain") == "", F.col(url)).otherwise(F.col("domain")))
    if not exact:
        share = F.conv(F.substring(seeded_hash("domain", seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
        return df.withColumn("split", F.when(share < 1 - frac, "train").otherwise("test"))
    domains = df.select("domain").distinct()
    n = domains.agg(F.count("*").alias("n")).scalar()
    cut = F.floor(n * F.lit(1 - frac))
    sides = hash_rank(domains, "domain", seed, out="_r")
    sides = sides.select("domain", F.when(F.col("_r") <= cut, "train").otherwise("test").alias("split"))
    return df.join(sides, "domain")


def stratified_split(df: DataFrame, y, key, frac, seed=42) -> DataFrame:
    """Add ``split``: round(frac * n_class) rows of every class go to ``test``."""
    ranked = hash_rank(df, key, seed, by=[y], out="_r")
    sizes = df.groupBy(y).agg(F.round(F.count("*") * F.lit(frac)).cast("long").alias("_k"))
    return (ranked.join(F.broadcast(sizes), y)
            .withColumn("split", F.when(F.col("_r") <= F.col("_k"), "test").otherwise("train"))
            .drop("_r", "_k"))


def split_and_append(base: DataFrame, extra: DataFrame, key, frac=0.2, seed=42):
    """(training pool, held-out extra rows): only base + the rest of extra is trained on."""
    ranked = hash_rank(extra, key, seed, out="_r")
    n = extra.agg(F.ceil(F.count("*") * F.lit(frac)).alias("n")).scalar()
    held = ranked.filter(F.col("_r") <= n).drop("_r")
    rest = ranked.filter(F.col("_r") > n).drop("_r")
    pool = (base.withColumn("source", F.lit("original"))
            .unionByName(rest.withColumn("source", F.lit("modern"))))
    return pool, held.withColumn("source", F.lit("modern"))


# ------------------------------------------------------------ set operations
def union_all(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def first_per_key(df: DataFrame, key, order) -> DataFrame:
    """The first row of every key in the given order.

    ``row_number() = 1`` is pruned per input partition before the shuffle, so
    a key with very many copies sends one row per partition.
    """
    keys = key if isinstance(key, (list, tuple)) else [key]
    orders = order if isinstance(order, (list, tuple)) else [order]
    w = W.partitionBy(*keys).orderBy(*orders)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def union_distinct(dfs, key, tie) -> DataFrame:
    """Union without repeated keys; earlier frames win, then ``tie``."""
    tagged = [d.withColumn("source_ord", F.lit(i)) for i, d in enumerate(dfs)]
    return first_per_key(union_all(tagged), key, ["source_ord", tie])


def union_with_quotas(parts, n, key="url", seed=42) -> DataFrame:
    """Distinct union of capped sources, then n random rows.

    ``parts`` is a list of (frame, quota); None keeps the whole source.
    """
    urls = [(d.select(key).distinct(), quota) for d, quota in parts]
    capped = [d if quota is None else sample_n(d, key, quota, seed) for d, quota in urls]
    return sample_n(union_all(capped).distinct(), key, n, seed)


def set_diff(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Rows of a whose key is not in b."""
    return a.join(b.select(key), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """One row: how many distinct keys both frames share (0 = disjoint)."""
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    return both.agg(F.count("*").alias("shared"))


def token_intersect(a, b) -> Column:
    return F.array_intersect(col(a), col(b))


def ordered_distinct(c) -> Column:
    """Array without repeats, first positions kept."""
    return F.array_distinct(col(c))
