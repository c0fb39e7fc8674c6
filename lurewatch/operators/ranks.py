"""Ranks, cumulative sums and quantiles without a global sort in one task.

A window without a partition column would send every row to one task.  Here
rows are first cut into ordered buckets; totals per bucket (a table of fixed
size) give each bucket its offset, and the rest is done bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurewatch.functions.common import col

HASH_BUCKETS = 4096  # three hex digits of an MD5 hash


def seeded_hash(key, seed) -> Column:
    """Reproducible random order: MD5 of key and seed."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"|{seed}")))


def _eq(names):
    return [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]


def hash_rank(df: DataFrame, key, seed=0, by=(), out="rank", limit=None) -> DataFrame:
    """Add the 1-based position of each row in seeded random order.

    ``by`` restarts the count per group.  Buckets are hash prefixes, so they
    are equally large even when one group holds most rows.  With ``limit``
    only rows ranked up to it are returned, and buckets that lie beyond the
    limit are dropped before anything is sorted.
    """
    by = list(by)
    df = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if limit is not None:
        sizes = sizes.filter(F.col("_skip") < limit)
    on = [F.col("l._b") == F.col("r._b"), *_eq(by)]
    joined = df.alias("l").join(sizes.alias("r"), on).select("l.*", "r._skip")
    within = W.partitionBy(*by, "_b").orderBy("_h", col(key))
    ranked = joined.withColumn(out, F.row_number().over(within) + F.col("_skip"))
    if limit is not None:
        ranked = ranked.filter(F.col(out) <= limit)
    return ranked.drop("_h", "_b", "_skip")


def quantile_borders(df: DataFrame, value, buckets) -> DataFrame:
    """One row ``borders``: values that cut the column into about equally many rows each.

    A mergeable quantile sketch, filled where the rows are; each border's rank is off by a
    tenth of a bucket at most, whatever the distribution.
    """
    shares = [k / buckets for k in range(1, buckets)]
    return df.agg(F.percentile_approx(col(value).cast("double"), shares, 10 * buckets).alias("borders"))


def border_bucket(c, borders) -> Column:
    """Number of borders at or below a value: among every 32nd first, then among the 32 after it."""
    x = col(c).cast("double")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= x))
    every = F.filter(borders, lambda b, i: i % 32 == 31)
    coarse = below(every) * 32
    return F.coalesce(coarse + below(F.slice(borders, coarse + 1, F.lit(32))), F.lit(0)).cast("int")


def cumulative_by_value(df: DataFrame, value, sums, buckets=1024, descending=False) -> DataFrame:
    """One row per distinct value with running totals before it.

    ``sums`` maps a name to a numeric column; each gives ``name`` (total at the
    value) and ``name_before`` (total over all earlier values).  Equal values
    are merged before anything is shuffled, so a score shared by most rows is
    one row here.  Bucket borders are quantiles of the distinct values, so crowded
    scores are spread as evenly as others.
    """
    names = list(sums)
    per_value = (df.groupBy(col(value).alias("value"))
                 .agg(*[F.sum(col(c)).alias(n) for n, c in sums.items()])
                 .filter(F.col("value").isNotNull()))
    per_value = per_value.crossJoin(F.broadcast(quantile_borders(per_value, "value", buckets))).withColumn(
        "_b", border_bucket("value", F.col("borders"))).drop("borders")        # one row is broadcast
    order = F.desc if descending else F.asc
    totals = per_value.groupBy("_b").agg(*[F.sum(n).alias(n) for n in names])
    earlier = W.orderBy(order("_b")).rowsBetween(W.unboundedPreceding, -1)  # at most `buckets` rows
    totals = totals.select("_b", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in names])
    inner = W.partitionBy("_b").orderBy(order("value")).rowsBetween(W.unboundedPreceding, -1)
    return (per_value.join(F.broadcast(totals), "_b")
            .select("value", *names,
                    *[(F.coalesce(F.sum(n).over(inner), F.lit(0)) + F.col(f"_{n}")).alias(f"{n}_before")
                      for n in names]))


def value_at(df: DataFrame, value, position, buckets=1024) -> DataFrame:
    """The value at a 0-based position of the sorted column.

    ``position`` maps the row count (a Column) to a position.  Returns one row
    ``n, value``.
    """
    cum = cumulative_by_value(df, value, {"n": F.lit(1).cast("long")}, buckets)
    total = df.filter(col(value).isNotNull()).agg(F.count("*").alias("total")).scalar()
    at = position(total)
    return (cum.filter((F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n")))
            .select(total.alias("n"), "value"))


def upper_median(df: DataFrame, value) -> DataFrame:
    """Element n // 2 of the sorted values (not the mean of the middle two)."""
    return value_at(df, value, lambda n: F.floor(n / 2))


def ordinal(df: DataFrame, key, out="pos") -> DataFrame:
    """Add the 0-based position of every row by a unique numeric key."""
    cum = cumulative_by_value(df, key, {"n": F.lit(1).cast("long")})
    return df.join(cum.select(F.col("value").alias(key), F.col("n_before").alias(out)), key)
