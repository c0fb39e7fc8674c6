"""Isotonic regression by pooling adjacent violators in ranges.

Equal scores are merged first (partial sums before the shuffle).  The merged scores are cut into
ranges, every range is pooled while its sorted rows stream by, and neighbouring ranges are then
pooled with each other, ``FAN`` at a time, until one is left.  Pooling is associative: blocks
that were pooled inside a range stay together in the whole fit.

What leaves a range are blocks of strictly rising means.  For labels 0 and 1 these means are
different fractions whose denominators add up to at most the rows N, of which there are O(N^(2/3));
this bounds the last merge, whatever the scores.
"""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16
BLOCK = "lo double, hi double, total double, n double, part int"
FINAL = "lo double, hi double, n long, fitted double, before_hi double, before_fitted double, is_last boolean"


def _push(stack, blocks):
    """Add (lo, hi, total, n) in order of lo; a block not above the one before it joins it."""
    for lo, hi, total, n in blocks:
        while stack and stack[-1][2] * n >= total * stack[-1][3]:
            lo, _, t, m = stack.pop()
            total, n = total + t, n + m
        stack.append((lo, hi, total, n))


def _frame(stack, part):
    out = pd.DataFrame(stack, columns=["lo", "hi", "total", "n"], dtype="float64")
    out["part"] = pd.Series(part, index=out.index, dtype="int32")
    return out


def _pool_range(batches):
    stack = []
    for pdf in batches:
        _push(stack, zip(pdf["p"].tolist(), pdf["p"].tolist(), pdf["total"].tolist(), pdf["n"].tolist()))
    yield _frame(stack, TaskContext.get().partitionId())


def _merge(key, pdf):
    stack = []
    _push(stack, pdf.sort_values("lo")[["lo", "hi", "total", "n"]].itertuples(index=False, name=None))
    return _frame(stack, key[0])


def _finish(pdf):
    out = _merge((0,), pdf)
    out["fitted"] = out["total"] / out["n"]
    out["before_hi"], out["before_fitted"] = out["hi"].shift(1), out["fitted"].shift(1)
    out["is_last"] = out.index == len(out) - 1
    return out.drop(columns=["total", "part"]).astype({"n": "int64"})


def isotonic_blocks(df: DataFrame, p="p", y="y") -> DataFrame:
    """Least-squares rising step function of the label over the score.

    One row per step: lo and hi (smallest and largest score), n rows, fitted (mean label), the step
    before (before_hi, before_fitted; null on the first) and is_last.  Rows without a label or
    a finite score take no part; an empty table has no steps.
    """
    score, label = F.col(p).cast("double"), F.col(y).cast("double")
    known = score.isNotNull() & label.isNotNull() & (F.abs(score) < float("inf")) & ~F.isnan(label)
    merged = df.filter(known).groupBy(score.alias("p")).agg(F.sum(label).alias("total"), F.count("*").cast("double").alias("n"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = merged.repartitionByRange(ranges, "p").sortWithinPartitions("p").mapInPandas(_pool_range, BLOCK)
    while ranges > FAN:
        ranges = -(-ranges // FAN)
        blocks = blocks.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("part")).applyInPandas(_merge, BLOCK)
    return blocks.groupBy(F.floor(F.col("part") / FAN).alias("all")).applyInPandas(_finish, FINAL)


def isotonic_knots(blocks: DataFrame, points=201) -> DataFrame:
    """The fit on an even grid 0..1 (pos, x, y): steps, straight lines between them, constant outside; y within 0..1."""
    last = points - 1
    cell = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(last)).cast("int")
    inf = F.lit(float("inf"))
    a = F.coalesce("before_hi", -inf)
    b = F.when(F.col("is_last"), inf).otherwise(F.col("hi"))
    low = F.when(a == -inf, F.lit(0.0)).otherwise(F.floor(a * last) - 1)
    high = F.when(b == inf, F.lit(float(last))).otherwise(F.ceil(b * last) + 1)
    grid = blocks.select("*", a.alias("a"), b.alias("b"), F.explode(F.sequence(cell(low), cell(high))).alias("pos"))
    x = F.col("pos") / last
    line = F.col("before_fitted") + (x - F.col("a")) * (F.col("fitted") - F.col("before_fitted")) / (F.col("lo") - F.col("a"))
    value = F.when((x >= F.col("lo")) | F.col("before_hi").isNull(), F.col("fitted")).otherwise(line)
    inside = (x > F.col("a")) & (x <= F.col("b"))
    return grid.filter(inside).select("pos", x.alias("x"), F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)).alias("y"))
