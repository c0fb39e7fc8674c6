"""Classifier metrics, gates and comparisons.

All jobs reduce to counts by map-side aggregation first; the formulas run on a
handful of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurewatch.functions.calc import safe_div, wilson
from lurewatch.functions.common import col
from lurewatch.operators.ranks import cumulative_by_value


def confusion(df: DataFrame, y="y", yhat="yhat", by=()) -> DataFrame:
    """tn, fp, fn, tp (per group)."""
    y, yhat = col(y).cast("int"), col(yhat).cast("int")
    cell = lambda a, b: F.count_if((y == a) & (yhat == b))
    return df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                               cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def with_rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 from confusion counts (0 when undefined)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    df = df.select("*", safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                   safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"))
    return df.withColumn("f1", safe_div(2 * tp, 2 * tp + fp + fn))


def binary_metrics(df: DataFrame, y="y", yhat="yhat", by=()) -> DataFrame:
    return with_rates(confusion(df, y, yhat, by))


def roc_auc(df: DataFrame, score="p", y="y") -> DataFrame:
    """Area under the ROC curve, ties counted half.

    Works on one row per distinct score; running sums are cut into buckets, so
    no task sees the whole curve.
    """
    y = col(y).cast("int")
    cum = cumulative_by_value(df, score, {"pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")},
                              descending=True)
    area = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0))
    return cum.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), area.alias("_a")).select(
        "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                 F.col("_a") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))


def sweep_threshold(df: DataFrame, p="p", y="y", thresholds=None) -> DataFrame:
    """Precision, recall and F1 for every threshold, and which one is chosen.

    Scores are binned once; every threshold is then a running sum over the few
    bins.  The best F1 wins, the lowest threshold on ties.
    """
    grid = thresholds or [round(0.20 + 0.05 * i, 2) for i in range(13)]
    level = F.lit(0)
    for t in grid:
        level = level + F.when(col(p) >= F.lit(t), 1).otherwise(0)
    y = col(y).cast("int")
    bins = df.groupBy(level.alias("level")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    # a row at level k passes the first k thresholds
    flat = bins.select("pos", "neg", F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), (F.col("level") > i).alias("hit"))
        for i, t in enumerate(grid)])).alias("g"))
    cells = flat.groupBy(F.col("g.threshold").alias("threshold")).agg(
        F.sum(F.when(~F.col("g.hit"), F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("g.hit"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("g.hit"), F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("g.hit"), F.col("pos")).otherwise(0)).alias("tp"))
    best = W.orderBy(F.desc("f1"), "threshold")  # one row per threshold
    return (with_rates(cells).withColumn("chosen", F.row_number().over(best) == 1)
            .select("threshold", "precision", "recall", "f1", "chosen"))


def class_weights(df: DataFrame, y="y") -> DataFrame:
    """n, n_class, weight = n / (classes * n_class), and neg/pos for binary labels."""
    counts = df.groupBy(col(y).alias("y")).agg(F.count("*").alias("n_class"))
    every = W.partitionBy()  # one row per class
    return counts.select(
        "y", "n_class",
        (F.sum("n_class").over(every) / (F.count("*").over(every) * F.col("n_class"))).alias("weight"),
        (F.sum(F.when(F.col("y") == 0, F.col("n_class")).otherwise(0)).over(every)
         / F.greatest(F.sum(F.when(F.col("y") == 1, F.col("n_class")).otherwise(0)).over(every), F.lit(1))
         ).alias("scale_pos_weight"))


# ------------------------------------------------------------------ intervals
def with_wilson(df: DataFrame, k="k", n="n") -> DataFrame:
    low, high = wilson(k, n)
    return df.select("*", low.alias("ci_low"), high.alias("ci_high"))


def bootstrap_ci(counts: DataFrame, replicates=2000, seed=42) -> DataFrame:
    """95 % bootstrap intervals of precision, recall, f1 and accuracy.

    Resampling n rows with replacement only matters through the four confusion
    counts, which are multinomial.  The replicates are therefore drawn from the
    counts: the cost does not depend on the number of rows.  ``counts`` is the
    one-row result of :func:`confusion`.
    """
    cells = counts.select(F.array("tn", "fp", "fn", "tp").alias("cells")).scalar()
    runs = counts.sparkSession.range(0, replicates).withColumn("cells", cells)

    def draw(batches):
        for pdf in batches:
            out = []
            for run, c in zip(pdf["id"], pdf["cells"]):
                c = np.asarray(c, dtype=float)
                n = int(c.sum())
                got = np.random.default_rng([seed, int(run)]).multinomial(n, c / n) if n else c
                out.append([int(run), *(int(x) for x in got)])
            yield pd.DataFrame(out, columns=["run", "tn", "fp", "fn", "tp"])

    drawn = with_rates(runs.mapInPandas(draw, "run long, tn long, fp long, fn long, tp long"))
    names = ["accuracy", "precision", "recall", "f1"]
    return drawn.agg(*[F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(m) for m in names]).select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.get(m, F.lit(0)).alias("ci_low"),
                                     F.get(m, F.lit(1)).alias("ci_high")) for m in names])).alias("s")).select("s.*")


# ---------------------------------------------------------------------- gates
def gate(df: DataFrame, bars: DataFrame, category="category", p="p", structure=None) -> DataFrame:
    """Pass rate per category against its bar.

    ``bars`` has ``category, expect, bar``.  A row is right when (p > 0.5)
    equals ``expect``.  ``gate`` is true when every category passed.
    """
    rows = df.join(F.broadcast(bars), category)
    ok = (col(p) > 0.5) == F.col("expect")
    extra = [F.count_distinct(col(structure)).alias("structures")] if structure else []
    out = rows.groupBy(category, "expect", "bar").agg(F.count_if(ok).alias("k"), F.count("*").alias("n"), *extra)
    out = with_wilson(out.withColumn("rate", safe_div("k", "n")))
    out = out.withColumn("passed", F.col("rate") >= F.col("bar"))
    return out.withColumn("gate", F.bool_and("passed").over(W.partitionBy()))  # one row per category


def compare_models(df: DataFrame, a="pa", b="pb", category="category", expect="expect") -> DataFrame:
    """Rates and intervals of two models on the same rows, and their difference."""
    hit = lambda c: F.count_if((col(c) > 0.5) == col(expect))
    out = df.groupBy(category, expect).agg(hit(a).alias("ka"), hit(b).alias("kb"), F.count("*").alias("n"))
    la, ha = wilson("ka", "n")
    lb, hb = wilson("kb", "n")
    rate_a, rate_b = safe_div("ka", "n"), safe_div("kb", "n")
    return out.select(category, expect, "n", rate_a.alias("rate_a"), la.alias("a_low"), ha.alias("a_high"),
                      rate_b.alias("rate_b"), lb.alias("b_low"), hb.alias("b_high"),
                      (rate_b - rate_a).alias("delta"))


def compare_summary(compared: DataFrame, category="category", expect="expect") -> DataFrame:
    """Mean rate per side (phishing / legitimate) and the weakest category of model b."""
    return compared.groupBy(expect).agg(
        F.avg("rate_a").alias("mean_a"), F.avg("rate_b").alias("mean_b"),
        F.min_by(col(category), F.struct(F.col("rate_b"), col(category))).alias("weakest_b"))


def fp_by_bucket(df: DataFrame, bucket="bucket", yhat="yhat") -> DataFrame:
    """False positives per bucket and over ALL (rows are all legitimate)."""
    flagged = F.count_if(col(yhat).cast("int") == 1)
    out = df.rollup(bucket).agg(F.grouping(bucket).alias("_all"), flagged.alias("flagged"), F.count("*").alias("n"))
    return out.select(F.when(F.col("_all") == 1, "ALL").otherwise(col(bucket)).alias("bucket"),
                      "flagged", "n", safe_div(100 * F.col("flagged"), "n").alias("fp_pct"))


def recall_by_degradation(df: DataFrame, missing="missing", p="p", threshold=0.5) -> DataFrame:
    """Caught / total by number of missing features."""
    out = df.groupBy(col(missing).alias("missing")).agg(
        F.count_if(col(p) >= threshold).alias("caught"), F.count("*").alias("total"))
    return out.withColumn("recall", safe_div("caught", "total"))


def probe_report(df: DataFrame, flag="flagged", expect=False, by=()) -> DataFrame:
    """How many probe rows differ from what is expected."""
    wrong = F.count_if(col(flag) != F.lit(expect))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), wrong.alias("wrong"))
    return out.withColumn("rate", safe_div("wrong", "n"))


def probe_worst(df: DataFrame, score, flag="flagged", expect=False, n=6, tie="url") -> DataFrame:
    """The wrongly judged probe rows with the highest score."""
    return df.filter(col(flag) != F.lit(expect)).orderBy(F.desc(score), tie).limit(n)


def naive_baseline(df: DataFrame, y="y", length="length_url", age="time_domain_activation") -> DataFrame:
    """Metrics of the rule: longer than the median, or younger than the 25th
    percentile of known ages.  Both columns are small integers, so the exact
    percentiles keep one counter per distinct value."""
    known = F.when(col(age) >= 0, col(age))
    cuts = df.agg(F.percentile(col(length), F.lit(0.5)).alias("len_cut"),
                  F.percentile(known, F.lit(0.25)).alias("age_cut"))
    len_cut, age_cut = cuts.select("len_cut").scalar(), cuts.select("age_cut").scalar()
    hit = (col(length) > len_cut) | ((col(age) >= 0) & (col(age) < age_cut))
    return binary_metrics(df.withColumn("_hat", F.coalesce(hit, F.lit(False)).cast("int")), y, "_hat")


def ship_decision(metrics: DataFrame, conditions: dict) -> DataFrame:
    """Add one boolean per condition and ``ship`` (all of them).

    ``conditions`` maps a metric column to (">=", x), ("<=", x) or ("==", x);
    an unmeasured (NULL) metric never passes.
    """
    ops = {">=": lambda c, x: c >= x, "<=": lambda c, x: c <= x, "==": lambda c, x: c == x}
    checks = {f"{m}_ok": F.coalesce(ops[op](F.col(m), F.lit(x)), F.lit(False))
              for m, (op, x) in conditions.items()}
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    return metrics.select("*", *[c.alias(n) for n, c in checks.items()], every.alias("ship"))


def profile(df: DataFrame, label="label", text="text") -> DataFrame:
    """Rows, nulls, repeated texts and class counts of a labeled corpus.

    Texts are reduced to a hash before they are compared.
    """
    one = df.agg(F.count("*").alias("rows"), F.count_if(col(text).isNull()).alias("null_text"),
                 F.count_if(col(label).isNull()).alias("null_label"),
                 F.count_if(col(label) == 0).alias("n0"), F.count_if(col(label) == 1).alias("n1"))
    distinct = (df.select(F.sha2(F.coalesce(col(text), F.lit("")), 256).alias("t"), col(label).alias("l"))
                .distinct().agg(F.count("*").alias("d")).scalar())
    return one.select("*", (F.col("rows") - distinct).alias("duplicates"),
                      safe_div(F.greatest("n0", "n1"), F.least("n0", "n1")).alias("class_ratio"))


def feature_importance(model, names, top=15) -> pd.DataFrame:
    """(feature, importance) of a fitted tree model, best first."""
    got = sorted(zip(names, model.featureImportances.toArray()), key=lambda x: (-x[1], x[0]))[:top]
    return pd.DataFrame(got, columns=["feature", "importance"])
