"""Metric, gate and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import SCORED, scored, table
from checks.registry import query
from lurewatch.functions import calc as C
from lurewatch.operators import isotonic as I
from lurewatch.operators import joins as J
from lurewatch.operators import metrics as M
from lurewatch.operators import ranks as R

r6 = lambda c: F.round(c, 6)


def rounded(df, *keep):
    """All double columns rounded to six places."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


div = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"
CELLS = """sum(CAST(y = 0 AND h = 0 AS BIGINT)) AS tn, sum(CAST(y = 0 AND h = 1 AS BIGINT)) AS fp,
 sum(CAST(y = 1 AND h = 0 AS BIGINT)) AS fn, sum(CAST(y = 1 AND h = 1 AS BIGINT)) AS tp"""
RATES = f"""round({div('tp + tn', '(tp + tn + fp + fn)')}, 6) AS accuracy, round({div('tp', '(tp + fp)')}, 6) AS precision,
 round({div('tp', '(tp + fn)')}, 6) AS recall, round({div('2 * tp', '(2 * tp + fp + fn)')}, 6) AS f1"""


def predicted(spark, sf, p="p", cut=0.5):
    return scored(spark, sf).withColumn("yhat", (F.col(p) >= cut).cast("int"))


@query("confusion", f"SELECT lang, {CELLS} FROM (SELECT *, CAST(p >= 0.5 AS INT) AS h FROM ({SCORED})) GROUP BY lang")
def confusion(spark, sf):
    return M.confusion(predicted(spark, sf), by=["lang"])


@query("binary_metrics", f"WITH c AS (SELECT lang, {CELLS} FROM (SELECT *, CAST(p >= 0.5 AS INT) AS h FROM ({SCORED})) GROUP BY lang) SELECT *, {RATES} FROM c")
def binary_metrics(spark, sf):
    return rounded(M.binary_metrics(predicted(spark, sf), by=["lang"]))


@query("roc_auc", f"""WITH s AS ({SCORED}), pos AS (SELECT round(p, 9) AS p FROM s WHERE y = 1), neg AS (SELECT round(p, 9) AS p FROM s WHERE y = 0)
 SELECT (SELECT count(*) FROM pos) AS n_pos, (SELECT count(*) FROM neg) AS n_neg,
  round((SELECT sum(CASE WHEN pos.p > neg.p THEN 1.0 WHEN pos.p = neg.p THEN 0.5 ELSE 0.0 END) FROM pos, neg)
   / ((SELECT count(*) FROM pos) * (SELECT count(*) FROM neg)), 6) AS auc""")
def roc_auc(spark, sf):
    return rounded(M.roc_auc(scored(spark, sf).withColumn("p", F.round("p", 9))))


def wilson_sql(k, n, sign):
    z = "CAST(1.96 AS DOUBLE)"
    p = f"(CAST({k} AS DOUBLE) / {n})"
    return (f"CASE WHEN {n} = 0 THEN 0.0 ELSE ({p} + {z} * {z} / (2 * {n}) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / "
            f"(CAST(4 AS DOUBLE) * {n} * {n}))) / (1 + {z} * {z} / {n}) END")


@query("wilson_interval", f"""WITH g AS (SELECT lang, sum(y) AS k, count(*) AS n FROM ({SCORED}) GROUP BY lang)
 SELECT lang, k, n, round({wilson_sql('k', 'n', '-')}, 6) AS ci_low, round({wilson_sql('k', 'n', '+')}, 6) AS ci_high FROM g""")
def wilson_interval(spark, sf):
    g = scored(spark, sf).groupBy("lang").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    return rounded(M.with_wilson(g))


BARS = [("de", False, 0.9), ("en", True, 0.65), ("es", False, 0.4), ("fr", True, 0.1)]
BARS_SQL = "bars(lang, expect, bar) AS (VALUES ('de', false, 0.9), ('en', true, 0.65), ('es', false, 0.4), ('fr', true, 0.1))"


@query("gate", f"""WITH {BARS_SQL}, g AS (SELECT lang, expect, CAST(bar AS DOUBLE) AS bar, sum(CAST((p > 0.5) = expect AS BIGINT)) AS k, count(*) AS n,
  count(DISTINCT missing) AS structures FROM ({SCORED}) JOIN bars USING (lang) GROUP BY 1, 2, 3),
 r AS (SELECT *, round({div('k', 'n')}, 6) AS rate, round({wilson_sql('k', 'n', '-')}, 6) AS ci_low, round({wilson_sql('k', 'n', '+')}, 6) AS ci_high,
  {div('k', 'n')} >= bar AS passed FROM g)
 SELECT *, (SELECT bool_and(passed) FROM r) AS gate FROM r""")
def gate(spark, sf):
    bars = spark.createDataFrame(BARS, "lang string, expect boolean, bar double")
    return rounded(M.gate(scored(spark, sf), bars, "lang", structure="missing"))


CMP = f"""WITH {BARS_SQL}, g AS (SELECT lang, expect, sum(CAST((p > 0.5) = expect AS BIGINT)) AS ka, sum(CAST((pb > 0.5) = expect AS BIGINT)) AS kb,
  count(*) AS n FROM ({SCORED}) JOIN bars USING (lang) GROUP BY 1, 2),
 r AS (SELECT lang, expect, n, {div('ka', 'n')} AS rate_a, {wilson_sql('ka', 'n', '-')} AS a_low, {wilson_sql('ka', 'n', '+')} AS a_high,
  {div('kb', 'n')} AS rate_b, {wilson_sql('kb', 'n', '-')} AS b_low, {wilson_sql('kb', 'n', '+')} AS b_high FROM g)"""


def _compared(spark, sf):
    bars = spark.createDataFrame(BARS, "lang string, expect boolean, bar double")
    return M.compare_models(scored(spark, sf).join(F.broadcast(bars), "lang"), "p", "pb", "lang")


@query("compare_models", CMP + """ SELECT lang, expect, n, round(rate_a, 6) AS rate_a, round(a_low, 6) AS a_low, round(a_high, 6) AS a_high,
 round(rate_b, 6) AS rate_b, round(b_low, 6) AS b_low, round(b_high, 6) AS b_high, round(rate_b - rate_a, 6) AS delta FROM r""")
def compare_models(spark, sf):
    return rounded(_compared(spark, sf))


@query("compare_summary", CMP + """ SELECT expect, round(avg(rate_a), 6) AS mean_a, round(avg(rate_b), 6) AS mean_b,
 arg_min(lang, struct_pack(r := rate_b, l := lang)) AS weakest_b FROM r GROUP BY expect""")
def compare_summary(spark, sf):
    return rounded(M.compare_summary(_compared(spark, sf), "lang"))


@query("fp_by_bucket", f"""SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS bucket, sum(CAST(p >= 0.5 AS BIGINT)) AS flagged, count(*) AS n,
 round(100.0 * sum(CAST(p >= 0.5 AS BIGINT)) / count(*), 6) AS fp_pct FROM ({SCORED}) WHERE y = 0 GROUP BY ROLLUP (lang)""")
def fp_by_bucket(spark, sf):
    return rounded(M.fp_by_bucket(predicted(spark, sf).filter("y = 0"), "lang"))


@query("recall_by_degradation", f"""SELECT missing, sum(CAST(p >= 0.5 AS BIGINT)) AS caught, count(*) AS total,
 round(sum(CAST(p >= 0.5 AS DOUBLE)) / count(*), 6) AS recall FROM ({SCORED}) WHERE y = 1 GROUP BY missing""")
def recall_by_degradation(spark, sf):
    return rounded(M.recall_by_degradation(scored(spark, sf).filter("y = 1")))


@query("upper_median", f"""WITH s AS (SELECT round(p, 9) AS p, row_number() OVER (ORDER BY round(p, 9)) - 1 AS r, count(*) OVER () AS n FROM ({SCORED}))
 SELECT n, round(p, 6) AS value FROM s WHERE r = n // 2""")
def upper_median(spark, sf):
    return rounded(R.upper_median(scored(spark, sf).withColumn("p", F.round("p", 9)), "p"))


GRID = [round(0.20 + 0.05 * i, 2) for i in range(13)]


@query("sweep_threshold", f"""WITH t(t) AS (SELECT unnest({GRID}::DOUBLE[])), c AS (SELECT t AS threshold,
  sum(CAST(y = 1 AND p >= t AS BIGINT)) AS tp, sum(CAST(y = 0 AND p >= t AS BIGINT)) AS fp, sum(CAST(y = 1 AND p < t AS BIGINT)) AS fn
  FROM t, (SELECT round(p, 9) AS p, y FROM ({SCORED})) GROUP BY t),
 m AS (SELECT threshold, {div('tp', '(tp + fp)')} AS precision, {div('tp', '(tp + fn)')} AS recall, {div('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM c)
 SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS chosen FROM m""")
def sweep_threshold(spark, sf):
    return rounded(M.sweep_threshold(scored(spark, sf).withColumn("p", F.round("p", 9))))


@query("class_weights", f"""WITH c AS (SELECT y, count(*) AS n_class FROM ({SCORED}) GROUP BY y)
 SELECT y, n_class, round((SELECT sum(n_class) FROM c) / ((SELECT count(*) FROM c) * CAST(n_class AS DOUBLE)), 6) AS weight,
  round((SELECT n_class FROM c WHERE y = 0) / CAST((SELECT n_class FROM c WHERE y = 1) AS DOUBLE), 6) AS scale_pos_weight FROM c""")
def class_weights(spark, sf):
    return rounded(M.class_weights(scored(spark, sf)))


@query("probe_report", f"SELECT lang, count(*) AS n, sum(CAST(p >= 0.5 AS BIGINT)) AS wrong, round(avg(CAST(p >= 0.5 AS DOUBLE)), 6) AS rate FROM ({SCORED}) WHERE y = 0 GROUP BY lang")
def probe_report(spark, sf):
    df = scored(spark, sf).filter("y = 0").withColumn("flagged", F.col("p") >= 0.5)
    return rounded(M.probe_report(df, by=["lang"]))


@query("probe_worst", f"SELECT doc_id, round(p, 6) AS p FROM ({SCORED}) WHERE y = 0 AND p >= 0.5 ORDER BY round(p, 6) DESC, doc_id LIMIT 6")
def probe_worst(spark, sf):
    df = scored(spark, sf).filter("y = 0").withColumn("flagged", F.col("p") >= 0.5).withColumn("p", r6("p"))
    return M.probe_worst(df, "p", tie="doc_id").select("doc_id", "p")


@query("naive_baseline", f"""WITH s AS (SELECT y, n_chars, CASE WHEN missing = 0 THEN -1 ELSE n_chars % 900 END AS age FROM ({SCORED})),
 h AS (SELECT y, CAST(n_chars > (SELECT median(n_chars) FROM s) OR (age >= 0 AND age < (SELECT quantile_cont(age, 0.25) FROM s WHERE age >= 0)) AS INT) AS h FROM s),
 c AS (SELECT {CELLS} FROM h) SELECT *, {RATES} FROM c""")
def naive_baseline(spark, sf):
    df = scored(spark, sf).withColumn("age", F.when(F.col("missing") == 0, -1).otherwise(F.col("n_chars") % 900))
    return rounded(M.naive_baseline(df, length="n_chars", age="age"))


@query("ship_decision", f"""WITH m AS (SELECT avg(CASE WHEN y = 1 THEN CAST(p >= 0.5 AS DOUBLE) END) AS recall,
  avg(CASE WHEN y = 0 THEN CAST(p >= 0.5 AS DOUBLE) END) AS fp FROM ({SCORED}))
 SELECT round(recall, 6) AS recall, round(fp, 6) AS fp, CAST(NULL AS DOUBLE) AS live, recall >= 0.8 AS recall_ok, fp <= 0.1 AS fp_ok, false AS live_ok, false AS ship FROM m""")
def ship_decision(spark, sf):
    hit = (F.col("p") >= 0.5).cast("double")
    m = scored(spark, sf).agg(F.avg(F.when(F.col("y") == 1, hit)).alias("recall"), F.avg(F.when(F.col("y") == 0, hit)).alias("fp"),
                              F.lit(None).cast("double").alias("live"))
    return rounded(M.ship_decision(m, {"recall": (">=", 0.8), "fp": ("<=", 0.1), "live": (">=", 0.8)}))


@query("corpus_profile", """WITH t AS (SELECT d.text, CAST(l.toxic AS INT) AS label FROM documents d LEFT JOIN labels l USING (doc_id))
 SELECT count(*) AS rows, count(*) - count(text) AS null_text, count(*) - count(label) AS null_label,
  sum(CAST(label = 0 AS BIGINT)) AS n0, sum(CAST(label = 1 AS BIGINT)) AS n1,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, label FROM t)) AS duplicates,
  round(greatest(sum(CAST(label = 0 AS BIGINT)), sum(CAST(label = 1 AS BIGINT))) / CAST(least(sum(CAST(label = 0 AS BIGINT)), sum(CAST(label = 1 AS BIGINT))) AS DOUBLE), 6) AS class_ratio FROM t""")
def corpus_profile(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id", "left")
    return rounded(M.profile(df))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    """2,000 multinomial resamples of the confusion counts."""
    return rounded(M.bootstrap_ci(M.confusion(predicted(spark, sf))))


@query("verdict", f"""SELECT doc_id, p >= 0.35 AS url_phishing, round(CASE WHEN p >= 0.35 THEN p * 100 ELSE (1 - p) * 100 END, 6) AS url_confidence,
 pb > 0.5 AS mail_phishing, round(CASE WHEN pb > 0.5 THEN pb * 100 ELSE (1 - pb) * 100 END, 6) AS mail_confidence FROM ({SCORED})""")
def verdict(spark, sf):
    hit, conf = C.verdict("p", 0.35)
    hit2, conf2 = C.verdict("pb", 0.5, inclusive=False)
    return scored(spark, sf).select("doc_id", hit.alias("url_phishing"), r6(conf).alias("url_confidence"),
                                    hit2.alias("mail_phishing"), r6(conf2).alias("mail_confidence"))


@query("sigmoid_pct", f"SELECT doc_id, round(1.0 / (1.0 + exp(-(p * 8 - 4))), 6) AS squashed, round(CASE WHEN missing = 0 THEN 0.0 ELSE n_chars * CAST(100 AS DOUBLE) / missing END, 4) AS pct FROM ({SCORED})")
def sigmoid_pct(spark, sf):
    return scored(spark, sf).select("doc_id", r6(C.sigmoid(F.col("p") * 8 - 4)).alias("squashed"), F.round(C.pct("n_chars", "missing"), 4).alias("pct"))


KNOTS = "SELECT DISTINCT doc_id AS pos, CAST(0.05 AS DOUBLE) + CAST(doc_id AS DOUBLE) / CAST(223 AS DOUBLE) AS x, sqrt(CAST(doc_id AS DOUBLE) / CAST(200 AS DOUBLE)) AS y FROM documents WHERE doc_id <= 200"


@query("calibrate", f"""WITH k AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM ({KNOTS})), s AS (SELECT doc_id, p * 1.1 AS p FROM ({SCORED}))
 SELECT doc_id, round(CASE WHEN p <= (SELECT min(x) FROM k) THEN (SELECT arg_min(y, x) FROM k) WHEN p >= (SELECT max(x) FROM k) THEN (SELECT arg_max(y, x) FROM k)
  ELSE y + (p - x) * (y1 - y) / (x1 - x) END, 6) AS calibrated FROM s LEFT JOIN k ON p >= x AND p < x1""")
def calibrate(spark, sf):
    i = F.col("doc_id")
    # the calibration curve: a 201-point table, the size a model file has
    knots = table(spark, sf, "documents").filter("doc_id <= 200").select(
        i.alias("pos"), (F.lit(0.05) + i / F.lit(223.0)).alias("x"), F.sqrt(i / F.lit(200.0)).alias("y"))
    df = scored(spark, sf).select("doc_id", (F.col("p") * 1.1).alias("p"))
    return J.calibrate(df, knots).select("doc_id", r6("calibrated").alias("calibrated"))


# the rising fit by its max-min formula over all pairs of distinct scores
FITTED = f"""WITH s AS (SELECT round(p, 4) AS p, sum(y) AS t, count(*) AS n FROM ({SCORED}) GROUP BY 1),
 c AS (SELECT p, t, n, row_number() OVER (ORDER BY p) AS i, sum(t) OVER (ORDER BY p) AS ct, sum(n) OVER (ORDER BY p) AS cn FROM s),
 low AS (SELECT j, i, min(m) OVER (PARTITION BY j ORDER BY i DESC) AS m FROM
  (SELECT a.i AS j, b.i AS i, CAST(b.ct - a.ct + a.t AS DOUBLE) / (b.cn - a.cn + a.n) AS m FROM c a JOIN c b ON a.i <= b.i)),
 f AS (SELECT i, round(max(m), 9) AS y FROM low GROUP BY i),
 blocks AS (SELECT min(p) AS lo, max(p) AS hi, CAST(sum(n) AS BIGINT) AS n, y FROM f JOIN c USING (i) GROUP BY y)"""


def _blocks(spark, sf):
    return I.isotonic_blocks(scored(spark, sf).withColumn("p", F.round("p", 4)))


@query("isotonic_blocks", f"{FITTED} SELECT lo, hi, n, round(y, 6) AS fitted FROM blocks")
def isotonic_blocks(spark, sf):
    return _blocks(spark, sf).select("lo", "hi", "n", r6("fitted").alias("fitted"))


@query("isotonic_knots", f"""{FITTED}, b AS (SELECT *, lag(hi) OVER (ORDER BY lo) AS h, lag(y) OVER (ORDER BY lo) AS z FROM blocks),
 g AS (SELECT CAST(range AS INT) AS pos, range / CAST(200 AS DOUBLE) AS x FROM range(201))
 SELECT pos, round(x, 6) AS x, round(CASE WHEN x > (SELECT max(hi) FROM b) THEN (SELECT max(y) FROM b) WHEN x < (SELECT min(lo) FROM b) THEN (SELECT min(y) FROM b)
  WHEN x >= lo THEN y ELSE z + (x - h) * (y - z) / (lo - h) END, 6) AS y FROM g LEFT JOIN b ON x <= hi AND (h IS NULL OR x > h)""")
def isotonic_knots(spark, sf):
    return I.isotonic_knots(_blocks(spark, sf)).select("pos", r6("x").alias("x"), r6("y").alias("y"))


@query("parity", f"""WITH a AS (SELECT doc_id, p > 0.5 AS f, p FROM ({SCORED}) WHERE missing <> 0), b AS (SELECT doc_id, pb > 0.5 AS f, pb AS p FROM ({SCORED}) WHERE missing <> 1)
 SELECT count(*) AS compared, sum(CAST(a.f IS NULL OR b.f IS NULL AS BIGINT)) AS missing, sum(CAST(a.f IS NULL OR b.f IS NULL OR a.f <> b.f AS BIGINT)) AS mismatches,
  round(max(abs(a.p - b.p)), 6) AS max_dp, false AS parity FROM a FULL JOIN b USING (doc_id)""")
def parity(spark, sf):
    s = scored(spark, sf)
    a = s.filter("missing <> 0").select("doc_id", (F.col("p") > 0.5).alias("is_phishing"), "p")
    b = s.filter("missing <> 1").select("doc_id", (F.col("pb") > 0.5).alias("is_phishing"), F.col("pb").alias("p"))
    return rounded(J.parity(a, b, "doc_id"))
