"""Model jobs on Spark ML: URL classifier, calibration, text classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch import fixed
from lurewatch.functions import hosts as H
from lurewatch.functions import text as T
from lurewatch.functions import urls as U
from lurewatch.functions.calc import fresh_domain, verdict
from lurewatch.operators.isotonic import isotonic_blocks, isotonic_knots
from lurewatch.operators.joins import calibrate
from lurewatch.operators.metrics import class_weights, sweep_threshold
from lurewatch.operators.sampling import stratified_split
from lurewatch.plans.url_features import degraded_features, url_features_v2


def assemble(df: DataFrame, features=fixed.FEATURES_V2) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def weighted(df: DataFrame, y="label") -> DataFrame:
    """Add the balanced class weight of every row (two rows are broadcast)."""
    w = class_weights(df, y).select(F.col("y").alias(y), "weight")
    return df.join(F.broadcast(w), y)


def train_gbt(df: DataFrame, features=fixed.FEATURES_V2, y="label", validation=None, rounds=40, seed=42):
    """Boosted trees, class-weighted, early stop on the rows where
    ``validation`` (a boolean column) is true."""
    gbt = GBTClassifier(labelCol=y, featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=6,
                        stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(assemble(weighted(df, y), features))


def raw_scores(model, df: DataFrame, features=fixed.FEATURES_V2) -> DataFrame:
    out = model.transform(assemble(df, features))
    return out.withColumn("raw", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def fit_calibration(df: DataFrame, p="raw", y="label", points=201) -> DataFrame:
    """Isotonic regression exported as a knot table on an even grid 0..1; fitted in ranges, nothing goes to the driver."""
    return isotonic_knots(isotonic_blocks(df, p, y), points)


def choose_threshold(df: DataFrame, p="calibrated", y="label") -> float:
    """The threshold of the sweep with the best F1 (one value to the driver)."""
    return sweep_threshold(df, p, y).filter("chosen").first()["threshold"]


def score_urls(df: DataFrame, model, knots: DataFrame, threshold, c="url", features=fixed.FEATURES_V2,
               dims=None, use_homograph=True) -> DataFrame:
    """Features -> model -> calibration -> verdict, homographs override."""
    rows = raw_scores(model, url_features_v2(df, c, dims), features)
    rows = calibrate(rows, knots, "raw", "calibrated")
    rows = U.with_url_parts(rows, c, "_s_", ci=False, strip=False)
    rows = H.with_homograph(rows, "_s_host")
    found = F.col("homograph_is_homograph") if use_homograph else F.lit(False)
    hit, confidence = verdict("calibrated", threshold)
    rows = rows.select(
        "*", hit.alias("model_is_phishing"), (hit | found).alias("is_phishing"),
        F.when(found, F.lit(99.0)).otherwise(confidence).alias("confidence"),
        F.when(found, F.greatest("calibrated", F.lit(0.99))).otherwise(F.col("calibrated")).alias("score"),
        F.when(found, F.concat(F.lit("Homograph/IDN lookalike domain — "), F.col("homograph_reason"))).alias("reason"))
    return rows.drop(*[x for x in rows.columns if x.startswith("_s_")])


def with_overlays(df: DataFrame) -> DataFrame:
    """Fresh-domain flag and the number of failed look-ups (v1 feature rows)."""
    fresh, age = fresh_domain("time_domain_activation")
    return df.select("*", fresh.alias("is_fresh"), age.alias("age_days"), degraded_features().alias("degraded_features"))


def fit_url_model(train: DataFrame, key="url", y="label", features=fixed.FEATURES_V2, seed=42, rounds=40):
    """(model, knots, threshold): calibration rows are held out of training."""
    parts = stratified_split(train, y, key, 0.2, seed).withColumn("held", F.col("split") == "test")
    model = train_gbt(parts, features, y, "held", rounds, seed)
    held = raw_scores(model, parts.filter("held"), features)
    knots = fit_calibration(held, "raw", y)
    return model, knots, choose_threshold(calibrate(held, knots, "raw", "calibrated"), "calibrated", y)


def train_text(df: DataFrame, c="text", y="label", dim=1 << 16, max_chars=None):
    """Class-weighted logistic regression on hashed words of the served text (whole, unless ``max_chars`` is given)."""
    stages = [HashingTF(inputCol="words", outputCol="tf", numFeatures=dim),
              IDF(inputCol="tf", outputCol="features"),
              LogisticRegression(labelCol=y, featuresCol="features", weightCol="weight", maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(with_words(weighted(df, y), c, max_chars))


def with_words(df: DataFrame, c="text", max_chars=None) -> DataFrame:
    return df.withColumn("words", T.text_tokens(F.lower(T.normalize_mail(c, max_chars=max_chars))))


def score_text(model, df: DataFrame, c="text", threshold=0.5, max_chars=None) -> DataFrame:
    out = model.transform(with_words(df, c, max_chars)).withColumn("p", vector_to_array("probability")[1])
    hit, confidence = verdict("p", threshold, inclusive=False)
    return out.select(*df.columns, "p", hit.alias("is_phishing"), confidence.alias("confidence"))
