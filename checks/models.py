"""Model jobs (no SQL form): trained and scored on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import probe_urls, table
from checks.registry import query
from lurewatch.operators import lookalike as L
from lurewatch.operators import metrics as M
from lurewatch.plans import training as TR
from lurewatch.session import materialize

r6 = lambda c: F.round(c, 6)
FEATURES = ["length_url", "qty_digit_url", "subdomain_entropy", "platform_and_random_subdomain", "brand_impersonation",
            "action_token_in_path", "suspicious_tld", "directory_length"]


@query("url_model_scores")
def url_model_scores(spark, sf):
    """Boosted trees on URL features, labels from the rule verdicts."""
    from lurewatch.plans.url_features import url_features_v2
    urls = L.lookalike_verdicts(probe_urls(spark, sf), decode_idn=False).select(
        "page_id", "url", F.col("is_lookalike").cast("int").alias("label"))
    rows = materialize(url_features_v2(urls).dropDuplicates(["page_id"]), "url-features")
    model, knots, threshold = TR.fit_url_model(rows, "page_id", "label", FEATURES, rounds=8)
    scored = TR.score_urls(rows.select("page_id", "url", "label"), model, materialize(knots, "knots"), threshold, features=FEATURES)
    return scored.select("page_id", "label", r6("score").alias("score"), "is_phishing")


@query("text_model_scores")
def text_model_scores(spark, sf):
    """Logistic regression on hashed words, quality labels of the documents."""
    rows = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("label")), "doc_id")
    rows = materialize(rows, "labeled-text")
    model = TR.train_text(rows, dim=1 << 12)
    return TR.score_text(model, rows).select("doc_id", r6("p").alias("p"), "is_phishing")
