"""Mail data sets: from an archive to training rows, and template corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import fixed
from lurewatch.functions import text as T
from lurewatch.functions.common import sealed
from lurewatch.operators.sampling import first_per_key, oversample, stratified_split, union_all
from lurewatch.operators.windows import cap_per_group, dedupe_first


def review_candidates(mails: DataFrame, name=None, email=None, min_len=150, normalize=True) -> DataFrame:
    """Cleaned, redacted mails that are long enough and no boilerplate.

    ``mails``: msg_idx, subject, from_hdr, body.  Cheap tests come before the
    comparison of signatures.
    """
    rows = mails.select(
        "msg_idx",
        T.sender_domain("from_hdr").alias("sender_domain"),
        T.redact(T.clean_text("body", normalize), name, email).alias("body"),
        T.redact(T.clean_text("subject", normalize), name, email).alias("subj"))
    # cleaned once per mail, not again inside every test below
    rows = sealed(rows, ["msg_idx"], {c: F.col(c) for c in ("sender_domain", "body", "subj")})
    return rows.filter((F.length("body") >= min_len) & ~T.is_boilerplate("body"))


# limits of a sheet that people fill in by hand
SHEET = {"sig_chars": 120, "head": 400, "caps": fixed.CATEGORY_CAPS, "text_chars": 1500, "subject_chars": 200}


def review_set(mails: DataFrame, name=None, email=None, min_len=150, normalize=True, caps=None, sig_chars=None,
               head=None, text_chars=None, subject_chars=None) -> DataFrame:
    """Rows for hand labelling: first of equal mails, per category at most ``caps`` rows.

    Equal are mails with the same letters and digits, of any script; with ``sig_chars`` those
    with the same leading latin ones.  A mail that has none is equal to no other.  All limits
    are off unless given; ``**SHEET`` are those of a labelling sheet.
    """
    cut = lambda c, n: F.substring(c, 1, n) if n else F.col(c)
    rows = review_candidates(mails, name, email, min_len, normalize)
    sig = F.nullif(T.signature("body", sig_chars), F.lit("")) if sig_chars else T.content_key("body")
    rows = dedupe_first(rows.withColumn("sig", F.coalesce(sig, F.concat(F.lit("#"), F.col("msg_idx").cast("string")))), "sig", "msg_idx").drop("sig")
    rows = rows.withColumn("auto_category", T.categorize_mail("sender_domain", "subj", "body", head))
    if caps:
        rows = cap_per_group(rows, "auto_category", caps, "msg_idx")
    return rows.select("msg_idx", cut("body", text_chars).alias("text"), "sender_domain",
                       cut("subj", subject_chars).alias("subject"), "auto_category",
                       F.lit("").alias("verified_label"))


def recode_review_labels(df: DataFrame) -> DataFrame:
    """legit -> 0, spam -> 1; skipped and empty labels are dropped."""
    label = F.when(F.col("verified_label") == "legit", 0).when(F.col("verified_label") == "spam", 1)
    return df.withColumn("label", label).filter("label IS NOT NULL").select("text", "label")


def drop_short(df: DataFrame, c="text", n=20):
    return df.filter(F.col(c).isNotNull() & (F.length(c) > n))


def training_set(frames, reviewed: DataFrame, times=15, oversample_first=True, max_chars=None) -> DataFrame:
    """Union of corpora and reviewed mails, normalised, distinct by text.

    Repeating the reviewed rows before the distinct step has no effect (every
    copy but one is dropped), so no copies are made then;
    ``oversample_first=False`` repeats them after it.
    """
    tagged = [f.select("text", "label").withColumn("source_ord", F.lit(i)) for i, f in enumerate(frames)]
    extra = reviewed.select("text", "label").withColumn("source_ord", F.lit(len(frames)))
    rows = drop_short(union_all([*tagged, extra]))
    rows = drop_short(sealed(rows, ["label", "source_ord"], {"text": T.normalize_mail("text", max_chars=max_chars)}))
    rows = first_per_key(rows.withColumn("key", F.sha2("text", 256)), "key", ["source_ord", "label"])
    if not oversample_first:
        rows = oversample(rows, times, F.col("source_ord") == len(frames)).drop("copy")
    return rows


def training_split(rows: DataFrame, frac=0.2, seed=42) -> DataFrame:
    return stratified_split(rows, "label", "key", frac, seed)


def generate_corpus(templates: DataFrame, subjects: DataFrame, brands: DataFrame, fills: dict, n=None) -> DataFrame:
    """Mails of each category: template x subject x plausible brand, filled.

    ``templates`` and ``subjects``: category, text; ``brands``: category,
    brand (work mail has none).  Rows are joined by category, no list of a
    category is gathered in one row; ``n`` keeps that many mails per category.
    """
    bodies = templates.filter("text IS NOT NULL").select("category", F.col("text").alias("body")).distinct()
    lines = subjects.filter("text IS NOT NULL").select("category", F.col("text").alias("subject")).distinct()
    names = brands.filter("brand IS NOT NULL").select("category", "brand").distinct()
    # the lines of a category, with its brands, are few beside the templates
    heads = lines.join(names, "category", "left").withColumn("brand", F.coalesce("brand", F.lit("")))
    rows = bodies.join(heads, "category")
    key = F.concat_ws("|", "category", "body", "subject", "brand")
    body = T.fill_template(F.replace("body", F.lit("{brand}"), F.col("brand")), fills, key)
    head = F.when(F.col("brand") != "", F.concat_ws(" - ", "brand", "subject")).otherwise(F.col("subject"))
    mails = rows.withColumn("text", F.concat(F.lit("Subject: "), head, F.lit("\n\n"), body))
    mails = mails.select("category", "brand", F.col("body").alias("template"), "text")
    if n is None:
        return mails
    from lurewatch.operators.sampling import cap_random
    return cap_random(mails, "category", "text", n)


def brand_categories(spark) -> DataFrame:
    """category, brand pairs of the fixed brand profiles."""
    data = [(c, b) for b, cats in fixed.BRAND_PROFILES.items() for c in cats]
    return spark.createDataFrame(data, "category string, brand string")
