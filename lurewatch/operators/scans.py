"""Scan history, users, tokens and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurewatch.functions.calc import iso, pct, safe_div
from lurewatch.functions.common import col
from lurewatch.functions.text import ellipsize

SCANS = ("id LONG, user_id LONG, scan_type STRING, content STRING, result STRING, confidence DOUBLE, "
         "is_phishing BOOLEAN, shap_explanation STRING, source STRING, created_at TIMESTAMP")
USERS = ("id LONG, first_name STRING, last_name STRING, username STRING, email STRING, role STRING, "
         "is_verified BOOLEAN, created_at TIMESTAMP")
AUDIT = ("id LONG, user_id LONG, event_type STRING, detail STRING, ip_address STRING, created_at TIMESTAMP")
TOKENS = ("id LONG, token STRING, user_id LONG, purpose STRING, expires_at TIMESTAMP, used BOOLEAN, "
          "created_at TIMESTAMP")
CHUNKS = ("doc_id STRING, title STRING, source STRING, chunk_index INT, content STRING, "
          "embedding ARRAY<FLOAT>, created_at TIMESTAMP")


# ------------------------------------------------------------------ look-ups
def lookup(df: DataFrame, **equal) -> DataFrame:
    """First row with the given column values (all conditions are pushed down)."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df.limit(1)


def exists_any(df: DataFrame, keys: DataFrame, key) -> DataFrame:
    """For each requested key: does a row with it exist?"""
    known = df.select(key).distinct().withColumn("exists", F.lit(True))
    return keys.select(key).distinct().join(known, key, "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False)))


def valid_tokens(df: DataFrame, purpose, now) -> DataFrame:
    """Unused, unexpired tokens of a purpose."""
    return df.filter((F.col("purpose") == purpose) & ~F.col("used") & (F.col("expires_at") >= now))


# ------------------------------------------------------------------- history
def latest_per_user(df: DataFrame, k=50) -> DataFrame:
    """Newest k scans of every user.

    ``rn <= k`` is applied per input partition before the shuffle, so a user
    with very many scans sends at most k rows per partition.
    """
    w = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def latest(df: DataFrame, n=50) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def history(df: DataFrame, user_id, source=None, scan_type=None, result=None, search=None, limit=500, page_first=False) -> DataFrame:
    """A user's history, newest first: the newest ``limit`` scans (None: all) that pass the filters.

    The search reads whole contents.  With ``page_first`` the page is cut before type, result
    and search, and the search sees what the page shows (100 characters).
    """
    df = df.filter(F.col("user_id") == user_id)
    if source in ("web", "extension"):
        df = df.filter(F.col("source") == source)
    if not page_first:
        df = _wanted(df, scan_type, result, search)
    page = latest(df, limit) if limit else df
    page = page.select(
        "id", "scan_type", ellipsize("content").alias("content"), "result", "confidence", "is_phishing",
        F.coalesce("source", F.lit("web")).alias("source"), iso("created_at").alias("created_at"))
    return _wanted(page, scan_type, result, search) if page_first else page


def _wanted(df, scan_type, result, search):
    if scan_type and scan_type != "all":
        df = df.filter(F.col("scan_type") == scan_type)
    if result and result != "all":
        df = df.filter(F.col("result") == result)
    return df.filter(F.lower("content").contains(search.lower())) if search else df


def user_stats(df: DataFrame, window=None) -> DataFrame:
    """Per user over the newest ``window`` scans (None: all): totals and clean rate.

    The rate is cut, not rounded, to whole percent; 100 without scans.
    """
    rows = latest_per_user(df, window) if window else df
    out = rows.groupBy("user_id").agg(
        F.count("*").alias("total_scans"), F.count_if("is_phishing").alias("phishing_detected"))
    legit = F.col("total_scans") - F.col("phishing_detected")
    return out.select("user_id", "total_scans", "phishing_detected", legit.alias("legitimate_detected"),
                      F.when(F.col("total_scans") > 0, (legit / F.col("total_scans") * 100).cast("long"))
                      .otherwise(F.lit(100)).cast("long").alias("clean_scan_rate"))


# ---------------------------------------------------------------- admin view
def admin_stats(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Totals in one pass over each table."""
    n_users = users.agg(F.count_if(F.col("role") == "user").alias("n")).scalar()
    one = scans.agg(F.count("*").alias("total_scans"), F.count_if("is_phishing").alias("phishing_detected"),
                    F.count_if(~F.col("is_phishing")).alias("legitimate_detected"))
    return one.select(n_users.alias("total_users"), "*",
                      pct("phishing_detected", "total_scans").alias("phishing_rate"))


def scans_by_type(scans: DataFrame) -> DataFrame:
    return scans.groupBy("scan_type").agg(F.count("*").alias("n"))


def daily_scans(scans: DataFrame, now, days=30, compat=False) -> DataFrame:
    """Scans per day since ``days`` before now; ``compat`` starts at today 0:00."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    since = F.date_trunc("day", now) if compat else now - F.make_dt_interval(days=F.lit(days))
    return (scans.filter(F.col("created_at") >= since)
            .groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n")))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("event_type", "ip_address").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"),
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def audit_rows(df: DataFrame, max_chars=None) -> DataFrame:
    """Audit rows as stored: empty details become NULL; ``max_chars`` cuts long ones."""
    detail = F.when(F.length("detail") > 0, F.substring("detail", 1, max_chars) if max_chars else F.col("detail"))
    return df.withColumn("detail", detail)


def most_common(df: DataFrame, key, n=40) -> DataFrame:
    """Most frequent values, ties by value."""
    return (df.groupBy(col(key).alias("value")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "value").limit(n))


def unknown_platforms(hosts: DataFrame, known, top=None, min_n=3, distinct_subs=False, top_first=False) -> DataFrame:
    """Registered domains seen often with a sub-domain that are no known platform.

    ``hosts``: registered, subdomain.  ``top`` keeps the most frequent ones;
    with ``top_first`` known platforms take places in that list, as in the
    audit.  ``distinct_subs`` counts different sub-domains instead of
    occurrences.
    """
    seen = hosts.filter((F.col("registered") != "") & (F.col("subdomain") != ""))
    if distinct_subs:
        seen = seen.select("registered", "subdomain").distinct()
    known = F.col("value").isin(list(known))
    if top_first:
        found = most_common(seen, "registered", top).filter(~known)
    else:
        found = seen.groupBy(F.col("registered").alias("value")).agg(F.count("*").alias("n")).filter(~known)
        found = found.orderBy(F.desc("n"), "value").limit(top) if top else found
    return found.filter(F.col("n") >= min_n).withColumnRenamed("value", "domain")


def share(df: DataFrame, **conditions) -> DataFrame:
    """Row count and the share of rows for each named condition."""
    out = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    return out.select("*", *[safe_div(k, "n").alias(f"{k}_share") for k in conditions])
