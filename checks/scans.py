"""Scan history, user and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import SCANS, USERS, scans, table, users
from checks.registry import query
from lurewatch.functions import calc as C
from lurewatch.operators import joins as J
from lurewatch.operators import scans as S

text_time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
SQL_TIME = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
NOW = "2024-01-20 10:30:00"


@query("recent_scans", f"""SELECT s.id, username, scan_type, result, confidence, {SQL_TIME.format(c='created_at')} AS created_at
 FROM ({SCANS}) s JOIN ({USERS}) u ON s.user_id = u.id ORDER BY s.created_at DESC, s.id DESC LIMIT 10""")
def recent_scans(spark, sf):
    return J.recent_scans(scans(spark, sf), users(spark, sf)).withColumn("created_at", text_time("created_at"))


@query("scan_detail", f"SELECT id, user_id, content, result FROM ({SCANS}) WHERE id = 42 AND user_id = (SELECT user_id FROM events WHERE event_id = 42)")
def scan_detail(spark, sf):
    owner = table(spark, sf, "events").filter("event_id = 42").select("user_id").scalar()
    return S.lookup(scans(spark, sf).filter(F.col("user_id") == owner), id=42).select("id", "user_id", "content", "result")


@query("user_lookup", f"SELECT * FROM ({USERS}) WHERE username = 'customer_000000007'")
def user_lookup(spark, sf):
    return S.lookup(users(spark, sf), username="customer_000000007")


@query("exists_any", f"SELECT DISTINCT user_id AS id, user_id IN (SELECT id FROM ({USERS}) WHERE role = 'admin') AS \"exists\" FROM events")
def exists_any(spark, sf):
    asked = table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return S.exists_any(users(spark, sf).filter("role = 'admin'"), asked, "id")


TOKENS = """SELECT event_id AS id, md5(CAST(event_id AS VARCHAR)) AS token, user_id, CASE WHEN event_id % 2 = 0 THEN 'verify' ELSE 'reset' END AS purpose,
 ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 24 HOUR ELSE INTERVAL 1 HOUR END AS expires_at, event_id % 3 = 0 AS used, ts AS created_at FROM events"""


def tokens(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        i.alias("id"), F.md5(i.cast("string")).alias("token"), "user_id",
        F.when(i % 2 == 0, "verify").otherwise("reset").alias("purpose"),
        F.when(i % 2 == 0, C.expires_at("ts", 24)).otherwise(C.expires_at("ts", 1)).alias("expires_at"),
        (i % 3 == 0).alias("used"), F.col("ts").alias("created_at"))


@query("valid_tokens", f"SELECT id, token, user_id FROM ({TOKENS}) WHERE purpose = 'verify' AND NOT used AND expires_at >= TIMESTAMP '{NOW}'")
def valid_tokens(spark, sf):
    return S.valid_tokens(tokens(spark, sf), "verify", F.lit(NOW).cast("timestamp")).select("id", "token", "user_id")


@query("history_page", f"""WITH p AS (SELECT * FROM ({SCANS}) WHERE user_id = 7 AND source = 'web' ORDER BY created_at DESC, id DESC LIMIT 500)
 SELECT id, scan_type, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS content, result, confidence, is_phishing, source,
  CASE WHEN epoch_us(created_at) % 1000000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END AS created_at
 FROM p WHERE scan_type = 'URL' AND result = 'Phishing' AND contains(lower(CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END), 'error')""")
def history_page(spark, sf):
    return S.history(scans(spark, sf), 7, "web", "URL", "Phishing", "ERROR", page_first=True)


@query("latest_per_user", f"SELECT user_id, id, rn FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM ({SCANS})) WHERE rn <= 10")
def latest_per_user(spark, sf):
    return S.latest_per_user(scans(spark, sf), 10).select("user_id", "id", "rn")


@query("user_stats", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM ({SCANS})),
 g AS (SELECT user_id, count(*) AS total_scans, sum(CAST(is_phishing AS BIGINT)) AS phishing_detected FROM r WHERE rn <= 50 GROUP BY user_id)
 SELECT user_id, total_scans, phishing_detected, total_scans - phishing_detected AS legitimate_detected,
  CAST(floor((total_scans - phishing_detected) / CAST(total_scans AS DOUBLE) * 100) AS BIGINT) AS clean_scan_rate FROM g""")
def user_stats(spark, sf):
    return S.user_stats(scans(spark, sf), 50)


@query("admin_stats", f"""SELECT (SELECT count(*) FROM ({USERS}) WHERE role = 'user') AS total_users, count(*) AS total_scans,
 sum(CAST(is_phishing AS BIGINT)) AS phishing_detected, sum(CAST(NOT is_phishing AS BIGINT)) AS legitimate_detected,
 round(100.0 * sum(CAST(is_phishing AS BIGINT)) / count(*), 6) AS phishing_rate FROM ({SCANS})""")
def admin_stats(spark, sf):
    return S.admin_stats(scans(spark, sf), users(spark, sf)).withColumn("phishing_rate", F.round("phishing_rate", 6))


@query("scans_by_type", f"SELECT scan_type, count(*) AS n FROM ({SCANS}) GROUP BY scan_type")
def scans_by_type(spark, sf):
    return S.scans_by_type(scans(spark, sf))


@query("daily_scans", f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM ({SCANS}) WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1")
def daily_scans(spark, sf):
    return S.daily_scans(scans(spark, sf), NOW, days=7).withColumn("day", F.col("day").cast("string"))


@query("daily_scans_compat", f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM ({SCANS}) WHERE created_at >= TIMESTAMP '{NOW[:10]} 00:00:00' GROUP BY 1")
def daily_scans_compat(spark, sf):
    return S.daily_scans(scans(spark, sf), NOW, compat=True).withColumn("day", F.col("day").cast("string"))


@query("audit_summary", f"""SELECT event_type, '10.0.0.' || (user_id % 5) AS ip_address, count(*) AS n, count(DISTINCT user_id) AS users,
 {SQL_TIME.format(c='min(ts)')} AS first_seen, {SQL_TIME.format(c='max(ts)')} AS last_seen FROM events GROUP BY 1, 2""")
def audit_summary(spark, sf):
    df = table(spark, sf, "events").withColumns({
        "created_at": F.col("ts"), "ip_address": F.concat(F.lit("10.0.0."), (F.col("user_id") % 5).cast("string"))})
    return S.audit_summary(df).withColumns({c: text_time(c) for c in ("first_seen", "last_seen")})


@query("audit_rows", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE left(text, 500) END AS detail FROM documents")
def audit_rows(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")).alias("detail"))
    return S.audit_rows(df, 500)


@query("most_common", "SELECT p_brand AS value, count(*) AS n FROM (SELECT CAST(l_partkey % 997 AS VARCHAR) AS p_brand FROM lineitem) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 40")
def most_common(spark, sf):
    return S.most_common(table(spark, sf, "lineitem"), (F.col("l_partkey") % 997).cast("string"))


@query("date_columns", """SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(ts)) / 86400000000) AS BIGINT) AS age_days,
 round((epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(ts)) / 1000000, 3) AS seconds,
 strftime(ts + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS expires_at FROM events""")
def date_columns(spark, sf):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    return table(spark, sf, "events").select("event_id", C.age_days("ts", now).alias("age_days"), F.round(C.seconds_between("ts", now), 3).alias("seconds"),
                                             text_time(C.expires_at("ts", 24)).alias("expires_at"))


@query("fresh_domain", """WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id % 90 END AS age FROM events)
 SELECT event_id, age >= 0 AND age < 30 AS is_fresh, CASE WHEN age >= 0 THEN age END AS age_days FROM t""")
def fresh_domain(spark, sf):
    age = F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("event_id") % 90)
    df = table(spark, sf, "events").select("event_id", age.alias("age"))
    fresh, days = C.fresh_domain("age")
    return df.select("event_id", fresh.alias("is_fresh"), days.alias("age_days"))
