"""Enrichment, range, chain and grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import table
from checks.registry import query
from lurewatch import fixed
from lurewatch.operators import joins as J
from lurewatch.plans.url_features import degraded_features

NOW = "2024-02-01 00:00:00"
HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
INFO = f"""SELECT host AS domain, TIMESTAMP '2023-01-01 06:00:00' + to_days(CAST(n % 380 AS INT)) AS created, TIMESTAMP '2024-01-15 00:00:00' + to_days(CAST(n % 200 AS INT)) AS expires,
 CASE WHEN n % 3 = 0 THEN NULL ELSE n % 3600 END AS ttl, CASE WHEN n % 4 = 0 THEN NULL ELSE CAST(n % 900 AS DOUBLE) END AS time_response, CASE WHEN n % 5 = 0 THEN NULL ELSE n % 64000 END AS asn
 FROM (SELECT host, min(page_id) * 7919 AS n FROM (SELECT page_id, {HOST} AS host FROM pages) GROUP BY host) WHERE n % 2 = 0"""


def hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("domain"))


def domain_info(spark, sf):
    n = F.col("n")
    per = hosts(spark, sf).groupBy("domain").agg((F.min("page_id") * 7919).alias("n")).filter("n % 2 = 0")
    day = lambda base, d: F.lit(base).cast("timestamp") + F.make_dt_interval(days=d.cast("int"))
    return per.select("domain", day("2023-01-01 06:00:00", n % 380).alias("created"), day("2024-01-15 00:00:00", n % 200).alias("expires"),
                      F.when(n % 3 != 0, n % 3600).alias("ttl"), F.when(n % 4 != 0, (n % 900).cast("double")).alias("time_response"),
                      F.when(n % 5 != 0, n % 64000).alias("asn"))


days = lambda a, b: f"coalesce(floor((epoch_us({b}) - epoch_us({a})) / 86400000000), -1)"
ENRICH = f"""SELECT page_id, domain, CAST(coalesce(time_response, -1) AS DOUBLE) AS time_response, CAST(coalesce(asn, -1) AS DOUBLE) AS asn_ip,
 CAST({days('created', f"TIMESTAMP '{NOW}'")} AS DOUBLE) AS time_domain_activation, CAST({days(f"TIMESTAMP '{NOW}'", 'expires')} AS DOUBLE) AS time_domain_expiration,
 CAST(coalesce(ttl, -1) AS DOUBLE) AS ttl_hostname FROM (SELECT page_id, {HOST} AS domain FROM pages) LEFT JOIN ({INFO}) USING (domain)"""


@query("enrich_domain", ENRICH)
def enrich_domain(spark, sf):
    return J.enrich_domain(hosts(spark, sf), domain_info(spark, sf), NOW)


@query("degraded_features", "SELECT page_id, " + " + ".join(f"CAST({n} = -1 AS BIGINT)" for n in fixed.NETWORK_FEATURES) + f" AS degraded FROM ({ENRICH})")
def degraded(spark, sf):
    return J.enrich_domain(hosts(spark, sf), domain_info(spark, sf), NOW).select("page_id", degraded_features().alias("degraded"))


IPS = "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'none' ELSE (user_id % 4 + 8) || '.' || (event_id % 8) || '.' || (user_id % 32) || '.' || (event_id % 250) END AS ip FROM events"
PREFIXES = """SELECT DISTINCT (c_custkey % 4 + 8) || '.0.0.0' AS network, 8 AS bits, c_custkey % 4 + 100 AS asn FROM customer WHERE c_custkey % 4 <> 3
 UNION SELECT DISTINCT (c_custkey % 4 + 8) || '.' || (c_custkey % 8) || '.0.0', 16, c_custkey % 8 + 1000 FROM customer
 UNION SELECT DISTINCT (c_custkey % 4 + 8) || '.' || (c_custkey % 8) || '.' || (c_custkey % 24) || '.0', 24, c_custkey % 24 + 50000 FROM customer"""
NUM = lambda c: " + ".join(f"CAST(split_part({c}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))


@query("asn_for_ip", f"""WITH p AS (SELECT min(asn) AS asn, bits, {NUM('network')} AS lo FROM ({PREFIXES}) GROUP BY bits, network),
 i AS (SELECT DISTINCT ip, CASE WHEN ip <> 'none' THEN {NUM('ip')} END AS n FROM ({IPS})),
 m AS (SELECT ip, arg_max(asn, bits) AS asn FROM i JOIN p ON n >= lo AND n < lo + pow(2, 32 - bits) GROUP BY ip)
 SELECT event_id, ip, coalesce(asn, -1) AS asn FROM ({IPS}) LEFT JOIN m USING (ip)""".replace("{NUM('ip')}", ""))
def asn_for_ip(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    s = lambda x: x.cast("string")
    ips = table(spark, sf, "events").select("event_id", F.when(i % 50 == 0, "none").otherwise(
        F.concat_ws(".", s(u % 4 + 8), s(i % 8), s(u % 32), s(i % 250))).alias("ip"))
    c = F.col("c_custkey")
    cust = table(spark, sf, "customer")
    p8 = cust.filter(c % 4 != 3).select(F.concat(s(c % 4 + 8), F.lit(".0.0.0")).alias("network"), F.lit(8).alias("bits"), (c % 4 + 100).alias("asn"))
    p16 = cust.select(F.concat(s(c % 4 + 8), F.lit("."), s(c % 8), F.lit(".0.0")).alias("network"), F.lit(16).alias("bits"), (c % 8 + 1000).alias("asn"))
    p24 = cust.select(F.concat_ws(".", s(c % 4 + 8), s(c % 8), s(c % 24), F.lit("0")).alias("network"), F.lit(24).alias("bits"), (c % 24 + 50000).alias("asn"))
    return J.asn_for_ip(ips, p8.unionByName(p16).unionByName(p24).distinct())


EDGES = """SELECT 'https://r.example/' || page_id AS url, CASE WHEN page_id % 11 = 0 THEN 200 ELSE 302 END AS status,
 'https://r.example/' || ((page_id * 7 + 1) % (SELECT count(*) FROM pages)) AS location, page_id % 13 <> 5 AS public FROM pages"""


@query("resolve_redirects", f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES}), w AS (
  SELECT page_id, 'https://r.example/' || page_id AS cur, CAST([] AS VARCHAR[]) AS chain, false AS blocked, 0 AS hop FROM pages
  UNION ALL SELECT w.page_id, CASE WHEN e.public THEN e.location ELSE w.cur END, CASE WHEN e.public THEN list_append(chain, e.location) ELSE chain END,
   NOT e.public, hop + 1 FROM w JOIN e ON e.url = w.cur WHERE hop < 5 AND NOT blocked
    AND (NOT e.public OR (e.status BETWEEN 300 AND 399 AND e.location <> w.cur AND NOT list_contains(chain, e.location)))),
 l AS (SELECT page_id, arg_max(struct_pack(cur := cur, chain := chain, blocked := blocked), hop) AS x FROM w GROUP BY page_id)
 SELECT page_id, x.cur AS final_url, len(x.chain) > 0 AS redirected, array_to_string(x.chain, ' ') AS chain, x.blocked AS blocked FROM l""")
def resolve_redirects(spark, sf):
    pages = table(spark, sf, "pages")
    i = F.col("page_id")
    url = lambda n: F.concat(F.lit("https://r.example/"), n.cast("string"))
    n = pages.agg(F.count("*").alias("n")).scalar()
    edges = pages.select(url(i).alias("url"), F.when(i % 11 == 0, 200).otherwise(302).alias("status"),
                         url((i * 7 + 1) % n).alias("location"), (i % 13 != 5).alias("public"))
    out = J.resolve_redirects(pages.select("page_id", url(i).alias("url")), edges)
    return out.select("page_id", "final_url", "redirected", F.array_join("redirect_chain", " ").alias("chain"), "blocked")


@query("redirect_ends", f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES}), m AS (SELECT count(*) AS n FROM pages), w AS (
  SELECT url, url AS cur, 0 AS hop FROM e
  UNION ALL SELECT w.url, e.location, hop + 1 FROM w JOIN e ON e.url = w.cur, m WHERE hop <= m.n AND e.public AND e.status = 302 AND e.location <> e.url),
 l AS (SELECT url, arg_max(cur, hop) AS cur, max(hop) AS hops FROM w GROUP BY url)
 SELECT url, CASE WHEN hops <= m.n THEN cur END AS final_url, CASE WHEN hops <= m.n THEN CAST(hops AS BIGINT) END AS hops, hops > m.n AS cycle FROM l, m""")
def redirect_ends(spark, sf):
    """Ends of redirect chains of any length; locations are absolute, by host, by path or relative."""
    pages = table(spark, sf, "pages")
    i = F.col("page_id")
    n = pages.agg(F.count("*").alias("n")).scalar()
    to = ((i * 7 + 1) % n).cast("string")
    form = F.when(i % 4 == 0, F.concat(F.lit("https://r.example/"), to)).when(i % 4 == 1, F.concat(F.lit("//r.example/"), to)).when(
        i % 4 == 2, F.concat(F.lit("/x/.././"), to)).otherwise(to)
    return J.redirect_ends(pages.select(
        F.concat(F.lit("https://r.example/"), i.cast("string")).alias("url"), F.when(i % 11 == 0, 200).otherwise(302).alias("status"),
        form.alias("location"), (i % 13 != 5).alias("public")))


QUIZ = "SELECT c_nationkey % 5 AS pos, chr(CAST(65 + c_nationkey % 4 AS INT)) AS correct_answer FROM customer"
ANSWERS = "SELECT user_id AS quiz_id, event_id % 5 AS pos, max(chr(CAST(65 + event_id % 4 AS INT))) AS answer FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2"


def _graded(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    letter = lambda n: F.char((n % 4 + 65).cast("int"))
    answers = e.filter(i % 3 != 0).groupBy(F.col("user_id").alias("quiz_id"), (i % 5).alias("pos")).agg(F.max(letter(i)).alias("answer"))
    n = F.col("n_nationkey")
    questions = table(spark, sf, "nation").filter(n < 5).select(n.cast("long").alias("pos"), letter(n).alias("correct_answer"))
    return J.grade_quiz(answers, questions)


QQ = "SELECT CAST(n_nationkey AS BIGINT) AS pos, chr(CAST(65 + n_nationkey % 4 AS INT)) AS correct_answer FROM nation WHERE n_nationkey < 5"
GRADED = f"""SELECT t.quiz_id, q.pos, q.correct_answer, a.answer AS user_answer, coalesce(a.answer = q.correct_answer, false) AS is_correct
 FROM (SELECT DISTINCT quiz_id FROM ({ANSWERS})) t CROSS JOIN ({QQ}) q LEFT JOIN ({ANSWERS}) a ON a.quiz_id = t.quiz_id AND a.pos = q.pos"""


@query("grade_quiz", GRADED)
def grade_quiz(spark, sf):
    return _graded(spark, sf)[0]


@query("quiz_feedback", f"""SELECT quiz_id, sum(CAST(is_correct AS BIGINT)) AS score, count(*) AS total, CASE WHEN sum(CAST(is_correct AS BIGINT)) = count(*)
  THEN 'Excellent! You have a strong understanding of phishing.' WHEN sum(CAST(is_correct AS BIGINT)) >= count(*) * 0.6
  THEN 'Good job! You understand the basics, but there''s room for improvement.'
  ELSE 'Keep learning! Review phishing tactics to improve your awareness.' END AS feedback FROM ({GRADED}) GROUP BY quiz_id""")
def quiz_feedback(spark, sf):
    return _graded(spark, sf)[1]
