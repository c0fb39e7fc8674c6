"""The jobs that have limits, run without them: whole texts, all rows, filters before limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import probe_urls, scans, table
from checks.lookalike import D, HARVEST, HARVEST_LEGIT, PROBE, domain_sql, parts_sql, sql_list
from checks.registry import query
from checks.scans import SCANS
from checks.text import DOCS, DOMAIN, MAILS, anyof, boiler_sql, clean_sql, docs, mail_sql, mails
from lurewatch import fixed
from lurewatch.functions import text as T
from lurewatch.functions import urls as U
from lurewatch.operators import joins as J
from lurewatch.operators import scans as S
from lurewatch.operators import windows as WN
from lurewatch.plans import mail as M

letters_sql = lambda c: rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"


def whole_category_sql(dom, subj, body):
    hay = f"lower({dom} || ' ' || {subj})"
    return (f"CASE WHEN {anyof(hay, fixed.PROMO_HINTS)} AND NOT ({anyof(hay, fixed.SECURITY_SUBJECT_HINTS)}) THEN 'promo' "
            f"WHEN {anyof(dom, fixed.SECURITY_SENDER_HINTS)} OR {anyof(hay, fixed.SECURITY_SUBJECT_HINTS)} OR "
            f"{anyof(f'lower({body})', fixed.SECURITY_SUBJECT_HINTS)} THEN 'security_transactional' ELSE 'ordinary_legit' END")


@query("normalize_mail_whole", f"SELECT doc_id, {mail_sql('text')} AS served FROM ({DOCS})")
def normalize_mail_whole(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_mail("text").alias("served"))


@query("content_keys", f"SELECT doc_id, CASE WHEN {letters_sql('text')} <> '' THEN sha256({letters_sql('text')}) END AS content_key FROM ({DOCS})")
def content_keys(spark, sf):
    return docs(spark, sf).select("doc_id", T.content_key("text").alias("content_key"))


@query("review_set_whole", f"""WITH c AS (SELECT msg_idx, {DOMAIN} AS dom, {clean_sql('subject')} AS subj, {clean_sql('body')} AS body FROM ({MAILS})),
 k AS (SELECT *, {letters_sql('body')} AS key FROM c WHERE length(body) >= 150 AND NOT {boiler_sql('body')}),
 g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY msg_idx) AS first FROM k)
 SELECT msg_idx, body AS text, dom AS sender_domain, subj AS subject, {whole_category_sql('dom', 'subj', 'body')} AS auto_category, '' AS verified_label
 FROM g WHERE key = '' OR first = 1""")
def review_set_whole(spark, sf):
    return M.review_set(mails(spark, sf), normalize=False)


@query("training_set_whole", f"""WITH a AS (SELECT text, CAST(doc_id % 2 AS INT) AS label, 0 AS s FROM ({DOCS})
  UNION ALL SELECT text, 1, 1 FROM benchmark UNION ALL SELECT text, 0, 2 FROM conversations),
 n AS (SELECT {mail_sql('text')} AS text, label, s FROM a WHERE length(text) > 20),
 k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY s, label) AS r FROM n WHERE length(text) > 20)
SELECT sha256(text) AS key, label, s AS source_ord FROM k WHERE r = 1""")
def training_set_whole(spark, sf):
    d = docs(spark, sf).select("text", (F.col("doc_id") % 2).cast("int").alias("label"))
    b = table(spark, sf, "benchmark").select("text", F.lit(1).alias("label"))
    c = table(spark, sf, "conversations").select("text", F.lit(0).alias("label"))
    return M.training_set([d, b], c).select("key", "label", "source_ord")


@query("history_search", f"""SELECT id, scan_type, result, is_phishing FROM ({SCANS})
 WHERE user_id = 7 AND scan_type = 'URL' AND contains(lower(content), 'error')""")
def history_search(spark, sf):
    """A search over all scans of a user, not over the newest 500."""
    return S.history(scans(spark, sf), 7, scan_type="URL", search="ERROR", limit=None).select(
        "id", "scan_type", "result", "is_phishing")


@query("user_stats_all", f"""WITH g AS (SELECT user_id, count(*) AS total_scans, sum(CAST(is_phishing AS BIGINT)) AS phishing_detected FROM ({SCANS}) GROUP BY user_id)
 SELECT user_id, total_scans, phishing_detected, total_scans - phishing_detected AS legitimate_detected,
  CAST(floor((total_scans - phishing_detected) / CAST(total_scans AS DOUBLE) * 100) AS BIGINT) AS clean_scan_rate FROM g""")
def user_stats_all(spark, sf):
    return S.user_stats(scans(spark, sf))


@query("cap_some_groups", """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
 WHERE r <= CASE source WHEN 'src0' THEN 40 WHEN 'src1' THEN 25 ELSE r END OR source IS NULL""")
def cap_some_groups(spark, sf):
    return WN.cap_per_group(table(spark, sf, "documents").select("source", "doc_id"), "source", {"src0": 40, "src1": 25}, "doc_id")


@query("harvest_all", f"""WITH {parts_sql(PROBE)}, {domain_sql()}
 SELECT page_id, p.url FROM dom JOIN ({PROBE}) p USING (page_id)
 WHERE len(list_filter({sql_list(HARVEST)}, lambda b: contains(concat_ws('.', subdomain, registered), b))) > 0
  AND NOT list_contains({sql_list(HARVEST_LEGIT)}, registered)""")
def harvest_all(spark, sf):
    return J.harvest_lookalikes(probe_urls(spark, sf), HARVEST, HARVEST_LEGIT).select("page_id", "url")


@query("unknown_platforms_all", f"""WITH {parts_sql(PROBE)}, {domain_sql()},
 c AS (SELECT registered AS domain, count(*) AS n FROM dom WHERE registered <> '' AND subdomain <> '' GROUP BY 1)
 SELECT domain, n FROM c WHERE n >= 3 AND NOT list_contains({sql_list(D.rule_platforms)}, domain)""")
def unknown_platforms_all(spark, sf):
    df = U.with_domain(U.with_url_parts(probe_urls(spark, sf)), prefix="u_")
    return S.unknown_platforms(df.select(F.col("u_registered").alias("registered"), F.col("u_subdomain").alias("subdomain")), D.rule_platforms)
