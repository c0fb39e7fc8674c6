"""Look-alike rules, brand matching and typosquat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import PROBE, Q, probe_urls, sql_list, table, values
from checks.registry import query
from checks.urls import domain_sql, parts_sql
from lurewatch import fixed
from lurewatch.dims import Dims, apply_approved
from lurewatch.functions import urls as U
from lurewatch.functions.common import strings
from lurewatch.operators import joins as J
from lurewatch.operators import lookalike as L
from lurewatch.operators import scans as S

D = Dims()
BRANDS = values("brand_", "o, b", list(enumerate(D.brands)))
FROM, TO = fixed.RULE_CONFUSABLES
fold_keep = lambda c: f"translate(lower({c}), {Q(FROM)}, {Q(TO)})"
fold = lambda c: f"replace(replace({fold_keep(c)}, '-', ''), '_', '')"
toks = lambda c: f"list_filter(regexp_split_to_array({fold_keep(c)}, '[^a-z0-9]+'), lambda x: x <> '')"
corr = lambda c: f"len(list_filter({sql_list(D.corroborating)}, lambda w: contains({fold_keep(c)}, w))) > 0"


def names(text, ctx):
    """SQL: brand b is named in text (short ones as words, corroborated by ctx)."""
    return (f"CASE WHEN length(b) >= 4 THEN contains({fold(text)}, b) ELSE list_contains({toks(text)}, b) OR "
            f"(({corr(ctx)}) AND len(list_filter({toks(ctx)}, lambda t: starts_with(t, b) AND t <> b)) > 0) END")


NEAR = ("length(b) >= 5 AND length({l}) >= 5 AND abs(length({l}) - length(b)) <= 1 AND (levenshtein({l}, b) = 1 OR "
        "(levenshtein({l}, b) = 2 AND length(b) >= 8 AND left({l}, 4) = left(b, 4) AND right({l}, 2) = right(b, 2)))")

PLATFORM = f"""plat_(p) AS (SELECT unnest({sql_list(D.rule_platforms)})),
 pl AS (SELECT d.*, (SELECT arg_max(p, length(p)) FROM plat_ WHERE host = p OR ends_with(host, '.' || p)) AS platform FROM dom d)"""

def verdict_sql(src):
    return rf"""WITH {BRANDS}, legit_(d) AS (SELECT unnest({sql_list(D.legit_domains)})),
 {values("known_", "d, why", list(D.known_legitimate.items()))},
 {parts_sql(src)}, {domain_sql()}, {PLATFORM},
 u AS (SELECT page_id, host, path, platform, list_last(string_split(suffix, '.')) AS tld,
   coalesce(platform, registered) AS reg,
   CASE WHEN platform IS NULL THEN subdomain WHEN host = platform THEN '' ELSE left(host, length(host) - length(platform) - 1) END AS sub,
   CASE WHEN platform IS NULL THEN label ELSE split_part(platform, '.', 1) END AS label FROM pl),
 s AS (SELECT *, {fold('label')} AS fl, {fold('reg')} AS fr, {fold('sub')} AS fs,
   list_contains({sql_list(D.rule_tlds)}, tld) AS susp, {corr("reg || ' ' || path")} AS harvest,
   {fold("host || path")} AS whole FROM u),
 hits AS (
  SELECT page_id, 0 AS ro, 0 AS o, 'R0' AS rule, NULL AS b FROM s WHERE platform IS NULL AND reg IN (SELECT d FROM legit_)
  UNION ALL SELECT page_id, 1, 0, 'R0b', NULL FROM s WHERE reg IN (SELECT d FROM known_)
  UNION ALL SELECT page_id, 2, 999, 'R1', NULL FROM s WHERE regexp_matches(host, '[^\x00-\x7F]')
  UNION ALL SELECT page_id, 2, o, 'R1', b FROM s, brand_ WHERE regexp_matches(host, '[^\x00-\x7F]') AND contains({fold('host')}, b)
  UNION ALL SELECT page_id, 3, o, 'R2', b FROM s, brand_ WHERE platform IS NULL AND fl = b
  UNION ALL SELECT page_id, 4, o, 'R3', b FROM s, brand_ WHERE platform IS NULL AND {names('reg', "reg || ' ' || path")}
    AND (harvest OR susp OR (contains(fr, b) AND NOT contains(reg, b)))
  UNION ALL SELECT page_id, 5, o, 'R4', b FROM s, brand_ WHERE platform IS NULL AND {NEAR.format(l='fl')}
  UNION ALL SELECT page_id, 6, o, CASE WHEN platform IN ('github.io', 'gitlab.io') AND fs = b THEN 'R0-org'
     WHEN platform IS NOT NULL THEN 'R5-platform' ELSE 'R5' END, b FROM s, brand_
     WHERE {names('sub', "sub || ' ' || reg || ' ' || path")}
  UNION ALL SELECT page_id, 7, o, 'R6', b FROM s, brand_ WHERE susp AND {names('whole', "whole || ' '")}),
 best AS (SELECT page_id, arg_min(struct_pack(rule := rule, b := b), ro * 1000 + o) AS x FROM hits GROUP BY page_id),
 v AS (SELECT s.*, x.rule AS rule, x.b AS b FROM s LEFT JOIN best USING (page_id)),
 w AS (SELECT *, contains(fr, b) AND NOT contains(reg, b) AS swapped FROM v)
 SELECT w.page_id, coalesce(rule IN ('R1', 'R2', 'R3', 'R4', 'R5', 'R5-platform', 'R6'), false) AS is_lookalike, rule,
  CASE WHEN rule IN ('R0', 'R0b', 'R0-org') THEN NULL ELSE b END AS brand,
  CASE rule WHEN 'R1' THEN CASE WHEN b IS NULL THEN 0.7 ELSE 0.99 END WHEN 'R2' THEN 0.97
   WHEN 'R3' THEN CASE WHEN susp OR swapped THEN 0.95 ELSE 0.9 END WHEN 'R4' THEN 0.88
   WHEN 'R5-platform' THEN 0.6 WHEN 'R5' THEN 0.92 WHEN 'R6' THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence,
  CASE rule WHEN 'R0' THEN 'Registered domain is a verified brand domain.'
   WHEN 'R0b' THEN 'Known legitimate domain (' || (SELECT why FROM known_ WHERE d = reg) || ').'
   WHEN 'R1' THEN CASE WHEN b IS NULL THEN 'Internationalised/punycode domain -- verify carefully.'
     ELSE 'Internationalised domain resolves to a lookalike of ''' || b || '''.' END
   WHEN 'R2' THEN 'Domain ''' || label || ''' is a character-substituted imitation of ''' || b || '''.'
   WHEN 'R3' THEN '''' || b || ''' appears in the domain ''' || reg || ''' ' || concat_ws(' and ',
     CASE WHEN swapped THEN 'with character substitution' END, CASE WHEN susp THEN 'on a low-reputation ''.' || tld || ''' domain' END,
     CASE WHEN harvest THEN 'alongside sign-in or payment wording' END) || ', and this domain is not owned by ' || b || '.'
   WHEN 'R4' THEN 'Domain ''' || label || ''' is ' || levenshtein(fl, b) || ' character(s) from ''' || b || ''' -- possible typosquat.'
   WHEN 'R0-org' THEN 'Subdomain matches the ''' || b || ''' organisation exactly on a code-hosting platform -- official project page.'
   WHEN 'R5-platform' THEN '''' || b || ''' appears in a subdomain on the shared host ''' || reg || '''. This may be a demo or clone project, but brand impersonation on free hosting is common -- do not enter credentials.'
   WHEN 'R5' THEN '''' || b || ''' appears in the subdomain of unrelated domain ''' || reg || '''.'
   WHEN 'R6' THEN '''' || b || ''' referenced on a low-reputation ''.' || tld || ''' domain.'
   ELSE 'No lookalike pattern detected.' END AS reason FROM w"""


VERDICT = verdict_sql(PROBE)


def _verdicts(spark, sf):
    return L.lookalike_verdicts(probe_urls(spark, sf))


@query("lookalike_verdicts", VERDICT)
def lookalike_verdicts(spark, sf):
    return _verdicts(spark, sf).select("page_id", *L.VERDICT)


@query("verdicts_by_rule", f"SELECT coalesce(rule, 'none') AS rule, is_lookalike, count(*) AS n FROM ({VERDICT}) GROUP BY 1, 2")
def verdicts_by_rule(spark, sf):
    return L.verdicts_by_rule(_verdicts(spark, sf))


@query("aggregate_only_log", f"SELECT is_lookalike, rule, count(*) AS n FROM ({VERDICT}) GROUP BY 1, 2")
def aggregate_only_log(spark, sf):
    return L.aggregate_only_log(_verdicts(spark, sf)).groupBy("is_lookalike", "rule").agg(F.count("*").alias("n"))


# the brands' own domains plus two that are not, as often as pages exist
AUDITED = sorted(d for d in D.legit_domains if "." in d) + ["paypal-login.top", "netfl1x.com"]
AUDIT_SRC = f"SELECT page_id, 'https://' || {sql_list(AUDITED)}[page_id % {len(AUDITED)} + 1] || '/' AS url FROM pages"


@query("self_audit", f"""SELECT DISTINCT rule, brand, {sql_list(AUDITED)}[page_id % {len(AUDITED)} + 1] AS host
 FROM ({verdict_sql(AUDIT_SRC)}) WHERE is_lookalike""")
def self_audit(spark, sf):
    hosts = table(spark, sf, "pages").select(
        F.get(strings(AUDITED), (F.col("page_id") % len(AUDITED)).cast("int")).alias("host"))
    return L.self_audit(hosts).select("rule", "brand", "host").distinct()


@query("resolve_platform", f"""WITH {parts_sql(PROBE)}, dom AS (SELECT * FROM parts), {PLATFORM}
 SELECT page_id, host, platform, CASE WHEN platform IS NULL THEN NULL WHEN host = platform THEN ''
  ELSE left(host, length(host) - length(platform) - 1) END AS platform_sub FROM pl""")
def resolve_platform(spark, sf):
    df = U.with_url_parts(probe_urls(spark, sf)).select("page_id", F.col("u_host").alias("host"))
    return L.resolve_platform(df)


@query("brand_matches", f"""WITH {BRANDS}, {parts_sql(PROBE)},
 m AS (SELECT page_id, o, b FROM parts, brand_ WHERE {names('host', "host || ' ' || path")})
 SELECT page_id, host, coalesce(brands, '') AS brands FROM parts LEFT JOIN
  (SELECT page_id, string_agg(b, ' ' ORDER BY o) AS brands FROM m GROUP BY page_id) USING (page_id)""")
def brand_matches(spark, sf):
    df = L.brand_matches(U.with_url_parts(probe_urls(spark, sf)), "u_host", "u_path")
    return df.select("page_id", F.col("u_host").alias("host"), F.array_join("brands", " ").alias("brands"))


@query("near_brand", f"""WITH {BRANDS}, {parts_sql(PROBE)}, {domain_sql()}, f AS (SELECT page_id, {fold('label')} AS l FROM dom)
 SELECT page_id, l AS label, (SELECT arg_min(b, o) FROM brand_ WHERE {NEAR.format(l='l')}) AS near_brand FROM f""")
def near_brand(spark, sf):
    from lurewatch.functions.hosts import fold as folded
    df = U.with_domain(U.with_url_parts(probe_urls(spark, sf)))
    return L.near_brand(df.select("page_id", folded("u_label").alias("label")))


# ------------------------------------------------------------------- typosquats
SQUAT_BRANDS = values("sb_", "brand, domain", [(b, d) for b, ds in fixed.SQUAT_BRANDS.items() for d in ds])
SQUATS = f"""{SQUAT_BRANDS}, bt_ AS (SELECT brand, domain, substr(domain, instr(domain, '.') + 1) AS tld FROM sb_),
 pos_ AS (SELECT *, unnest(range(2, length(brand))) AS i FROM bt_),
 raw_sq AS (
  SELECT brand, 'leet' AS family, substr(brand, 1, instr(brand, a) - 1) || d || substr(brand, instr(brand, a) + 1) || '.' || tld AS host
   FROM bt_, (VALUES {', '.join(f"({Q(a)}, {Q(d)})" for a, d in zip(*fixed.SQUAT_LEET))}) t(a, d) WHERE contains(brand, a)
  UNION ALL SELECT brand, 'doubled', substr(brand, 1, i) || substr(brand, i) || '.' || tld FROM pos_
  UNION ALL SELECT brand, 'dropped', substr(brand, 1, i - 1) || substr(brand, i + 1) || '.' || tld FROM pos_
  UNION ALL SELECT brand, 'swapped', substr(brand, 1, i - 1) || substr(brand, i + 1, 1) || substr(brand, i, 1) || substr(brand, i + 2) || '.' || tld FROM pos_
  UNION ALL SELECT brand, 'affix', unnest([brand || '-' || s, s || '-' || brand, brand || s]) || '.' || tld FROM bt_, (SELECT unnest({sql_list(fixed.SQUAT_AFFIXES)}) AS s)
  UNION ALL SELECT brand, 'alt_tld', brand || '.' || t FROM bt_, (SELECT unnest({sql_list(fixed.SQUAT_TLDS)}) AS t) WHERE t <> tld
  UNION ALL SELECT brand, 'subdomain', brand || unnest(['.', '-secure.']) || h FROM bt_, (SELECT unnest({sql_list(fixed.SQUAT_HOSTS)}) AS h)
  UNION ALL SELECT brand, 'country', brand || '.' || c FROM bt_, (SELECT unnest({sql_list(fixed.SQUAT_COUNTRY)}) AS c)),
 squat_ AS (SELECT brand, host, min(family) AS family FROM raw_sq WHERE host NOT IN (SELECT domain FROM sb_) GROUP BY brand, host)"""


def _squat_brands(spark):
    return spark.createDataFrame([(b, d) for b, ds in fixed.SQUAT_BRANDS.items() for d in ds], "brand string, domain string")


@query("find_squats", f"""WITH {SQUATS}, {parts_sql(PROBE)}
 SELECT page_id, regexp_replace(host, '^www\\.', '') AS host, brand, family FROM parts JOIN squat_ s
 ON regexp_replace(parts.host, '^www\\.', '') = s.host""".replace("SELECT page_id, regexp_replace(host", "SELECT page_id, regexp_replace(parts.host"))
def find_squats(spark, sf):
    return J.find_squats(probe_urls(spark, sf), _squat_brands(spark)).select("page_id", "host", "brand", "family")


@query("squat_recall", f"""WITH {SQUATS}, n AS (SELECT count(*) AS c FROM squat_),
 p AS (SELECT page_id, (page_id * 7919) % (SELECT c FROM n) AS k FROM pages),
 r AS (SELECT *, row_number() OVER (ORDER BY brand, host) - 1 AS k FROM squat_)
 SELECT family, count(*) AS n FROM p JOIN r USING (k) GROUP BY family""")
def squat_recall(spark, sf):
    """Typosquats assigned to pages, counted per family (probe construction)."""
    from pyspark.sql import Window as W
    sq = J.typosquats(_squat_brands(spark))
    n = sq.agg(F.count("*").alias("n")).scalar()
    # the squat table is fixed (20 brands), so ordering it is bounded
    ranked = sq.withColumn("k", F.row_number().over(W.orderBy("brand", "host")) - 1)
    pages = table(spark, sf, "pages").select(((F.col("page_id") * 7919) % n).alias("k"))
    return pages.join(F.broadcast(ranked), "k").groupBy("family").agg(F.count("*").alias("n"))


HARVEST = list(fixed.SQUAT_BRANDS)
HARVEST_LEGIT = [d for ds in fixed.SQUAT_BRANDS.values() for d in ds]


@query("harvest_lookalikes", f"""WITH {parts_sql(PROBE)}, {domain_sql()}
 SELECT page_id, p.url FROM dom JOIN ({PROBE}) p USING (page_id)
 WHERE len(list_filter({sql_list(HARVEST)}, lambda b: contains(concat_ws('.', subdomain, registered), b))) > 0
  AND NOT list_contains({sql_list(HARVEST_LEGIT)}, registered) ORDER BY p.url, page_id LIMIT 150""")
def harvest_lookalikes(spark, sf):
    feed = probe_urls(spark, sf)
    return J.harvest_lookalikes(feed, HARVEST, HARVEST_LEGIT, n=150, tie=["page_id"]).select("page_id", "url")


@query("unknown_platforms", f"""WITH {parts_sql(PROBE)}, {domain_sql()},
 c AS (SELECT registered AS domain, count(*) AS n FROM dom WHERE registered <> '' AND subdomain <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 40)
 SELECT domain, n FROM c WHERE n >= 3 AND NOT list_contains({sql_list(D.rule_platforms)}, domain)""")
def unknown_platforms(spark, sf):
    df = U.with_domain(U.with_url_parts(probe_urls(spark, sf)), prefix="u_")
    hosts = df.select(F.col("u_registered").alias("registered"), F.col("u_subdomain").alias("subdomain"))
    return S.unknown_platforms(hosts, D.rule_platforms, top=40, top_first=True)


# --------------------------------------------------------------- brand list work
CERTS = """SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN 'paypal' WHEN 1 THEN 'fedex' WHEN 2 THEN 'zoom' ELSE 'trezor' END
 || '.' || {suf}[(page_id // 4) % 25 + 1] AS host,
 CASE WHEN page_id % 3 = 0 THEN ['parking.example', 'a.parking.example'] ELSE
  ['www.' || CASE page_id % 4 WHEN 0 THEN 'paypal' WHEN 1 THEN 'fedex' WHEN 2 THEN 'zoom' ELSE 'trezor' END || '.com', 'cdn.example', 'b.example', 'a.example'] END AS names, page_id FROM pages"""
TRUSTED = values("bd_", "brand_ord, brand, domain", [(i, b, d) for i, (b, ds) in enumerate(D.brand_domains.items()) for d in ds])
CAND = f"""cand_ AS (SELECT brand, domain AS source, split_part(domain, '.', 1) || '.' || suf AS candidate
   FROM bd_, (SELECT unnest({sql_list(fixed.CCTLD_SUFFIXES)}) AS suf) WHERE contains(domain, '.')),
 uniq_ AS (SELECT candidate, min(struct_pack(brand := brand, source := source)) AS o FROM cand_
   WHERE candidate NOT IN (SELECT domain FROM bd_) AND candidate <> source GROUP BY candidate)"""


@query("confirm_candidates", f"""WITH {TRUSTED}, {CAND}, certs AS ({CERTS.format(suf=sql_list(fixed.CCTLD_SUFFIXES))})
 SELECT page_id, o.brand AS brand, o.source AS source, candidate, array_to_string(list_sort(names)[1:3], ' ') AS cert_names,
  len(list_filter(names, lambda n: contains(n, split_part(o.source, '.', 1)))) > 0 AS confirmed
 FROM uniq_ JOIN certs ON host = candidate""")
def confirm_candidates(spark, sf):
    i = F.col("page_id")
    root = F.get(F.array(*[F.lit(x) for x in ("paypal", "fedex", "zoom", "trezor")]), (i % 4).cast("int"))
    suf = F.get(F.array(*[F.lit(x) for x in fixed.CCTLD_SUFFIXES]), (F.floor(i / 4) % 25).cast("int"))
    own = F.array(F.concat(F.lit("www."), root, F.lit(".com")), F.lit("cdn.example"), F.lit("b.example"), F.lit("a.example"))
    certs = table(spark, sf, "pages").select(
        "page_id", F.concat_ws(".", root, suf).alias("host"),
        F.when(i % 3 == 0, F.array(F.lit("parking.example"), F.lit("a.parking.example"))).otherwise(own).alias("names"))
    cands = J.cctld_candidates(D, spark)
    joined = cands.join(certs.select("page_id", F.col("host").alias("candidate")), "candidate").select("page_id", "candidate")
    out = J.confirm_candidates(cands, certs.select("host", "names").distinct())
    return out.join(joined, "candidate").select(
        "page_id", "brand", "source", "candidate", F.array_join("cert_names", " ").alias("cert_names"), "confirmed") \
        .join(certs.select("page_id", F.array_join(F.slice(F.array_sort("names"), 1, 3), " ").alias("cert_names")), ["page_id", "cert_names"])


@query("apply_approved", f"""WITH {TRUSTED}, prop AS (SELECT CASE page_id % 3 WHEN 0 THEN 'paypal' WHEN 1 THEN 'steam' ELSE 'nobody' END AS brand,
  'new' || (page_id % 17) || '.example' AS domain, page_id % 2 = 0 AS approved FROM pages),
 u AS (SELECT brand_ord, brand, domain FROM bd_ UNION SELECT bo, p.brand, p.domain FROM prop p
   JOIN (SELECT DISTINCT brand, brand_ord AS bo FROM bd_) k ON p.brand = k.brand WHERE approved)
 SELECT min(brand_ord) AS brand_ord, brand, domain FROM u GROUP BY brand, domain""")
def apply_approved_query(spark, sf):
    i = F.col("page_id")
    prop = table(spark, sf, "pages").select(
        F.when(i % 3 == 0, "paypal").when(i % 3 == 1, "steam").otherwise("nobody").alias("brand"),
        F.concat(F.lit("new"), (i % 17).cast("string"), F.lit(".example")).alias("domain"), (i % 2 == 0).alias("approved"))
    return apply_approved(D.table(spark, "brand_domains"), prop)
