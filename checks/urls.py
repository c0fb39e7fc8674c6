"""URL, host and feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import MESSY, PROBE, Q, messy_urls, probe_urls, sql_list, table
from checks.registry import query
from lurewatch import fixed
from lurewatch.dims import Dims
from lurewatch.functions import hosts as H
from lurewatch.functions import urls as U
from lurewatch.functions.suffixes import suffix_rules
from lurewatch.functions.common import strings
from lurewatch.plans import url_features as P

r6 = lambda c: F.round(c, 6)


# ---------------------------------------------------------------- SQL fragments
def parts_sql(src, ci=True, strip=True):
    """CTE body: id, raw, scheme, netloc, host, path, query, fragment of src(id, url)."""
    raw = r"regexp_replace(coalesce(url, ''), '^\s+|\s+$', '', 'g')" if strip else "coalesce(url, '')"
    test = "(?i)^https?://" if ci else "^https?://"
    return rf"""
 raw_ AS (SELECT page_id, CASE WHEN regexp_matches({raw}, '{test}') THEN {raw} ELSE 'http://' || {raw} END AS raw FROM ({src})),
 net_ AS (SELECT *, regexp_extract(raw, '^[^:/?#]+://([^/?#]*)', 1) AS netloc,
          regexp_extract(raw, '(?s)^[^:/?#]+://[^/?#]*(.*)$', 1) AS tail FROM raw_),
 parts AS (SELECT page_id, raw, netloc, lower(regexp_extract(raw, '^([^:/?#]+)://', 1)) AS scheme,
          lower(split_part(list_last(string_split(netloc, '@')), ':', 1)) AS host,
          regexp_extract(split_part(split_part(tail, '#', 1), '?', 1), '(?s)^((?:.*/)?[^/;]*)', 1) AS path,
          CASE WHEN contains(split_part(tail, '#', 1), '?')
               THEN substr(split_part(tail, '#', 1), instr(split_part(tail, '#', 1), '?') + 1) ELSE '' END AS query,
          CASE WHEN contains(tail, '#') THEN substr(tail, instr(tail, '#') + 1) ELSE '' END AS fragment FROM net_)"""


def domain_sql(name="parts", out="dom"):
    """CTE: adds registered, label, suffix and subdomain by longest listed suffix."""
    ip = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
    return rf"""
 sfx_(s) AS (SELECT unnest({sql_list(fixed.MULTI_SUFFIXES)})),
 lab_ AS (SELECT *, string_split(host, '.') AS ls FROM {name}),
 k_ AS (SELECT l.*, CASE WHEN regexp_matches(host, '{ip}') THEN 0
          WHEN EXISTS (SELECT 1 FROM sfx_ WHERE host = s OR ends_with(host, '.' || s))
            THEN (SELECT max(len(string_split(s, '.'))) FROM sfx_ WHERE host = s OR ends_with(host, '.' || s))
          WHEN regexp_matches(ls[-1], '^(?:\p{{L}}{{2,}}|xn--[a-z0-9\-]+)$') THEN 1 ELSE 0 END AS k FROM lab_ l),
 {out} AS (SELECT * EXCLUDE (ls, k),
   CASE WHEN k > 0 AND len(ls) > k THEN array_to_string(ls[len(ls) - k:], '.') ELSE '' END AS registered,
   CASE WHEN k > 0 AND len(ls) > k THEN ls[len(ls) - k] WHEN regexp_matches(host, '{ip}') THEN host
        WHEN k > 0 THEN '' ELSE ls[-1] END AS label,
   CASE WHEN k > 0 THEN array_to_string(ls[len(ls) - k + 1:], '.') ELSE '' END AS suffix,
   CASE WHEN k > 0 AND len(ls) > k + 1 THEN array_to_string(ls[1:len(ls) - k - 1], '.')
        WHEN k = 0 AND len(ls) > 1 AND NOT regexp_matches(host, '{ip}') THEN array_to_string(ls[1:len(ls) - 1], '.')
        ELSE '' END AS subdomain FROM k_)"""


def cnt(c, ch):
    return f"(length({c}) - length(replace({c}, {Q(ch)}, '')))"


def cre(c, pattern):
    return f"len(regexp_extract_all({c}, '{pattern}'))"


# ---------------------------------------------------------------------- parsing
@query("url_parts", f"WITH {parts_sql(MESSY)} SELECT page_id, scheme, host, path, query, fragment FROM parts")
def url_parts(spark, sf):
    df = U.with_url_parts(messy_urls(spark, sf))
    return df.select("page_id", *[F.col("u_" + c).alias(c) for c in ("scheme", "host", "path", "query", "fragment")])


@query("registered_domain", f"WITH {parts_sql(MESSY)}, {domain_sql()} "
       "SELECT page_id, registered, label, suffix, subdomain FROM dom")
def registered_domain(spark, sf):
    df = U.with_domain(U.with_url_parts(messy_urls(spark, sf)))
    return df.select("page_id", *[F.col("u_" + c).alias(c) for c in ("registered", "label", "suffix", "subdomain")])


@query("registered_domain_counts", f"""WITH {parts_sql('SELECT page_id, url FROM pages')}, {domain_sql()}
 SELECT registered, count(*) AS pages, count(DISTINCT host) AS hosts, round(avg(length(raw)), 6) AS avg_length,
  sum({cnt('path', '/')}) AS slashes FROM dom GROUP BY registered""")
def registered_domain_counts(spark, sf):
    df = U.with_domain(U.with_url_parts(table(spark, sf, "pages").select("page_id", "url")))
    return df.groupBy(F.col("u_registered").alias("registered")).agg(
        F.count("*").alias("pages"), F.count_distinct("u_host").alias("hosts"),
        r6(F.avg(F.length("u_raw"))).alias("avg_length"), F.sum(U.count_of("u_path", "/")).alias("slashes"))


@query("url_counts", f"""SELECT page_id, length(url) AS length_url, {cnt('url', '/')} AS qty_slash_url,
 {cnt('url', '.')} AS qty_dot_url, {cnt('url', '-')} AS qty_hyphen_url, {cre('url', '[0-9]')} AS qty_digit_url,
 {cnt('url', '@')} AS qty_at_url, {cnt('url', '?')} AS qty_question_url, {cnt('url', '=')} AS qty_equal_url,
 {cnt('url', '%')} AS qty_percent_url, {cnt('url', '_')} AS qty_underscore_url FROM pages""")
def url_counts(spark, sf):
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in U.url_counts("url").items()])


@query("defang_refang", r"""SELECT page_id,
 replace(regexp_replace(url, 'http(s?)://', 'hxxp\1://', 'g'), '.', '[.]') AS defanged, url AS refanged FROM pages""")
def defang_refang(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.defang("url").alias("defanged"), U.refang(U.defang("url")).alias("refanged"))


@query("feature_cache_key", "SELECT page_id, 'url_features:' || sha256(url) AS cache_key FROM pages")
def feature_cache_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.cache_key("url").alias("cache_key"))


@query("validate_url", rf"""WITH src AS ({MESSY}), t AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN ''
   WHEN page_id % 11 = 1 THEN url || repeat('x', 2048) WHEN page_id % 11 = 2 THEN 'not a url' ELSE url END AS url FROM src),
 e AS (SELECT page_id, CASE WHEN url = '' THEN 'No URL provided'
   WHEN length(trim(url)) > 2048 THEN 'URL too long (max 2048 characters)'
   WHEN NOT regexp_matches(trim(url), '(?i)^(https?://)?([\w\-]+\.)+[\w\-]+(/[^\s]*)?$') THEN 'Invalid URL format' END AS error FROM t)
 SELECT page_id, error IS NULL AS is_valid, error FROM e""")
def validate_url(spark, sf):
    k = F.col("page_id") % 11
    df = messy_urls(spark, sf).withColumn("url", F.when(k == 0, "").when(
        k == 1, F.concat("url", F.repeat(F.lit("x"), 2048))).when(k == 2, "not a url").otherwise(F.col("url")))
    ok, error = U.validate_url("url")
    return df.select("page_id", ok.alias("is_valid"), error.alias("error"))


@query("deep_url_stats", f"""SELECT count(*) AS n, sum(CAST({cnt("rtrim(url, '/')", '/')} > 2 AND length(url) < 500 AS BIGINT)) AS deep,
 sum(CAST(contains(url, '?') AS BIGINT)) AS query,
 round(avg(CAST({cnt("rtrim(url, '/')", '/')} > 2 AND length(url) < 500 AS DOUBLE)), 6) AS deep_share,
 round(avg(CAST(contains(url, '?') AS DOUBLE)), 6) AS query_share FROM pages""")
def deep_url_stats(spark, sf):
    from lurewatch.operators.scans import share
    out = share(table(spark, sf, "pages"), deep=U.is_deep("url"), query=F.col("url").contains("?"))
    return out.select("n", "deep", "query", r6("deep_share").alias("deep_share"), r6("query_share").alias("query_share"))


FEED_HOSTS = ["github.io", "Example.org/", ".vercel.app"]


@query("exclude_hosts", f"SELECT page_id, url FROM ({PROBE}) WHERE NOT regexp_matches(url, '(?i)github\\.io|example\\.org/|\\.vercel\\.app')")
def exclude_hosts(spark, sf):
    return U.without_hosts(probe_urls(spark, sf), "url", FEED_HOSTS)


RULES = ["// rules", "", "com", "org", "net", "ng", "gov.ng", "ke", "ac.ke", "hu", "co.hu", "*.ck", "!www.ck", "jp", "*.kawasaki.jp",
         "!city.kawasaki.jp", "uk", "co.uk  trailing text", "GOV.UK"]
TAILS = ["gov.ng", "ng", "ac.ke", "co.hu", "ck", "any.ck", "www.ck", "a.www.ck", "kawasaki.jp", "ward.kawasaki.jp", "city.kawasaki.jp",
         "co.uk", "gov.uk", "unlisted", "co.unlisted", "com"]


def ruled_sql():
    """CTEs: rule table, hosts of the pages under every tail, suffix size by testing every rule against every host."""
    return f"""rules AS (SELECT DISTINCT lower(split_part(trim(r), ' ', 1)) AS r FROM (SELECT unnest({sql_list(RULES)}) AS r)
   WHERE trim(r) <> '' AND NOT starts_with(trim(r), '//')),
 h AS (SELECT page_id, lower(split_part(split_part(url, '://', 2), '.', 1)) || '.' || {sql_list(TAILS)}[page_id % {len(TAILS)} + 1] AS host FROM pages),
 m AS (SELECT page_id, max(CASE WHEN starts_with(r, '!') THEN len(string_split(r, '.')) - 1 END) AS except_n,
   max(len(string_split(r, '.'))) AS n FROM h, rules WHERE ends_with('.' || host, '.' || ltrim(r, '!*.'))
   AND (NOT starts_with(r, '*.') OR ends_with(host, substr(r, 2))) GROUP BY page_id),
 d AS (SELECT page_id, host, string_split(host, '.') AS ls, coalesce(except_n, n, 1) AS k FROM h LEFT JOIN m USING (page_id)),
 ruled AS (SELECT page_id, host, CASE WHEN len(ls) > k THEN array_to_string(ls[len(ls) - k:], '.') ELSE '' END AS registered,
   array_to_string(ls[len(ls) - k + 1:], '.') AS suffix FROM d)"""


def ruled_urls(spark, sf):
    tail = F.get(strings(TAILS), (F.col("page_id") % len(TAILS)).cast("int"))
    host = F.lower(F.concat_ws(".", F.regexp_extract("url", "^https?://([^./]*)", 1), tail))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/x")).alias("url"))


def rule_table(spark):
    return suffix_rules(spark.createDataFrame([(r,) for r in RULES], "value string"))


@query("suffix_rule_domains", f"WITH {ruled_sql()} SELECT * FROM ruled")
def suffix_rule_domains(spark, sf):
    """Registered domains by a rule table with wildcards and exceptions."""
    df = U.with_domain(U.with_url_parts(ruled_urls(spark, sf)), suffixes=rule_table(spark))
    return df.select("page_id", "host", F.col("u_registered").alias("registered"), F.col("u_suffix").alias("suffix"))


@query("suffix_rule_split", f"""WITH {ruled_sql()} SELECT registered AS domain, count(*) AS n,
 CASE WHEN CAST(('0x' || left(md5(registered || '|7'), 8)) AS BIGINT) / 4294967296.0 < 0.6 THEN 'train' ELSE 'test' END AS split
 FROM ruled WHERE registered <> '' GROUP BY 1""")
def suffix_rule_split(spark, sf):
    """A domain-disjoint split by the rule table: one side per registered domain."""
    from lurewatch.operators.sampling import domain_split
    df = domain_split(ruled_urls(spark, sf), "url", 0.4, 7, suffixes=rule_table(spark)).filter("not startswith(domain, 'http')")
    return df.groupBy("domain", "split").agg(F.count("*").alias("n"))


DICTIONARY = "SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS w FROM part WHERE p_size < 25"
SUBS = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'my' || a || b WHEN 1 THEN reverse(a) || '-' || b WHEN 2 THEN reverse(a) || reverse(b)
  WHEN 3 THEN left(a, 2) || '7' || reverse(b) ELSE '' END AS sub
  FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)"""


@query("word_features", rf"""WITH w AS ({DICTIONARY}), s AS ({SUBS}),
 t AS (SELECT p_partkey, regexp_replace(unnest(list_filter(regexp_split_to_array(lower(sub), '[-_.\d]+'), lambda x: x <> '')), '[^\p{{L}}]', '', 'g') AS tok FROM s),
 c AS (SELECT p_partkey, count(*) AS n, count(*) FILTER (NOT (length(tok) < 3 OR EXISTS (SELECT 1 FROM w WHERE w = tok
   OR (length(w) >= 4 AND contains(tok, w))))) AS bad FROM t GROUP BY 1)
 SELECT p_partkey, sub, CAST(coalesce(round(bad / CAST(n AS DOUBLE), 6), 0) AS DOUBLE) AS nonword_ratio, CAST(CASE WHEN n > 0 AND n = bad THEN 1 ELSE 0 END AS DOUBLE) AS has_no_words
 FROM s LEFT JOIN c USING (p_partkey)""")
def word_features(spark, sf):
    """Dictionary features against a word table: sub-domains made of part names, words of the small parts."""
    part = table(spark, sf, "part")
    words = part.filter("p_size < 25").select(F.explode(F.split("p_name", " ")).alias("word"))
    a, b, k = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 5
    sub = (F.when(k == 0, F.concat(F.lit("my"), a, b)).when(k == 1, F.concat(F.reverse(a), F.lit("-"), b))
           .when(k == 2, F.concat(F.reverse(a), F.reverse(b))).when(k == 3, F.concat(F.substring(a, 1, 2), F.lit("7"), F.reverse(b))).otherwise(""))
    urls = part.select("p_partkey", sub.alias("sub")).withColumn("url", F.concat(
        F.lit("https://"), "sub", F.when(F.col("sub") != "", ".").otherwise(""), F.lit("shop-1.com/")))
    df = P.url_features_v2(urls, dims=Dims.from_tables(words=words))
    return df.select("p_partkey", "sub", r6("subdomain_nonword_ratio").alias("nonword_ratio"), F.col("subdomain_has_no_words").alias("has_no_words"))


SHORT = ["bit.ly", "www.bit.ly", "example.org", "T.co", ".goo.gl", "www.example.com", "is.gd"]


@query("shortener_flag", f"""WITH t AS (SELECT page_id, {sql_list(SHORT)}[page_id % 7 + 1] AS host FROM pages)
 SELECT page_id, host, list_contains({sql_list(fixed.SHORTENERS)},
  regexp_replace(ltrim(lower(host), '.'), '^www\\.', '')) AS shortener FROM t""")
def shortener_flag(spark, sf):
    df = table(spark, sf, "pages").withColumn("host", F.get(strings(SHORT), (F.col("page_id") % 7).cast("int")))
    return df.select("page_id", "host", U.is_shortener("host").alias("shortener"))


@query("public_ip_flag", """WITH t AS (SELECT event_id, (event_id * 7919 + user_id * 104729) % 256 AS a,
  (event_id * 31) % 256 AS b, event_id % 256 AS c, user_id % 300 AS d FROM events)
 SELECT event_id, d <= 255 AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254)
   OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19))
   OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10)) OR (a = 192 AND b = 0 AND c = 2)
   OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS is_public FROM t""")
def public_ip_flag(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    ip = F.concat_ws(".", *[x.cast("string") for x in
                            ((e * 7919 + u * 104729) % 256, (e * 31) % 256, e % 256, u % 300)])
    return table(spark, sf, "events").select("event_id", U.is_public_ipv4(ip).alias("is_public"))


# ------------------------------------------------------------------- sub-domains
def sub_stats_sql():
    """Columns over lower-case text s: entropy, ratios, runs, word shape."""
    ent = ("CASE WHEN length(s) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split(s, '')), "
           "lambda c: -((length(s) - length(replace(s, c, ''))) / CAST(length(s) AS DOUBLE)) * "
           "log2((length(s) - length(replace(s, c, ''))) / CAST(length(s) AS DOUBLE)))) END")
    run = (r"coalesce(list_max(list_transform(regexp_extract_all(regexp_replace(s, '[aeiou]', ' ', 'g'), "
           r"'\p{L}+'), lambda t: length(t))), 0)")
    let, vow = cre("s", r"\p{L}"), cre("s", "[aeiou]")
    vr = f"({vow} / CAST(greatest({let}, 1) AS DOUBLE))"
    dr = f"({cre('s', '[0-9]')} / CAST(greatest(length(s), 1) AS DOUBLE))"
    return dict(entropy=ent, run=run, letters=let, vr=vr, dr=dr,
                wordlike=f"({let} >= 3 AND {vr} BETWEEN 0.20 AND 0.60 AND {run} <= 4 AND {dr} < 0.25)")


SUB = sub_stats_sql()


@query("subdomain_shape", f"""WITH {parts_sql(PROBE)}, {domain_sql()},
 t AS (SELECT page_id, array_to_string(list_filter(string_split(subdomain, '.'), lambda x: x <> '' AND x <> 'www'), '.') AS s FROM dom)
 SELECT page_id, s AS sub, round({SUB['entropy']}, 6) AS entropy, round({SUB['dr']}, 6) AS digit_ratio,
  round({SUB['vr']}, 6) AS vowel_ratio, {SUB['run']} AS run, {SUB['wordlike']} AS wordlike,
  {cre('s', '[0-9]+')} AS digit_runs, translate(s, '1035478$@!|-_.', 'loesatbsail') AS deleet FROM t""")
def subdomain_shape(spark, sf):
    df = U.with_domain(U.with_url_parts(probe_urls(spark, sf)))
    df = df.withColumn("sub", F.array_join(U.sub_labels("u_subdomain"), "."))
    df = df.select("page_id", "sub", U.letters("sub").alias("l"), U.vowel_ratio("sub").alias("v"),
                   U.max_consonant_run("sub").alias("run"), U.digit_ratio("sub").alias("d"))
    return df.select("page_id", "sub", r6(U.entropy("sub")).alias("entropy"), r6("d").alias("digit_ratio"),
                     r6("v").alias("vowel_ratio"), "run", U.is_wordlike("v", "l", "run", "d").alias("wordlike"),
                     U.digit_runs("sub").alias("digit_runs"), U.deleet("sub").alias("deleet"))


@query("word_stats", rf"""WITH w(w) AS (SELECT unnest({sql_list(fixed.TECH_WORDS)})),
 {parts_sql(PROBE)}, {domain_sql()},
 t AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(lower(host), '[-_.\d]+'), lambda x: x <> '')) AS tok FROM dom),
 j AS (SELECT page_id, length(regexp_replace(tok, '[^\p{{L}}]', '', 'g')) < 3 OR EXISTS (SELECT 1 FROM w
   WHERE w = regexp_replace(tok, '[^\p{{L}}]', '', 'g') OR (length(w) >= 4 AND contains(regexp_replace(tok, '[^\p{{L}}]', '', 'g'), w))) AS ok FROM t)
 SELECT page_id, count(*) AS tokens, sum(CAST(NOT ok AS BIGINT)) AS nonwords FROM j GROUP BY page_id""")
def word_stats(spark, sf):
    df = U.with_url_parts(probe_urls(spark, sf))
    n, bad = U.nonword_counts("u_host", fixed.TECH_WORDS)
    return df.select("page_id", n.alias("tokens"), bad.alias("nonwords")).filter("tokens > 0")


# ----------------------------------------------------------------- feature tables
def v2_sql():
    fb = ", ".join(f"({Q(b)}, {Q(x)})" for b, ds in fixed.FEATURE_BRAND_DOMAINS.items() for x in ds)
    action = " OR ".join(f"contains(lower(path), {Q(t)})" for t in fixed.ACTION_TOKENS)
    b = lambda cond: f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"
    feats = {
        "length_url": "length(raw)", "qty_slash_url": cnt("raw", "/"), "qty_dot_url": cnt("raw", "."),
        "qty_hyphen_url": cnt("raw", "-"), "qty_digit_url": cre("raw", "[0-9]"), "qty_at_url": cnt("raw", "@"),
        "qty_question_url": cnt("raw", "?"), "qty_equal_url": cnt("raw", "="), "qty_percent_url": cnt("raw", "%"),
        "qty_underscore_url": cnt("raw", "_"), "domain_length": "length(registered)",
        "qty_dot_domain": cnt("registered", "."), "qty_hyphen_domain": cnt("registered", "-"),
        "qty_digit_domain": cre("registered", "[0-9]"), "directory_length": "length(dir)",
        "qty_slash_directory": cnt("dir", "/"), "file_length": "length(file)",
        "qty_params": "len(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.')))",
        "is_hosting_platform": b(f"list_contains({sql_list(fixed.FEATURE_PLATFORMS)}, registered)"),
        "subdomain_length": "length(s)", "subdomain_label_count": "CASE WHEN s = '' THEN 0 ELSE len(string_split(s, '.')) END",
        "subdomain_entropy": SUB["entropy"], "subdomain_digit_ratio": SUB["dr"], "subdomain_hyphen_count": cnt("s", "-"),
        "subdomain_max_consonant_run": SUB["run"], "subdomain_vowel_ratio": SUB["vr"],
        "subdomain_is_wordlike": b(SUB["wordlike"]),
        "subdomain_nonword_ratio": "coalesce(nonwords / CAST(tokens AS DOUBLE), 0.0)",
        "subdomain_has_no_words": b("tokens > 0 AND nonwords = tokens"),
        "platform_and_random_subdomain": b(
            f"list_contains({sql_list(fixed.FEATURE_PLATFORMS)}, registered) AND length(s) >= 4 AND "
            f"(NOT {SUB['wordlike']} OR (tokens > 0 AND nonwords = tokens))"),
        "brand_token_present": b("hits > 0"), "brand_impersonation": b("fakes > 0"),
        "action_token_in_path": b(action),
        "suspicious_tld": b(f"list_contains({sql_list(fixed.FEATURE_TLDS)}, list_last(string_split(suffix, '.')))"),
        "is_https": b("scheme = 'https'"), "has_ip_host": b(r"regexp_matches(host, '^\d{1,3}(\.\d{1,3}){3}$')"),
        "qty_subdomain_digits_runs": cre("s", "[0-9]+"),
    }
    cols = ", ".join(f"round(CAST({feats[n]} AS DOUBLE), 6) AS {n}" for n in fixed.FEATURES_V2)
    return rf"""WITH w(w) AS (SELECT unnest({sql_list(fixed.TECH_WORDS)})),
 fb(b) AS (SELECT unnest({sql_list(fixed.FEATURE_BRANDS)})), fd(b, d) AS (VALUES {fb}),
 {parts_sql(PROBE)}, {domain_sql()},
 t AS (SELECT *, array_to_string(list_filter(string_split(subdomain, '.'), lambda x: x <> '' AND x <> 'www'), '.') AS s,
   CASE WHEN contains(trim(path, '/'), '/') THEN regexp_extract(path, '(?s)^(.*)/', 1) ELSE '' END AS dir,
   CASE WHEN contains(trim(path, '/'), '/') THEN list_last(string_split(path, '/')) ELSE trim(path, '/') END AS file FROM dom),
 tk AS (SELECT page_id, regexp_replace(unnest(list_filter(regexp_split_to_array(lower(s), '[-_.\d]+'), lambda x: x <> '')), '[^\p{{L}}]', '', 'g') AS tok FROM t),
 ws AS (SELECT page_id, count(*) AS tokens, sum(CAST(NOT (length(tok) < 3 OR EXISTS (SELECT 1 FROM w WHERE w = tok
    OR (length(w) >= 4 AND contains(tok, w)))) AS BIGINT)) AS nonwords FROM tk GROUP BY page_id),
 bh AS (SELECT page_id, count(*) AS hits, sum(CAST(NOT EXISTS (SELECT 1 FROM fd WHERE fd.b = fb.b AND fd.d = registered) AS BIGINT)) AS fakes
   FROM t, fb WHERE contains(lower(s || ' ' || path || ' ' || query), fb.b)
     OR contains(translate(lower(host || ' ' || path || ' ' || query), '1035478$@!|-_.', 'loesatbsail'), fb.b) GROUP BY page_id)
 SELECT page_id, {cols} FROM t LEFT JOIN ws USING (page_id) LEFT JOIN bh USING (page_id)"""


@query("url_features_v2", v2_sql())
def url_features_v2(spark, sf):
    df = P.url_features_v2(probe_urls(spark, sf))
    return df.select("page_id", *[r6(n).alias(n) for n in fixed.FEATURES_V2])


def v1_sql():
    exprs = [cnt("raw", "/"), "length(raw)", cnt("dom", "."), "length(dom)"]
    exprs += [cnt("dir", ch) for ch in "./=@&%"] + ["length(dir)"]
    exprs += [cnt("file", ch) for ch in "-+$"] + ["length(file)"]
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in zip(fixed.FEATURES_V1, exprs))
    return f"""WITH {parts_sql(MESSY, ci=False, strip=False)}, {domain_sql()},
 t AS (SELECT *, CASE WHEN registered <> '' THEN registered WHEN suffix <> '' THEN '.' || suffix ELSE label END AS dom,
   regexp_extract(path, '(?s)^(.*)/', 1) AS dir, list_last(string_split(path, '/')) AS file FROM dom)
 SELECT page_id, {cols} FROM t"""


@query("url_features_v1_lexical", v1_sql())
def url_features_v1_lexical(spark, sf):
    df = P.url_features_v1_lexical(messy_urls(spark, sf))
    return df.select("page_id", *fixed.FEATURES_V1[:15])


@query("feature_json_round_trip", f"""SELECT page_id, CAST(length(url) AS DOUBLE) AS length_url,
 CAST({cnt('url', '/')} AS DOUBLE) AS qty_slash_url, CAST({cnt('url', '.')} AS DOUBLE) AS qty_dot_url FROM pages""")
def feature_json_round_trip(spark, sf):
    names = ["length_url", "qty_slash_url", "qty_dot_url"]
    feats = U.url_counts("url")
    df = table(spark, sf, "pages").select("page_id", *[feats[n].alias(n) for n in names])
    df = df.select("page_id", P.features_to_json(names).alias("j"))
    return df.select("page_id", *P.features_from_json("j", names))


SWAPS = [("a", "а"), ("e", "е"), ("o", "о"), ("t", "т"), ("n", "ñ"), ("h", "η")]


@query("homograph", rf"""WITH t AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS h FROM pages),
 s AS (SELECT page_id, CASE page_id % 7 {' '.join(f"WHEN {i} THEN replace(h, {Q(a)}, {Q(b)})" for i, (a, b) in enumerate(SWAPS))}
   ELSE 'www.' || translate('apple', 'aple', 'арӏе') || '.com' END AS host FROM t),
 l AS (SELECT page_id, host, generate_subscripts(string_split(host, '.'), 1) AS i, unnest(string_split(host, '.')) AS lab FROM s),
 r AS (SELECT page_id, host, i, CASE
   WHEN regexp_matches(lab, '[A-Za-z\p{{Latin}}]') AND regexp_matches(lab, '[\p{{Armenian}}\p{{Cyrillic}}\p{{Greek}}]')
    THEN 'label ''' || lab || ''' mixes Latin with ' || concat_ws(', ', CASE WHEN regexp_matches(lab, '\p{{Armenian}}') THEN 'Armenian' END,
      CASE WHEN regexp_matches(lab, '\p{{Cyrillic}}') THEN 'Cyrillic' END, CASE WHEN regexp_matches(lab, '\p{{Greek}}') THEN 'Greek' END)
   WHEN regexp_matches(lab, '[^\x00-\x7F]') AND NOT regexp_matches(lab, '[^\x00-\x7F{fixed.HOMOGRAPH_CONFUSABLES[0]}]')
    THEN 'label ''' || lab || ''' imitates the Latin string ''' || translate(lab, '{fixed.HOMOGRAPH_CONFUSABLES[0]}', '{fixed.HOMOGRAPH_CONFUSABLES[1]}') || ''''
   END AS why FROM l)
 SELECT page_id, host, count(why) > 0 AS is_homograph, regexp_matches(host, '[^\x00-\x7F]') AS is_idn,
  string_agg(why, '; ' ORDER BY i) AS reason FROM r GROUP BY page_id, host""")
def homograph(spark, sf):
    h, k = U.host_of("url"), F.col("page_id") % 7
    host = F.concat(F.lit("www."), F.translate(F.lit("apple"), "aple", "арӏе"), F.lit(".com"))
    for i, (a, b) in enumerate(SWAPS):
        host = F.when(k == i, F.replace(h, F.lit(a), F.lit(b))).otherwise(host)
    df = H.with_homograph(table(spark, sf, "pages").select("page_id", host.alias("host")), "host", "")
    return df.select("page_id", "host", "is_homograph", "is_idn", "reason")


@query("punycode_hosts")
def punycode_hosts(spark, sf):
    """Hosts rewritten to punycode and decoded again (a Python codec)."""
    names = ["xn--80ak6aa92e.com", "xn--mnchen-3ya.de", "xn--e1afmkfd.xn--p1ai", "example.org"]
    df = table(spark, sf, "pages").select("page_id", F.get(strings(names), (F.col("page_id") % 4).cast("int")).alias("host"))
    return H.with_homograph(df, "host", "").select("page_id", "host", "decoded", "is_homograph", "is_idn")


@query("fold_tokens", f"""WITH t AS (SELECT page_id, url, translate(lower(url), {Q(fixed.RULE_CONFUSABLES[0])}, {Q(fixed.RULE_CONFUSABLES[1])}) AS k FROM ({PROBE}))
 SELECT page_id, k AS kept, replace(replace(k, '-', ''), '_', '') AS folded,
  array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(k, '[^a-z0-9]+'), lambda x: x <> ''))), ' ') AS tokens FROM t""")
def fold_tokens(spark, sf):
    return probe_urls(spark, sf).select("page_id", H.fold_keep("url").alias("kept"), H.fold("url").alias("folded"),
                                        F.array_join(F.array_sort(H.tokens("url")), " ").alias("tokens"))


@query("repo_urls", """WITH t AS (SELECT c_custkey AS id, c_mktsegment AS owner,
   CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || '.github.io' ELSE 'app-' || (c_custkey % 50) END AS repo,
   CASE c_custkey % 4 WHEN 0 THEN 'https://app' || (c_custkey % 20) || '.pages.dev' WHEN 1 THEN 'http://x.org'
     WHEN 2 THEN 'https://me.github.io/x' END AS homepage FROM customer),
 p AS (SELECT CASE WHEN lower(repo) = lower(owner) || '.github.io' THEN 'https://' || lower(owner) || '.github.io/'
   ELSE 'https://' || lower(owner) || '.github.io/' || repo || '/' END AS url FROM t
  UNION SELECT homepage FROM t WHERE starts_with(homepage, 'https://') AND NOT contains(homepage, 'github.io'))
 SELECT DISTINCT url FROM p""")
def repo_urls(spark, sf):
    from lurewatch.operators.joins import repo_urls as job
    i, seg = F.col("c_custkey"), F.col("c_mktsegment")
    num = lambda n: (i % n).cast("string")
    df = table(spark, sf, "customer").select(
        seg.alias("owner"),
        F.when(i % 3 == 0, F.concat(F.lower(seg), F.lit(".github.io"))).otherwise(F.concat(F.lit("app-"), num(50))).alias("repo"),
        F.when(i % 4 == 0, F.concat(F.lit("https://app"), num(20), F.lit(".pages.dev"))).when(i % 4 == 1, "http://x.org")
        .when(i % 4 == 2, "https://me.github.io/x").alias("homepage"))
    return job(df)
