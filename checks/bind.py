"""Views of the given tables in the shape the jobs expect.

Each view exists twice, as a DataFrame and as SQL text, built from the same
arithmetic on the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.functions.common import strings

Q = lambda s: "'" + s.replace("'", "''") + "'"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(items):
    return "[" + ", ".join(Q(i) for i in items) + "]"


def values(name, cols, data):
    """``name(cols) AS (VALUES ...)`` for a WITH clause."""
    cell = lambda v: Q(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in data)
    return f"{name}({cols}) AS (VALUES {body})"


# ------------------------------------------------------------------- messy URLs
def messy_urls(spark, sf_dir):
    """Page URLs with missing schemes, ports, user info, blanks and parameters."""
    u, k = F.col("url"), F.col("page_id") % 7
    bare = F.regexp_replace(u, "^https?://", "")
    url = (F.when(k == 0, u).when(k == 1, bare)
           .when(k == 2, F.regexp_replace(u, "^(https?://)", "$1user:pw@"))
           .when(k == 3, F.concat(F.lit("  "), F.upper(u), F.lit(" ")))
           .when(k == 4, F.regexp_replace(u, "^(https?://[^/]+)", "$1:8080"))
           .when(k == 5, F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit(";v=1?a=1&b=&c")))
           .otherwise(F.replace(u, F.lit(".example."), F.lit(".shop-1.co."))))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


MESSY = r"""SELECT page_id, CASE page_id % 7
 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '')
 WHEN 2 THEN regexp_replace(url, '^(https?://)', '\1user:pw@')
 WHEN 3 THEN '  ' || upper(url) || ' '
 WHEN 4 THEN regexp_replace(url, '^(https?://[^/]+)', '\1:8080')
 WHEN 5 THEN regexp_replace(url, '[?#].*$', '') || ';v=1?a=1&b=&c'
 ELSE replace(url, '.example.', '.shop-1.co.') END AS url FROM pages"""

# ------------------------------------------------------------------- probe URLs
PROBE_HOSTS = [
    "www.paypal.com", "paypa1-secure.com", "paypalsupport.com", "login-steam.com", "dropbox.site",
    "www.roblox.com.am", "ledger--live-auth.pages.dev", "www.netflixcln.vercel.app", "verify-dhl.com",
    "dhl-secure.secure-portal.com", "groups.google.com", "www.startups.com", "instagram-cmd.github.io",
    "microsoft.github.io", "johnsmith.github.io", "ups-tracking-update.com", "dhlaccount.com", "upstream.com",
    "applefcu.org", "metabase.com", "steamdb.info", "pay-pal-news.com", "g00gle.net", "amazom.com", "payapl.com",
    "bankofamericca.com", "coinbase-login.xyz", "news.discord.gg", "netflix.account-check.top",
    "d1234abcd.cloudfront.net", "myapp.s3.amazonaws.com", "paypal-verify.s3.amazonaws.com", "3rf3x34x.pages.dev",
    "shop.apple-deals.icu", "sbi.secure-bank.co.in", "x7.duckdns.org", "192.168.10.4", "localhost",
    "wellsfarg0.co.uk", "pаypal-help.com", "münchen.de", "docs.python.org", "ppaypal.com",
    "facebook-login.monster",
]
PROBE_PATHS = ["", "/account/verify?id=7&x=", "/Spotify-Clone/index.html", "/a/b/c.php?q=1&r=2", "/paypal/update"]


def probe_urls(spark, sf_dir):
    """Brand-like hosts picked by page id, with the page's path or a probe path."""
    i = F.col("page_id")
    host = F.get(strings(PROBE_HOSTS), (i % len(PROBE_HOSTS)).cast("int"))
    path = F.get(strings(PROBE_PATHS), (F.floor(i / 3) % len(PROBE_PATHS)).cast("int"))
    tail = F.when(path == "", F.regexp_replace("url", "^https?://[^/]+", "")).otherwise(path)
    scheme = F.regexp_extract("url", "^(https?://)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(scheme, host, tail).alias("url"))


PROBE = f"""SELECT page_id, regexp_extract(url, '^(https?://)', 1)
 || {sql_list(PROBE_HOSTS)}[page_id % {len(PROBE_HOSTS)} + 1]
 || CASE WHEN {sql_list(PROBE_PATHS)}[(page_id // 3) % {len(PROBE_PATHS)} + 1] = ''
         THEN regexp_replace(url, '^https?://[^/]+', '')
         ELSE {sql_list(PROBE_PATHS)}[(page_id // 3) % {len(PROBE_PATHS)} + 1] END AS url FROM pages"""


# ------------------------------------------------------------------------ scans
def scans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.concat(F.lit("https://"), F.col("event_type"), F.lit(".example.org/"), k.cast("string"))
    content = F.when(k % 5 == 0, F.concat(text, F.repeat(F.lit("/path"), 25))).otherwise(text)
    hit = F.col("event_type").isin("error", "signup")
    return e.select(
        F.col("event_id").alias("id"), "user_id",
        F.when(F.col("event_type") == "purchase", "Email").otherwise("URL").alias("scan_type"),
        content.alias("content"), F.when(hit, "Phishing").otherwise("Legitimate").alias("result"),
        F.col("value").alias("confidence"), hit.alias("is_phishing"),
        F.lit(None).cast("string").alias("shap_explanation"),
        F.when(F.col("event_id") % 3 == 0, "extension").otherwise("web").alias("source"),
        F.col("ts").cast("timestamp").alias("created_at"))


SCANS = """SELECT event_id AS id, user_id,
 CASE WHEN event_type = 'purchase' THEN 'Email' ELSE 'URL' END AS scan_type,
 'https://' || event_type || '.example.org/' || (props->>'$.k')
   || CASE WHEN CAST(props->>'$.k' AS BIGINT) % 5 = 0 THEN repeat('/path', 25) ELSE '' END AS content,
 CASE WHEN event_type IN ('error', 'signup') THEN 'Phishing' ELSE 'Legitimate' END AS result,
 value AS confidence, event_type IN ('error', 'signup') AS is_phishing,
 CASE WHEN event_id % 3 = 0 THEN 'extension' ELSE 'web' END AS source, ts AS created_at FROM events"""


def users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.lower(F.replace("c_name", F.lit("#"), F.lit("_")))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("first_name"),
                    F.col("c_name").alias("last_name"), name.alias("username"),
                    F.concat(name, F.lit("@"), F.when(F.col("c_custkey") % 4 == 0, "Mailinator.com")
                             .otherwise("example.org")).alias("email"),
                    F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("user").alias("role"))


USERS = """SELECT c_custkey AS id, c_mktsegment AS first_name, c_name AS last_name,
 lower(replace(c_name, '#', '_')) AS username,
 lower(replace(c_name, '#', '_')) || '@' || CASE WHEN c_custkey % 4 = 0 THEN 'Mailinator.com' ELSE 'example.org' END AS email,
 CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role FROM customer"""


# ------------------------------------------------------------------ request log
def request_log(spark, sf_dir):
    """Events on a clock 600 times faster, so that windows fill up."""
    base = 1704067200  # 2024-01-01
    micros = F.lit(base * 1_000_000) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - base * 1_000_000) / 600)
    return table(spark, sf_dir, "events").select(
        F.timestamp_micros(micros).alias("ts"), F.col("event_id").cast("string").alias("request_id"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"), F.lit("POST").alias("method"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), 500).otherwise(200).alias("status"),
        (F.col("value") * 40).alias("latency_ms"), "user_id",
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 3).cast("string")).alias("ip"))


LOG = """SELECT make_timestamp(1704067200000000 + CAST(floor((epoch_us(ts) - 1704067200000000) / 600) AS BIGINT)) AS ts,
 CAST(event_id AS VARCHAR) AS request_id, '/' || event_type AS path,
 CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 500 ELSE 200 END AS status,
 value * 40 AS latency_ms, user_id, '10.0.0.' || (user_id % 3) AS ip FROM events"""


# ----------------------------------------------------------------- scored labels
def scored(spark, sf_dir):
    """Labels with two deterministic scores, a category and missing counts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id")
    i = F.col("doc_id")
    return rows.select(
        "doc_id", "lang", "n_chars", (1 - F.col("quality")).alias("y"),
        (((i * 37 + F.col("n_chars")) % 101) / 100.0 * 0.6 + (1 - F.col("quality")) * 0.3).alias("p"),
        (((i * 53 + F.col("n_chars")) % 97) / 96.0).alias("pb"), (i % 6).alias("missing"))


SCORED = """SELECT l.doc_id, d.lang, d.n_chars, 1 - l.quality AS y,
 CAST((l.doc_id * 37 + d.n_chars) % 101 AS DOUBLE) / CAST(100.0 AS DOUBLE) * CAST(0.6 AS DOUBLE) + (1 - l.quality) * CAST(0.3 AS DOUBLE) AS p,
 CAST((l.doc_id * 53 + d.n_chars) % 97 AS DOUBLE) / CAST(96.0 AS DOUBLE) AS pb, l.doc_id % 6 AS missing
 FROM labels l JOIN documents d USING (doc_id)"""
