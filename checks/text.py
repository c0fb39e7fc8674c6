"""Mail text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind
from checks.bind import Q, sql_list, table, values
from checks.registry import query
from lurewatch import fixed
from lurewatch.functions import text as T
from lurewatch.operators import windows as WN
from lurewatch.plans import mail as M
from lurewatch.session import spread

r6 = lambda c: F.round(c, 6)
WS, WORD = T.WS, T.WORD
squeeze = lambda c: f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'))"


def rep(c, *pairs, flags="g"):
    for a, b in pairs:
        c = f"regexp_replace({c}, {Q(a)}, {Q(b)}, '{flags}')"
    return c


def docs(spark, sf):
    """Documents with an odd line of markup, links and numbers in front."""
    i = F.col("doc_id")
    head = (F.when(i % 4 == 0, F.concat(F.lit("Subject: Re: <b>Invoice&nbsp;"), i.cast("string"), F.lit("</b> &amp; more www.pay.example/x?y=1 ")))
            .when(i % 4 == 1, F.concat(F.lit("mail jane.doe@corp.example.org or call 0044123456789 at https://x.example.org/a/b?c=1 "), i.cast("string"), F.lit(" ")))
            .when(i % 4 == 2, F.lit("#outlook a{padding:0;} @media print{x} color: red; {z} Jane DOE ")).otherwise(F.lit("")))
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "source", F.concat(head, "text").alias("text")))


DOCS = """SELECT doc_id, lang, source, CASE doc_id % 4
 WHEN 0 THEN 'Subject: Re: <b>Invoice&nbsp;' || doc_id || '</b> &amp; more www.pay.example/x?y=1 '
 WHEN 1 THEN 'mail jane.doe@corp.example.org or call 0044123456789 at https://x.example.org/a/b?c=1 ' || doc_id || ' '
 WHEN 2 THEN '#outlook a{padding:0;} @media print{x} color: red; {z} Jane DOE ' ELSE '' END || text AS text FROM documents"""

LEGACY = squeeze(rep("lower(text)", ("<[^>]+>", ""), ("https?://[a-zA-Z$-_!]+", ""), (f"[^{WS}]+@[^{WS}]+", ""),
                     (f"[^{WORD}{WS}.!?,-]", " ")))


@query("normalize_legacy", f"SELECT doc_id, {LEGACY} AS text FROM ({DOCS})")
def normalize_legacy(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_legacy("text").alias("text"))


def mail_sql(c):
    u = c
    for e, ch in T.COMMON_ENTITIES:
        u = f"replace({u}, {Q(e)}, {Q(ch)})"
    t = f"CASE WHEN contains({u}, '<') AND contains({u}, '>') THEN regexp_replace({u}, '<[^>]+>', ' ', 'g') ELSE {u} END"
    t = f"regexp_replace({t}, '(?i)^[{WS}]*subject[{WS}]*:[{WS}]*', '')"
    return squeeze(rep(t, (f"https?://[^{WS}]+|www\\.[^{WS}]+", " httpaddr ")))


@query("normalize_mail", f"SELECT doc_id, left({mail_sql('text')}, 5000) AS served, length({mail_sql('text')}) AS full_length FROM ({DOCS})")
def normalize_mail(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_mail("text", max_chars=5000).alias("served"),
                                  F.length(T.normalize_mail("text", max_chars=None)).alias("full_length"))


@query("normalize_mail_all_entities")
def normalize_mail_all_entities(spark, sf):
    """Full HTML entity table (Python step for texts with an ampersand)."""
    return docs(spark, sf).select("doc_id", T.normalize_mail("text", full_entities=True, max_chars=None).alias("text"))


STRIP = rep("html", (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?is)<script[^>]*>.*?</script>", " "), ("<[^>]+>", " "))


@query("strip_html", f"SELECT page_id, {squeeze(STRIP)} AS text FROM pages")
def strip_html(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", T.squeeze(T.strip_html("html")).alias("text"))


@query("html_to_text")
def html_to_text(spark, sf):
    """Standard-library HTML parser in Arrow batches."""
    return table(spark, sf, "pages").select("page_id", T.html_to_text("html").alias("text"))


def css_sql(c):
    return rep(c, (r"@(?:media|import|font-face)[^{]*\{[^}]*\}", " "),
               (rf"[#.\[][A-Za-z0-9_\-\]\[\"'=:{WS}\^~]+\{{[^}}]*\}}", " "),
               (rf"[A-Za-z\-]+[{WS}]*:[{WS}]*[^;{{}}\n]{{1,40}};", " "), (r"\{[^}]*\}", " "))


@query("kill_css", f"SELECT page_id, {css_sql('html')} AS text FROM pages")
def kill_css(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.kill_css("html").alias("text"))


def clean_sql(c):
    t = css_sql(f"translate({c}, {Q(fixed.INVISIBLE_CHARS)}, '')")
    t = rep(t, (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"))
    num = (rf"(^|[^{WORD}])\p{{Nd}}{{5,}}([^{WORD}]|$)", r"\1[NUM]\2")
    t = rep(t, num, num)  # neighbours share a separator: twice
    return squeeze(rep(t, (f"(https?://[^{WS}/]+)[^{WS}]*", r"\1")))


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM ({DOCS})")
def clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.clean_text("text", normalize=False).alias("text"))


@query("clean_text_nfkc")
def clean_text_nfkc(spark, sf):
    """With compatibility normalisation (Python step for non-ASCII texts)."""
    return docs(spark, sf).select("doc_id", T.clean_text("text").alias("text"))


@query("redact", f"SELECT doc_id, {rep(chr(114)+'eplace(text, ' + Q('jane.doe@corp.example.org') + ', ' + Q('[EMAIL]') + ')', ('(?i)jane doe', '[NAME]'), ('(?i)jane', '[NAME]'), ('(?i)doe', '[NAME]'))} AS text FROM ({DOCS})")
def redact(spark, sf):
    return docs(spark, sf).select("doc_id", T.redact("text", "Jane Doe", "jane.doe@corp.example.org").alias("text"))


def boiler_sql(c):
    n = rf"len(regexp_extract_all({c}, '\p{{L}}'))"
    p = rf"len(regexp_extract_all({c}, '[{{}}:;#.\[\]()=<>/*]'))"
    return (f"({n} < 60 OR {p} > {n} * 0.5 OR len(regexp_extract_all({c}, '!important')) >= 2 "
            f"OR contains({c}, 'ReadMsgBody') OR contains({c}, 'ExternalClass'))")


sig_sql = lambda c: f"left(regexp_replace(lower({c}), '[^a-z0-9]', '', 'g'), 120)"


@query("boilerplate_signature", f"SELECT doc_id, {boiler_sql('text')} AS boilerplate, {sig_sql('text')} AS signature FROM ({DOCS})")
def boilerplate_signature(spark, sf):
    return docs(spark, sf).select("doc_id", T.is_boilerplate("text").alias("boilerplate"), T.signature("text", 120).alias("signature"))


@query("dedupe_first", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {sig_sql('text')} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first(spark, sf):
    df = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.signature("text", 120).alias("sig"))
    return WN.dedupe_first(df, "sig", "doc_id").select("doc_id")


SENDERS = ["Jane <jane@Corp.Example.org>", "no-reply@accounts.google.com", "Shop <deals@newsletter.example>", "nobody", "bob@example.net"]
SUBJECTS = ["Weekly digest: 20% off", "Your password was reset", "Lunch?", "Invoice 17", "Big sale, verify now", "Notes", "Minutes of the meeting"]


def mails(spark, sf):
    i = F.col("doc_id")
    pick = lambda xs, d: F.get(F.array(*[F.lit(x) for x in xs]), (F.floor(i / d) % len(xs)).cast("int"))
    return docs(spark, sf).select(i.alias("msg_idx"), pick(SUBJECTS, 1).alias("subject"), pick(SENDERS, 7).alias("from_hdr"), F.col("text").alias("body"))


MAILS = f"""SELECT doc_id AS msg_idx, {sql_list(SUBJECTS)}[doc_id % 7 + 1] AS subject,
 {sql_list(SENDERS)}[(doc_id // 7) % 5 + 1] AS from_hdr, text AS body FROM ({DOCS})"""
DOMAIN = "lower(regexp_extract(from_hdr, '@([a-zA-Z0-9.\\-]+)', 1))"
anyof = lambda c, items: f"len(list_filter({sql_list(items)}, lambda h: contains({c}, h))) > 0"


def cat_sql(dom, subj, body):
    hay = f"lower({dom} || ' ' || {subj})"
    return (f"CASE WHEN {anyof(hay, fixed.PROMO_HINTS)} AND NOT ({anyof(hay, fixed.SECURITY_SUBJECT_HINTS)}) THEN 'promo' "
            f"WHEN {anyof(dom, fixed.SECURITY_SENDER_HINTS)} OR {anyof(hay, fixed.SECURITY_SUBJECT_HINTS)} OR "
            f"{anyof(f'lower(left({body}, 400))', fixed.SECURITY_SUBJECT_HINTS)} THEN 'security_transactional' ELSE 'ordinary_legit' END")


@query("categorize_mail", f"SELECT msg_idx, {DOMAIN} AS sender_domain, {cat_sql(DOMAIN, 'subject', 'body')} AS category FROM ({MAILS})")
def categorize_mail(spark, sf):
    df = mails(spark, sf).withColumn("sender_domain", T.sender_domain("from_hdr"))
    return df.select("msg_idx", "sender_domain", T.categorize_mail("sender_domain", "subject", "body", 400).alias("category"))


@query("review_set", f"""WITH c AS (SELECT msg_idx, {DOMAIN} AS dom, {clean_sql('subject')} AS subj, {clean_sql('body')} AS body FROM ({MAILS})),
 k AS (SELECT *, row_number() OVER (PARTITION BY {sig_sql('body')} ORDER BY msg_idx) AS first FROM c WHERE length(body) >= 150 AND NOT {boiler_sql('body')}),
 g AS (SELECT *, {cat_sql('dom', 'subj', 'body')} AS cat FROM k WHERE first = 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY msg_idx) AS pos FROM g)
 SELECT msg_idx, left(body, 1500) AS text, dom AS sender_domain, left(subj, 200) AS subject, cat AS auto_category, '' AS verified_label
 FROM n WHERE pos <= CASE cat WHEN 'security_transactional' THEN 400 WHEN 'ordinary_legit' THEN 250 ELSE 60 END""")
def review_set(spark, sf):
    return M.review_set(mails(spark, sf), normalize=False, **M.SHEET)


@query("recode_review_labels", "SELECT text, CASE doc_id % 5 WHEN 0 THEN 0 ELSE 1 END AS label FROM documents WHERE doc_id % 5 IN (0, 1)")
def recode_review_labels(spark, sf):
    i = F.col("doc_id") % 5
    lab = F.when(i == 0, "legit").when(i == 1, "spam").when(i == 2, "skip").otherwise("")
    return M.recode_review_labels(table(spark, sf, "documents").withColumn("verified_label", lab))


@query("drop_short", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND length(text) > 60")
def drop_short(spark, sf):
    return M.drop_short(table(spark, sf, "conversations"), "text", 60).select("conv_id", "turn")


@query("training_set", f"""WITH a AS (SELECT text, CAST(doc_id % 2 AS INT) AS label, 0 AS s FROM ({DOCS})
  UNION ALL SELECT text, 1, 1 FROM benchmark UNION ALL SELECT text, 0, 2 FROM conversations),
 n AS (SELECT left({mail_sql('text')}, 5000) AS text, label, s FROM a WHERE length(text) > 20),
 k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY s, label) AS r FROM n WHERE length(text) > 20)
 SELECT sha256(text) AS key, label, s AS source_ord FROM k WHERE r = 1""")
def training_set(spark, sf):
    d = docs(spark, sf).select("text", (F.col("doc_id") % 2).cast("int").alias("label"))
    b = table(spark, sf, "benchmark").select("text", F.lit(1).alias("label"))
    c = table(spark, sf, "conversations").select("text", F.lit(0).alias("label"))
    return M.training_set([d, b], c, max_chars=5000).select("key", "label", "source_ord")


@query("chunk_paragraphs", r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
   lambda x: regexp_replace(x, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents)
 SELECT doc_id, generate_subscripts(ps, 1) - 1 AS chunk_index, unnest(ps) AS content FROM p""")
def chunk_paragraphs(spark, sf):
    return WN.chunk_paragraphs(table(spark, sf, "documents").select("doc_id", "text"), "text", "\n")


WORDS = f"len(list_filter(regexp_split_to_array({LEGACY}, '[{WS}]+'), lambda w: w <> ''))"


@query("text_profile", f"""WITH w AS (SELECT {WORDS} AS n FROM ({DOCS}))
 SELECT count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, round(quantile_cont(n, 0.25), 6) AS p25,
  round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, max(n) AS max,
  sum(CAST(n > 256 AS BIGINT)) AS over_256, sum(CAST(n > 512 AS BIGINT)) AS over_512 FROM w""")
def text_profile(spark, sf):
    out = WN.text_profile(docs(spark, sf))
    return out.select(*[r6(c).alias(c) if c in ("mean", "std", "p25", "p50", "p75") else F.col(c) for c in out.columns])


COEF = """SELECT token, CAST(length(token) % 7 AS DOUBLE) / CAST(4.0 AS DOUBLE) - CAST(0.7 AS DOUBLE) AS coef, CAST(0.125 AS DOUBLE) AS mean FROM (
 SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[{w}]+'), lambda x: x <> '')) AS token FROM benchmark)""".replace("{w}", WS)
ATTR = f"""coef AS ({COEF}), wd AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[{WS}]+'), lambda x: x <> '')) AS token FROM documents),
 ct AS (SELECT doc_id, token, count(*) AS n FROM wd GROUP BY 1, 2),
 att AS (SELECT doc_id, token, coef * (n - mean) AS value FROM ct JOIN coef USING (token))"""


def _attributions(spark, sf):
    vocab = table(spark, sf, "benchmark").select(F.explode(T.text_tokens(F.lower("text"))).alias("token")).distinct()
    coef = vocab.select("token", ((F.length("token") % 7) / F.lit(4.0) - F.lit(0.7)).alias("coef"), F.lit(0.125).alias("mean"))
    return WN.attribute_tokens(spread(table(spark, sf, "documents").select("doc_id", "text")), coef)


@query("attribute_tokens", f"WITH {ATTR} SELECT doc_id, token, round(value, 6) AS value FROM att")
def attribute_tokens(spark, sf):
    return _attributions(spark, sf).select("doc_id", "token", r6("value").alias("value"))


@query("top_tokens", rf"""WITH {ATTR},
 f AS (SELECT doc_id, token, value, CASE WHEN value > 0 THEN 'risky' ELSE 'safe' END AS side FROM att
  WHERE length(token) >= 3 AND NOT regexp_matches(token, '[^\x00-\x7F]') AND regexp_matches(token, '[A-Za-z]') AND value <> 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY abs(value) DESC, token) AS rank, max(abs(value)) OVER (PARTITION BY doc_id, side) AS m FROM f)
 SELECT doc_id, side, rank, token, round(value, 6) AS value, round_even(100.0 * abs(value) / m, 1) AS weight FROM r WHERE rank <= 5""")
def top_tokens(spark, sf):
    return WN.top_tokens(_attributions(spark, sf)).withColumn("value", r6("value"))


@query("real_words", rf"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[{WS}]+')) AS w FROM conversations)
 SELECT w AS word, length(w) >= 3 AND NOT regexp_matches(w, '[^\x00-\x7F]') AND regexp_matches(w, '[A-Za-z]')
  AND NOT (length(w) <= 3 AND regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS keep FROM w WHERE w <> ''""")
def real_words(spark, sf):
    w = table(spark, sf, "conversations").select(F.explode(T.text_tokens("text")).alias("word")).distinct()
    return w.select("word", T.is_real_word("word").alias("keep"))


FILLS = {"num": ["1001", "2002", "30030"], "day": ["Monday", "Friday", "tomorrow", "12 August"]}
TEMPLATE = "Order {num} ships {day}, order {num} follows {day}."


def fill_sql(c, key, fills):
    for name, vals in fills.items():
        c = (f"array_to_string(list_transform(string_split({c}, '{{{name}}}'), lambda p, i: CASE WHEN i = 1 THEN p ELSE "
             f"{sql_list(vals)}[CAST('0x' || left(md5(concat_ws('|', {key}, '{name}', CAST(i - 1 AS VARCHAR))), 8) AS BIGINT) % {len(vals)} + 1] || p END), '')")
    return c


@query("fill_template", f"SELECT doc_id, {fill_sql(Q(TEMPLATE), 'CAST(doc_id AS VARCHAR)', FILLS)} AS text FROM documents")
def fill_template(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fill_template(F.lit(TEMPLATE), FILLS, "doc_id").alias("text"))


@query("generate_corpus", f"""WITH {values('prof', 'category, brand', [(c, b) for b, cs in fixed.BRAND_PROFILES.items() for c in cs])},
 t AS (SELECT CASE item_id % 3 WHEN 0 THEN 'txn' WHEN 1 THEN 'sec' ELSE 'work' END AS category,
   '{{brand}} {{num}}: ' || left(text, 60) AS text FROM benchmark),
 s(category, subject) AS (VALUES ('txn', 'Receipt'), ('txn', 'Your order'), ('sec', 'Sign-in alert'), ('work', 'Tomorrow')),
 m AS (SELECT DISTINCT t.category, t.text AS body, subject, coalesce(brand, '') AS brand FROM t JOIN s USING (category) LEFT JOIN prof USING (category))
 SELECT category, brand, 'Subject: ' || CASE WHEN brand <> '' THEN brand || ' - ' || subject ELSE subject END || chr(10) || chr(10) ||
  {fill_sql("replace(body, '{brand}', brand)", "concat_ws('|', category, body, subject, brand)", {'num': FILLS['num']})} AS text FROM m""")
def generate_corpus(spark, sf):
    i = F.col("item_id") % 3
    t = table(spark, sf, "benchmark").select(F.when(i == 0, "txn").when(i == 1, "sec").otherwise("work").alias("category"),
                                             F.concat(F.lit("{brand} {num}: "), F.substring("text", 1, 60)).alias("text"))
    s = spark.createDataFrame([("txn", "Receipt"), ("txn", "Your order"), ("sec", "Sign-in alert"), ("work", "Tomorrow")], "category string, text string")
    return M.generate_corpus(t, s, M.brand_categories(spark), {"num": FILLS["num"]}).select("category", "brand", "text")


@query("validate_text", """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text FROM documents)
 SELECT doc_id, length(text) BETWEEN 1 AND 10000 AS is_valid, CASE WHEN text = '' THEN 'No text provided'
  WHEN length(text) > 10000 THEN 'Text too long (max 10000 characters)' END AS error FROM t""")
def validate_text(spark, sf):
    ok, error = T.validate_text("text")
    df = table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")))
    return df.select("doc_id", ok.alias("is_valid"), error.alias("error"))


@query("disposable_mail", f"SELECT id, email, list_contains({sql_list(fixed.DISPOSABLE_MAIL_DOMAINS)}, lower(split_part(email, '@', 2))) AS disposable FROM ({bind.USERS})")
def disposable_mail(spark, sf):
    return bind.users(spark, sf).select("id", "email", T.is_disposable("email").alias("disposable"))
