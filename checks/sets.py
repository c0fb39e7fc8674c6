"""Sampling, split and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind
from checks.bind import MESSY, PROBE, Q, messy_urls, probe_urls, sql_list, table
from checks.registry import query
from checks.urls import domain_sql, parts_sql
from lurewatch.operators import joins as J
from lurewatch.operators import ranks as R
from lurewatch.operators import sampling as S
from lurewatch.operators import windows as WN

h = lambda key, seed: f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


@query("sample_n", f"SELECT doc_id FROM documents ORDER BY {h('doc_id', 42)}, doc_id LIMIT 137")
def sample_n(spark, sf):
    return S.sample_n(table(spark, sf, "documents"), "doc_id", 137).select("doc_id")


@query("shuffle_rank", f"SELECT doc_id, row_number() OVER (ORDER BY {h('doc_id', 7)}) AS rank FROM documents")
def shuffle_rank(spark, sf):
    return R.hash_rank(table(spark, sf, "documents").select("doc_id"), "doc_id", 7)


@query("shuffle", "SELECT doc_id FROM documents")
def shuffle(spark, sf):
    return S.shuffle(table(spark, sf, "documents"), "doc_id").select("doc_id")


@query("cap_random", f"""SELECT host, page_id FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id,
 row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY {h('page_id', 42)}) AS r FROM pages) WHERE r <= 3""")
def cap_random(spark, sf):
    df = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id")
    return S.cap_random(df, "host", "page_id", 3)


@query("cap_per_group", """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
 WHERE r <= CASE source WHEN 'src0' THEN 40 WHEN 'src1' THEN 25 WHEN 'src2' THEN 6 ELSE 0 END""")
def cap_per_group(spark, sf):
    return WN.cap_per_group(table(spark, sf, "documents").select("source", "doc_id"), "source", {"src0": 40, "src1": 25, "src2": 6}, "doc_id", keep_others=False)


@query("oversample", "SELECT doc_id, unnest(range(1, CASE WHEN quality = 0 THEN 16 ELSE 2 END)) AS copy FROM labels")
def oversample(spark, sf):
    return S.oversample(table(spark, sf, "labels"), 15, F.col("quality") == 0).select("doc_id", "copy")


@query("cycle_to", """WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark)
 SELECT r.i, item_id FROM (SELECT unnest(range(0, 1050)) AS i) r JOIN p ON r.i % p.n = p.pos""")
def cycle_to(spark, sf):
    return S.cycle_to(table(spark, sf, "benchmark").select("item_id"), 1050, "item_id").select("i", "item_id")


DOM = f"WITH {parts_sql(MESSY)}, {domain_sql()}, d AS (SELECT page_id, CASE WHEN registered = '' THEN url ELSE registered END AS domain FROM dom JOIN ({MESSY}) USING (page_id))"
BYHOST = "SELECT page_id, 'https://' || replace(regexp_extract(url, '^https?://([^/]+)', 1), '.', '-') || '.org/x' AS url FROM pages"


def by_host(spark, sf):
    """One registered domain per page host."""
    host = F.replace(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("."), F.lit("-"))
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://"), host, F.lit(".org/x")).alias("url"))


DOMAIN = "regexp_extract(url, '//([^/]+)', 1)"


@query("domain_split", f"""SELECT page_id, {DOMAIN} AS domain, CASE WHEN CAST('0x' || left({h(DOMAIN, 42)}, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < 0.75
 THEN 'train' ELSE 'test' END AS split FROM ({BYHOST})""")
def domain_split(spark, sf):
    return S.domain_split(by_host(spark, sf)).select("page_id", "domain", "split")


@query("domain_split_exact", f"""WITH d AS (SELECT DISTINCT {DOMAIN} AS domain FROM ({BYHOST})),
 r AS (SELECT domain, row_number() OVER (ORDER BY {h('domain', 42)}) AS r, count(*) OVER () AS n FROM d)
 SELECT page_id, domain, CASE WHEN r <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM ({BYHOST}) JOIN r ON domain = {DOMAIN}""")
def domain_split_exact(spark, sf):
    return S.domain_split(by_host(spark, sf), exact=True).select("page_id", "domain", "split")


@query("stratified_split", f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {h('doc_id', 42)}) AS r,
  count(*) OVER (PARTITION BY quality) AS n FROM labels)
 SELECT doc_id, quality, CASE WHEN r <= round(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf):
    return S.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.2)


@query("split_and_append", f"""WITH e AS (SELECT item_id + 1000000 AS id, row_number() OVER (ORDER BY {h('item_id + 1000000', 42)}) AS r, count(*) OVER () AS n FROM benchmark)
 SELECT doc_id AS id, 'original' AS source, 'pool' AS part FROM documents UNION ALL SELECT id, 'modern', 'pool' FROM e WHERE r > ceil(n * CAST(0.2 AS DOUBLE))
 UNION ALL SELECT id, 'modern', 'held' FROM e WHERE r <= ceil(n * CAST(0.2 AS DOUBLE))""")
def split_and_append(spark, sf):
    base = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    extra = table(spark, sf, "benchmark").select((F.col("item_id") + 1000000).alias("id"))
    pool, held = S.split_and_append(base, extra, "id")
    return pool.withColumn("part", F.lit("pool")).unionByName(held.withColumn("part", F.lit("held")))


@query("union_distinct", """WITH u AS (SELECT text, doc_id AS id, 0 AS s FROM documents UNION ALL SELECT text, item_id, 1 FROM benchmark)
 SELECT id, s AS source_ord FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY s, id) AS r FROM u) WHERE r = 1""")
def union_distinct(spark, sf):
    d = table(spark, sf, "documents").select("text", F.col("doc_id").alias("id"))
    b = table(spark, sf, "benchmark").select("text", F.col("item_id").alias("id"))
    return S.union_distinct([d, b], "text", "id").select("id", "source_ord")


@query("union_with_quotas", f"""WITH a AS (SELECT DISTINCT url FROM pages ORDER BY {h('url', 42)}, url LIMIT 60), b AS (SELECT DISTINCT url FROM ({PROBE})),
 u AS (SELECT url FROM a UNION SELECT url FROM b) SELECT url FROM u ORDER BY {h('url', 42)}, url LIMIT 100""".replace(
    "SELECT DISTINCT url FROM pages ORDER BY", "SELECT url FROM (SELECT DISTINCT url FROM pages) ORDER BY"))
def union_with_quotas(spark, sf):
    return S.union_with_quotas([(table(spark, sf, "pages"), 60), (probe_urls(spark, sf), None)], 100)


@query("set_diff", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_diff(spark, sf):
    return S.set_diff(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


SENT = "SELECT DISTINCT unnest(string_split(text, '. ')) AS s FROM {t}"


@query("overlap", f"SELECT count(*) AS shared FROM ({SENT.format(t='documents')}) a WHERE s IN (SELECT s FROM ({SENT.format(t='benchmark')}))")
def overlap(spark, sf):
    """Sentences of the held-out pool that also occur in the corpus."""
    sent = lambda t: table(spark, sf, t).select(F.explode(F.split("text", r"\. ")).alias("s"))
    return S.overlap(sent("documents"), sent("benchmark"), "s")


@query("token_sets", r"""WITH t AS (SELECT c.conv_id, c.turn, list_distinct(string_split(lower(c.text), ' ')) AS a, list_distinct(string_split(lower(p.text), ' ')) AS b
  FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)
 SELECT conv_id, turn, len(list_intersect(a, b)) AS shared, len(a) AS distinct_words FROM t""")
def token_sets(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("a"))
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("a").alias("b"))
    return c.join(p, ["conv_id", "turn"]).select("conv_id", "turn", F.size(S.token_intersect("a", "b")).alias("shared"),
                                                 F.size(S.ordered_distinct("a")).alias("distinct_words"))


@query("first_brand_per_candidate", """SELECT n_regionkey AS region, arg_min(n_name, n_nationkey) AS first_nation, count(*) AS n FROM nation
 JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def first_brand_per_candidate(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    first = S.first_per_key(rows.select(F.col("n_regionkey").alias("region"), "n_name", "n_nationkey"), "region", ["n_nationkey"])
    counts = rows.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))
    return counts.join(first, "region").select("region", F.col("n_name").alias("first_nation"), "n")


@query("deep_link_probe", """SELECT host || replace(t, '{id}', md5(host)) AS url FROM (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS host FROM pages),
 (SELECT unnest(['/chat/{id}', '/document/d/{id}/edit?usp=sharing', '/u/1/#inbox/{id}']) AS t)""")
def deep_link_probe(spark, sf):
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("domain")).distinct()
    return J.deep_link_probe(hosts, ["/chat/{id}", "/document/d/{id}/edit?usp=sharing", "/u/1/#inbox/{id}"]).select("url")


OPEN, CTA = ["Dear customer,", "Hello,", "Attention:"], ["Click now", "Reply today"]


@query("grid", f"""WITH n AS (SELECT count(*) AS c FROM documents), g AS (SELECT o, n_name, k FROM (SELECT unnest({sql_list(OPEN)}) AS o),
  (SELECT n_name FROM nation), (SELECT unnest({sql_list(CTA)}) AS k))
 SELECT o AS opener, n_name AS nation, k AS cta FROM g""")
def grid(spark, sf):
    """Template grid over the nations (25 names, the category list)."""
    nations = [r.n_name for r in table(spark, sf, "nation").select("n_name").orderBy("n_name").limit(100).collect()]
    return J.grid(spark, opener=OPEN, nation=nations, cta=CTA).drop("combo")
