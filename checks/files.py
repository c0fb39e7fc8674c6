"""Readers and writers, run on files derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import Q, messy_urls, probe_urls, scans, table
from checks.registry import query
from lurewatch import fixed
from lurewatch.functions import urls as U
from lurewatch.plans.url_features import url_features_v1_lexical
from lurewatch.session import scratch_path
from lurewatch.sources import readers as RD
from lurewatch.sources import versioned as VT
from lurewatch.sources import writers as WR

r6 = lambda c: F.round(c, 6)


@query("read_url_list", "SELECT url FROM pages WHERE page_id % 5 <> 0")
def read_url_list(spark, sf):
    """URL list with comments and blank lines."""
    i = F.col("page_id")
    path = scratch_path(spark, "list")
    lines = F.when(i % 5 == 0, F.concat(F.lit("# "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" \n")))
    table(spark, sf, "pages").select(lines.alias("value")).write.text(path)
    return RD.read_url_list(spark, path)


@query("read_feeds", "SELECT DISTINCT trim(url) AS url FROM pages")
def read_feeds(spark, sf):
    """Two feeds with the same URLs, one with junk lines."""
    a, b = scratch_path(spark, "feed"), scratch_path(spark, "feed")
    p = table(spark, sf, "pages")
    p.select(F.col("url").alias("value")).write.text(a)
    p.select(F.concat("url", F.lit("\nnot-a-url "), F.col("page_id").cast("string")).alias("value")).write.text(b)
    return RD.read_feeds(spark, [a, b])


HOSTS = "SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h FROM pages"


@query("read_ranked_domains", f"SELECT url FROM (SELECT 'https://' || h || '/' AS url FROM ({HOSTS})) ORDER BY md5(url || '|42'), url LIMIT 40")
def read_ranked_domains(spark, sf):
    path = scratch_path(spark, "ranked")
    h = F.upper(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    df = table(spark, sf, "pages").select(h.alias("Domain")).distinct()
    df.select(F.lit(1).alias("GlobalRank"), F.lit(2).alias("TldRank"), "Domain").write.option("header", True).csv(path)
    return RD.read_ranked_domains(spark, path, 40)


@query("read_mail_corpora", """SELECT 'a' || item_id AS text, 1 AS label FROM benchmark UNION ALL SELECT trim('s' || item_id || ' ' || text), 0 FROM benchmark
 UNION ALL SELECT text, 1 FROM benchmark""")
def read_mail_corpora(spark, sf):
    """Three header variants and one file without labels."""
    b = table(spark, sf, "benchmark")
    i = F.col("item_id").cast("string")
    variants = [b.select(F.concat(F.lit("a"), i).alias("text_combined"), F.lit(1).alias("Label")),
                b.select(F.concat(F.lit("s"), i).alias("subject"), F.col("text").alias("body"), F.lit(0).alias("label")),
                b.select("text", F.lit(1).alias("label")), b.select("text")]
    paths = []
    for df in variants:
        paths.append(scratch_path(spark, "corpus"))
        df.write.option("header", True).option("escape", '"').csv(paths[-1])
    return RD.read_mail_corpora(spark, paths)


@query("read_csv_records", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, sha256('<' || coalesce(text, '') || '>') AS text FROM documents")
def read_csv_records(spark, sf):
    """Whole texts with line breaks, commas and quotes, written as CSV and put together from split lines."""
    path = scratch_path(spark, "records")
    text = F.concat(F.lit("<"), F.coalesce("text", F.lit("")), F.lit(">"))
    (table(spark, sf, "documents").select("doc_id", "lang", text.alias("text"))
     .write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path))
    return RD.read_csv_records(spark, path).select("doc_id", "lang", F.sha2("text", 256).alias("text"))


@query("quoted_csv", "SELECT doc_id, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM documents")
def quoted_csv(spark, sf):
    path = scratch_path(spark, "quoted")
    WR.write_quoted_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return spark.read.schema("doc_id LONG, text STRING").option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@query("append_missing", "SELECT url, count(*) AS n FROM (SELECT DISTINCT url FROM pages) GROUP BY url")
def append_missing(spark, sf):
    """Half the URLs are stored, then all are offered: nothing is stored twice."""
    path = scratch_path(spark, "done")
    p = table(spark, sf, "pages").select("page_id", "url")
    WR.append_missing(p.filter("page_id % 2 = 0"), path, "url")
    WR.append_missing(p, path, "url")
    return spark.read.parquet(path).groupBy("url").agg(F.count("*").alias("n"))


@query("upsert_table", """SELECT doc_id, 0 AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS content FROM documents
 UNION ALL SELECT item_id + 1000000, 0, 'added' FROM benchmark""")
def upsert_table(spark, sf):
    path = scratch_path(spark, "chunks")
    base = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), F.col("source").alias("content"), F.lit(1).alias("version"))
    changed = base.filter("doc_id % 3 = 0").withColumn("content", F.lit("new")).withColumn("version", F.lit(3))
    stale = changed.withColumn("content", F.lit("old")).withColumn("version", F.lit(2))
    added = table(spark, sf, "benchmark").select((F.col("item_id") + 1000000).alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("added").alias("content"), F.lit(2).alias("version"))
    WR.upsert_table(base, path, ["doc_id", "chunk_index"])
    WR.upsert_table(changed.unionByName(stale).unionByName(added), path, ["doc_id", "chunk_index"], order="version")
    return spark.read.parquet(path).select("doc_id", "chunk_index", "content")


@query("versioned_upserts", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS content, 3 AS newest FROM documents
 UNION ALL SELECT item_id + 1000000, 'added', 3 FROM benchmark""")
def versioned_upserts(spark, sf):
    """Commits by key into a versioned table; the last one is delivered twice."""
    path = scratch_path(spark, "versions")
    base = table(spark, sf, "documents").select("doc_id", F.col("source").alias("content"), F.lit(1).alias("turn"))
    changed = base.filter("doc_id % 3 = 0").withColumns({"content": F.lit("new"), "turn": F.lit(3)})
    stale = changed.withColumns({"content": F.lit("old"), "turn": F.lit(2)})
    added = table(spark, sf, "benchmark").select((F.col("item_id") + 1000000).alias("doc_id"), F.lit("added").alias("content"), F.lit(2).alias("turn"))
    VT.commit(base, path, ["doc_id"], "turn", buckets=8)
    VT.commit(changed.unionByName(stale), path, ["doc_id"], "turn", stream="s", batch=0)
    VT.commit(added, path, ["doc_id"], "turn", stream="s", batch=1)
    newest = VT.commit(stale, path, ["doc_id"], "turn", stream="s", batch=1)
    return VT.read_version(spark, path).select("doc_id", "content", F.lit(newest).alias("newest"))


@query("append_scans", "SELECT event_id AS id, count(*) AS n FROM events GROUP BY 1")
def append_scans(spark, sf):
    path = scratch_path(spark, "scans")
    s = scans(spark, sf)
    WR.append_scans(s.filter("id % 2 = 0"), path)
    WR.append_scans(s.filter("id % 2 = 1"), path)
    return RD.read_table(spark, path, s.schema).groupBy("id").agg(F.count("*").alias("n"))


@query("append_audit", "SELECT doc_id AS id, left(text, 500) AS detail FROM documents")
def append_audit(spark, sf):
    path = scratch_path(spark, "audit")
    WR.append_audit(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("detail")), path, max_chars=500)
    return spark.read.parquet(path)


@query("request_log_files", "SELECT CAST(event_id AS VARCHAR) AS request_id, '/' || event_type AS path, user_id FROM events")
def request_log_files(spark, sf):
    from checks.bind import request_log
    path = scratch_path(spark, "log")
    WR.write_request_log(request_log(spark, sf), path)
    return RD.read_request_log(spark, path).select("request_id", "path", "user_id")


@query("read_corpus", "SELECT CAST(item_id AS VARCHAR) AS doc_id, 'T' || item_id AS title, text FROM benchmark")
def read_corpus(spark, sf):
    path = scratch_path(spark, "json")
    b = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"),
                                             F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("title"), F.lit("kb").alias("source"), "text")
    # JSON arrays of a hundred documents each
    arrays = b.groupBy(F.floor(F.col("doc_id").cast("long") / 100).alias("g")).agg(F.to_json(F.collect_list(F.struct("doc_id", "title", "source", "text"))).alias("value"))
    arrays.select("value").repartition(4).write.text(path)
    return RD.read_corpus(spark, path).select("doc_id", "title", "text")


@query("read_calibration", "SELECT CAST(n_nationkey AS INT) AS pos, n_nationkey / CAST(24.0 AS DOUBLE) AS x, round(sqrt(n_nationkey / CAST(24.0 AS DOUBLE)), 6) AS y, CAST(0.35 AS DOUBLE) AS threshold FROM nation")
def read_calibration(spark, sf):
    """Model configuration with one knot per nation."""
    path = scratch_path(spark, "config")
    x = F.col("n_nationkey") / F.lit(24.0)
    knots = table(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct(x.alias("x"), r6(F.sqrt(x)).alias("y")))).alias("k"))
    WR.write_report(knots.select(F.array(F.lit("length_url")).alias("features"), F.lit(0.35).alias("threshold"),
                                 F.struct(F.col("k.x").alias("x"), F.col("k.y").alias("y")).alias("calibration")), path)
    return RD.read_calibration(spark, path)


@query("read_features", "SELECT page_id % 2 AS phishing, CAST(sum(length(url)) AS DOUBLE) AS total_length, count(*) AS n FROM pages GROUP BY 1")
def read_features(spark, sf):
    path = scratch_path(spark, "features")
    df = url_features_v1_lexical(table(spark, sf, "pages").select("page_id", "url"))
    df = df.select(*fixed.FEATURES_V1[:15], *[F.lit(-1.0).alias(n) for n in fixed.NETWORK_FEATURES],
                   (F.col("page_id") % 2).cast("int").alias("phishing"), "url")
    df.write.option("header", True).csv(path)
    got = RD.read_features(spark, path)
    return got.groupBy("phishing").agg(F.sum("length_url").alias("total_length"), F.count("*").alias("n"))


@query("read_mbox", "SELECT doc_id AS msg_idx, 'Subject ' || doc_id AS subject, 'User ' || doc_id || ' <u' || doc_id || '@example.org>' AS from_hdr, length(source) + 5 AS body_length FROM documents")
def read_mbox(spark, sf):
    """Documents written as one mail archive per partition and parsed again."""
    path = scratch_path(spark, "mbox")
    i = F.col("doc_id").cast("string")
    mail = F.concat(F.lit("From x@example.org Mon Jan  1 00:00:00 2024\nSubject: Subject "), i, F.lit("\nFrom: User "), i, F.lit(" <u"), i,
                    F.lit("@example.org>\nContent-Type: text/plain; charset=utf-8\n\nbody "), "source", F.lit("\n"))
    table(spark, sf, "documents").coalesce(1).orderBy("doc_id").select(mail.alias("value")).coalesce(1).write.text(path)
    out = RD.read_mbox(spark, path)
    return out.select("msg_idx", "subject", "from_hdr", F.length(F.trim(F.replace("body", F.lit("\n"), F.lit("")))).alias("body_length"))
