"""Request monitoring and stateful queries (batch form, and stream runs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import LOG, SCANS, request_log, scans, table
from checks.registry import query
from checks.scans import TOKENS, tokens
from lurewatch import fixed
from lurewatch.functions.urls import cache_key
from lurewatch.session import scratch_path
from lurewatch.streaming import monitor as M
from lurewatch.streaming import state as S

r6 = lambda c: F.round(c, 6)
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
T = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
bucket = lambda w: f"time_bucket(INTERVAL {w}, ts, TIMESTAMP '2000-01-01')"
ROUTES = {"/click": (2, "1 minute"), "/view": (3, "1 minute")}


def stamped(df, *cols):
    return df.withColumns({c: stamp(c) for c in cols})


OVER = f"""SELECT {T('w')} AS window_start, {T('w + INTERVAL 1 MINUTE')} AS window_end, ip, path, count(*) AS n, CASE path WHEN '/click' THEN 2 WHEN '/view' THEN 3 ELSE 4 END AS allowed, '1 minute' AS per
 FROM (SELECT *, {bucket('1 MINUTE')} AS w FROM ({LOG})) GROUP BY w, ip, path HAVING count(*) > CASE path WHEN '/click' THEN 2 WHEN '/view' THEN 3 ELSE 4 END
 UNION ALL SELECT {T('w')}, {T('w + INTERVAL 1 HOUR')}, ip, path, count(*), 30, '1 hour' FROM (SELECT *, {bucket('1 HOUR')} AS w FROM ({LOG}))
 WHERE path NOT IN ('/click', '/view') GROUP BY w, ip, path HAVING count(*) > 30"""


@query("over_limit", OVER)
def over_limit(spark, sf):
    out = M.over_limit(request_log(spark, sf), ROUTES, [(30, "1 hour"), (4, "1 minute")])
    return stamped(out, "window_start", "window_end")


@query("request_rates", f"""SELECT {T('w')} AS window_start, {T('w + INTERVAL 1 MINUTE')} AS window_end, status, count(*) AS n, round(count(*) / 60.0, 6) AS per_second
 FROM (SELECT *, {bucket('1 MINUTE')} AS w FROM ({LOG})) GROUP BY w, status""")
def request_rates(spark, sf):
    return stamped(M.request_rates(request_log(spark, sf)), "window_start", "window_end").withColumn("per_second", r6("per_second"))


@query("request_rates_by_path", f"""SELECT {T('w')} AS window_start, {T('w + INTERVAL 5 MINUTE')} AS window_end, path, count(*) AS n, round(count(*) / 300.0, 6) AS per_second
 FROM (SELECT *, {bucket('5 MINUTE')} AS w FROM ({LOG})) GROUP BY w, path""")
def request_rates_by_path(spark, sf):
    out = M.request_rates(request_log(spark, sf), "path", "5 minutes")
    return stamped(out, "window_start", "window_end").withColumn("per_second", r6("per_second"))


@query("total_requests", f"SELECT count(*) AS n FROM ({LOG})")
def total_requests(spark, sf):
    return M.total_requests(request_log(spark, sf))


def sliding(step, n, unit):
    """ends(we, ...): every request in each sliding window that covers it."""
    return f"""SELECT {bucket(f'{step} {unit}')} + to_seconds({{step_s}} * (k + 1)) AS we, * EXCLUDE (k) FROM ({LOG}), (SELECT unnest(range({n})) AS k)"""


ERR = f"""SELECT we, count(*) AS n, sum(CAST(status BETWEEN 500 AND 599 AS BIGINT)) AS errors FROM ({sliding(15, 8, 'SECOND').format(step_s=15)}) GROUP BY we"""


@query("error_rates", f"SELECT {T('we')} AS window_end, n, errors, round(errors / CAST(n AS DOUBLE), 6) AS ratio FROM ({ERR})")
def error_rates(spark, sf):
    out = M.error_rates(request_log(spark, sf))
    return out.select(stamp("window.end").alias("window_end"), "n", "errors", r6("ratio").alias("ratio"))


@query("error_percent", f"""SELECT {T('we - INTERVAL 5 MINUTE')} AS window_start, {T('we')} AS window_end, count(*) AS n, sum(CAST(status BETWEEN 500 AND 599 AS BIGINT)) AS errors,
 round(100.0 * sum(CAST(status BETWEEN 500 AND 599 AS BIGINT)) / count(*), 6) AS error_pct FROM ({sliding(1, 5, 'MINUTE').format(step_s=60)}) GROUP BY we""")
def error_percent(spark, sf):
    return stamped(M.error_percent(request_log(spark, sf)), "window_start", "window_end").withColumn("error_pct", r6("error_pct"))


@query("error_rate_alerts", f"""WITH b AS (SELECT we FROM ({ERR}) WHERE errors / CAST(n AS DOUBLE) > 0.1)
 SELECT {T('we')} AS alert_at FROM b x WHERE (SELECT count(*) FROM b y WHERE y.we BETWEEN x.we - INTERVAL 60 SECOND AND x.we) = 5""")
def error_rate_alerts(spark, sf):
    return stamped(M.error_rate_alerts(request_log(spark, sf)), "alert_at")


def histogram_sql():
    edges = fixed.LATENCY_BUCKETS
    lows = [0.0, *edges]
    case = " ".join(f"WHEN latency_ms / 1000.0 <= {e} THEN {i}" for i, e in enumerate(edges))
    quant = lambda q, name: f"""(SELECT CASE WHEN h.b = {len(edges)} THEN {edges[-1]} ELSE h.lo + (h.hi - h.lo) * ({q} * g.total - h.before) / h.n END
      FROM h WHERE h.we = g.we AND h.before < {q} * g.total AND h.before + h.n >= {q} * g.total) AS {name}"""
    return f"""WITH e(b, lo, hi) AS (VALUES {', '.join(f"({i}, CAST({lows[i]} AS DOUBLE), CAST({(edges + [edges[-1]])[i]} AS DOUBLE))" for i in range(len(edges) + 1))}),
 s AS (SELECT we, CASE {case} ELSE {len(edges)} END AS b FROM ({sliding(1, 5, 'MINUTE').format(step_s=60)})),
 c AS (SELECT we, b, count(*) AS n FROM s GROUP BY we, b),
 h AS (SELECT we, b, n, lo, hi, coalesce(sum(n) OVER (PARTITION BY we ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c JOIN e USING (b)),
 g AS (SELECT we, sum(n) AS total FROM c GROUP BY we),
 q AS (SELECT we, {quant('CAST(0.5 AS DOUBLE)', 'p50')}, {quant('CAST(0.95 AS DOUBLE)', 'p95')}, {quant('CAST(0.99 AS DOUBLE)', 'p99')} FROM g)"""


@query("latency_percentiles", f"{histogram_sql()} SELECT {T('we')} AS window_end, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM q")
def latency_percentiles(spark, sf):
    out = M.latency_percentiles(request_log(spark, sf))
    return out.select(stamp("window.end").alias("window_end"), *[r6(c).alias(c) for c in ("p50", "p95", "p99")])


@query("latency_alerts", f"""{histogram_sql()}, b AS (SELECT we FROM q WHERE p95 > 2)
 SELECT {T('we')} AS alert_at FROM b x WHERE (SELECT count(*) FROM b y WHERE y.we BETWEEN x.we - INTERVAL 2 MINUTE AND x.we) = 3""")
def latency_alerts(spark, sf):
    return stamped(M.latency_alerts(request_log(spark, sf)), "alert_at")


@query("request_gaps", f"""SELECT strftime(down_from, '%Y-%m-%d %H:%M:%S.%f') AS down_from, round((epoch_us(ts) - epoch_us(down_from)) / 1000000, 3) AS seconds
 FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS down_from FROM events) WHERE epoch_us(ts) - epoch_us(down_from) > 1800000000""")
def request_gaps(spark, sf):
    log = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = M.gaps(log, 1800)
    return out.select(F.date_format("down_from", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("down_from"), F.round("seconds", 3).alias("seconds"))


@query("stale_keys", """WITH s AS (SELECT sha256(url) AS k, max(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(page_id % 60 AS INT))) AS at FROM pages WHERE page_id % 4 <> 0 GROUP BY 1)
 SELECT DISTINCT url FROM pages WHERE sha256(url) NOT IN (SELECT k FROM s WHERE at > TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 24 HOUR)""".replace(" AS at ", " AS at_ ").replace("WHERE at >", "WHERE at_ >"))
def stale_keys(spark, sf):
    p = table(spark, sf, "pages")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("page_id") % 60).cast("int"))
    store = p.filter("page_id % 4 <> 0").groupBy(cache_key("url").alias("cache_key")).agg(F.max(at).alias("cached_at"))
    return S.stale_keys(p, store, "2024-01-03 00:00:00").select("url")


ATTEMPT = "SELECT event_id, md5(CAST(event_id // 2 * 2 AS VARCHAR)) AS token, 'verify' AS purpose, ts + INTERVAL 20 HOUR AS at_ FROM events"


@query("check_tokens", f"""SELECT a.event_id, coalesce(t.expires_at >= a.at_, false) AS valid, CASE WHEN t.expires_at >= a.at_ THEN t.user_id END AS user_id
 FROM ({ATTEMPT}) a LEFT JOIN (SELECT * FROM ({TOKENS}) WHERE NOT used) t ON t.token = a.token AND t.purpose = a.purpose""")
def check_tokens(spark, sf):
    i = F.col("event_id")
    attempts = table(spark, sf, "events").select("event_id", F.md5((F.floor(i / 2) * 2).cast("string")).alias("token"), F.lit("verify").alias("purpose"),
                                                 (F.col("ts") + F.make_dt_interval(hours=F.lit(20))).alias("ts"))
    return S.check_tokens(attempts, tokens(spark, sf)).select("event_id", "valid", "user_id")


# ------------------------------------------------------------- duplicate scans
def dense_scans(spark, sf):
    """Scans on a clock 3,000 times faster with few different contents."""
    s = scans(spark, sf)
    base = 1704067200
    fast = F.timestamp_micros(F.lit(base * 1_000_000) + F.floor((F.unix_micros("created_at") - base * 1_000_000) / 3000))
    return s.select("id", (F.col("user_id") % 5).alias("user_id"), F.concat(F.lit("https://site"), (F.col("id") % 7).cast("string"), F.lit(".example/..")).alias("content"),
                    "source", fast.alias("created_at"))


DENSE = f"""SELECT id, user_id % 5 AS user_id, 'https://site' || (id % 7) || '.example/' AS head, source,
 1704067200000000 + CAST(floor((epoch_us(created_at) - 1704067200000000) / 3000) AS BIGINT) AS at_ FROM ({SCANS})"""


KEPT = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_, id) AS i FROM ({DENSE})),
 w AS (SELECT id, user_id, i, true AS keep, [struct_pack(s := source, h := head, t := at_)] AS saved FROM d WHERE i = 1
  UNION ALL SELECT n.id, n.user_id, n.i, len(list_filter(w.saved, lambda x: x.s = n.source AND x.h = n.head AND n.at_ - x.t < 60000000)) = 0,
   CASE WHEN len(list_filter(w.saved, lambda x: x.s = n.source AND x.h = n.head AND n.at_ - x.t < 60000000)) = 0
     THEN list_slice(list_append(w.saved, struct_pack(s := n.source, h := n.head, t := n.at_)), -10, -1) ELSE w.saved END
  FROM w JOIN d n ON n.user_id = w.user_id AND n.i = w.i + 1)
 SELECT id FROM w WHERE keep"""


@query("suppress_duplicates", KEPT)
def suppress_duplicates(spark, sf):
    return S.suppress_duplicates(dense_scans(spark, sf)).select("id")


# ----------------------------------------------------------------- stream runs
def run_stream(spark, batch, job, label, mode="append"):
    """Write a frame to files, read them as a stream, run the job to its end."""
    src, out, state = (scratch_path(spark, f"{label}-{x}") for x in ("in", "out", "state"))
    batch.write.parquet(src)
    stream = job(spark.readStream.schema(batch.schema).parquet(src))
    done = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .outputMode(mode).trigger(availableNow=True).start())
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def closed_by(rows, key="user_id", value=-1, ts="created_at", days=30):
    """The rows and one more, of a key of its own, that moves the watermark past them all."""
    end = rows.agg((F.max(ts) + F.make_dt_interval(days=F.lit(days))).alias(ts)).withColumn(key, F.lit(value).cast(rows.schema[key].dataType))
    return rows.unionByName(end, allowMissingColumns=True)


LAST = f"(SELECT max(ts) FROM ({LOG}))"


@query("stream_request_rates", f"""SELECT {T('w')} AS window_start, status, count(*) AS n FROM (SELECT *, {bucket('1 MINUTE')} AS w FROM ({LOG}))
 GROUP BY w, status HAVING w + INTERVAL 1 MINUTE <= {LAST} - INTERVAL 1 MINUTE""")
def stream_request_rates(spark, sf):
    """Closed windows of the streaming job equal the batch result."""
    job = lambda s: M.request_rates(M.with_lateness(s))
    out = run_stream(spark, request_log(spark, sf), job, "rates")
    return out.select(stamp("window_start").alias("window_start"), "status", "n")


@query("stream_suppress_duplicates", KEPT)
def stream_suppress_duplicates(spark, sf):
    """Kept scans of the stateful streaming job."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = run_stream(spark, closed_by(dense_scans(spark, sf)), S.suppress_duplicates_stream, "dupes")
    return out.select("id")


@query("stream_cache_misses", """WITH RECURSIVE r AS (SELECT event_id, md5(CAST(user_id % 50 AS VARCHAR)) AS url, ts FROM events),
 first_miss AS (SELECT url, min(ts) AS at_ FROM r GROUP BY url),
 misses AS (SELECT url, at_ FROM first_miss UNION ALL
  SELECT m.url, (SELECT min(r.ts) FROM r WHERE r.url = m.url AND r.ts >= m.at_ + INTERVAL 24 HOUR) FROM misses m WHERE m.at_ IS NOT NULL)
 SELECT min(r.event_id) AS id, m.url, epoch_us(m.at_) AS at_micros FROM misses m JOIN r ON r.url = m.url AND r.ts = m.at_ GROUP BY ALL""")
def stream_cache_misses(spark, sf):
    """Requests of the event table that a cache of 24 hours would not answer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    requests = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.md5((F.col("user_id") % 50).cast("string")).alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    out = run_stream(spark, closed_by(requests, "url", "", "ts"), S.cache_misses_stream, "misses")
    return out.select("id", "url", F.unix_micros("ts").alias("at_micros"))
