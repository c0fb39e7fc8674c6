"""Request-log monitoring.

Every function takes a batch or a streaming frame; on a stream, call
``with_lateness`` first.  Requests are first counted in small tumbling windows
(a map-side aggregation), and only those counts are spread over sliding
windows, so a request is never copied once per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurewatch.fixed import LATENCY_BUCKETS
from lurewatch.functions.calc import micros, safe_div
from lurewatch.operators.sampling import union_all

# requests per client and route; routes with their own limit replace these
DEFAULT_LIMITS = [(200, "1 hour"), (50, "1 minute")]


def with_lateness(log: DataFrame, delay="1 minute", ts="ts") -> DataFrame:
    """Accept events up to ``delay`` late (streams only)."""
    return log.withWatermark(ts, delay) if log.isStreaming else log


def _ends(df: DataFrame, *names) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names)


def over_limit(log: DataFrame, routes=None, default=None) -> DataFrame:
    """Client / route / window combinations above their request limit.

    ``routes``: path -> (n, window); other paths use ``default``.
    """
    routes, default = routes or {}, DEFAULT_LIMITS if default is None else default
    parts = []
    for length in sorted({w for _, w in [*default, *routes.values()]}):
        allowed = F.lit(None).cast("long")
        for n, w in default:
            if w == length:
                allowed = F.when(~F.col("path").isin(list(routes)), F.lit(n))
        for path, (n, w) in routes.items():
            if w == length:
                allowed = F.when(F.col("path") == path, F.lit(n)).otherwise(allowed)
        counts = log.groupBy(F.window("ts", length), "ip", "path").agg(F.count("*").alias("n"))
        counts = counts.withColumn("allowed", allowed.cast("long")).filter(F.col("n") > F.col("allowed"))
        parts.append(_ends(counts, "ip", "path", "n", "allowed", F.lit(length).alias("per")))
    return union_all(parts)


def request_rates(log: DataFrame, by="status", length="1 minute") -> DataFrame:
    """Requests per second in tumbling windows, by status or path."""
    counts = log.groupBy(F.window("ts", length), by).agg(F.count("*").alias("n"))
    secs = (micros("window.end") - micros("window.start")) / 1e6
    return _ends(counts, by, "n", (F.col("n") / secs).alias("per_second"))


def total_requests(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n"))


def error_rates(log: DataFrame, length="2 minutes", step="15 seconds") -> DataFrame:
    """Share of 5xx answers in sliding windows."""
    base = log.groupBy(F.window("ts", step)).agg(
        F.count("*").alias("n"), F.count_if(F.col("status").between(500, 599)).alias("errors"))
    wide = base.groupBy(F.window(F.window_time("window"), length, step)).agg(
        F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return wide.withColumn("ratio", safe_div("errors", F.greatest("n", F.lit(1))))


def _held(breaches: DataFrame, hold: str, evaluations: int, step: str) -> DataFrame:
    """Times at which the condition was true in every one of the last evaluations."""
    last = breaches.groupBy(F.window(F.window_time("window"), hold, step)).agg(F.count("*").alias("n"))
    return last.filter(F.col("n") == evaluations).select(F.col("window.end").alias("alert_at"))


def error_rate_alerts(log: DataFrame, threshold=0.1) -> DataFrame:
    """More than 10 % errors over two minutes, at every 15-second evaluation of
    a minute (five in a row)."""
    rates = error_rates(log)
    return _held(rates.filter(F.col("ratio") > threshold), "75 seconds", 5, "15 seconds")


def error_percent(log: DataFrame) -> DataFrame:
    """Percentage of 5xx answers over five minutes, evaluated every minute."""
    return _ends(error_rates(log, "5 minutes", "1 minute"), "n", "errors", (F.col("ratio") * 100).alias("error_pct"))


def _latency_counts(log: DataFrame, length, step) -> DataFrame:
    secs = F.col("latency_ms") / 1000.0
    edges = [*LATENCY_BUCKETS, float("inf")]
    low = [float("-inf"), *LATENCY_BUCKETS]
    names = [f"b{i}" for i in range(len(edges))]
    inside = lambda i: (secs > low[i]) & (secs <= edges[i]) if i + 1 < len(edges) else secs > low[i]
    base = log.groupBy(F.window("ts", step)).agg(*[F.count_if(inside(i)).alias(n) for i, n in enumerate(names)])
    wide = base.groupBy(F.window(F.window_time("window"), length, step)).agg(*[F.sum(n).alias(n) for n in names])
    return wide.withColumn("counts", F.array(*names)).select("window", "counts")


def histogram_quantile(counts, q) -> Column:
    """Quantile from bucket counts, linear inside the bucket it falls in.

    A quantile beyond the last finite edge is reported as that edge.
    """
    counts = F.col(counts)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    want = total * F.lit(float(q))
    below = lambda i: F.aggregate(F.slice(counts, 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
    at = F.size(F.filter(F.sequence(F.lit(1), F.size(counts)), lambda i: below(i) < want))
    edges = F.array(*[F.lit(e) for e in LATENCY_BUCKETS])
    low = F.when(at == 0, F.lit(0.0)).otherwise(F.get(edges, at - 1))
    inner = low + (F.get(edges, at) - low) * (want - below(at)) / F.get(counts, at)
    return F.when(total == 0, F.lit(None)).when(at >= len(LATENCY_BUCKETS), F.lit(LATENCY_BUCKETS[-1])).otherwise(inner)


def latency_percentiles(log: DataFrame, length="5 minutes", step="1 minute") -> DataFrame:
    """p50, p95 and p99 (seconds) in sliding windows from the latency histogram."""
    wide = _latency_counts(log, length, step)
    return wide.select("window", *[histogram_quantile("counts", q).alias(n)
                                   for n, q in (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))])


def latency_alerts(log: DataFrame, limit=2.0) -> DataFrame:
    """p95 above two seconds at every evaluation of two minutes (three in a row)."""
    slow = latency_percentiles(log).filter(F.col("p95") > limit)
    return _held(slow.select("window"), "3 minutes", 3, "1 minute")


def gaps(log: DataFrame, seconds=60) -> DataFrame:
    """Stretches of more than ``seconds`` without any request (batch).

    Requests are reduced to first and last time per minute; only those rows are
    put in order.
    """
    per = log.groupBy(F.date_trunc("minute", "ts").alias("m")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    per = per.withColumn("down_from", F.lag("last").over(W.orderBy("m")))
    length = (micros("first") - micros("down_from")) / 1e6
    return (per.select("down_from", F.col("first").alias("down_to"), length.alias("seconds"))
            .filter(F.col("seconds") > seconds))


def down_since(log: DataFrame, gap="1 minute", by="path") -> DataFrame:
    """Streaming form: a row when a service has been silent for ``gap``."""
    sessions = log.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return sessions.select(by, F.col("session_window.end").alias("down_at"), "n")
