"""Stateful jobs against brute force, and streams against batch."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from checks import bind
from checks.monitor import run_stream
from lurewatch.streaming import monitor as M
from lurewatch.session import scratch_path
from lurewatch.streaming import state as S

T0 = datetime(2024, 1, 1, 0, 59, 0)
SCHEMA = "id long, user_id long, content string, source string, created_at timestamp"


def keep_in_order(rows, depth=10):
    saved, kept = {}, []
    for i, user, content, source, at in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        head = (content or "")[:100].rstrip(".")
        last = saved.setdefault(user, [])[-depth:]
        if not any(s == source and h and h == head and (at - t).total_seconds() < 60 for s, h, t in last):
            saved[user].append((source, head, at))
            kept.append(i)
    return sorted(kept)


def random_scans(n=1500, seed=0):
    rng = random.Random(seed)
    at, rows = T0, []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0.5, 1, 5, 20, 59, 60, 61, 200]) if i % 97 else 4000)
        user = 0 if rng.random() < 0.6 else rng.randint(1, 4)  # one hot user
        content = rng.choice(["", None, "a..", "a", "b" * 120, "b" * 120 + "c", *"defghijklmno"])
        rows.append((i, user, content, rng.choice(["web", "extension"]), at))
    return rows


def test_saved_scans_at_0_50_70(spark):
    rows = [(i, 1, "x", "web", T0 + timedelta(seconds=s)) for i, s in enumerate((0, 50, 70))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.id for r in S.suppress_duplicates(df).collect()) == [0, 2]


def test_suppression_against_brute_force(spark):
    rows = random_scans()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for depth in (10, 2):
        assert sorted(r.id for r in S.suppress_duplicates(df, depth=depth).collect()) == keep_in_order(rows, depth)


def test_a_hot_user_is_cut_into_sessions(spark):
    out = S.time_sessions(spark.createDataFrame(random_scans(), SCHEMA))
    rows = out.filter("user_id = 0").orderBy("created_at", "id").collect()
    start = None
    for prev, r in zip([None, *rows], rows):
        if prev is None or (r.created_at - prev.created_at).total_seconds() >= 60:
            start = r.created_at
        assert r.session == start
    assert len({r.session for r in rows}) > 10


def closing(rows, days=300):
    """The rows and one of another user that lies far behind them all."""
    return [*rows, (-1, -1, "end", "web", T0 + timedelta(days=days))]


def test_suppression_stream(spark):
    rows = random_scans(400, 3)
    out = run_stream(spark, spark.createDataFrame(closing(rows), SCHEMA).coalesce(1), S.suppress_duplicates_stream, "t-dupes")
    assert sorted(r.id for r in out.collect()) == keep_in_order(rows)


def test_suppression_stream_of_many_arrow_batches(spark):
    rows = random_scans(400, 4)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "40")
    try:
        shuffled = spark.createDataFrame(random.Random(1).sample(closing(rows), len(rows) + 1), SCHEMA).coalesce(1)
        out = run_stream(spark, shuffled, S.suppress_duplicates_stream, "t-dupes-40")
        assert sorted(r.id for r in out.collect()) == keep_in_order(rows)
    finally:
        spark.conf.set(size, before)


def run_parts(spark, parts, schema, job, label):
    """One micro-batch a part, in the order given; the result and the state rows left."""
    src, out, state = (scratch_path(spark, f"{label}-{x}") for x in ("in", "out", "state"))
    left = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = job(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(src))
        run = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
               .trigger(availableNow=True).start())
        run.awaitTermination()
        left = sum(op["numRowsTotal"] for op in run.lastProgress["stateOperators"])
    return spark.read.schema(stream.schema).parquet(out), left


def test_late_scans_over_micro_batches_and_no_state_left(spark):
    """Scans out of order over two micro-batches give the batch result, once each."""
    rows = random_scans(300, 5)
    late = {r[0] for r in random.Random(2).sample(rows, 120)}
    first = [r for r in rows if r[0] not in late]
    second = [r for r in rows if r[0] in late]
    job = lambda s: S.suppress_duplicates_stream(s, delay="100 days")
    out, _ = run_parts(spark, [first, second, closing([])], SCHEMA, job, "t-late-dupes")
    assert sorted(r.id for r in out.collect()) == keep_in_order(rows)
    ends = [closing([], 600)]
    _, after = run_parts(spark, [first, closing([]), *ends], SCHEMA, job, "t-left")
    assert after == run_parts(spark, [closing([]), *ends], SCHEMA, job, "t-none")[1]


def test_all_columns_return_as_they_went_in(spark):
    at = T0 + timedelta(microseconds=123457)
    rows = [(1, 1, 'a "quoted"\n\u00e9', None, at)]
    out = run_stream(spark, spark.createDataFrame(closing(rows), SCHEMA), S.suppress_duplicates_stream, "t-columns")
    assert [tuple(r) for r in out.collect()] == rows


def test_cache_misses_stream(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("abc"), T0 + timedelta(minutes=rng.randint(0, 9000))) for i in range(300)]
    cached, missed = {}, []
    for i, url, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if url not in cached or ts - cached[url] >= timedelta(hours=24):
            cached[url] = ts
            missed.append(i)
    job = lambda s: S.cache_misses_stream(s, delay="30 days")
    end = [(-1, "end", T0 + timedelta(days=n)) for n in (100, 200)]
    out, left = run_parts(spark, [rows[::2], rows[1::2], end[:1], end[1:]], "id long, url string, ts timestamp", job, "t-misses")
    assert sorted(r.id for r in out.collect() if r.id >= 0) == sorted(missed)
    assert left == run_parts(spark, [end[:1], end[1:]], "id long, url string, ts timestamp", job, "t-no-misses")[1]


def misses_in_order(rows, hours=24):
    cached, missed = {}, []
    for i, url, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if url not in cached or ts - cached[url] >= timedelta(hours=hours):
            cached[url] = ts
            missed.append(i)
    return sorted(missed)


class Calls:
    """A handle that keeps the state of one key and counts the calls."""

    def __init__(self):
        self.n, self.timers = 0, set()

    def getListState(self, name, schema):
        return State(self, [])

    def getMapState(self, name, key, value):
        return State(self, {})

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)


class State:
    def __init__(self, calls, held):
        self.calls, self.held = calls, held

    def __getattribute__(self, name):
        if name not in ("calls", "held"):
            self.calls.n += 1
        return super().__getattribute__(name)

    def exists(self):
        return bool(self.held)

    def get(self):
        return iter(self.held)

    def put(self, values):
        self.held = list(values)

    def clear(self):
        self.held = type(self.held)()

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


def frames(ats, size):
    rows = pd.DataFrame({"at": ats, "tie": range(len(ats)), "row": [str(i) for i in range(len(ats))]})
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def test_state_calls_do_not_grow_with_slots():
    """4,000 rows of a key in as many slots: a few calls a key, not some for each slot."""
    minute = 60_000_000
    ats = [i * minute for i in random.Random(8).sample(range(4000), 4000)]
    calls, processor = Calls(), S.MissedKeys(24)
    processor.init(calls)
    list(processor.handleInputRows(("k",), iter(frames(ats, 500)), None))
    assert calls.n < 20 and len(calls.timers) == 1


def test_many_rows_of_a_key_are_sorted_in_bounded_pieces():
    """Spilled rows come in order, in frames of bounded length, also where most lie in little time; no piece stays."""
    rng = random.Random(9)
    ats = [rng.choice([5, 1000 + rng.randrange(300), rng.randrange(10**9)]) for _ in range(6000)]
    for order in (ats, sorted(ats), sorted(ats, reverse=True), [5] * 700 + ats):
        calls, processor = Calls(), S.MissedKeys(24, held=300, ranges=8)
        processor.init(calls)
        parts = list(processor._in_order(iter(frames(order, 100))))
        got = [pair for p in parts for pair in zip(p["at"].tolist(), p["tie"].tolist())]
        assert got == sorted(zip(order, range(len(order))))
        assert all(len(p) <= 300 or p["at"].nunique() == 1 for p in parts)
        assert not processor.pieces.held


def test_cache_misses_stream_of_a_key_with_more_rows_than_are_held(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice("aab"), T0 + timedelta(minutes=rng.randint(0, 9000))) for i in range(900)]
    end = [(-1, "end", T0 + timedelta(days=100))]
    processor = S.MissedKeys(24, held=100, ranges=4)
    job = lambda s: S.in_event_order(s, processor, F.col("url"), "ts", "id", "10 minutes")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "40")
    try:
        out = run_stream(spark, spark.createDataFrame([*rows, *end], "id long, url string, ts timestamp").coalesce(1), job, "t-held")
        assert sorted(r.id for r in out.collect()) == misses_in_order(rows)
    finally:
        spark.conf.set(size, before)


def test_misses_without_a_ttl_are_all_requests():
    for ttl in (0, -1):
        processor = S.MissedKeys(ttl)
        assert processor.fold([], frames([1, 1, 2], 3)[0])[0] == [0, 1, 2]


def closed(batch, stream, key):
    """All closed windows of the stream are in the batch result, and most of it."""
    a, b = {tuple(r) for r in batch.collect()}, {tuple(r) for r in stream.collect()}
    assert b <= a
    last = max(r[key] for r in b)
    assert {r for r in a if r[key] <= last} == b


def test_monitoring_streams_equal_batch(spark, sf):
    log = bind.request_log(spark, "/root/testdata/sf0.01")
    jobs = {
        "rates": (lambda s: M.request_rates(M.with_lateness(s)).select("window_end", "status", "n"), 0),
        "errors": (lambda s: M.error_percent(M.with_lateness(s)).select("window_end", "n", "errors"), 0),
        "alerts": (lambda s: M.error_rate_alerts(M.with_lateness(s)), 0),
        "latency": (lambda s: M.latency_percentiles(M.with_lateness(s)).select(F.col("window.end").alias("e"), "p50", "p95", "p99"), 0),
    }
    for name, (job, key) in jobs.items():
        closed(job(log), run_stream(spark, log, job, f"t-{name}"), key)


def test_rows_late_within_the_watermark_count(spark):
    """Files arrive out of order; nothing inside the allowed delay is lost."""
    log = bind.request_log(spark, "/root/testdata/sf0.001")
    mixed = log.repartition(3, "request_id")
    job = lambda s: M.request_rates(M.with_lateness(s, "30 minutes")).select("window_end", "status", "n")
    closed(job(log), run_stream(spark, mixed, job, "t-late"), 0)


def test_down_since_stream(spark):
    rows = [("/a", T0 + timedelta(seconds=s)) for s in (0, 30, 200, 230, 900, 2000)]
    df = spark.createDataFrame(rows, "path string, ts timestamp").coalesce(1)
    out = run_stream(spark, df, lambda s: M.down_since(M.with_lateness(s)), "t-down")
    ends = sorted((r.down_at - T0).total_seconds() for r in out.collect())
    assert ends == [90.0, 290.0, 960.0]


def test_gaps(spark):
    rows = [(T0 + timedelta(seconds=s),) for s in (0, 59, 119, 180, 400)]
    got = sorted(r.seconds for r in M.gaps(spark.createDataFrame(rows, "ts timestamp")).collect())
    assert got == [61.0, 220.0]


def test_token_stream(spark):
    tokens = spark.createDataFrame([("t1", "verify", 7, T0 + timedelta(hours=1), False), ("t2", "verify", 8, T0, True)],
                                   "token string, purpose string, user_id long, expires_at timestamp, used boolean")
    attempts = spark.createDataFrame([("t1", "verify", T0), ("t1", "reset", T0), ("t1", "verify", T0 + timedelta(hours=2)), ("t2", "verify", T0)],
                                     "token string, purpose string, ts timestamp")
    out = run_stream(spark, attempts, lambda s: S.check_tokens(s, tokens), "t-tokens")
    assert sorted((r.purpose, r.valid, r.user_id or 0) for r in out.collect()) == [
        ("reset", False, 0), ("verify", False, 0), ("verify", False, 0), ("verify", True, 7)]
