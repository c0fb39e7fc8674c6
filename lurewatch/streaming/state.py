"""Jobs with memory: duplicate scans, cached features, tokens."""

from __future__ import annotations

from collections import Counter, deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lurewatch.functions.calc import micros
from lurewatch.functions.urls import cache_key

GAP_SECONDS = 60
DEPTH = 10


def content_head(c="content"):
    """Leading 100 characters without trailing dots."""
    return F.rtrim(F.substring(F.coalesce(F.col(c), F.lit("")), 1, 100), F.lit("."))


# ------------------------------------------------------- duplicate scans: batch
def time_sessions(df: DataFrame, user="user_id", ts="created_at", key="id", gap=GAP_SECONDS) -> DataFrame:
    """Add ``session``: the time a user's run of scans less than ``gap`` apart began.

    Scans further apart cannot influence each other, so a session is the unit
    of work, not the user.  Time is cut into hours first: all windows run per
    user and hour, and only one row per user and hour is ordered per user.
    """
    hour = F.date_trunc("hour", F.col(ts))
    df = df.withColumn("_hour", hour)
    slots = df.groupBy(user, "_hour").agg(F.max(ts).alias("_last"))
    by_user = W.partitionBy(user).orderBy("_hour")
    slots = slots.select(user, "_hour", F.lag("_last").over(by_user).alias("_before"))
    inside = W.partitionBy(user, "_hour").orderBy(ts, key)
    rows = df.join(slots, [user, "_hour"]).withColumn(
        "_prev", F.coalesce(F.lag(ts).over(inside), F.col("_before")))
    rows = rows.withColumn("_start", F.when(
        F.col("_prev").isNull() | (micros(ts) - micros("_prev") >= gap * 1_000_000), F.col(ts)))
    carried = rows.groupBy(user, "_hour").agg(F.max("_start").alias("_s"))
    earlier = by_user.rowsBetween(W.unboundedPreceding, -1)
    carried = carried.select(user, "_hour", F.last("_s", ignorenulls=True).over(earlier).alias("_carry"))
    rows = rows.join(carried, [user, "_hour"])
    running = F.last("_start", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("session", F.coalesce(running, "_carry")).drop(
        "_hour", "_before", "_prev", "_start", "_carry")


def _keep(saved, source, head, at, gap):
    """Is a scan new, given the user's latest saved (source, head, time)?"""
    return not any(s == source and h and h == head and at - t < gap for s, h, t in saved)


def suppress_duplicates(scans: DataFrame, gap=GAP_SECONDS, depth=DEPTH) -> DataFrame:
    """Scans that get saved: no equal (source, content head) among the user's
    last ``depth`` saved scans within ``gap`` seconds.

    Sessions are spread over all tasks; inside a task rows stream by in time
    order with only ``depth`` saved scans in memory.
    """
    rows = time_sessions(scans, gap=gap).withColumns(
        {"_head": content_head(), "_at": micros("created_at")})
    rows = rows.repartition("user_id", "session").sortWithinPartitions("user_id", "session", "created_at", "id")
    names = scans.columns

    def fold(batches):
        current, saved = None, deque(maxlen=depth)
        for pdf in batches:
            mask = []
            for user, session, source, head, at in zip(
                    pdf["user_id"], pdf["session"], pdf["source"], pdf["_head"], pdf["_at"]):
                if (user, session) != current:
                    current, saved = (user, session), deque(maxlen=depth)
                new = _keep(saved, source, head, at, gap * 1_000_000)
                if new:
                    saved.append((source, head, at))
                mask.append(new)
            yield pdf.loc[mask, names]

    return rows.mapInPandas(fold, scans.schema)


# ------------------------------------------------------ streams in event order
class InEventOrder(StatefulProcessor):
    """The rows of a key, folded in the order of (at, tie).

    Input columns: ``at`` (microseconds), ``tie``, ``row`` (JSON) and those of
    ``carried``; a micro-batch brings the rows of the slots that the watermark
    has passed, so all its rows are later than those of earlier micro-batches.
    They are sorted and folded at once; beyond ``held`` rows of a key they are
    first dealt into ranges of time in the state, so a task holds ``held`` rows
    and one Arrow batch (or the rows of one time), never a whole key.  The state
    is called per key and per piece of many rows, not per row or slot.
    ``memory`` is what ``fold`` knows of earlier rows; entries that can no
    longer matter are dropped by a timer, so an idle key leaves no state.
    """

    carried: tuple = ()
    memory_schema: str = ""

    def __init__(self, slot_seconds=10, held=200_000, ranges=64):
        self.slot, self.held, self.ranges = int(slot_seconds * 1_000_000), held, ranges

    def init(self, handle):
        self.handle = handle
        self.memory = handle.getListState("memory", self.memory_schema)
        self.pieces = handle.getMapState("pieces", "range string, piece long", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        memory = [tuple(r) for r in self.memory.get()] if self.memory.exists() else []
        names = ["at", "tie", "row", *self.carried]
        for part in self._in_order(pdf[names] for pdf in rows):
            kept, memory = self.fold(memory, part)
            if len(kept):
                yield pd.DataFrame({"row": part["row"].to_numpy()[kept]}, dtype=object)
        self._remember(memory)

    def _in_order(self, parts, name=""):
        """The rows as sorted frames, each later than the one before."""
        held, n, limit, borders, dealt = [], 0, self.held, None, Counter()
        for pdf in parts:
            held.append(pdf)
            n += len(pdf)
            if n > limit:
                pdf = pd.concat(held, ignore_index=True)
                borders = self._borders(pdf) if borders is None else borders
                if borders is None:  # one time only so far
                    held, limit = [pdf], 2 * n
                else:
                    self._deal(pdf, borders, name, dealt)
                    held, n, limit = [], 0, self.held
        if n:
            pdf, held = pd.concat(held, ignore_index=True), None
            borders = self._borders(pdf) if borders is None and n > self.held else borders
            if borders is None:
                yield pdf.iloc[np.lexsort((pdf["tie"], pdf["at"]))]
                return
            self._deal(pdf, borders, name, dealt)
        pdf = None
        for i in sorted(dealt):
            child = f"{name}/{i}"
            yield from self._in_order((self._taken(child, j) for j in range(dealt[i])), child)

    def _borders(self, pdf):
        """First times of the ranges after the first one; None if all rows have one time."""
        at = np.sort(pdf["at"].to_numpy())
        if at[0] == at[-1]:
            return None
        borders = np.unique(at[np.arange(1, self.ranges) * len(at) // self.ranges])
        borders = borders[borders > at[0]]
        return borders if len(borders) else np.array([at[0] + 1])

    def _deal(self, pdf, borders, name, dealt):
        for i, part in pdf.groupby(np.searchsorted(borders, pdf["at"].to_numpy(), side="right")):
            table = pa.Table.from_pandas(part, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.pieces.updateValue((f"{name}/{i}", dealt[i]), (sink.getvalue().to_pybytes(),))
            dealt[i] += 1

    def _taken(self, name, piece):
        (data,) = self.pieces.getValue((name, piece))
        self.pieces.removeKey((name, piece))
        return pa.ipc.open_stream(bytes(data)).read_pandas()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        memory = [tuple(r) for r in self.memory.get()] if self.memory.exists() else []
        self._remember([m for m in memory if self.expires(m) > end])
        return iter(())

    def _remember(self, memory):
        if memory:
            self.memory.put(memory)
            # on a slot's end: all rows before it are folded when the timer fires
            self.handle.registerTimer(-(-self.expires(memory[-1]) // self.slot) * self.slot // 1000)
        else:
            self.memory.clear()

    def fold(self, memory, rows):
        """Positions of the sorted rows that are given out, and the memory after them."""
        raise NotImplementedError

    def expires(self, entry):
        """Time from which a memory entry no longer matters."""
        raise NotImplementedError

    def close(self):
        pass


JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def in_event_order(rows: DataFrame, processor: InEventOrder, by, ts, tie, delay, **carried) -> DataFrame:
    """Run a processor per key on a stream; the result has the columns of ``rows``.

    Rows wait in an aggregation by key and slot of event time until the
    watermark has passed the slot.  Rows later than ``delay`` behind the newest
    time are dropped if their slot is closed (watermark), rows younger than that
    are given out once the watermark passes their slot.  Rows without a time or
    key take no part.  Needs the RocksDB state store.
    """
    known = rows.withWatermark(ts, delay).filter(F.col(ts).isNotNull()).withColumn("_key", by)
    slots = known.filter(F.col("_key").isNotNull()).groupBy("_key", F.window(ts, f"{processor.slot} microseconds")).agg(
        F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    closed = slots.select("_key", F.window_time("window").alias("_closed"), F.explode("_rows").alias("_row"))
    packed = closed.select("_key", "_closed", "_row.*").select(
        "_key", "_closed", micros(ts).alias("at"), F.coalesce(F.col(tie), F.lit(0)).cast("long").alias("tie"),
        F.to_json(F.struct(*rows.columns), JSON_TIME).alias("row"), *(c.cast("string").alias(n) for n, c in carried.items()))
    kept = packed.groupBy("_key").transformWithStateInPandas(
        processor, outputStructType="row string", outputMode="Append", timeMode="EventTime")
    return kept.select(F.from_json("row", rows.schema, JSON_TIME).alias("r")).select("r.*")


# ------------------------------------------------------ duplicate scans: stream
class KeepNewScans(InEventOrder):
    """Memory: the user's last saved scans."""

    carried = ("source", "head")
    memory_schema = "source string, head string, at long"

    def __init__(self, gap=GAP_SECONDS, depth=DEPTH, slot_seconds=10, **limits):
        super().__init__(slot_seconds, **limits)
        self.gap, self.depth = gap * 1_000_000, depth

    def fold(self, memory, rows):
        saved, kept = deque(memory, maxlen=self.depth), []
        texts = rows[["source", "head"]].astype(object)
        texts = texts.where(texts.notna(), None)
        for i, (at, source, head) in enumerate(zip(rows["at"].tolist(), texts["source"], texts["head"])):
            if _keep(saved, source, head, at, self.gap):
                saved.append((source, head, at))
                kept.append(i)
        return kept, [s for s in saved if self.expires(s) > at]

    def expires(self, entry):
        return entry[2] + self.gap


def suppress_duplicates_stream(scans: DataFrame, gap=GAP_SECONDS, depth=DEPTH, delay="10 minutes") -> DataFrame:
    """Streaming form of ``suppress_duplicates``: the same scans, in time order,
    also when a user's scans arrive mixed over several micro-batches."""
    return in_event_order(scans, KeepNewScans(gap, depth), F.col("user_id"), "created_at", "id", delay,
                          source=F.col("source"), head=content_head())


# ------------------------------------------------------------ caches and tokens
class MissedKeys(InEventOrder):
    """Memory: the time a key was last cached."""

    memory_schema = "at long"

    def __init__(self, ttl_hours=24, slot_seconds=60, **limits):
        super().__init__(slot_seconds, **limits)
        self.ttl = ttl_hours * 3_600_000_000

    def fold(self, memory, rows):
        kept, at = [], rows["at"].to_numpy()
        i = np.searchsorted(at, self.expires(memory[0])) if memory else 0
        while i < len(at):
            kept.append(i)
            memory = [(int(at[i]),)]
            i = max(i + 1, np.searchsorted(at, self.expires(memory[0])))
        return kept, memory

    def expires(self, entry):
        return entry[0] + self.ttl


def cache_misses_stream(requests: DataFrame, ttl_hours=24, c="url", ts="ts", tie="id", delay="10 minutes") -> DataFrame:
    """Requests on a stream that find no cached row younger than the TTL.

    A miss caches its key at the time of the request; the entry leaves the
    state when the watermark passes its end.
    """
    return in_event_order(requests, MissedKeys(ttl_hours), cache_key(c), ts, tie, delay)


def stale_keys(requests: DataFrame, store: DataFrame, now, ttl_hours=24, c="url") -> DataFrame:
    """Requested URLs without a cached feature row younger than the TTL.

    ``store``: cache_key, cached_at.
    """
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    fresh = store.filter(F.col("cached_at") > now - F.make_dt_interval(hours=F.lit(ttl_hours)))
    keyed = requests.select(c).distinct().withColumn("cache_key", cache_key(c))
    return keyed.join(fresh.select("cache_key"), "cache_key", "left_anti")


def check_tokens(attempts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Attempts (token, purpose, ts) with the user of a valid token.

    ``attempts`` may be a stream; a token is valid if unused, of the same
    purpose and not expired at the time of the attempt.
    """
    known = tokens.filter(~F.col("used")).select("token", "purpose", "user_id", "expires_at")
    joined = attempts.join(known, ["token", "purpose"], "left")
    ok = F.coalesce(F.col("expires_at") >= F.col("ts"), F.lit(False))
    return joined.select(*attempts.columns, ok.alias("valid"), F.when(ok, F.col("user_id")).alias("user_id"))
