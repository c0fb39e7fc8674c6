"""Removal of repeated byte strings by sampled suffixes and induced verdicts.

Every byte covered by a ``length``-byte string that also starts elsewhere goes.
Sorting all suffixes would need several times the corpus on disk, so only a sample
is carried: in each window of ``length`` bytes the half-length string with the
smallest hash is its sampled suffix.  Equal windows choose equal samples, and one
sample owns a run of neighbouring windows.  A run travels as a tuple: the hash of
the bytes that all its windows have in common (the common prefix of the group)
and the hash of the bytes that they cover together.

* covered bytes seen twice: every window of the run repeats;
* common bytes seen once: none does;
* otherwise the run is cut and judged again, first in blocks of ``BLOCK`` windows,
  then window by window: verdicts of larger runs are induced on smaller ones.

Tuples are packed into binary rows per hash bucket, sorted there, and spilled by
Spark's shuffle.  Tuples that meet in one task are combined before they are sent,
so a string in a third of all documents is a few tuples per task.  From the first
cut on, only texts with an undecided run are read, each text once however many
copies it has.

Defined cases: null text is empty; texts shorter than ``length`` keep everything;
matches never cross texts but may overlap and lie in one text; copies count as
elsewhere; very long texts are hashed in one piece; extra columns are not returned;
an empty table gives an empty result.  Strings are compared by 64-bit hashes of
common and of covered bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import chunks
from lurewatch.llm.near import BITMAP_BITS, key_bitmap
from lurewatch.llm.shingles import mixed
from lurewatch.session import materialize

LENGTH, BLOCK = 200, 10
POSTINGS = 400_000          # tuples aimed at per hash bucket
CHUNK, FLUSH = 1_500_000, 600_000
BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FULL, FINE, PROBE = 1, 2, 3     # all windows repeat; undecided; all repeat and needed to judge others


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hash of any slice of a byte array, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * _powers(BASE, n), out=self.sums[1:])
        self.back = _powers(INVERSE, n + 1)

    def of(self, start, stop):
        span = (self.sums[stop] - self.sums[start]) * self.back[start]
        return mixed(span + (np.asarray(stop) - np.asarray(start)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sampled_runs(hashes: Hashes, starts: np.ndarray, ends: np.ndarray, length: int):
    """(first window, last window, sampled position) of every run in the texts [start, end)."""
    half, n = length // 2, len(hashes.sums) - 1
    width = length - half + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - half + 1)
    key = hashes.of(at, at + half)
    best, span = at, 1
    while span * 2 <= width:
        a, b = best[:-span], best[span:]
        best, span = np.where(key[b] <= key[a], b, a), span * 2
    if span < width:
        a, b = best[:-(width - span)], best[width - span:]
        best = np.where(key[b] <= key[a], b, a)
    ok = np.zeros(n + 1, np.int64)
    fits = ends - starts >= length
    np.add.at(ok, starts[fits], 1)
    np.add.at(ok, ends[fits] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(ok)[:len(best)] > 0)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3
    chosen = best[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return valid[first], valid[last], chosen[first]


def cut_runs(first, last, sample, size):
    """Runs cut into blocks of ``size`` windows at fixed distances from the sample.

    (first, last, sample, first and last of the whole block); a run's end may cut a
    block short, but what all windows of the whole block have in common lies in it.
    """
    far, near = (sample - first) // size, (sample - last) // size      # distances shrink along the run
    n = far - near + 1
    owner = np.repeat(np.arange(len(first)), n)
    step = far[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    bottom, top = sample[owner] - step * size - size + 1, sample[owner] - step * size
    return np.maximum(first[owner], bottom), np.minimum(last[owner], top), sample[owner], bottom, top


class _Packer:
    """Tuples of runs, combined within the task, as one binary row per hash bucket.

    An owner is the place of the text's key; ``kind`` is 0 for one occurrence, 1 for
    the representative of several and 2 for an occurrence that is known to repeat.
    """
    FIELDS = (("common", np.uint64), ("covered", np.uint64), ("owner", np.uint16), ("first", np.uint32), ("size", np.uint8),
              ("reach", np.uint8), ("kind", np.uint8))
    SCHEMA = "bucket int, keys binary, " + ", ".join(f"{n} binary" for n, _ in FIELDS)

    def __init__(self, buckets):
        self.buckets = buckets
        self.keys, self.parts, self.held = [], [], 0

    def add(self, keys, columns):
        columns["owner"] = columns["owner"] + len(self.keys)
        self.keys += keys
        self.parts.append(columns)
        self.held += len(columns["first"])
        return self.held >= FLUSH

    def full(self, more):
        return len(self.keys) + more > 60_000

    def rows(self):
        if self.held:
            c = {n: np.concatenate([p[n] for p in self.parts]) for n, _ in self.FIELDS if n != "kind"}
            keys = np.array(self.keys, np.int64)
            order = np.lexsort((c["covered"], c["common"]))
            c = {n: v[order] for n, v in c.items()}
            new = np.ones(len(order), bool)
            new[1:] = (c["covered"][1:] != c["covered"][:-1]) | (c["common"][1:] != c["common"][:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(order)))
            kind = np.full(len(order), 2)
            kind[new] = times > 1
            c["kind"] = kind
            bucket = ((c["common"] >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
            at = np.argsort(bucket, kind="stable")
            out = []
            for part in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1):
                used, place = np.unique(c["owner"][part], return_inverse=True)
                row = {n: c[n][part].astype(t).tobytes() for n, t in self.FIELDS}
                row["owner"] = place.astype(np.uint16).tobytes()
                out.append((int(bucket[part[0]]), keys[used].tobytes(), *row.values()))
            names = ["bucket", "keys", *[n for n, _ in self.FIELDS]]
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(x, pa.binary()) for x in columns[1:]]],
                                             names=names)
        self.keys, self.parts, self.held = [], [], 0


VERDICT = "key long, runs array<struct<first:int,size:int,reach:int,mode:int>>"


def _judge(table):
    """Verdict of every run of a bucket, gathered per text."""
    c = {n: [] for n, _ in _Packer.FIELDS}
    keys = []
    for row in range(table.num_rows):
        own = np.frombuffer(table["keys"][row].as_buffer(), np.int64)
        for n, t in _Packer.FIELDS:
            c[n].append(np.frombuffer(table[n][row].as_buffer(), t))
        keys.append(own[c["owner"][-1]])
    c = {n: np.concatenate(v) for n, v in c.items()}
    key = np.concatenate(keys)
    order = np.lexsort((c["covered"], c["common"]))
    c, key = {n: v[order] for n, v in c.items()}, key[order]
    sent = c["kind"] != 2
    group = np.cumsum(np.concatenate([[True], c["common"][1:] != c["common"][:-1]])) - 1
    new = np.ones(len(key), bool)
    new[1:] = (c["covered"][1:] != c["covered"][:-1]) | (group[1:] != group[:-1])
    run = np.cumsum(new) - 1
    times = np.bincount(run, np.where(c["kind"] == 1, 2, sent))
    repeated = times[run] > 1
    several = np.bincount(group, np.where(new, 1, 0))[group] > 1
    undecided = np.bincount(group, ~repeated)[group] > 0
    mode = np.where(repeated, FULL, np.where(several, FINE, 0))
    mode[new & repeated & several & undecided] = PROBE
    keep = np.flatnonzero(mode)
    keep = keep[np.argsort(key[keep], kind="stable")]
    key = key[keep]
    cuts = np.flatnonzero(np.diff(key)) + 1
    offsets = np.concatenate([[0], cuts, [len(key)]]) if len(key) else np.zeros(1)
    struct = pa.StructArray.from_arrays([pa.array(c["first"][keep].astype(np.int32)), pa.array(c["size"][keep].astype(np.int32)),
                                         pa.array(c["reach"][keep].astype(np.int32)), pa.array(mode[keep].astype(np.int32))],
                                        names=["first", "size", "reach", "mode"])
    return pa.table({"key": pa.array(key[offsets[:-1].astype(np.int64)] if len(key) else np.zeros(0, np.int64)),
                     "runs": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), struct)})


def _judged(rows: DataFrame, tuples, buckets: int) -> DataFrame:
    return rows.mapInArrow(tuples, _Packer.SCHEMA).groupBy("bucket").applyInArrow(_judge, VERDICT)


def _joined_bytes(part):
    """(bytes of all texts as one array, start, end of each)."""
    raw = pc.fill_null(part.column("text").cast(pa.binary()), b"")
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    return data, ends - size, ends


def _tuple_columns(hashes, common, first, last, sample, starts, owner, length):
    # the distance to the sample tells apart equal bytes at another place of the run
    reach = (sample - first).astype(np.uint64)
    return {"common": common, "covered": hashes.of(first, last + length) ^ mixed(reach + np.uint64(1)), "owner": owner,
            "first": first - starts[owner], "size": last - first + 1, "reach": reach}


def first_verdicts(keyed: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """Verdicts on the runs of all texts of (key, text)."""
    half = length // 2

    def tuples(batches):
        packer = _Packer(buckets)
        for part in chunks(batches, limit=CHUNK):
            if packer.full(part.num_rows):
                yield from packer.rows()
            data, starts, ends = _joined_bytes(part)
            hashes = Hashes(data)
            first, last, sample = sampled_runs(hashes, starts, ends, length)
            owner = np.searchsorted(ends, first, side="right")
            common = hashes.of(sample, sample + half)      # the sampled suffix itself
            columns = _tuple_columns(hashes, common, first, last, sample, starts, owner, length)
            if packer.add(part.column("key").to_pylist(), columns):
                yield from packer.rows()
        yield from packer.rows()

    return _judged(keyed, tuples, buckets)


def next_verdicts(open_: DataFrame, buckets: int, size: int, length: int = LENGTH) -> DataFrame:
    """Verdicts on blocks of ``size`` windows of the undecided runs of (key, text, runs)."""
    def tuples(batches):
        packer = _Packer(buckets)
        for part in chunks(batches, limit=CHUNK):
            if packer.full(part.num_rows):
                yield from packer.rows()
            data, starts, ends = _joined_bytes(part)
            hashes = Hashes(data)
            lists = part.column("runs")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(lists)
            owner = np.repeat(np.arange(len(n)), n)
            field = lambda k: flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64)
            first = field("first") + starts[owner]
            low, high, sample, bottom, top = cut_runs(first, first + field("size") - 1, first + field("reach"), size)
            owner = np.searchsorted(ends, low, side="right")
            common = hashes.of(top, bottom + length) ^ mixed((sample - top).astype(np.uint64) + np.uint64(1))
            columns = _tuple_columns(hashes, common, low, high, sample, starts, owner, length)
            if packer.add(part.column("key").to_pylist(), columns):
                yield from packer.rows()
        yield from packer.rows()

    return _judged(open_, tuples, buckets)


def _open_runs(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("runs", F.filter("runs", lambda r: r.mode > FULL)).filter(F.size("runs") > 0).groupBy("key").agg(
        F.flatten(F.collect_list("runs")).alias("runs"))       # bounded by the text


def _texts_of(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the given keys, each once; a bitmap of fixed size spares the others the shuffle."""
    shared = keyed.sparkSession.sparkContext.broadcast(key_bitmap(keys.select(F.col("key").alias("doc_id"))))

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column("bit").to_numpy()
            yield batch.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1)).select(["key", "text"])

    rows = keyed.withColumn("bit", F.pmod(F.xxhash64("key"), F.lit(BITMAP_BITS)))
    return rows.mapInArrow(run, "key long, text string").dropDuplicates(["key"])


def _buckets(rows) -> int:
    return int(max(64, rows // POSTINGS))


def repeated_spans(docs: DataFrame, text="text", length: int = LENGTH) -> DataFrame:
    """(key, spans): maximal byte ranges to remove, per text with any; key is xxhash64 of the text."""
    if length < 2 * BLOCK or length > 500:
        raise ValueError("length must be from 20 to 500 bytes")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(body).alias("key"), body.alias("text"))
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    verdicts = materialize(first_verdicts(keyed, _buckets(total * 4 // length), length), "verdicts")
    opened = _open_runs(verdicts)
    texts = _texts_of(keyed, opened.select("key"))
    active = materialize(texts.join(opened, "key"), "active")
    n = active.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    second = materialize(next_verdicts(active, _buckets(n * 6), BLOCK, length), "verdicts")
    third_runs = _open_runs(second)
    third = next_verdicts(active.select("key", "text").join(third_runs, "key"), _buckets(n * 10), 1, length)
    found = verdicts.unionByName(second).unionByName(third)
    ranges = F.transform(F.filter("runs", lambda r: r.mode != FINE), lambda r: F.struct(
        r.first.alias("start"), (r.first + r["size"] - 1 + length).alias("end")))
    rows = found.select("key", ranges.alias("ranges")).filter(F.size("ranges") > 0).groupBy("key").agg(
        F.flatten(F.collect_list("ranges")).alias("ranges"))   # bounded by the text

    def merge(batches):
        for batch in batches:
            out = []
            for spans in batch.column("ranges"):
                start = spans.values.field("start").to_numpy().astype(np.int64)
                end = spans.values.field("end").to_numpy().astype(np.int64)
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(end[order])
                new = np.concatenate([[True], start[1:] > reach[:-1]])
                at = np.flatnonzero(new)
                out.append([{"start": int(a), "end": int(b)} for a, b in zip(start[at], reach[np.append(at[1:], len(start)) - 1])])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                                             names=["key", "spans"])

    return rows.mapInArrow(merge, "key long, spans array<struct<start:int,end:int>>")


def without_repeats(docs: DataFrame, key="doc_id", text="text", length: int = LENGTH) -> DataFrame:
    """(doc_id, text_key, n_bytes, spans, kept): the bytes that stay, null where all stay."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(body).alias("key"), body.alias("text"))
    spans = materialize(repeated_spans(docs, text, length), "spans")

    def cut(batches):
        for batch in batches:
            out = []
            for raw, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                at, kept = 0, []
                for r in ranges:
                    kept.append(raw[at:r["start"]])
                    at = r["end"]
                out.append(b"".join([*kept, raw[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("spans"), pa.array(out, pa.binary())],
                                             names=["key", "spans", "kept"])

    kept = _texts_of(keyed, spans.select("key")).join(spans, "key").mapInArrow(
        cut, "key long, spans array<struct<start:int,end:int>>, kept binary")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("key"),
                       F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("text_sha256")
                       ).join(kept, "key", "left")


def op4_repeated_bytes(spark, sf_dir):
    """Removed bytes and the digest of what stays, of every document."""
    from lurewatch.llm.common import documents
    docs = documents(spark, sf_dir)
    out = without_repeats(docs)
    kept = F.col("kept")
    return out.select("doc_id", "n_bytes", F.when(kept.isNull(), 0).otherwise(F.col("n_bytes") - F.octet_length(kept)).cast("long").alias("n_removed"),
                      F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
                      F.coalesce(F.sha2(kept, 256), F.col("text_sha256")).alias("kept_sha256"))
