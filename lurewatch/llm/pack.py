"""Best-fit packing of token sequences by exact complements.

Lengths are at most ``capacity``, so the whole packing problem is the histogram
of piece lengths, a table of at most ``capacity`` rows whatever the corpus size.
The plan is made on that table: single, pair and triple length sums are looked
up for the gap of each length and combinations that fill it exactly are consumed
as often as their availability counts allow; what is left is placed best-fit.
A plan line says: pieces ``first <= rank < last`` of one length go, one each, to
sequences ``sequence + rank - first`` at ``offset``.  Pieces get their rank
within their length from salted groups, so a length that holds a third of all
pieces is ranked by many tasks.

Defined cases: a null or empty text is the single closing id; a document longer
than ``capacity`` is cut and only its last piece may be shorter; equal rows each
get their own place; an empty table gives an empty result; other columns are not
returned.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import chunks, keyed_text
from lurewatch.llm.vocab import vocabulary, word_ids
from lurewatch.session import materialize

CAPACITY, CLOSING_ID = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first long, last long, sequence long, offset long"


def token_pieces(docs: DataFrame, key="doc_id", text="text", vocab="word_bpe_49k.json",
                 capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text, each text closed by ``closing_id``."""
    def run(batches):
        table = word_ids("bpe", vocabulary(vocab))
        for part in chunks(batches):
            ids, sizes, *_ = table.of_texts(part.column("text"))
            ends = np.cumsum(sizes)
            rows = []
            for doc, end, size in zip(part.column("doc_id").to_pylist(), ends, sizes):
                closed = np.append(ids[end - size:end], closing_id).astype("<u4")
                for k, start in enumerate(range(0, len(closed), capacity)):
                    piece = closed[start:start + capacity]
                    rows.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes())))
            doc, k, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed_text(docs, key, text).mapInArrow(run, PIECES)


class _Plan:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        self.used = np.zeros(capacity + 1, np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        for length, n in counts.items():
            self.left[length] = n

    def place(self, length, times, sequence, offset):
        first = int(self.used[length])
        self.rows.append((int(length), first, first + int(times), int(sequence), int(offset)))
        self.used[length] += times
        self.left[length] -= times

    def consume(self, lengths):
        """As many sequences of these lengths as there are pieces for."""
        times = min(int(self.left[x]) // lengths.count(x) for x in set(lengths))
        offset = 0
        for x in lengths:
            self.place(x, times, self.sequences, offset)
            offset += x
        self.sequences += times

    def pair(self, gap, most):
        """Two available lengths with this sum, the larger first."""
        a = np.arange(gap // 2, 0, -1)
        b = gap - a
        ok = (b <= most) & (self.left[a] > 0) & (self.left[b] > (a == b))
        hit = np.flatnonzero(ok)
        return [int(b[hit[-1]]), int(a[hit[-1]])] if len(hit) else None

    def filling(self, length):
        """The lengths that close the gap beside ``length``: one, two or three."""
        gap = self.capacity - length
        spare = lambda x: self.left[x] - (x == length) > 0
        self.left[length] -= 1
        try:
            if gap <= length and self.left[gap] > 0:
                return [gap]
            found = self.pair(gap, length)
            if found:
                return found
            for c in np.flatnonzero(self.left[:min(gap, length + 1)])[::-1]:
                self.left[c] -= 1
                found = self.pair(gap - int(c), int(c))
                self.left[c] += 1
                if found:
                    return [int(c), *found]
            return None
        finally:
            self.left[length] += 1

    def exact(self):
        if self.left[self.capacity]:
            self.consume([self.capacity])
        for length in range(self.capacity - 1, 0, -1):
            while self.left[length] > 0:
                found = self.filling(length)
                if not found:
                    break
                self.consume([length, *found])

    def best_fit(self):
        """Longest first, each into the sequences with the smallest gap that takes it."""
        open_by_gap: dict[int, list[tuple[int, int]]] = {}   # gap -> [(first sequence, how many)]
        gaps: list[int] = []

        def reopen(gap, sequence, n):
            if gap and n:
                if gap not in open_by_gap:
                    open_by_gap[gap] = []
                    bisect.insort(gaps, gap)
                open_by_gap[gap].append((sequence, n))

        for length in range(self.capacity - 1, 0, -1):
            while self.left[length] > 0:
                n = int(self.left[length])
                k = bisect.bisect_left(gaps, length)
                if k < len(gaps):
                    gap = gaps[k]
                    sequence, bins = open_by_gap[gap].pop()
                    if not open_by_gap[gap]:
                        del open_by_gap[gap], gaps[k]
                else:
                    gap, sequence, bins = self.capacity, self.sequences, -(-n // (self.capacity // length))
                    self.sequences += bins
                each = gap // length
                full = min(bins, n // each)
                for j in range(each if full else 0):
                    self.place(length, full, sequence, self.capacity - gap + j * length)
                reopen(gap - each * length, sequence, full)
                if full < bins:
                    rest = int(min(self.left[length], each - 1))
                    for j in range(rest):
                        self.place(length, 1, sequence + full, self.capacity - gap + j * length)
                    reopen(gap - rest * length, sequence + full, 1)
                    reopen(gap, sequence + full + 1, bins - full - 1)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY):
    """Plan lines (length, first, last, sequence, offset) for a histogram of lengths."""
    plan = _Plan(counts, capacity)
    plan.exact()
    plan.best_fit()
    return plan.rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, ..., length of 1 to ``capacity``) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")     # read twice: histogram and placement
    # at most ``capacity`` rows reach the driver
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = packing_plan(counts, capacity)
    plan = spark.createDataFrame(rows, PLAN) if rows else spark.createDataFrame([], PLAN)
    salts = max(64, -(-max(counts.values(), default=0) // 100_000))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("__k", F.row_number().over(order) - 1).join(bases, ["length", "__salt"])
              .withColumn("__rank", F.col("__base") + F.col("__k")))
    # the plan has a few lines per length: bounded by the capacity, not by the corpus
    lines = F.broadcast(plan.withColumnRenamed("length", "__length"))
    inside = ((F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("first"))
              & (F.col("__rank") < F.col("last")))
    return ranked.join(lines, inside).select(
        *pieces.columns, (F.col("sequence") + F.col("__rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, key="doc_id", text="text", capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, key, text, capacity=capacity), capacity)


def op1_best_fit_packing(spark, sf_dir):
    """Every document's pieces with their sequence and place."""
    from lurewatch.llm.common import documents
    return pack_documents(documents(spark, sf_dir))
