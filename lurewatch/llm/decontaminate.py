"""Benchmark decontamination on canonical templates.

Numbers, units and names become typed placeholders, so a question asked again
with other values keeps its template.  Windows of ``WIDTH`` template words are
hash-joined with the windows of the benchmark; matches of one document and one
item are followed along a diagonal (same distance between the positions), and
the values in the slots are compared: one value of the item must stand against
one value of the document.  Where several do, the most frequent one is kept and
the windows that hold another are dropped.  A pair counts when the windows left
cover ``MIN_WORDS`` words or are half of the item's.

Template windows are made in Arrow batches, canonical forms once per distinct
word.  The benchmark's window hashes set bits of a bitmap of fixed size, and only
document windows whose bit is set leave the Python worker; the join itself is
Spark's, whatever the size of the benchmark.

Defined cases: null and empty texts match nothing; texts and items shorter than a
window have no window; equal rows are judged alike and the pair is reported once;
a window in a third of all documents is one row of the benchmark side; windows
with fewer than ``MIN_LITERALS`` plain words are not used; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import sealed
from lurewatch.llm.common import chunks, coded, keyed_text, words_of

WIDTH, MIN_WORDS, MIN_LITERALS = 8, 13, 4
BITS = 1 << 22            # size of the window bitmap: 512 kB, fixed
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
UNITS = set("""mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms ton tons lb
lbs pound pounds ounce ounces l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h
hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros degree degrees
celsius fahrenheit kmh mph watt watts volt volts joule joules newton newtons hz khz mhz""".split())
_NUMBER = re.compile(r"[$€£+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|%)?")
_NUMBER_WORDS = set("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split())
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
ENDS = (".", "!", "?", ":")

WINDOW = "hash long, position int, slots array<string>, places array<int>"


def canonical(word: str) -> tuple[str, str, bool, bool]:
    """(template inside a sentence, bare lower-cased word, is a sentence's end, begins with a capital)."""
    bare = _EDGE.sub("", word)
    low = bare.lower()
    if _NUMBER.fullmatch(bare) or low in _NUMBER_WORDS:
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif bare[:1].isupper() and not bare.isupper():
        kind = NAME
    else:
        kind = low
    return kind, low, word.rstrip("\"')]").endswith(ENDS), kind == NAME


def _hash(words) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def windows(texts: pa.Array, width: int, keep=None):
    """Per kept window: (text number, position, hash, template is slot, words).

    ``keep`` is a test on the array of hashes.
    """
    words, n_words = words_of(texts)
    if not len(words):
        return
    codes, distinct = coded(words)
    forms = [canonical(w) for w in distinct.to_pylist()]
    doc = np.repeat(np.arange(len(n_words)), n_words)
    ends = np.array([f[2] for f in forms])[codes]
    first = np.ones(len(codes), bool)                       # a sentence's first word is no name by its capital
    first[1:] = ends[:-1] | (doc[1:] != doc[:-1])
    name = np.array([f[3] for f in forms])[codes] & ~first
    low, inside = _hash([f[1] for f in forms]), _hash([f[0] for f in forms])
    lone = np.array([f[0] in (NUMBER, UNIT) for f in forms])
    slot = lone[codes] | name
    value = np.where(slot, inside[codes], low[codes])
    n = len(codes) - width + 1
    if n < 1:
        return
    mixed = np.zeros(n, np.uint64)
    literal = np.zeros(n, np.int64)
    for k in range(width):
        mixed = (mixed ^ value[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        literal += ~slot[k:k + n]
    ok = (doc[:n] == doc[width - 1:]) & (literal >= MIN_LITERALS)
    if keep is not None:
        ok &= keep(mixed)
    starts = np.concatenate([[0], np.cumsum(n_words)])
    for i in np.flatnonzero(ok):
        places = [k for k in range(width) if slot[i + k]]
        yield (int(doc[i]), int(i - starts[doc[i]]), int(mixed[i].astype(np.int64)),
               [forms[codes[i + k]][1] for k in places], places)


def _rows(part, found, columns):
    found = list(found)
    take = [f[0] for f in found]
    return pa.RecordBatch.from_arrays(
        [c.take(pa.array(take, pa.int64())) for c in columns]
        + [pa.array([f[2] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()),
           pa.array([f[3] for f in found], pa.list_(pa.string())), pa.array([f[4] for f in found], pa.list_(pa.int32()))],
        names=part + ["hash", "position", "slots", "places"])


def benchmark_windows(items: DataFrame, key="item_id", text="text", width: int = WIDTH) -> DataFrame:
    def run(batches):
        for part in chunks(batches):
            yield _rows(["doc_id"], windows(part.column("text"), width), [part.column("doc_id")])
    return keyed_text(items, key, text).mapInArrow(run, f"doc_id long, {WINDOW}").withColumnRenamed("doc_id", "item_id")


def bitmap(hashed: DataFrame, bits: int = BITS) -> np.ndarray:
    """One bit per hash residue; at most ``bits`` / 64 rows reach the driver."""
    bit = F.col("hash").bitwiseAND(bits - 1)
    rows = hashed.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(hash & 63 as int))").alias("mask")).groupBy(
        "word").agg(F.bit_or("mask").alias("mask")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r.word] = r.mask
    return out.view(np.uint64)


def document_windows(docs: DataFrame, marks: np.ndarray, key="doc_id", text="text", width: int = WIDTH) -> DataFrame:
    """Document windows whose bit is set, with a checksum and the length of the text as row identity."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)   # fixed size

    def run(batches):
        bits = shared.value
        size = np.uint64(len(bits) * 64 - 1)

        def keep(h):
            at = h & size
            return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

        for part in chunks(batches):
            texts = part.column("text")
            raw = [t.as_buffer() if t.is_valid else b"" for t in texts.cast(pa.binary())]
            yield _rows(["doc_id", "crc", "size"], windows(texts, width, keep),
                        [part.column("doc_id"), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                         pa.array([len(r) for r in raw], pa.int64())])

    return keyed_text(docs, key, text).mapInArrow(run, f"doc_id long, crc long, size long, {WINDOW}")


def lost_places(slots: str) -> Column:
    """Places whose value is not the one that stands most often against the item's value.

    On a tie the item's own value is kept, then the first one.
    """
    both = F.array_distinct(F.transform(slots, lambda s: F.struct(s.theirs.alias("theirs"), s.ours.alias("ours"))))

    def vote(b):
        at = F.transform(F.filter(slots, lambda s: (s.theirs == b.theirs) & (s.ours == b.ours)), lambda s: s.place)
        return F.struct(b.theirs.alias("theirs"), (-F.size(at)).alias("minus"), (b.theirs != b.ours).alias("changed"),
                        F.array_min(at).alias("first"), at.alias("at"))

    votes = F.array_sort(F.transform(both, vote))
    theirs = F.array_distinct(F.transform(slots, lambda s: s.theirs))
    # in order, the first of each value of the item is kept
    others = F.aggregate(votes, F.struct(F.lit(None).cast("string").alias("theirs"), F.array().cast("array<int>").alias("at")),
                         lambda a, v: F.struct(v.theirs.alias("theirs"), F.when(a.theirs == v.theirs, F.concat(a["at"], v["at"]))
                                               .otherwise(a["at"]).alias("at")), lambda a: a["at"])
    return F.when(F.size(both) > F.size(theirs), others).otherwise(F.array().cast("array<int>"))


def contaminated(docs: DataFrame, items: DataFrame, key="doc_id", text="text", item_key="item_id", item_text="text",
                 width: int = WIDTH, min_words: int = MIN_WORDS, min_share: float = 0.5) -> DataFrame:
    """Pairs (document, item) whose templates agree: windows, covered words, slots, verdict details."""
    bench = benchmark_windows(items, item_key, item_text, width)
    found = document_windows(docs, bitmap(bench), key, text, width)
    totals = bench.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    left = found.select("doc_id", "crc", "size", "hash", "position", "slots", "places").distinct()
    right = bench.select("item_id", "hash", F.col("position").alias("item_position"), F.col("slots").alias("item_slots"))
    hits = left.join(right, "hash").withColumn("diagonal", F.col("position") - F.col("item_position"))
    pairs = F.transform("places", lambda p, i: F.struct(
        (F.col("item_position") + p).alias("place"), F.get("item_slots", i).alias("theirs"), F.get("slots", i).alias("ours")))
    who = ["doc_id", "crc", "size", "item_id", "diagonal"]
    # one group is one passage of an item: its size is bounded by the item
    lines = hits.groupBy(*who).agg(
        F.array_sort(F.collect_set("item_position")).alias("at"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"))
    lines = sealed(lines, [*who, "at", "slots"], {"lost": lost_places("slots")})
    lines = sealed(lines, [*who, "slots"], {"at": F.filter("at", lambda p: ~F.exists("lost", lambda q: (q >= p) & (q < p + width)))})
    lines = sealed(lines, [*who, "at"], {"slots": F.filter("slots", lambda s: F.exists(
        "at", lambda p: (s.place >= p) & (s.place < p + width)))})
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda a, p: F.struct(
        (a.n + F.least(p - a["last"], F.lit(width))).alias("n"), p.alias("last")), lambda a: a.n)
    lines = lines.select(*who, (F.col("diagonal") + F.get("at", F.lit(0))).alias("first"), F.size("at").alias("n_windows"),
                         covered.alias("n_words"), F.size(F.array_distinct(F.transform("slots", lambda s: s.theirs))).alias("n_slots"),
                         F.size(F.filter("slots", lambda s: s.theirs != s.ours)).alias("n_changed"))
    enough = (F.col("n_words") >= min_words) | (F.col("n_windows") >= min_share * F.col("item_windows"))
    good = lines.join(totals, "item_id").filter(enough)
    best = F.max(F.struct("n_words", "n_windows", (-F.col("n_changed")).alias("same"), (-F.col("first")).alias("early"),
                          "n_slots")).alias("b")
    return good.groupBy("doc_id", "crc", "size", "item_id").agg(best).select(
        "doc_id", "crc", "size", "item_id", (-F.col("b.early")).alias("position"), F.col("b.n_windows").alias("n_windows"),
        F.col("b.n_words").alias("n_words"), F.col("b.n_slots").alias("n_slots"), (-F.col("b.same")).alias("n_changed"))


def without_contaminated(docs: DataFrame, items: DataFrame, key="doc_id", text="text") -> DataFrame:
    """``docs`` without the rows of contaminated pairs; rows with null keys are judged too."""
    bad = contaminated(docs, items, key, text).select(
        F.col("doc_id").alias("__id"), F.col("crc").alias("__crc"), F.col("size").alias("__size")).distinct()
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumns({"__c": F.crc32(body), "__s": F.octet_length(body).cast("long")})
    same = (F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__c") == F.col("__crc"))
            & (F.col("__s") == F.col("__size")))
    return rows.join(bad, same, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op6_benchmark_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item or part of one, with the item."""
    from lurewatch.llm.common import documents
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(documents(spark, sf_dir), items).drop("crc", "size")
