"""Exact n-gram Jaccard join through a token-group matrix.

Documents link when 100 * |A n B| >= 80 * |A u B| over their sets of five-word
shingles.  The result is exact; the steps only avoid work.

1. Equal word sequences are one node.
2. In one global order (the hash) two linked sets share their first k common
   tokens inside short prefixes.  Prefix tokens go, packed, to the task of their
   hash bucket, which counts in how many nodes a token occurs.  A node with too
   few shared prefix tokens has no partner.  Usually most documents end here.
3. Similar nodes are put into groups: min-hash buckets elect the node that is most
   like the others, and members that pass the exact test join its group, one
   comparison per member and elected node instead of all pairs.  A second turn compares
   nodes of different groups that stand side by side in a min-hash bucket, so that a
   large set of near copies of one lost original comes together as well.
4. The token-group matrix: the union of the members' prefix tokens per group, kept
   as (token, group) incidences in hash buckets.  A query opens other groups only
   if enough of its own prefix tokens occur in their unions; members of one group
   need no further comparison, however many they are.
5. Among the nodes left, the rarest tokens are joined across groups and the pairs
   tested exactly.  Frequent tokens (a shared passage) come last in the order, and a
   pair meets only at a token with enough tokens after it on both sides: the first
   common token of a linked pair has at least the overlap that the pair needs.  Each
   posting brings the parity, per hash bit, of its node's tokens from there on; two parities
   differ in no more bits than those tokens differ, and before the first common token all
   differ, so a pair with too many such bits and earlier tokens is no link.

Groups and links give the components.  Broadcast data have a fixed size: a bitmap
of row keys and the most frequent tokens of step 5 (a matter of speed only).

Defined cases: null or empty texts and texts without words have an empty set and
link with nothing; fewer than five words are one shingle; equal rows and equal
keys are linked like other copies; a null key belongs to the component of its
text; extra columns are not returned; an empty table gives an empty result.
Identities and shingles are 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import chunks, keyed_text
from lurewatch.llm.components import components
from lurewatch.llm.shingles import MIX, mixed, overlap, text_shingles
from lurewatch.session import materialize

WIDTH, PERCENT = 5, 80
HASHES, ELECTED = 16, 3         # min-hashes per node, elected nodes a node is compared with
BITMAP_BITS = 1 << 24           # 2 MB
PARITY_WORDS = 4                # longs of parity bits per posting in step 5
FREQUENT = 1 << 18              # tokens whose frequency orders step 5
PREFIX_NODES = 500              # nodes whose postings step 5 makes at once
POSTINGS = 700_000              # aimed at per hash bucket
MULTIPLIERS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def least_overlap(n, percent=PERCENT):
    return -(-percent * n // 100)


def slack(n):
    """Common prefix tokens asked for beyond the first."""
    return n // 10


def prefix_size(n, percent=PERCENT):
    return n - least_overlap(n, percent) + 1 + slack(n)


def needed(n, percent=PERCENT):
    """Shared prefix tokens without which a node of n tokens has no partner.

    A partner has at least percent * n tokens, hence at least this slack.
    """
    return 1 + slack(least_overlap(n, percent))


def profiles(docs: DataFrame, width=WIDTH) -> DataFrame:
    """(doc_id, node, n): identity of the word sequence and set size of each row."""
    def run(batches):
        for part in chunks(batches):
            found = [(node, len(s)) for node, s in text_shingles(part.column("text"), width)]
            node, n = zip(*found)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(node, pa.int64()),
                                              pa.array(n, pa.int64())], names=["doc_id", "text_hash", "node", "n"])
    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, node long, n long")


class _Packer:
    """Collects (label, tokens) and hands out one row per hash bucket.

    A row has the distinct labels, and per token a 32-bit remainder of its hash
    and the place of its label.
    """
    SCHEMA = "bucket int, labels binary, rest binary, place binary"

    def __init__(self, buckets: int, limit=1_500_000, most_labels=60_000):
        self.buckets, self.limit, self.most_labels = buckets, limit, most_labels
        self.clear()

    def clear(self):
        self.labels, self.tokens, self.held = [], [], 0

    def add(self, label, tokens):
        self.labels.append(label)
        self.tokens.append(tokens)
        self.held += len(tokens)
        return self.held >= self.limit or len(self.labels) >= self.most_labels

    def rows(self):
        if not self.held:
            self.clear()
            return
        labels = np.array(self.labels, np.int64)
        owner = np.repeat(np.arange(len(labels)), [len(t) for t in self.tokens]).astype(np.uint16)
        h = np.concatenate(self.tokens) * MIX
        self.clear()
        bucket = ((h >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        rest = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)     # two tokens that agree here only add work
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        out = []
        for at in np.split(order, cuts):
            used, place = np.unique(owner[at], return_inverse=True)
            out.append((int(bucket[at[0]]), labels[used].tobytes(), rest[at].tobytes(), place.astype(np.uint16).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                         names=["bucket", "labels", "rest", "place"])


def _unpacked(table: pa.Table):
    """(label, rest) of all postings of a bucket."""
    labels, rest = [], []
    for a, b, c in zip(table["labels"], table["rest"], table["place"]):
        labels.append(np.frombuffer(a.as_buffer(), np.int64)[np.frombuffer(c.as_buffer(), np.uint16)])
        rest.append(np.frombuffer(b.as_buffer(), np.uint32))
    return np.concatenate(labels), np.concatenate(rest)


def _shared_per_label(table):
    """How many of its tokens each label shares with another label."""
    label, rest = _unpacked(table)
    order = np.lexsort((label, rest))
    label, rest = label[order], rest[order]
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (rest[1:] != rest[:-1])
    label, rest = label[new], rest[new]
    start = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
    n = np.diff(np.append(start, len(rest)))
    who, times = np.unique(label[np.repeat(n > 1, n)], return_counts=True)
    return pa.table({"node": pa.array(who, pa.int64()), "shared": pa.array(times.astype(np.int64))})


def shared_prefixes(docs: DataFrame, buckets: int, width=WIDTH, percent=PERCENT) -> DataFrame:
    """(node, shared): prefix tokens of a node that also are in another node's prefix."""
    def run(batches):
        packer = _Packer(buckets)
        for part in chunks(batches):
            for node, tokens in text_shingles(part.column("text"), width):
                if len(tokens) and packer.add(node, tokens[:prefix_size(len(tokens), percent)]):
                    yield from packer.rows()
        yield from packer.rows()

    return docs.mapInArrow(run, _Packer.SCHEMA).groupBy("bucket").applyInArrow(
        _shared_per_label, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of hashed keys, at most ``BITMAP_BITS`` / 64 rows to the driver."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS))
    rows = keys.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))")
                       .alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["mask"].to_numpy()
    return out


def token_sets(docs: DataFrame, chosen: DataFrame, width=WIDTH) -> DataFrame:
    """(node, n, mins, tokens) of the chosen (doc_id, node), each node once."""
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(chosen))

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))
            for part in chunks([batch]):
                rows = []
                for node, s in text_shingles(part.column("text"), width):
                    mins = [int((s * m).min().astype(np.int64)) for m in MULTIPLIERS] if len(s) else []
                    rows.append((node, len(s), mins, s.tobytes()))
                node, n, mins, tokens = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(node, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(mins, pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
                    names=["doc_id", "node", "n", "mins", "tokens"])

    rows = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)))
    found = rows.mapInArrow(run, "doc_id long, node long, n long, mins array<long>, tokens binary")
    same = (found.node == chosen.node) & found.doc_id.eqNullSafe(chosen.doc_id)
    return found.join(chosen, same, "left_semi").drop("doc_id").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent=PERCENT) -> DataFrame:
    """Those (a, b) whose sets pass the exact test.

    Sets grow with the texts, so they are shuffled, never broadcast.
    """
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")).hint("merge")
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")).hint("merge")

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = overlap(x, y)
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def elected_pairs(sets: DataFrame, percent=PERCENT) -> DataFrame:
    """(a, b): a node and up to ``ELECTED`` nodes elected in its min-hash buckets."""
    keys = materialize(sets.select("node", "n", F.posexplode("mins").alias("k", "min")), "mins")
    sizes = keys.groupBy("k", "min").agg(F.count("*").alias("size")).filter("size > 1")
    rows = keys.join(sizes, ["k", "min"])
    weight = rows.groupBy("node").agg(F.sum(F.log2("size")).alias("weight"))
    heads = rows.join(weight, "node").groupBy("k", "min").agg(
        F.max_by("node", F.struct("weight", "node")).alias("head"), F.max_by("n", F.struct("weight", "node")).alias("m"))
    met = rows.join(heads, ["k", "min"]).filter("head <> node").groupBy("node", "head", "n", "m").agg(F.count("*").alias("agree"))
    fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("agree") >= HASHES // 2)
    best = Window.partitionBy("node").orderBy(F.desc("agree"), "head")
    return met.filter(fits).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= ELECTED).select(
        F.col("node").alias("a"), F.col("head").alias("b"))


def neighbour_pairs(left: DataFrame, percent=PERCENT) -> DataFrame:
    """(a, b): nodes of different groups next to each other in the shuffled min-hash buckets."""
    keys = left.select("node", "group", "n", F.posexplode("mins").alias("k", "min"))
    order = Window.partitionBy("k", "min").orderBy(F.xxhash64("node", "k"), "node")
    before = keys.select("node", "group", "n", *[F.lag(c).over(order).alias(f"last_{c}") for c in ("node", "group", "n")])
    fits = (F.col("group") != F.col("last_group")) & (F.least("n", "last_n") * 100 >= F.greatest("n", "last_n") * percent)
    return before.filter(fits).select(F.least("node", "last_node").alias("a"), F.greatest("node", "last_node").alias("b")).distinct()


def across_groups(grouped: DataFrame, buckets: int, percent=PERCENT, **limits) -> DataFrame:
    """(node, shared): prefix tokens of a node that occur in the union of another group.

    ``grouped`` has node, group and tokens.  Each bucket keeps the incidences
    (token, group) once, so a group of thousands of near copies is one line per token.
    ``limits`` are the packer's.
    """
    def run(batches):
        packer, groups = _Packer(buckets, **limits), {}
        for batch in batches:
            for node, group, tokens in zip(batch.column("node").to_pylist(), batch.column("group").to_pylist(), batch.column("tokens")):
                t = np.frombuffer(tokens.as_buffer(), np.uint64)
                groups[node] = group        # before the packer hands out its rows, this node's among them
                if packer.add(node, t[:prefix_size(len(t), percent)]):
                    yield from _with_groups(packer, groups)
                    groups.clear()
        yield from _with_groups(packer, groups)

    def _with_groups(packer, groups):
        for batch in packer.rows():
            of = [np.array([groups[x] for x in np.frombuffer(b.as_buffer(), np.int64).tolist()], np.int64).tobytes()
                  for b in batch.column("labels")]
            yield batch.append_column("groups", pa.array(of, pa.binary()))

    def count(table):
        label, rest = _unpacked(table)
        group = np.concatenate([np.frombuffer(g.as_buffer(), np.int64)[np.frombuffer(p.as_buffer(), np.uint16)]
                                for g, p in zip(table["groups"], table["place"])])
        order = np.argsort(rest, kind="stable")
        label, rest, group = label[order], rest[order], group[order]
        start = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        several = np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)
        who, times = np.unique(label[np.repeat(several, np.diff(np.append(start, len(rest))))], return_counts=True)
        return pa.table({"node": pa.array(who, pa.int64()), "shared": pa.array(times.astype(np.int64))})

    return grouped.select("node", "group", "tokens").mapInArrow(run, _Packer.SCHEMA + ", groups binary").groupBy(
        "bucket").applyInArrow(count, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))


def parities(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``PARITY_WORDS`` longs for each place in ``first``, the beginning of ``tokens`` in order:
    per hash bit, whether an odd number of the tokens from that place on has it."""
    def words(t):
        bit = mixed(t.view(np.uint64)) % np.uint64(64 * PARITY_WORDS)
        out = np.zeros((len(t), PARITY_WORDS), np.uint64)
        out[np.arange(len(t)), bit >> np.uint64(6)] = np.uint64(1) << (bit & np.uint64(63))
        return out
    before = np.bitwise_xor.accumulate(np.concatenate([np.zeros((1, PARITY_WORDS), np.uint64), words(first[:-1])]))
    return (before ^ np.bitwise_xor.reduce(words(tokens))).view(np.int64)


def rare_pairs(left: DataFrame, percent=PERCENT) -> DataFrame:
    """Pairs of nodes of different groups that share one of their rarest tokens."""
    def tokens(batches):
        for batch in batches:
            for t in batch.column("tokens"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t.as_buffer(), np.int64))], names=["token"])

    counts = left.select("tokens").mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    counts = materialize(counts.withColumn("level", F.floor(F.log2("n") * 16)), "counts")
    levels = counts.groupBy("level").count().orderBy(F.desc("level")).toPandas()             # at most 16 * 64
    held = levels["level"][levels["count"].cumsum() <= FREQUENT]
    lowest = int(held.min()) if len(held) else 1 << 62
    top = counts.filter(F.col("level") >= lowest).select("token", "n").toPandas().sort_values("token")   # at most FREQUENT tokens
    shared = left.sparkSession.sparkContext.broadcast((top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    odd = [f"odd{k}" for k in range(PARITY_WORDS)]
    columns = ["token", "node", "group", "n", "position", *odd]

    def prefixes(batches):
        known, count = shared.value
        for batch in (b.slice(k, PREFIX_NODES) for b in batches for k in range(0, b.num_rows, PREFIX_NODES)):
            out = []
            for node, group, n, t in zip(*(batch.column(c).to_pylist() for c in ("node", "group", "n", "tokens"))):
                t = np.frombuffer(t, np.int64)
                at = np.minimum(np.searchsorted(known, t), max(len(known) - 1, 0))
                often = np.where(known[at] == t, count[at], 0) if len(known) else np.zeros(len(t), np.int64)
                keep = np.lexsort((t, often))[:n - least_overlap(n, percent) + 1]
                out.append((t[keep], node, group, n, np.arange(len(keep)), parities(t, t[keep])))
            if not out:
                continue
            sizes = [len(o[0]) for o in out]
            of = lambda k: np.concatenate([o[k] for o in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(of(0)), *[pa.array(np.repeat(np.array([o[k] for o in out], np.int64), sizes)) for k in (1, 2, 3)],
                 pa.array(of(4)), *[pa.array(c) for c in of(5).T.copy()]], names=columns)

    found = materialize(left.select("node", "group", "n", "tokens").mapInArrow(
        prefixes, ", ".join(f"{c} long" for c in columns)), "prefixes")
    spread = found.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("token")
    found = found.join(spread, "token")
    a, b = found.alias("x"), found.alias("y")
    fits = ((F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.group") != F.col("y.group"))
            & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
            & (F.least(F.col("x.n") - F.col("x.position"), F.col("y.n") - F.col("y.position")) * (100 + percent)
               >= (F.col("x.n") + F.col("y.n")) * percent)
            & (reduce(add, [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in odd],
                      F.col("x.position") + F.col("y.position")) * (100 + percent)
               <= (F.col("x.n") + F.col("y.n")) * (100 - percent)))
    return a.join(b, fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_components(docs: DataFrame, key="doc_id", text="text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, set, n_shingles, component_id) of every row.

    ``set`` numbers the components, component_id is the smallest key of a component.
    """
    rows = keyed_text(docs, key, text)
    seen = materialize(profiles(rows, width), "profiles")
    nodes = seen.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(64, total * 3 // 10 // POSTINGS)
    need = lambda n: F.expr(f"1 + (({percent} * {n} + 99) div 100) div 10")
    shared = shared_prefixes(rows, buckets, width, percent)
    # null keys: the smallest key of such a node is null, which the bitmap and the join keep
    chosen = materialize(nodes.join(shared, "node").filter(F.col("shared") >= need("n")).select("doc_id", "node"), "chosen")
    sets = materialize(token_sets(rows, chosen, width), "sets")
    links = materialize(verified(elected_pairs(sets, percent), sets, percent), "links")
    few = max(64, sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 3 // 10 // POSTINGS)

    def unsettled(links):
        groups = components(links)
        grouped = sets.hint("merge").join(groups, "node", "left").select(
            "node", "n", "mins", "tokens", F.coalesce("component", "node").alias("group"))
        open_ = across_groups(grouped, few, percent)
        return materialize(grouped.hint("merge").join(open_, "node").filter(F.col("shared") >= need("n")).drop("shared"), "left")

    left = unsettled(links)
    links = materialize(links.union(verified(neighbour_pairs(left, percent), left, percent)), "links")
    left = unsettled(links)
    more = verified(rare_pairs(left, percent), left, percent)
    linked = components(links.union(more))
    named = seen.join(linked, "node", "left").withColumn("__set", F.coalesce("component", "node"))
    smallest = named.filter("n > 0").groupBy("__set").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "__set", "left").select(
        "doc_id", "text_hash", F.col("__set").alias("set"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def _row_bit(key, text_hash):
    return F.pmod(F.xxhash64(key, text_hash), F.lit(BITMAP_BITS))


def without_near_copies(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key (a null key last);
    rows without words all stay."""
    found = near_components(docs, key, text).filter("n_shingles > 0")
    heads = found.groupBy("set").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("keyless"), "doc_id", "text_hash")).alias("head"))
    head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    others = materialize(found.join(heads, "set").groupBy("doc_id", "text_hash").agg(
        F.max(head).alias("head"), F.count("*").alias("copies")).filter("not head or copies > 1").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__other"), F.col("head").alias("__head")), "others")
    rows = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))).withColumn(
        "__bit", _row_bit(F.col(f"`{key}`").cast("long"), F.col("__hash")))
    # only rows named in others can change: a bitmap of fixed size spares the texts of the rest the shuffle
    bits = others.select(_row_bit(F.col("__id"), F.col("__other")).alias("bit")).select(
        F.shiftright("bit", 6).alias("__at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")).groupBy("__at").agg(
        F.bit_or("mask").alias("__mask"))
    bits = materialize(bits, "bits")
    marked = rows.join(F.broadcast(bits), F.shiftright("__bit", 6) == F.col("__at"), "left")
    hit = F.expr("shiftright(coalesce(__mask, 0L), cast(__bit & 63 as int)) & 1L") == 1
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__other"))
    open_ = materialize(marked.filter(hit).drop("__at", "__mask").join(others, same, "left").filter("__head is null or __head"), "open")
    once = open_.filter("__head").dropDuplicates([key, "__hash"])
    columns = [f"`{c}`" for c in docs.columns]
    return marked.filter(~hit).select(columns).union(open_.filter("__head is null").select(columns)).union(once.select(columns))


def op3_jaccard_groups(spark, sf_dir):
    """Set size and component of every document."""
    from lurewatch.llm.common import documents
    return near_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
