"""Prefix trie of rebuilt conversations by composable fingerprints.

A sequence of turns has the fingerprint ``sum(e[i] * B**(n-1-i))`` modulo 2**64 over the
hashes of its turns.  Fingerprints form a monoid with inverses: from the prefix products of
the stored conversations, that of any rebuilt one (a head of one conversation, then the rest
of another) follows by one product, without joining any text.  A row per rebuilt turn holds
the product, the reference's digest and running bytes; rows with equal depth and product are
one node.

*Exact.*  Every node checks 128 further bits of its members' stored last turn, and a parent's
product follows from the node's own, so equal nodes have equal turns all the way up.  If any
node fails, all products are made again with another multiplier.

*Subtrees without rounds.*  The smallest member owns a node.  A conversation owns the deepest
part of its path, so per conversation one depth tells the nodes it owns.  Saved tokens of a
subtree are the bytes of its rows that their conversation does not own; its leaves are the
members that own a leaf.  Both are sums over members, combined before the shuffle.

*Order.*  Turns are range partitioned; products of a conversation over several partitions are
continued from at most two totals per partition, which the driver adds up.  The digest of a
node's ends hashes the ordered identifiers in pieces; SHA-256 is sequential, so those of one node
stream through one task in pieces of some kilobytes.

Defined cases: rows with a null conv_id belong to no conversation; null turns come first; rows of
equal turn are ordered by role, then text, and equal rows stay separate turns; null role or text
is the empty string; a base conversation that does not exist gives an empty head; extra columns
are not returned; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.turns import in_order, keyed_turns, spanning
from lurewatch.session import materialize

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)   # odd, so they have inverses
RUN = 1_000                                                                # identifiers per piece of a digest
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2**64, by repeated squaring."""
    left, square, out = exponents.astype(np.uint64), np.uint64(base), np.ones(len(exponents), np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        square, left = np.multiply(square, square, dtype=np.uint64), left >> np.uint64(1)
    return out


def _numbers(batch, name, kind=np.uint64):
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(kind)


def _local_products(turns: DataFrame, base: int) -> DataFrame:
    """Prefix products per piece of a conversation: part, conv_id, pos, h, e, n_bytes, size, check1, check2."""
    inverse = pow(base, -1, 1 << 64)

    def run(batches):
        part, conv, pos, h, size = TaskContext.get().partitionId(), None, 0, np.uint64(0), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = _numbers(batch, "conv_id", np.int64)
            words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(n, 4)
            e, n_bytes = words[:, 0], _numbers(batch, "n_bytes", np.int64)
            new = np.concatenate([[of[0] != conv], of[1:] != of[:-1]])
            place = np.arange(n)
            start = np.maximum.accumulate(np.where(new, place, 0))
            up, scaled = _powers(base, n), e * _powers(inverse, n)
            total, sizes = np.cumsum(scaled), np.cumsum(n_bytes)
            product = (total - (total - scaled)[start]) * up
            here, running = place - start + 1, sizes - (sizes - n_bytes)[start]
            old = np.arange(int(np.argmax(new)) if new.any() else n)          # rows that go on from the batch before
            if len(old):
                product[old] += h * up[old] * np.uint64(base)
                here[old] += pos
                running[old] += size
            conv, pos, h, size = of[-1], int(here[-1]), product[-1], int(running[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(of), pa.array(here), pa.array(product.view(np.int64)), pa.array(e.view(np.int64)),
                 pa.array(n_bytes), pa.array(running), *[pa.array(words[:, k].view(np.int64)) for k in (1, 2)]],
                names=["part", "conv_id", "pos", "h", "e", "n_bytes", "size", "check1", "check2"])

    return turns.mapInArrow(run, "part int, conv_id long, pos long, h long, e long, n_bytes long, size long, check1 long, check2 long")


def stored_products(conversations: DataFrame, base: int) -> DataFrame:
    """Position, product and bytes so far of every stored turn, also where a conversation spans partitions."""
    turns = in_order(keyed_turns(conversations).filter("conv_id is not null"))
    content = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    local = materialize(_local_products(turns.select(
        "conv_id", F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), base), "products")
    pieces = local.join(F.broadcast(spanning(local)), "conv_id", "left_semi").groupBy("conv_id", "part").agg(
        F.max("pos").alias("pos"), F.max_by("h", "pos").alias("h"), F.max("size").alias("size"))
    carried, at = [], {}
    for r in pieces.orderBy("conv_id", "part").collect():          # at most two rows per partition
        pos, h, size = at.get(r.conv_id, (0, 0, 0))
        if pos:
            carried.append((r.conv_id, r.part, pos, h - (1 << 64) if h >> 63 else h, size))
        at = {r.conv_id: (pos + r.pos, (h * pow(base, r.pos, 1 << 64) + r.h) % (1 << 64), size + r.size)}
    before = conversations.sparkSession.createDataFrame(carried, "conv_id long, part int, pos0 long, h0 long, size0 long")

    def run(batches):
        for batch in batches:
            h = _numbers(batch, "h") + _numbers(batch, "h0") * power(base, _numbers(batch, "pos", np.int64))
            named = dict(zip(batch.schema.names, batch.columns)) | {"h": pa.array(h.view(np.int64))}
            yield pa.RecordBatch.from_arrays([named[c] for c in names], names=names)

    names = ["conv_id", "pos", "h", "e", "n_bytes", "size", "check1", "check2", "pos0", "size0"]
    joined = local.join(F.broadcast(before), ["conv_id", "part"], "left").fillna(0, ["pos0", "h0", "size0"])
    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in names)).select(
        "conv_id", (F.col("pos") + F.col("pos0")).alias("pos"), "h", "e", "n_bytes", (F.col("size") + F.col("size0")).alias("size"),
        "check1", "check2")


def _plans(stored: DataFrame, base_of, head_of, max_head: int) -> DataFrame:
    """Per conversation: its head's turns and what takes its own products over to the rebuilt ones."""
    turn = F.struct("pos", "h", "e", "n_bytes", "size", "check1", "check2")
    known = stored.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max("size").alias("all_bytes"), F.sort_array(
        F.collect_list(F.when(F.col("pos") <= max_head, turn))).alias("first"))       # bounded by max_head
    bases = known.select(F.col("conv_id").alias("base_id"), F.col("first").alias("base_first"))
    own = known.withColumn("skip", head_of(F.col("conv_id")).cast("int")).withColumn("base_id", base_of(F.col("conv_id")).cast("long"))
    head = F.slice(F.coalesce("base_first", F.slice("first", 1, 0)), F.lit(1), F.col("skip"))
    last, cut = F.get("head", F.size("head") - 1), F.get("first", F.col("skip") - 1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    plan = own.join(bases, "base_id", "left").withColumn("head", head).select(
        "conv_id", "head", F.col("skip").cast("long").alias("skip"), F.size("head").cast("long").alias("n_head"),
        zero(last["h"]).alias("head_h"), zero(last["size"]).alias("head_size"), zero(cut["h"]).alias("cut_h"), zero(cut["size"]).alias("cut_size"),
        F.greatest(F.col("n") - F.col("skip"), F.lit(0).cast("long")).alias("n_rest"), "all_bytes")
    return plan.withColumn("length", F.col("n_head") + F.col("n_rest")).withColumn(
        "total", F.col("head_size") + F.when(F.col("n_rest") > 0, F.col("all_bytes") - F.col("cut_size")).otherwise(0))


def _rebuilt(stored: DataFrame, plans: DataFrame, base: int) -> DataFrame:
    """One row per rebuilt conversation and depth, the root included."""
    facts = ["e", "n_bytes", "check1", "check2", "total", "length"]
    none = F.lit(0).cast("long")
    heads = plans.select("conv_id", "total", "length", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), F.col("t.h").alias("h"), none.alias("head_h"), none.alias("cut_h"), none.alias("moved"),
        F.col("t.size").alias("size"), *[F.col(f"t.{c}").alias(c) for c in facts[:4]], "total", "length")
    rests = stored.join(plans.filter("n_rest > 0").drop("head"), "conv_id").filter("pos > skip").select(
        "conv_id", (F.col("n_head") + F.col("pos") - F.col("skip")).alias("depth"), "h", "head_h", "cut_h", (F.col("pos") - F.col("skip")).alias("moved"),
        (F.col("head_size") + F.col("size") - F.col("cut_size")).alias("size"), *facts)
    inverse = np.uint64(pow(base, -1, 1 << 64))

    def run(batches):
        for batch in batches:
            node = _numbers(batch, "h") + (_numbers(batch, "head_h") - _numbers(batch, "cut_h")) * power(base, _numbers(batch, "moved", np.int64))
            parent = (node - _numbers(batch, "e")) * inverse
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("depth"), pa.array(node.view(np.int64)), pa.array(parent.view(np.int64)), batch.column("size"),
                 *[batch.column(c) for c in facts[1:]]], names=["conv_id", "depth", "node", "parent", "size", *facts[1:]])

    schema = ", ".join(f"{c} long" for c in ["conv_id", "depth", "node", "parent", "size", *facts[1:]])
    roots = plans.select("conv_id", *[none.alias(c) for c in ("depth", "node", "parent", "size", *facts[1:4])], "total", "length")
    return heads.union(rests).mapInArrow(run, schema).union(roots)


def _end_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ordered, comma-joined identifiers of the conversations that end in a node."""
    keys = ["depth", "node", "conv_id"]

    def runs(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            depth, node, ids = (_numbers(batch, c, np.int64) for c in keys)
            edge = np.flatnonzero((depth[1:] != depth[:-1]) | (node[1:] != node[:-1])) + 1
            starts = np.concatenate([np.arange(a, b, RUN) for a, b in zip([0, *edge], [*edge, len(ids)])]).astype(int) if len(ids) else []
            stops = [*starts[1:], len(ids)]
            text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(depth[starts] if len(ids) else [], pa.int64()), pa.array(node[starts] if len(ids) else [], pa.int64()),
                 pa.array([part] * len(text), pa.int64()), pa.array(range(k, k + len(text)), pa.int64()), pa.array(text, pa.string())],
                names=["depth", "node", "part", "run", "ids"])
            k += len(text)

    def hashed(batches):
        at, digest = None, None

        def out():
            return pa.RecordBatch.from_pydict({"depth": [at[0]], "node": [at[1]], "ends_sha256": [digest.hexdigest()]})
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids"))):
                if (depth, node) == at:
                    digest.update(b",")
                else:
                    if at:
                        yield out()
                    at, digest = (depth, node), hashlib.sha256()
                digest.update(ids.encode())
        if at:
            yield out()

    ordered = rows.filter("depth = length").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    pieces = ordered.mapInArrow(runs, "depth long, node long, part long, run long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "part", "run").mapInArrow(
        hashed, "depth long, node long, ends_sha256 string")


def _checked(conversations, base_of, head_of, max_head):
    """Rows and nodes, made with the first multiplier for which every node agrees with its stored turns."""
    for base in MULTIPLIERS:
        stored = materialize(stored_products(conversations, base), "stored")
        plans = materialize(_plans(stored, base_of, head_of, max_head), "plans")
        rows = materialize(_rebuilt(stored, plans, base), "rebuilt")
        checks = [f(c).alias(f"{f.__name__}_{c}") for c in ("check1", "check2", "parent") for f in (F.min, F.max)]
        nodes = materialize(rows.groupBy("depth", "node").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min("size").alias("size"), *checks), "nodes")
        if nodes.filter("min_check1 < max_check1 or min_check2 < max_check2 or min_parent < max_parent").isEmpty():
            return rows, nodes.withColumnRenamed("min_parent", "parent")
    raise ArithmeticError("fingerprints of different turn sequences collide under every multiplier")


def prefix_trie(conversations: DataFrame, base_of, head_of, max_head: int) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.

    Conversation c becomes the first ``head_of(c)`` turns (at most ``max_head``) of conversation
    ``base_of(c)`` and its own turns after as many; both are functions of a column.
    """
    rows, nodes = _checked(conversations, base_of, head_of, max_head)
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(
        F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, ["depth", "node"], "left").fillna(0, ["n_children"]).select(
        "depth", "node", "parent", "conv_id", "n_convs", "n_children", "n_bytes", "size"), "counted")
    owners = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", (F.col("size") - F.col("n_bytes")).alias("before"))).alias("own"),
                                          F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owners = materialize(owners, "owners")
    start, upto = F.coalesce("own.depth", F.col("length") + 1), F.coalesce("own.before", "total")
    sums = rows.join(owners, "conv_id", "left").select(
        "depth", "node", F.when(F.col("depth") < start, upto - F.col("size") + F.col("n_bytes")).otherwise(0).alias("spare"), "leaf").groupBy(
        "depth", "node").agg(F.sum("spare").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, ["depth", "parent"], "left").join(sums, ["depth", "node"]).join(
        _end_digests(rows), ["depth", "node"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir):
    """The trie of conversations rebuilt on the head of their group of five."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), lambda c: c - c % 5,
                       lambda c: F.crc32(c.cast("string").cast("binary")) % 9, 8)
