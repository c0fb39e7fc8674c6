"""Repeated paragraphs by MinHash banding, exact tests and components.

Units are paragraphs and pieces.  Pieces find a passage inside a longer line or wrapped into
short ones: boundaries stand at words whose hash, with the next word's, is the least of
``RADIUS`` words to both sides, wherever they occur; a piece reaches from ``RADIUS`` words before a boundary to
as many after the next, at least ``3 * RADIUS + 1`` words.  An edit leaves the pieces next to it as they are,
so pieces are compared as whole word sequences and count where they occur in several documents.

Paragraphs are lines of at least ``MIN_WORDS`` words.  Equal word sequences are one
node.  Signatures are banded; the number of bands is tuned so that a pair at the
threshold collides with probability ``RECALL`` or more.  Band keys travel packed, in
hash buckets.  First every band key proposes two comparisons per node, with the
smallest node of the key and with its neighbour; pairs that pass the exact Jaccard test make groups.  Then
nodes that share a band key with another group are open: they are joined on the
rarest shingles of their sets, by which every colliding pair that links also meets,
while thousands of paragraphs just below the threshold, which collide in the bands,
mostly do not.  A thousand near copies of one paragraph, one group by then, need no
comparison of all pairs.  The links' components are the classes of paragraphs; the
first occurrence of a class (by key, then position) stays.

Defined cases: null and empty texts have no units; shorter lines are never
removed; one document may hold several copies, of which all but the first go; rows
with equal keys and equal paragraphs count once; a null key comes first; extra
columns are not returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import chunks, coded, gather_runs, keyed_text, words_of
from lurewatch.llm.components import components
from lurewatch.llm.near import BITMAP_BITS, PERCENT, POSTINGS, _Packer, _unpacked, rare_pairs, verified
from lurewatch.llm.shingles import MIX, mixed
from lurewatch.session import materialize

MIN_WORDS, WIDTH, ROWS, RECALL = 20, 5, 3, 0.999
RADIUS = 6
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def tuned_bands(threshold: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """Fewest bands of ``rows`` hashes with which a pair at the threshold collides surely enough."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))


def _paragraphs(part, min_words):
    """(row number, place in the text, word hashes, words per paragraph, start in the hashes) of long lines."""
    lines = pc.split_pattern(part.column("text"), "\n")
    flat, row = pc.list_flatten(lines), pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    words, n = words_of(pc.ascii_lower(flat))
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none, none
    codes, distinct = coded(words)
    h = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[codes]
    long_ = np.flatnonzero(n >= min_words)
    start = np.cumsum(n) - n
    return row[long_], place[long_], h, n[long_], start[long_]


def _nodes_and_grams(h, n, start):
    """(identity of each paragraph, its shingles one after the other, shingles per paragraph)."""
    grams = mixed(h)
    for k in range(1, WIDTH):
        grams[:-k] = mixed(grams[:-k] * MIX + h[k:])
    at = gather_runs(start, n)
    place = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    first = np.cumsum(n) - n
    node = mixed(np.add.reduceat(mixed(h[at] + place * MIX), first) + n.astype(np.uint64))
    count = n - WIDTH + 1
    return node.view(np.int64), grams[gather_runs(start, count)], count


def occurrences(rows: DataFrame, min_words=MIN_WORDS) -> DataFrame:
    """(doc_id, paragraph, n_words, node) of every long line of (doc_id, text)."""
    def run(batches):
        for part in chunks(batches):
            row, place, h, n, start = _paragraphs(part, min_words)
            node = _nodes_and_grams(h, n, start)[0] if len(n) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(n), pa.array(node)],
                names=["doc_id", "paragraph", "n_words", "node"])
    return rows.mapInArrow(run, "doc_id long, paragraph int, n_words long, node long")


def _band_keys(h, n, start, bands, rows):
    """(node, band keys) per paragraph."""
    node, grams, count = _nodes_and_grams(h, n, start)
    first = np.cumsum(count) - count
    multipliers = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    keys = np.empty((len(n), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(n), b + 1, np.uint64)
        for m in multipliers[b * rows:(b + 1) * rows]:
            key = mixed(key * MIX + np.minimum.reduceat(grams * m, first))
        keys[:, b] = key
    return node, keys


def _star(table):
    """(a, b): each node of a band key with the smallest node and with the one before it.

    Identities are hashes, so the node before is a random one of the key.
    """
    label, rest = _unpacked(table)
    order = np.lexsort((label, rest))
    label, rest = label[order], rest[order]
    start = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
    head = np.repeat(label[start], np.diff(np.append(start, len(rest))))
    before = np.where(label == head, head, np.concatenate([head[:1], label[:-1]]))
    pairs = np.concatenate([np.stack([label, head])[:, label != head], np.stack([label, before])[:, label != before]], axis=1)
    pairs = np.unique(pairs, axis=1)
    return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})


def _across(table):
    """Nodes that share a band key with a node of another group."""
    label, rest = _unpacked(table)
    group = np.concatenate([np.frombuffer(g.as_buffer(), np.int64)[np.frombuffer(p.as_buffer(), np.uint16)]
                            for g, p in zip(table["groups"], table["place"])])
    order = np.argsort(rest, kind="stable")
    label, rest, group = label[order], rest[order], group[order]
    start = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
    several = np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)
    open_ = np.unique(label[np.repeat(several, np.diff(np.append(start, len(rest))))])
    return pa.table({"node": pa.array(open_, pa.int64())})


def band_pairs(rows: DataFrame, buckets, bands, rows_per_band=ROWS, min_words=MIN_WORDS) -> DataFrame:
    def run(batches):
        packer = _Packer(buckets)
        for part in chunks(batches):
            _, _, h, n, start = _paragraphs(part, min_words)
            if len(n):
                for node, keys in zip(*_band_keys(h, n, start, bands, rows_per_band)):
                    if packer.add(int(node), keys):
                        yield from packer.rows()
        yield from packer.rows()
    return rows.mapInArrow(run, _Packer.SCHEMA).groupBy("bucket").applyInArrow(_star, "a long, b long").distinct()


def paragraph_sets(rows: DataFrame, wanted: DataFrame, bands, rows_per_band=ROWS, min_words=MIN_WORDS) -> DataFrame:
    """(node, tokens, keys) of the wanted nodes, each once; a bitmap of fixed size picks them."""
    bit = F.pmod(F.col("node"), F.lit(BITMAP_BITS))
    found = wanted.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(node, 64) as int))").alias(
        "mask")).groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    bits[found["at"].to_numpy()] = found["mask"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits = shared.value
        for part in chunks(batches):
            _, _, h, n, start = _paragraphs(part, min_words)
            if not len(n):
                continue
            node = _nodes_and_grams(h, n, start)[0]
            at = node % BITMAP_BITS
            keep = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
            if not len(keep):
                continue
            node, keys = _band_keys(h, n[keep], start[keep], bands, rows_per_band)
            _, grams, count = _nodes_and_grams(h, n[keep], start[keep])
            ends = np.cumsum(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array([np.unique(grams[e - c:e]).tobytes() for e, c in zip(ends, count)], pa.binary()),
                 pa.array([k.tobytes() for k in keys], pa.binary())], names=["node", "tokens", "keys"])

    return rows.mapInArrow(run, "node long, tokens binary, keys binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def open_nodes(grouped: DataFrame, buckets) -> DataFrame:
    """Nodes with a band key in common with another group, from (node, group, keys)."""
    def run(batches):
        packer, groups = _Packer(buckets), {}

        def out():
            for batch in packer.rows():
                of = [np.array([groups[x] for x in np.frombuffer(b.as_buffer(), np.int64).tolist()], np.int64).tobytes()
                      for b in batch.column("labels")]
                yield batch.append_column("groups", pa.array(of, pa.binary()))
            groups.clear()

        for batch in batches:
            for node, group, keys in zip(batch.column("node").to_pylist(), batch.column("group").to_pylist(), batch.column("keys")):
                groups[node] = group
                if packer.add(node, np.frombuffer(keys.as_buffer(), np.uint64)):
                    yield from out()
        yield from out()

    return grouped.select("node", "group", "keys").mapInArrow(run, _Packer.SCHEMA + ", groups binary").groupBy(
        "bucket").applyInArrow(_across, "node long").distinct()


def repeated_paragraphs(docs: DataFrame, key="doc_id", text="text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per paragraph of a class with several: doc_id, paragraph, n_words, the kept one, removed."""
    if min_words < WIDTH:
        raise ValueError(f"a paragraph needs {WIDTH} words")
    rows = keyed_text(docs, key, text)
    bands = tuned_bands(percent / 100)
    seen = materialize(occurrences(rows, min_words), "paragraphs")
    buckets = max(64, seen.count() * bands // POSTINGS)
    proposed = materialize(band_pairs(rows, buckets, bands, min_words=min_words), "proposed")
    wanted = proposed.select(F.col("a").alias("node")).union(proposed.select("b")).distinct()
    sets = materialize(paragraph_sets(rows, wanted, bands, min_words=min_words), "sets")
    links = materialize(verified(proposed, sets, percent), "links")
    groups = components(links)
    grouped = sets.join(groups, "node", "left").select(
        "node", (F.length("tokens") / 8).cast("long").alias("n"), "tokens", "keys", F.coalesce("component", "node").alias("group"))
    left = materialize(grouped.join(open_nodes(grouped, max(64, buckets // 8)), "node", "left_semi").drop("keys"), "open")
    more = verified(rare_pairs(left, percent), left, percent)
    classes = components(links.union(more))
    named = seen.distinct().join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    heads = named.groupBy("class").agg(F.min(F.struct("doc_id", "paragraph")).alias("kept"), F.count("*").alias("class_size"),
                                       F.countDistinct("doc_id").alias("class_documents")).filter("class_size > 1")
    here = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("paragraph") == F.col("kept.paragraph"))
    return named.join(heads, "class").select(
        "doc_id", "paragraph", "n_words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.paragraph").alias("kept_paragraph"),
        "class_size", (~here).alias("removed"))


def without_repeated_paragraphs(docs: DataFrame, key="doc_id", text="text", **options) -> DataFrame:
    """``docs`` whose text lacks the removed paragraphs; other columns stay as they are."""
    gone = repeated_paragraphs(docs, key, text, **options).filter("removed").groupBy(F.col("doc_id").alias("__id")).agg(
        F.collect_set("paragraph").alias("__gone"))            # bounded by the document
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__id"))
    return docs.join(gone, same, "left").withColumn(text, F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(kept)).select(
        *[f"`{c}`" for c in docs.columns])


def pieces(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, first, n_words, node) of every piece of (doc_id, text); ``first`` counts words from 0."""
    def run(batches):
        for part in chunks(batches):
            words, n = words_of(pc.ascii_lower(part.column("text")))
            if not len(words):
                continue
            codes, distinct = coded(words)
            h = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[codes]
            doc, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            rank = mixed(h)
            rank[:-1] = np.where(doc[1:] == doc[:-1], mixed(rank[:-1] * MIX + h[1:]), rank[:-1])
            least = np.ones(len(h), bool)
            for k in range(1, min(radius, len(h) - 1) + 1):
                apart = doc[k:] != doc[:-k]
                least[k:] &= apart | (rank[k:] < rank[:-k])
                least[:-k] &= apart | (rank[:-k] <= rank[k:])
            at = np.flatnonzero(least)
            start, stop, of = at[:-1] - radius, at[1:] + radius, doc[at[:-1]]
            good = (of == doc[at[1:]]) & (start >= (ends - n)[of]) & (stop <= ends[of])
            start, stop, of = start[good], stop[good], of[good]
            # sum of h[j] * STEP ** (j - start): the same wherever the words stand
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(STEP, len(h)))])
            node = mixed((total[stop] - total[start]) * _powers(BACK, len(h))[start] + (stop - start).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(of)), pa.array(start - (ends - n)[of]), pa.array(stop - start), pa.array(node.view(np.int64))],
                names=["doc_id", "first", "n_words", "node"])
    return rows.mapInArrow(run, "doc_id long, first long, n_words long, node long")


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def repeated_pieces(docs: DataFrame, key="doc_id", text="text", radius: int = RADIUS) -> DataFrame:
    """One row per piece that occurs in several documents: doc_id, first, n_words, the kept one, class size, removed."""
    seen = materialize(pieces(keyed_text(docs, key, text), radius), "pieces")
    place = F.struct("doc_id", "first")
    shared = seen.groupBy("node").agg(F.min(place).alias("kept"), F.max(place).alias("last")).filter(
        ~F.col("kept.doc_id").eqNullSafe(F.col("last.doc_id"))).select("node", "kept")
    held = materialize(seen.join(materialize(shared, "shared"), "node").distinct(), "held")
    sizes = held.groupBy("node").agg(F.count("*").alias("class_size"))
    here = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("first") == F.col("kept.first"))
    return held.join(sizes, "node").select(
        "doc_id", "first", "n_words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.first").alias("kept_first"), "class_size",
        (~here).alias("removed"))


def op10_repeated_paragraphs(spark, sf_dir):
    """Every paragraph that repeats, exactly or nearly, and every piece that several documents share.

    ``paragraph`` is the line's number, for a piece that of its first word.
    """
    from lurewatch.llm.common import documents
    docs = documents(spark, sf_dir)
    lines = repeated_paragraphs(docs).withColumn("unit", F.lit("line"))
    found = repeated_pieces(docs).withColumn("unit", F.lit("piece"))
    return lines.withColumns({c: F.col(c).cast("long") for c in ("paragraph", "kept_paragraph")}).unionByName(
        found.withColumnsRenamed({"first": "paragraph", "kept_first": "kept_paragraph"}))
