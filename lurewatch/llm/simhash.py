"""Near copies by 64-bit SimHash, joined through segment bit counts.

A fingerprint is embedded as its bit counts per segment of two bits.  The Manhattan
distance of two embeddings is at most the number of differing bits, so it discards
pairs before the exact test.  Counts are written in unary (0 as 00, 1 as 01, 2 as 11),
by which the Manhattan distance of two embeddings is the bit count of their XOR, and a
coordinate subset is a mask.

The range join takes several grids.  Coordinates are dealt into groups; within distance
k at most k groups differ, so every pair in range shares the cell of one of the grids
that leave out k groups.  The number of groups follows from the number of fingerprints.

1. Equal fingerprints are one node; the grids see distinct ones only.
2. Every cell proposes its smallest fingerprint to all its members: one test per member.
   The links found make groups, so a thousand near copies need no test of all pairs.
3. Cells that still hold several groups are joined with themselves across groups.  A cell
   of more than ``CROWD`` members is first cut along the coordinates its grid leaves out:
   of k + 1 parts of them one must agree.
4. Links of both steps give the components.

Defined cases: null, empty and blank texts have fingerprint zero and link with each other
and with whatever has at most k bits set; fewer than three words are one shingle; equal
rows and repeated keys keep their own rows; a null key never is the smallest of a component
with any other key (a component of null keys alone has null); extra columns are not returned;
an empty table gives an empty result.  A text is hashed piece by piece, so memory holds its
bytes once and one piece of words.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import chunks, documents, keyed_text
from lurewatch.llm.components import components
from lurewatch.session import materialize

WIDTH, SEED, DISTANCE = 3, 42, 3
SEGMENTS = 32                     # of two bits
AGREE = 0.375                     # two random segments of two bits have equal counts
ROW_COST = 50                     # a row more in the shuffle costs about as much as so many tests
CROWD = 2_000
PIECE = 1 << 20
LOW = 0x5555555555555555
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes):
    """Lists of words, each of about ``PIECE`` bytes; no word is cut."""
    start = 0
    while start < len(data):
        stop = start + PIECE
        found = SPACE.search(data, stop) if stop < len(data) else None
        stop = found.start() if found else len(data)
        yield data[start:stop].split()
        start = stop


def _hashes(words, width):
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], "<u8")


def simhash(data: bytes, width: int = WIDTH) -> int:
    """Fingerprint of UTF-8 bytes: bits set in over half of the shingle hashes."""
    ones, n, left = np.zeros(64, np.int64), 0, []
    for words in _pieces(data.lower()):                 # bytes.lower() lowers A-Z only
        left += words
        if len(left) >= width:
            h = _hashes(left, width)
            ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
            n += len(h)
            left = left[len(left) - width + 1:]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(left), SEED) if left else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """(doc_id, fp) of (doc_id, text); the fingerprint as a signed long."""
    def run(batches):
        for part in chunks(batches):
            texts = part.column("text").cast(pa.binary())
            fp = np.array([simhash(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])
    return rows.mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(segments) -> int:
    return _signed(sum(3 << 2 * s for s in segments))


def _grids(n_groups: int, distance: int):
    """[(mask of the cell, masks of the parts of the coordinates left out)] of every grid."""
    groups = [[int(s) for s in g] for g in np.array_split(np.arange(SEGMENTS), n_groups)]
    out = []
    for free in combinations(range(n_groups), distance):
        rest = [s for g in free for s in groups[g]]
        parts = [[int(s) for s in p] for p in np.array_split(rest, distance + 1)]
        out.append((_mask(s for g, of in enumerate(groups) if g not in free for s in of), [_mask(p) for p in parts]))
    return out


def grid_groups(n: int, distance: int = DISTANCE) -> int:
    """Number of coordinate groups with which n random fingerprints cost least to join."""
    def cost(g):
        return comb(g, distance) * (ROW_COST + n * AGREE ** (SEGMENTS * (g - distance) / g))
    return min(range(distance + 1, SEGMENTS // 2 + 1), key=cost)


def embedding(fp):
    """Bit counts per segment of two bits, in unary."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _differ(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def near_fingerprints(nodes: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(node, component) of the fingerprints in column fp that have a link; components by transitive links.

    ``n`` is the number of distinct fingerprints.
    """
    grids = _grids(grid_groups(n, distance), distance)
    cells = nodes.select("fp", embedding(F.col("fp")).alias("counts")).select(
        "fp", "counts", F.posexplode(F.array(*[F.col("counts").bitwiseAND(F.lit(m)) for m, _ in grids])).alias("grid", "cell"))
    sizes = cells.groupBy("grid", "cell").agg(F.min("fp").alias("head"), F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes, "cells")
    near_head = cells.join(sizes, ["grid", "cell"]).filter(
        (F.col("fp") != F.col("head")) & (_differ(F.col("fp"), F.col("head")) <= distance)).select(
        F.col("fp").alias("a"), F.col("head").alias("b")).distinct()
    stars = components(near_head)

    grouped = nodes.select("fp").join(stars.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("group"))
    grouped = materialize(grouped, "grouped")
    members = grouped.select("fp", "group", embedding(F.col("fp")).alias("counts")).select(
        "fp", "group", "counts", F.posexplode(F.array(*[F.col("counts").bitwiseAND(F.lit(m)) for m, _ in grids])).alias("grid", "cell"))
    mixed = members.groupBy("grid", "cell").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias(
        "n")).filter("low < high and n > 2").select("grid", "cell", "n")   # of two members one is the head
    parts = F.array(*[F.lit(p) for _, of in grids for p in of])
    cut = F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda j: F.struct(
        j.alias("part"), F.col("counts").bitwiseAND(F.element_at(parts, F.col("grid") * (distance + 1) + j + 1)).alias("sub")))
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub")))
    held = members.join(mixed, ["grid", "cell"]).select(
        "fp", "group", "counts", "grid", "cell", F.inline(F.when(F.col("n") > CROWD, cut).otherwise(whole)))
    held = materialize(held, "held")
    a, b = (held.select(*[F.col(c).alias(f"{side}_{c}") for c in held.columns]) for side in "ab")
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("grid", "cell", "part", "sub")]
    across = a.join(b, [*same, F.col("a_fp") < F.col("b_fp"), F.col("a_group") != F.col("b_group"),
                        _differ(F.col("a_counts"), F.col("b_counts")) <= distance,      # Manhattan distance
                        _differ(F.col("a_fp"), F.col("b_fp")) <= distance])
    joined = components(across.select(F.col("a_group").alias("a"), F.col("b_group").alias("b")).distinct())
    return grouped.join(joined.select(F.col("node").alias("group"), F.col("component").alias("joined")), "group", "left").select(
        F.col("fp").alias("node"), F.coalesce("joined", "group").alias("component"))


def simhash_components(docs: DataFrame, key="doc_id", text="text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, the smallest key reachable by links."""
    seen = materialize(fingerprints(keyed_text(docs, key, text)), "fingerprints")
    nodes = materialize(seen.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "nodes")
    classes = near_fingerprints(nodes, nodes.count(), distance).join(nodes, F.col("node") == F.col("fp"))
    classes = materialize(classes.select("fp", "lowest", "component"), "classes")
    lowest = classes.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = materialize(classes.select("fp", "component").join(lowest, "component").select("fp", "component_id"), "named")
    return seen.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash_groups(spark, sf_dir):
    """Components of documents whose fingerprints differ in at most three bits."""
    return simhash_components(documents(spark, sf_dir))
