"""Prefix trie against brute force on materialized rebuilt conversations."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import trie

HEAD = lambda c: F.crc32(c.cast("string").cast("binary")) % 9


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children = defaultdict(set)
    for s in members:
        if s:
            children[s[:-1]].add(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    return sorted((m[0], len(s), members[s[:-1]][0] if s else None, len(m), len(children[s]), leaves[s], saved[s],
                   hashlib.sha256(",".join(str(c) for c in m if len(full[c]) == len(s)).encode()).hexdigest()) for s, m in members.items())


def _trie(df):
    got = trie.prefix_trie(df, lambda c: c - c % 5, HEAD, 8).collect()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def _odd():
    """Nulls, ties, repeated rows, shared prefixes, a long conversation, missing bases, large ids."""
    rows = [(1, None, None, "x"), (1, 0, "user", None), (None, 1, "user", "lost"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"),
            (2, 1, "assistant", "z"), (3, None, None, None), (10**15 + 7, 0, "user", "ü"), (104, 2, "", "x"), (104, 1, "", "x")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"say {min(t, c % 3)}") for c in range(20, 60) for t in range(c % 11)]
    rows += [(70, t, "user", f"long {t % 17}") for t in range(400)] + [(71, t, "user", f"long {t % 17}") for t in range(300)]
    return rows


@pytest.mark.parametrize("spread", [False, True])
def test_trie(spark, spread):
    rows = _odd()
    df = spark.createDataFrame([(*r, 5, 6, "c") for r in rows], "conv_id long, turn long, role string, text string, depth int, node int, part string")
    if spread:                     # conversations over many partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _trie(df) == _brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_trie_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = trie.op12_prefix_trie(spark, sf).collect()
    assert sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in got) == _brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert _trie(df.limit(0)) == []


def test_a_collision_takes_another_multiplier(spark, monkeypatch):
    """With multiplier one a product forgets the order of the turns before; the check notices."""
    rows = [(7, 0, "u", "a"), (7, 1, "u", "b"), (8, 0, "u", "b"), (8, 1, "u", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(trie, "MULTIPLIERS", (1, *trie.MULTIPLIERS))
    plain = lambda c: c
    got = {(r.conv_id, r.depth) for r in trie.prefix_trie(df, plain, lambda c: F.lit(0), 8).collect()}
    assert got == {(7, 0), (7, 1), (7, 2), (8, 1), (8, 2)}
    monkeypatch.setattr(trie, "MULTIPLIERS", (1,))
    with pytest.raises(ArithmeticError):
        trie.prefix_trie(df, plain, lambda c: F.lit(0), 8)


def test_powers():
    base = trie.MULTIPLIERS[0]
    k = np.array([0, 1, 2, 63, 10**12])
    assert trie.power(base, k).tolist() == [pow(base, int(x), 1 << 64) for x in k]
