"""SimHash components against brute force."""

import random

import pytest
import xxhash
from llm_words import words
from pyspark.sql import functions as F

from lurewatch.llm import simhash


def _fingerprint(text):
    w = words(text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def _classes(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_components_of_documents(request, table):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, _fingerprint(r.text)) for r in df.collect()]
    classes = _classes({f for _, f in rows})
    low = {}
    for d, f in rows:
        if d is not None:
            low[classes[f]] = min(d, low.get(classes[f], d))
    want = sorted((str(d), f"{f:016x}", low.get(classes[f])) for d, f in rows)
    got = simhash.simhash_components(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 71} é{i % 13}\n" for i in range(500))
    want = _fingerprint(text)
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.simhash(text.encode()) == want


def test_hash_is_the_one_of_the_column_function(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("one two é"))).first()[0]
    assert simhash.simhash("One  two\né".encode()) == got % 2**64


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(1)
    pairs = [(a, a ^ sum(1 << j for j in rng.sample(range(64), k))) for k in range(0, 60, 3) for a in [rng.getrandbits(64)]]
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    got = df.select(F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b"))))).collect()
    count = lambda x: [bin(x >> 2 * s & 3).count("1") for s in range(32)]
    assert [r[0] for r in got] == [sum(abs(x - y) for x, y in zip(count(a), count(b))) for a, b in pairs]
    assert all(r[0] <= bin(a ^ b).count("1") for r, (a, b) in zip(got, pairs))


@pytest.mark.parametrize("crowd", [2_000, 5])
def test_crowded_cells(spark, monkeypatch, crowd):
    """A cloud around a lost centre, chains, and random fingerprints; also with every cell cut."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << j for j in rng.sample(range(64), rng.choice([2, 3, 5, 7]))) for _ in range(250)}
    step = rng.getrandbits(64)
    for _ in range(15):
        step ^= sum(1 << j for j in rng.sample(range(64), 3))
        fps.add(step)
    fps |= {rng.getrandbits(64) for _ in range(80)} | {0, 7, 2**64 - 1}
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {}
    for r in simhash.near_fingerprints(df, len(fps)).collect():
        got.setdefault(r.component, set()).add(r.node)
    want = {}
    for f, c in _classes(fps).items():
        want.setdefault(c, set()).add(signed(f))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_more_fingerprints_take_finer_grids():
    groups = [simhash.grid_groups(10 ** k) for k in range(2, 13)]
    assert groups == sorted(groups) and groups[0] == 4 and groups[-1] > 6
