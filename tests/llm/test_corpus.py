"""Operators on pairs and on the whole corpus against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from llm_words import words
from pyspark.sql import functions as F

import corpus_pipeline
from lurewatch.llm import components, lm, near, paragraphs, repeats


def _classes(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            where[g].append(k)
    for k, s in sets.items():
        for other, both in Counter(e for g in s for e in where[g] if e != k).items():
            if 100 * both >= 80 * (len(s) + len(sets[other]) - both):
                a, b = find(k), find(other)
                parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in sets}


def _shingles(w):
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_random_links(spark):
    rng = random.Random(8)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(k, k - 1) for k in range(1000, 900, -1)]
    links += [(a, b) for a in range(2000, 2025) for b in range(2000, 2025)] + [(-5, -5)]      # a dense group, a loop
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for node in sorted(near):
        todo = [] if node in want else [node]
        while todo:
            at = todo.pop()
            if want.setdefault(at, node) == node:
                todo += [x for x in near[at] if x not in want]
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def test_near_components(docs, odd):
    sets = {r.doc_id: _shingles(words(r.text)) for r in docs.collect()}
    want = _classes(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_components(docs).collect()}
    assert got == {k: (len(s), want[k]) for k, s in sets.items()}
    rows = near.near_components(odd).collect()
    assert len(rows) == 10
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == 1 and by[2] == 2 and by[3] == 3 and by[4] == 4 and by[None] == 4 and by[6] == 5
    kept = sorted(r.doc_id for r in near.without_near_copies(odd).collect())
    assert kept == [1, 2, 3, 4, 5, 7, 8]
    assert near.near_components(odd.limit(0)).count() == 0


def test_parities_bound_the_difference():
    """From any place on, parities differ in no more bits than the tokens do."""
    rng = np.random.default_rng(5)
    for size in (1, 7, 300):
        a = rng.integers(-2**62, 2**62, size)
        b = np.unique(np.concatenate([a[size // 5:], rng.integers(-2**62, 2**62, 3)]))
        pa_, pb = near.parities(a, a), near.parities(b, b)
        for i, j in ((0, 0), (size // 2, 0), (size - 1, len(b) - 1)):
            bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in pa_[i] ^ pb[j])
            assert bits <= len(set(a[i:]) ^ set(b[j:]))


def test_near_copies_without_original(spark):
    """Copies that mostly lie below the threshold to each other still form the exact components."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(120), 3):
            w[at] = f"e{i}_{at}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = _classes({k: _shingles(words(t)) for k, t in texts})
    assert {r.doc_id: r.component_id for r in near.near_components(df).collect()} == want


def test_across_groups_hands_out_early(spark):
    """A task that hands out its postings several times counts what one that does so once counts."""
    rng = np.random.default_rng(9)
    sets = [(k, k % 7, np.unique(rng.integers(0, 200, 40).astype(np.uint64)).tobytes()) for k in range(60)]
    grouped = spark.createDataFrame(sets, "node long, group long, tokens binary").coalesce(1)
    want = sorted(near.across_groups(grouped, 4).collect())
    assert len(want) == 60
    for limits in ({"limit": 50}, {"most_labels": 1}, {"most_labels": 7}):
        assert sorted(near.across_groups(grouped, 4, **limits).collect()) == want


def test_repeated_bytes(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    p, q = noise(230), noise(600)
    rows = [(1, None), (2, ""), (3, "a" * 199), (5, "a" * 333), (6, noise(50) + p + noise(70)), (7, p[3:] + noise(10)), (8, noise(100) + q),
            (9, q[:250] + "X" + q[251:]), (9, q[:250] + "X" + q[251:]), (None, noise(30) + q[100:480]), (11, "ab" * 300), (12, q[5:206]),
            (13, noise(20) + q[:200] + q[350:560])]
    rows += [(100 + i, noise(rng.randint(0, 300)) + q[rng.randint(0, 200):rng.randint(300, 600)] + p[rng.randint(0, 30):]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + 200] for _, b in raw for i in range(len(b) - 199))
    want = Counter()
    for d, b in raw:
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                cut[i:i + 200] = True
        want[d, int(cut.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cut])).hexdigest()] += 1
    out = repeats.without_repeats(df).select(
        "doc_id", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_bytes") - F.octet_length("kept")).alias("n"),
        F.coalesce(F.sha2("kept", 256), F.col("text_sha256")).alias("sha"))
    assert Counter((r.doc_id, r.n, r.sha) for r in out.collect()) == want
    assert repeats.without_repeats(df.limit(0)).count() == 0


def test_paragraphs(docs, odd):
    sets = {(r.doc_id, k): _shingles(words(line)) for r in docs.collect() for k, line in enumerate(r.text.split("\n")) if len(words(line)) >= 20}
    of = defaultdict(list)
    for k, head in _classes(sets).items():
        of[head].append(k)
    want = {k: min(v) for v in of.values() if len(v) > 1 for k in v}
    got = {(r.doc_id, r.paragraph): (r.kept_doc_id, r.kept_paragraph) for r in paragraphs.repeated_paragraphs(docs).collect()}
    assert got == want
    assert paragraphs.without_repeated_paragraphs(odd).columns == odd.columns
    assert paragraphs.repeated_paragraphs(odd.limit(0)).count() == 0


def test_scores(docs, odd):
    for df in (docs, odd):
        rows = [(r.doc_id, words(r.text) + ["\n"]) for r in df.collect()]
        out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        c = Counter(w for d, t in rows if not out(d) for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((str(d), out(d), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for d, t in rows)
        got = lm.score_documents(df).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
        assert all(r.train_tokens == n and r.score < 0 for r in got)


def test_pipeline(spark, sf, docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == docs.columns
        assert out.count() <= rows.count()
        rows = out
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == rows.count()
