"""Pieces of documents: sound against the words, and passages in other surroundings are found."""

import random
from collections import defaultdict

from llm_words import words

from lurewatch.llm import paragraphs


def _texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: [word() for _ in range(n)]
    rows, hold = [], defaultdict(set)
    for p in range(60):
        passage = prose(rng.randint(51, 110))
        for _ in range(2):
            body = prose(rng.randint(20, 300))
            at = rng.randint(0, len(body))
            body[at:at] = passage
            every = rng.choice([7, 12, 400])                       # short lines, or one long line
            rows.append((len(rows), "".join(w + ("\n" if i % every == 0 else " ") for i, w in enumerate(body))))
            hold[p].add(len(rows) - 1)
    clean = []
    for _ in range(60):
        common = prose(3 * paragraphs.RADIUS)                      # one word short of a piece
        for _ in range(2):
            body = prose(150)
            body[70:70] = common
            clean.append(len(rows))
            rows.append((len(rows), " ".join(body)))
    return rows, hold, clean


def test_passages_in_other_lines(spark):
    rows, hold, clean = _texts()
    got = paragraphs.repeated_pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    texts = {d: words(t) for d, t in rows}
    where = defaultdict(set)
    for r in got:
        piece = tuple(texts[r.doc_id][r.first:r.first + r.n_words])
        assert len(piece) == r.n_words >= 3 * paragraphs.RADIUS + 1
        assert piece == tuple(texts[r.kept_doc_id][r.kept_first:r.kept_first + r.n_words])
        assert r.removed == ((r.doc_id, r.first) != (r.kept_doc_id, r.kept_first))
        where[piece].add((r.doc_id, r.first, r.class_size))
    assert all(len({d for d, _, _ in v}) > 1 and {n for _, _, n in v} == {len(v)} for v in where.values())
    found = {r.doc_id for r in got}
    planted = {d for v in hold.values() for d in v}
    assert len(planted & found) >= 0.95 * len(planted)
    assert not found & set(clean)


def test_all_pieces_against_a_plain_search(docs):
    """Boundaries, word sequences and classes by a search of all positions."""
    import numpy as np
    import pandas as pd
    from lurewatch.llm.shingles import MIX, mixed

    r, want = paragraphs.RADIUS, defaultdict(set)
    for row in docs.collect():
        w = words(row.text)
        if not w:
            continue
        h = pd.util.hash_array(np.array(w, object), categorize=False)
        rank = [int(mixed(mixed(h[i:i + 1]) * MIX + h[i + 1])[0]) if i + 1 < len(w) else int(mixed(h[i:i + 1])[0]) for i in range(len(w))]
        at = [i for i in range(len(w)) if all(rank[i] < x for x in rank[max(0, i - r):i]) and all(rank[i] <= x for x in rank[i + 1:i + 1 + r])]
        for a, b in zip(at, at[1:]):
            if a >= r and b + r <= len(w):
                want[tuple(w[a - r:b + r])].add((row.doc_id, a - r))
    want = {(d, i, len(p)): (*min(v), len(v)) for p, v in want.items() if len({d for d, _ in v}) > 1 for d, i in v}
    got = {(x.doc_id, x.first, x.n_words): (x.kept_doc_id, x.kept_first, x.class_size) for x in paragraphs.repeated_pieces(docs).collect()}
    assert got == want and want


def test_odd_rows(spark, odd):
    rows = paragraphs.repeated_pieces(odd).collect()
    assert {r.doc_id for r in rows} == {5, 6}
    assert paragraphs.repeated_pieces(odd.limit(0)).count() == 0
    same = spark.createDataFrame([(1, " ".join(map(str, range(90))))] * 3, "doc_id long, text string")
    assert paragraphs.repeated_pieces(same).count() == 0            # one document, given three times
