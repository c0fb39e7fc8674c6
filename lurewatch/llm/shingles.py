"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from lurewatch.llm.common import coded, words_of

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_shingles(texts: pa.Array, width: int = 5):
    """Per text: (identity of its word sequence, sorted distinct shingle hashes).

    A-Z are lowered.  Fewer words than ``width`` make one shingle, no words none;
    a text without words has identity 0.
    """
    words, n_words = words_of(pc.ascii_lower(texts))
    ends = np.cumsum(n_words)
    if len(words):
        codes, distinct = coded(words)
        h = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[codes]
        grams = mixed(h)
        for k in range(1, width):
            grams[:-k] = mixed(grams[:-k] * MIX + h[k:])
        place = np.arange(len(h), dtype=np.uint64) - np.repeat((ends - n_words).astype(np.uint64), n_words)
        whole = mixed(h + place * MIX)
    for end, n in zip(ends, n_words):
        if not n:
            yield 0, np.zeros(0, np.uint64)
            continue
        identity = mixed(whole[end - n:end].sum(dtype=np.uint64, keepdims=True) + np.uint64(n))[0]
        found = grams[end - n:end - width + 1] if n >= width else mixed(np.array([identity + np.uint64(n)], np.uint64))
        yield int(identity.astype(np.int64)), np.unique(found)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())
