"""Word-wise tokenising with public vocabularies.

The vocabularies split at white space before anything else, so the ids of a
text are the ids of its words in order.  Each distinct word of a batch is
encoded once, and a bounded table keeps the words seen before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lurewatch.llm.common import coded, gather_runs, words_of

KEEP = 300_000   # words a Python worker remembers


class WordIds:
    """Token ids of words through ``encode`` (list of words -> list of id lists)."""

    def __init__(self, encode, keep=KEEP):
        self.encode, self.keep = encode, keep
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(keep, np.int64)
        self.size = np.zeros(keep, np.int64)
        self.used = 0

    def _store(self, words, lists):
        room = self.keep - len(self.place)
        for word, ids in zip(words[:room], lists[:room]):
            n, k = len(ids), len(self.place)
            while self.used + n > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used:self.used + n] = ids
            self.start[k], self.size[k] = self.used, n
            self.place[word] = k
            self.used += n

    def of_distinct(self, words: list[str]):
        """(flat ids, start, size per word) for distinct words."""
        known = np.fromiter(map(self.place.get, words, [-1] * len(words)), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        missing = [words[i] for i in new]
        lists = self.encode(missing) if missing else []
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        extra = np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum()))
        hit = np.maximum(known, 0)
        start, size = self.start[hit], self.size[hit]
        base = self.used
        flat = np.concatenate([self.ids[:base], extra])
        start[new] = base + np.cumsum(sizes) - sizes
        size[new] = sizes
        self._store(missing, lists)
        return flat, start, size

    def of_texts(self, texts: pa.Array):
        """(ids of all texts, ids per text, words, words per text, ids per word)."""
        words, n_words = words_of(texts)
        codes, distinct = coded(words)
        flat, start, size = self.of_distinct(distinct.to_pylist())
        per_word = size[codes]
        ids = flat[gather_runs(start[codes], per_word)]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        return ids, ends[bounds[1:]] - ends[bounds[:-1]], words, n_words, codes


def byte_letters():
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others follow from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def bpe_encoder(path: str):
    """Encoder of a ``tokenizers`` file that lowers, splits letters from the rest and marks word ends.

    Words of plain Latin letters, possibly followed by marks, go straight to the
    merge model; every other word takes the whole tokenizer.
    """
    import re
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    merge = tokenizer.model.tokenize
    letters = byte_letters()
    simple = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:]*)")
    marks = {"": []}

    def one(word):
        m = simple.fullmatch(word)
        if m is None:
            return tokenizer.encode(word, add_special_tokens=False).ids
        stem, mark = m.group(1).lower(), m.group(2)
        if not stem.isascii():
            stem = "".join([letters[b] for b in stem.encode()])
        if mark not in marks and len(marks) < 10_000:
            marks[mark] = [t.id for t in merge(mark)]
        tail = marks[mark] if mark in marks else [t.id for t in merge(mark)]
        return [t.id for t in merge(stem)] + tail

    return lambda words: [one(w) for w in words]


def piece_encoder(path: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda words: processor.encode(words, num_threads=1)


_LOADED: dict[tuple[str, str], WordIds] = {}


def word_ids(kind: str, path: str) -> WordIds:
    """The word table of this Python worker for one vocabulary file."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = WordIds({"bpe": bpe_encoder, "piece": piece_encoder}[kind](path))
    return _LOADED[kind, path]


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
