"""Quality rules on tokeniser fertility.

A public vocabulary with byte fallback tells how well a text looks like the
language it claims: characters per token, share of byte-fallback tokens, share
of tokens without a letter or digit, and entropy of the token distribution.
Each language (or, where the language is unknown, each script) has a band for
the four; a text outside its band is rejected.  Plain counts (words, symbols, repeated lines and word windows) give
the base rules.

One pass over the rows, no shuffle: the work is Arrow batches cut into pieces
of a few megabytes, and vocabulary look-ups happen once per distinct word.

Defined cases: a null or empty text has no words, fails the base rule and gets
null fertility; an unknown or null language takes the band of its script; a
text of one very long line or word is handled like any other; repeated rows
each get their own row; extra columns are not returned.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import bounded_batches, chunks, segment_sums, words_of
from lurewatch.llm.vocab import vocabulary, word_ids

# (least, most) characters per token, most byte-fallback share, most share of
# tokens of marks, (least, most) entropy in bits of a text of at least SHORT tokens.  Wide bands: natural
# prose of a language lies well inside, text in another script or made of
# repeated or random symbols does not.
BANDS = {
    "en": (1.4, 8.0, 0.05, 0.35, 3.0, 11.5),
    "de": (1.3, 8.0, 0.05, 0.35, 3.0, 11.5),
    "fr": (1.2, 8.0, 0.05, 0.35, 3.0, 11.5),
    "es": (1.3, 8.0, 0.05, 0.35, 3.0, 11.5),
    "Latin": (1.2, 9.0, 0.10, 0.35, 3.0, 12.0),
    "Cyrillic": (1.0, 9.0, 0.15, 0.35, 3.0, 12.0),
    "Greek": (0.7, 9.0, 0.30, 0.35, 3.0, 12.0),
    "Han": (0.3, 4.0, 0.75, 0.35, 2.5, 12.0),
    "other": (0.25, 9.0, 0.95, 0.50, 2.5, 12.0),
}
SHORT = 100            # tokens below which entropy says little
SCRIPTS = (("Latin", "[A-Za-zÀ-ɏ]"), ("Cyrillic", "[Ѐ-ӿ]"), ("Greek", "[Ͱ-Ͽ]"), ("Han", "[一-鿿぀-ヿ]"))
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_tokens long, n_byte_tokens long, chars_per_token double, byte_share double, mark_share double, "
          "token_entropy double, "
          "band string, base_failed boolean, kept boolean")


def repeat_words(codes: np.ndarray, n_words: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, words inside ``width``-word windows that occur twice or more in it."""
    total = len(codes)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    n = total - width + 1
    if n < 1:
        return np.zeros(len(n_words), np.int64)
    inside = np.flatnonzero(doc[:n] == doc[width - 1:])
    key = doc[inside]
    for k in range(width):     # a number for each distinct (document, words so far)
        key = pd.factorize(key * (int(codes.max()) + 1) + codes[inside + k])[0].astype(np.int64)
    again = np.bincount(key)[key] > 1 if len(key) else np.zeros(0, bool)
    covered = np.zeros(total, bool)
    for k in range(width):
        covered[inside[again] + k] = True
    return segment_sums(covered.astype(np.int64), n_words)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def entropies(ids: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """Bits of the token distribution of each text."""
    doc = np.repeat(np.arange(len(n_ids)), n_ids)
    pairs, count = np.unique(doc * (1 << 32) + ids, return_counts=True)
    share = count / np.maximum(n_ids, 1)[pairs >> 32]
    return np.abs(np.bincount(pairs >> 32, -share * np.log2(share), minlength=len(n_ids)))


def mark_ids(path: str) -> np.ndarray:
    """Which ids are pieces that hold neither a letter nor a digit."""
    import sentencepiece
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return np.array([not pieces.is_byte(i) and not any(c.isalnum() for c in pieces.id_to_piece(i))
                     for i in range(pieces.get_piece_size())])


def script_of(text: str) -> str:
    found = [(len(re.findall(p, text)), name) for name, p in SCRIPTS]
    most, name = max(found)
    return name if most else "other"


def measure(batch: pa.RecordBatch, table, marks: np.ndarray, bands: dict) -> pa.RecordBatch:
    """Counts, fertility and verdict of each row (doc_id, text, lang)."""
    texts = batch.column("text")
    ids, n_ids, words, n_words, codes = table.of_texts(texts)
    first_byte = 3         # ids of the byte-fallback pieces follow <unk> <s> </s>
    is_byte = (ids >= first_byte) & (ids < first_byte + 256)
    n_byte = segment_sums(is_byte.astype(np.int64), n_ids)
    n_marks = segment_sums(marks[ids].astype(np.int64), n_ids)
    chars = segment_sums(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64), n_words)
    symbols = pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = np.array([duplicate_lines(t) for t in texts.to_pylist()], np.int64)
    repeats = repeat_words(codes, n_words)
    per = np.where(n_ids > 0, chars / np.maximum(n_ids, 1), np.nan)
    share = np.where(n_ids > 0, n_byte / np.maximum(n_ids, 1), np.nan)
    mark = np.where(n_ids > 0, n_marks / np.maximum(n_ids, 1), np.nan)
    bits = np.where(n_ids > 0, entropies(ids, n_ids), np.nan)
    names = [x if x in bands else None for x in batch.column("lang").to_pylist()]
    names = [x or script_of(texts[i].as_py()) for i, x in enumerate(names)]
    low, high, most, most_marks, least_bits, most_bits = np.array([bands[x] for x in names]).T
    failed = (n_words < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
    fits = ((per >= low) & (per <= high) & (share <= most) & (mark <= most_marks)
            & ((n_ids < SHORT) | ((bits >= least_bits) & (bits <= most_bits))))
    number = lambda x: pa.array(x, pa.float64(), from_pandas=True)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *map(pa.array, (n_words, chars, symbols, lines, repeats, n_ids, n_byte)),
         number(per), number(share), number(mark), number(bits), pa.array(names), pa.array(failed), pa.array(~failed & fits)],
        names=[x.split()[0] for x in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame, key="doc_id", text="text", lang="lang",
                  pieces: str = "piece_bpe_32k.model", bands: dict | None = None) -> DataFrame:
    """One row per document: base counts, fertility, band and verdict.

    ``pieces`` names the vocabulary file, ``bands`` replaces :data:`BANDS`.
    """
    bands = {**BANDS, **(bands or {})}
    bounded_batches(docs.sparkSession)

    def run(batches):
        table, marks = word_ids("piece", vocabulary(pieces)), mark_ids(vocabulary(pieces))
        for part in chunks(batches):
            yield measure(part, table, marks, bands)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                       F.col(f"`{lang}`").cast("string").alias("lang"))
    return rows.mapInArrow(run, SCHEMA)


def keep_quality(docs: DataFrame, key="doc_id", text="text", lang="lang",
                 pieces: str = "piece_bpe_32k.model", bands: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    bands = {**BANDS, **(bands or {})}
    bounded_batches(docs.sparkSession)

    def run(batches):
        table, marks = word_ids("piece", vocabulary(pieces)), mark_ids(vocabulary(pieces))
        for part in chunks(batches, text):            # the text travels once
            rows = pa.RecordBatch.from_arrays([part.column(key), pc.fill_null(part.column(text).cast(pa.string()), ""),
                                               part.column(lang).cast(pa.string())], names=["doc_id", "text", "lang"])
            yield part.filter(measure(rows, table, marks, bands).column("kept"))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_fertility(spark, sf_dir):
    """Base counts and fertility verdict of every document."""
    from lurewatch.llm.common import documents
    return quality_rules(documents(spark, sf_dir))
