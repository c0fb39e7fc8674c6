"""Helpers shared by the operators: column choice, bounded Arrow batches, words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4_000_000   # text that one numpy step holds at once
BATCH_BYTES = 8 << 20     # of an Arrow batch between the JVM and a Python worker
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not by rows alone; holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key as long and text with null as the empty string; other columns are left out."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def chunks(batches, column="text", limit=CHUNK_BYTES):
    """Slices of Arrow batches with at most ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words_of(texts: pa.Array):
    """Runs of non-space characters of every text.

    Returns (words of all texts one after another, number of words per text).
    Space is what ``[\\x20\\x09-\\x0D]`` holds.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.greater(pc.binary_length(flat), 0)
    flat, parents = flat.filter(keep), parents.filter(keep).to_numpy(zero_copy_only=False)
    return flat, np.bincount(parents, minlength=len(texts)).astype(np.int64)


def coded(words: pa.Array):
    """(code per word as int64, distinct words) of one batch."""
    enc = words.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` neighbouring values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def gather_runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - sizes), sizes)
