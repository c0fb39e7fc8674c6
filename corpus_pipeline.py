"""A corpus made ready for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again before the next one.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from lurewatch.llm.decontaminate import without_contaminated
from lurewatch.llm.near import without_near_copies
from lurewatch.llm.pack import pack_documents
from lurewatch.llm.pii import redact
from lurewatch.llm.quality import keep_quality
from lurewatch.session import materialize


def quality_rules(spark, docs, sf_dir):
    """Documents outside the base rules or their language's fertility band go."""
    return keep_quality(docs)


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return without_near_copies(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item, also with other values, go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    """Base and discovered personal data are replaced by their kind."""
    return redact(docs)


def packing(spark, docs, sf_dir):
    """Pieces of at most 4096 tokens, packed into sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]
ORACLE_SQL = None      # tokenisers and graph scores are beyond SQL; see tests/llm


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
