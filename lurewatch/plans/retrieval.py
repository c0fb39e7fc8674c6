"""Knowledge retrieval: ingest chunks, answer query batches."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import text as T
from lurewatch.operators.vectors import ann, knn, l2_normalize
from lurewatch.operators.windows import chunk_paragraphs, context_block, rerank
from lurewatch.sources.writers import upsert_table


def embed(df: DataFrame, c="content", dim=256, out="embedding") -> DataFrame:
    """Unit-length hashed bag of words.

    Offline stand-in for a sentence encoder; a real one plugs in as a pandas
    UDF that returns ``array<float>``.
    """
    words = df.withColumn("_w", T.text_tokens(F.lower(F.col(c))))
    hashed = HashingTF(inputCol="_w", outputCol="_v", numFeatures=dim).transform(words)
    vec = l2_normalize(vector_to_array("_v")).cast("array<float>")
    return hashed.withColumn(out, vec).drop("_w", "_v")


def chunk_corpus(corpus: DataFrame, sep="\n\n") -> DataFrame:
    return chunk_paragraphs(corpus, "text", sep)


def ingest(corpus: DataFrame, path, now=None, encoder=embed, sep="\n\n"):
    """Chunk, embed and upsert a corpus; running it again changes nothing else."""
    chunks = encoder(chunk_corpus(corpus, sep))
    chunks = chunks.withColumn("created_at", F.lit(now).cast("timestamp") if now else F.current_timestamp())
    upsert_table(chunks.select("doc_id", "title", "source", "chunk_index", "content", "embedding", "created_at"),
                 path, ["doc_id", "chunk_index"])


def retrieve(queries: DataFrame, chunks: DataFrame, candidates=20, top_k=5, score=None, approximate=False) -> DataFrame:
    """Reranked chunks per query, numbered.

    ``queries``: query_id, query, embedding.  ``score`` as in ``rerank``.
    """
    keyed = chunks.withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    find = ann if approximate else knn
    near = find(queries, keyed, candidates, id_col="chunk_id")
    cands = (near.drop("rank").join(keyed.drop("embedding"), "chunk_id")
             .join(queries.select("query_id", "query"), "query_id"))
    return rerank(cands, score, top_k).drop("chunk_id")


def contexts(retrieved: DataFrame) -> DataFrame:
    return context_block(retrieved)
