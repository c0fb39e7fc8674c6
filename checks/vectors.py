"""Vector retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bind import table
from checks.registry import query
from lurewatch.functions import text as T
from lurewatch.operators import vector_index as VI
from lurewatch.operators import vectors as V
from lurewatch.operators import windows as WN
from lurewatch.plans import retrieval as R
from lurewatch.session import scratch_path

r6 = lambda c: F.round(c, 6)
E = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
QUERIES = f"SELECT label AS query_id, arg_min(e, vec_id) AS q FROM ({E}) GROUP BY label"


def corpus(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def query_batch(spark, sf):
    """One query per label: its first vector."""
    e = table(spark, sf, "embeddings")
    return e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


@query("cosine", f"SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS cosine FROM ({E}) JOIN ({QUERIES}) ON label = query_id")
def cosine(spark, sf):
    q = query_batch(spark, sf).select(F.col("query_id").alias("label"), F.col("embedding").alias("q"))
    return corpus(spark, sf).join(q, "label").select("vec_id", r6(V.cosine("embedding", "q")).alias("cosine"))


@query("l2_normalize", f"""SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * 3)) / sqrt(list_sum(list_transform(e, lambda x: x * x * 9))), 6) AS total FROM ({E})""")
def l2_normalize(spark, sf):
    unit = V.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return corpus(spark, sf).select("vec_id", r6(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x)).alias("total"))


KNN = f"""SELECT query_id, vec_id, round(s, 6) AS vector_score, rank FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank
 FROM (SELECT query_id, vec_id, list_cosine_similarity(e, q) AS s FROM ({E}), ({QUERIES}))) WHERE rank <= 20"""


@query("knn", KNN)
def knn(spark, sf):
    return V.knn(query_batch(spark, sf), corpus(spark, sf), 20).withColumn("vector_score", r6("vector_score"))


@query("ann_recall")
def ann_recall(spark, sf):
    """Share of the exact top 10 found by the cell index."""
    q, c = query_batch(spark, sf), corpus(spark, sf)
    return V.recall(V.ann(q, c, 10, lists=8, probe=4), V.knn(q, c, 10))


@query("index_search_exact", KNN)
def index_search_exact(spark, sf):
    """The stored index with every cell probed."""
    path = scratch_path(spark, "vector-index")
    VI.build_index(corpus(spark, sf), path, lists=16)
    return VI.search_index(query_batch(spark, sf), path, 20, probe=16).withColumn("vector_score", r6("vector_score"))


@query("index_cells", "SELECT count(*) AS vectors FROM embeddings")
def index_cells(spark, sf):
    """Every row is indexed: the lengths of the cells add up to the table."""
    path = scratch_path(spark, "vector-index")
    VI.build_index(corpus(spark, sf), path)
    return spark.read.parquet(f"{path}/cells").agg(F.sum("n").alias("vectors"))


@query("index_recall")
def index_recall(spark, sf):
    """Recall of the stored index against exact search, probing as many cells as 0.9 takes.

    Queries are the rows with vec_id divisible by 100, against all rows.
    """
    path, c = scratch_path(spark, "vector-index"), corpus(spark, sf)
    VI.build_index(c, path)
    q = c.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    probe = VI.probe_for_recall(q, path, 10, 0.9)
    found = V.recall(VI.search_index(q, path, 10, probe), V.knn(q, c, 10))
    return found.select("recall", F.lit(probe).alias("probe"), F.lit(spark.read.parquet(f"{path}/cells").count()).alias("cells"))


CHUNKS = """SELECT item_id % 12 AS query_id, item_id AS doc_id, 0 AS chunk_index, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'Passage ' || item_id END AS title,
 left(text, 200) AS content, (SELECT left(text, 120) FROM benchmark WHERE item_id = 0) AS query FROM benchmark"""
BAG = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+'), lambda w: w <> ''))"
RERANKED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id, chunk_index) AS n FROM
 (SELECT *, 1.0 / (1.0 + exp(-(len(list_intersect({BAG.format(c='query')}, {BAG.format(c='content')})) - 2.0))) AS rerank_score FROM ({CHUNKS}))) WHERE n <= 5"""


def _reranked(spark, sf):
    b = table(spark, sf, "benchmark")
    first = b.filter("item_id = 0").select(F.substring("text", 1, 120)).scalar()
    i = F.col("item_id")
    cands = b.select((i % 12).alias("query_id"), i.alias("doc_id"), F.lit(0).alias("chunk_index"),
                     F.when(i % 3 != 0, F.concat(F.lit("Passage "), i.cast("string"))).alias("title"),
                     F.substring("text", 1, 200).alias("content"), first.alias("query"))
    return WN.rerank(cands, k=5)


@query("rerank", f"SELECT query_id, doc_id, n, round(rerank_score, 6) AS rerank_score FROM ({RERANKED})")
def rerank(spark, sf):
    return _reranked(spark, sf).select("query_id", "doc_id", "n", r6("rerank_score").alias("rerank_score"))


@query("context_block", f"""SELECT query_id, string_agg('[' || n || '] ' || coalesce(title, CAST(doc_id AS VARCHAR)) || chr(10) || content, chr(10) || chr(10) ORDER BY n) AS context
 FROM ({RERANKED}) GROUP BY query_id""")
def context_block(spark, sf):
    return WN.context_block(_reranked(spark, sf))


@query("retrieve_chunks")
def retrieve_chunks(spark, sf):
    """Hashed bag-of-words retrieval: benchmark passages against document paragraphs."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), "text")
    chunks = R.embed(R.chunk_corpus(docs, "\n"), dim=64)
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = R.retrieve(R.embed(q, "query", dim=64), chunks, 20, 5)
    return found.select("query_id", "doc_id", "chunk_index", "n", r6("vector_score").alias("vector_score"))
