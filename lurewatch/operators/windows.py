"""Ordered work inside groups: caps, first wins, numbering, token lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurewatch.functions import text as T
from lurewatch.functions.calc import sigmoid
from lurewatch.functions.common import col
from lurewatch.operators.sampling import first_per_key


def cap_per_group(df: DataFrame, group, caps: dict, order, keep_others=True) -> DataFrame:
    """The first ``caps[group]`` rows of each group in arrival order.

    Groups without a cap stay whole, unless ``keep_others`` is off.  The bound
    on the row number is a literal (the largest cap), so each input partition
    passes on at most that many rows per capped group, however large it is.
    """
    capped = F.coalesce(col(group).isin(list(caps)), F.lit(False))
    others = df.filter(~capped)
    df = df.filter(capped)
    w = W.partitionBy(group).orderBy(order)
    cap = F.lit(None).cast("int")
    for name, n in caps.items():
        cap = F.when(col(group) == name, F.lit(n)).otherwise(cap)
    top = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(caps.values()))
    top = top.filter(F.col("_r") <= cap).drop("_r")
    return top.unionByName(others) if keep_others else top


def dedupe_first(df: DataFrame, key, order) -> DataFrame:
    """First row per key in arrival order."""
    return first_per_key(df, key, order)


def chunk_paragraphs(df: DataFrame, c="text", sep="\n\n") -> DataFrame:
    """One row per non-empty paragraph with its index in the document."""
    return df.select(*[x for x in df.columns if x != c],
                     F.posexplode(T.paragraphs(c, sep)).alias("chunk_index", "content"))


def top_tokens(df: DataFrame, by="doc_id", token="token", value="value", k=5) -> DataFrame:
    """The k strongest risky (> 0) and safe (< 0) display words per document,
    scaled to 0-100 by the side's maximum."""
    df = df.withColumn(token, T.clean_token(token)).filter(T.is_real_word(token) & (col(value) != 0))
    df = df.withColumn("side", F.when(col(value) > 0, "risky").otherwise("safe"))
    order = [F.desc(F.abs(col(value))), F.asc(token)]
    w = W.partitionBy(by, "side").orderBy(*order)
    top = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    largest = F.max(F.abs(col(value))).over(W.partitionBy(by, "side"))
    return top.select(by, "side", "rank", token, value,
                      F.bround(100.0 * F.abs(col(value)) / largest, 1).alias("weight"))


def number_sources(df: DataFrame, by="query_id", score="rerank_score", tie=("doc_id", "chunk_index")) -> DataFrame:
    """Citation number n = 1.. in rerank order."""
    return df.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), *tie)))


def context_block(df: DataFrame, by="query_id") -> DataFrame:
    """Prompt context per query: numbered title and content, blank line between.

    Works on reranked rows (at most 20 per query).
    """
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")),
                       F.when(F.col("doc_id").cast("string") != "", F.col("doc_id").cast("string")),
                       F.concat(F.lit("Source "), F.col("n").cast("string")))
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), title, F.lit("\n"),
                     F.coalesce("content", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("n", block.alias("b"))))
    return df.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("context"))


def attribute_tokens(df: DataFrame, coef: DataFrame, by="doc_id", c="text") -> DataFrame:
    """Linear-model attribution per token: coef * (count - mean count).

    For a linear score this is the exact Shapley value.  ``coef``: token,
    coef, mean - the model vocabulary.
    """
    words = df.select(by, F.explode(T.text_tokens(F.lower(col(c)))).alias("token"))
    # words outside the vocabulary are dropped before anything is grouped
    known = words.join(coef.select("token"), "token", "left_semi")
    counts = known.groupBy(by, "token").agg(F.count("*").alias("n"))
    return counts.join(coef, "token").select(
        by, "token", (F.col("coef") * (F.col("n") - F.col("mean"))).alias("value"))


def rerank(cands: DataFrame, score=None, k=5, by="query_id", tie=("doc_id", "chunk_index")) -> DataFrame:
    """Score candidates, squash to 0..1 and keep the k best per query.

    ``score`` is a column (for example a pandas UDF around a cross-encoder);
    default is the number of query words found in the content, minus two.
    """
    if score is None:
        bag = lambda c: F.array_distinct(T.text_tokens(F.lower(col(c))))
        score = F.size(F.array_intersect(bag("query"), bag("content"))).cast("double") - 2.0
    ranked = cands.withColumn("rerank_score", sigmoid(score))
    return number_sources(ranked, by, tie=tie).filter(F.col("n") <= k)


def text_profile(df: DataFrame, c="text") -> DataFrame:
    """Word-count statistics of the normalised texts."""
    n = df.select(F.size(T.text_tokens(T.normalize_legacy(c))).alias("words"))
    q = F.percentile("words", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = n.agg(F.count("*").alias("n"), F.avg("words").alias("mean"), F.stddev("words").alias("std"),
                F.min("words").alias("min"), F.max("words").alias("max"), q.alias("q"),
                F.count_if(F.col("words") > 256).alias("over_256"), F.count_if(F.col("words") > 512).alias("over_512"))
    return out.select("n", "mean", "std", "min", F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p50"),
                      F.get("q", F.lit(2)).alias("p75"), "max", "over_256", "over_512")
