"""Word look-ups in sub-domains with a dictionary table of any length.

Distinct sub-domains give distinct tokens; each token's substrings are joined with the words
once, and the flags are folded back per sub-domain.  Rows meet the result by their sub-domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions.common import col

LEAST_INSIDE = 4        # a shorter word must be the whole token
SHORT = 3               # shorter tokens are not judged
SPREAD = 1024


def read_words(spark: SparkSession, path) -> DataFrame:
    """(word) of a word file, one entry a line; comments and blanks are left out."""
    return word_table(spark.read.text(path).filter("not startswith(trim(value), '#')"), "value")


def word_table(df: DataFrame, word="word") -> DataFrame:
    return df.select(F.lower(F.trim(col(word))).alias("word")).filter("word <> ''").distinct()


def token_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Of the distinct ``token`` column: those that are, or contain, a word."""
    sizes = words.filter(F.length("word") >= LEAST_INSIDE).agg(
        F.coalesce(F.min(F.length("word")), F.lit(0)).alias("low"), F.coalesce(F.max(F.length("word")), F.lit(0)).alias("high"))   # one row
    low, high = F.col("low"), F.col("high")
    size = F.length("token")
    lengths = F.when((low > 0) & (size >= low), F.sequence(low, F.least(high, size))).otherwise(F.array())
    inside = F.flatten(F.transform(lengths, lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda at: F.substring("token", at, n))))
    parts = tokens.crossJoin(F.broadcast(sizes)).select("token", F.explode(F.array_distinct(F.concat(F.array("token"), inside))).alias("word"))
    return parts.join(words, "word", "left_semi").select("token").distinct()


def nonword_table(subs: DataFrame, words: DataFrame, tokens_of) -> DataFrame:
    """(sub, tokens, nonwords) of the distinct values of column ``sub``; ``tokens_of`` splits a column."""
    plain = F.transform(tokens_of(F.col("sub")), lambda t: F.regexp_replace(t, r"[^\p{L}]", ""))
    rows = subs.select("sub").filter("sub <> ''").distinct().select("sub", F.explode(plain).alias("token"))
    known = token_words(rows.select("token").filter(F.length("token") >= SHORT).distinct(), words).withColumn("known", F.lit(True))
    good = (F.length("token") < SHORT) | F.coalesce("known", F.lit(False))
    return rows.join(known, "token", "left").groupBy("sub").agg(
        F.count("*").alias("tokens"), F.count_if(~good).alias("nonwords"))


def with_nonwords(df: DataFrame, sub, words: DataFrame, tokens_of, out_tokens, out_nonwords) -> DataFrame:
    """Add token counts of a sub-domain column.

    Most rows have no sub-domain; their join key is spread, so that they do not meet in one task.
    """
    found = nonword_table(df.select(col(sub).alias("sub")), words, tokens_of).select(
        F.col("sub").alias("_nw_sub"), F.col("tokens").alias(out_tokens), F.col("nonwords").alias(out_nonwords))
    spread = F.concat(F.lit(" "), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))
    rows = df.withColumn("_nw_key", F.when(F.coalesce(col(sub), F.lit("")) == "", spread).otherwise(col(sub)))
    return rows.join(found, F.col("_nw_key") == F.col("_nw_sub"), "left").drop("_nw_key", "_nw_sub").fillna(0, [out_tokens, out_nonwords])
