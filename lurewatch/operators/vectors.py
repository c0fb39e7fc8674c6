"""Nearest chunks by cosine similarity.

A query batch that fits one matrix travels to the corpus, which is then not
shuffled at all: each task multiplies its Arrow batches with the query matrix
and keeps a running top k per query, so it emits k rows per query, not all
pairs.  Larger query sets are joined with the corpus in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.functions.common import col

MAX_QUERY_BYTES = 64 << 20  # query vectors that may be broadcast, or of one block
MAX_CORPUS_BYTES = 256 << 20  # corpus vectors of one block


def dot(a, b) -> Column:
    prod = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(c) -> Column:
    return F.sqrt(F.aggregate(col(c), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity of two array columns, in double precision."""
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(c) -> Column:
    """Unit-length vector; the norm is computed once per row."""
    unit = lambda n: F.transform(col(c), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))
    return F.get(F.transform(F.array(norm(c)), unit), F.lit(0))


def _unit(rows):
    m = np.vstack([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _schema(corpus, id_col, query_id_type):
    return T.StructType([T.StructField("query_id", query_id_type),
                         T.StructField(id_col, corpus.schema[id_col].dataType),
                         T.StructField("vector_score", T.DoubleType())])


class _Best:
    """Running top k per query over batches of corpus vectors; the smaller id on equal scores.

    Scores exist in tiles of ``TILE`` entries only.  Of a tile, the entries that are at least as good as the
    k-th best so far, and as the k-th best of their tile, are merged with the best so far in one sort.
    """

    TILE = 1 << 21

    def __init__(self, n, k):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.name = np.empty((n, k), dtype=object)

    def add_dot(self, q, m, names, rows=None, allowed=None):
        """Score the vectors ``m`` against ``q``, or its ``rows``; ``allowed(rows, columns)`` masks pairs."""
        rows = np.arange(len(q)) if rows is None else rows
        wide = min(len(m), 4096) or 1
        tall = max(1, self.TILE // wide)
        for top in range(0, len(rows), tall):
            part = rows[top:top + tall]
            for left in range(0, len(m), wide):
                sims = q[part] @ m[left:left + wide].T
                if allowed is not None:
                    sims = np.where(allowed(part, slice(left, left + wide)), sims, -np.inf)
                self._add(part, sims, names[left:left + wide])

    def _add(self, part, sims, names):
        k = self.k
        edge = self.score[part, -1]
        if sims.shape[1] > k:
            edge = np.maximum(edge, np.partition(sims, -k, axis=1)[:, -k])
        r, c = np.nonzero((sims >= edge[:, None]) & (sims > -np.inf))
        if not len(r):
            return
        hit = np.unique(r)
        held_r, held_c = np.nonzero(self.score[part[hit]] > -np.inf)
        held = part[hit][held_r], held_c
        row = np.concatenate([hit[held_r], r])
        score = np.concatenate([self.score[held], sims[r, c]])
        name = np.concatenate([self.name[held], names[c].astype(object)])
        order = np.lexsort((pd.factorize(name, sort=True)[0], -score, row))
        row, score, name = row[order], score[order], name[order]
        at = np.arange(len(row)) - np.searchsorted(row, row)
        keep = at < k
        self.score[part[hit]], self.name[part[hit]] = -np.inf, None
        where = part[row[keep]], at[keep]
        self.score[where], self.name[where] = score[keep], name[keep]

    def rows(self, ids, id_col):
        r, j = np.nonzero(self.score > -np.inf)
        out = {"query_id": [ids[i] for i in r], id_col: self.name[r, j], "vector_score": self.score[r, j]}
        return pd.DataFrame(out, columns=["query_id", id_col, "vector_score"])


def _scan(corpus, id_col, vec_col, ids, queries, k, schema, cells=None, probes=None):
    """Top k per query and corpus partition; the query matrix is broadcast."""
    shared = corpus.sparkSession.sparkContext.broadcast((ids, queries, cells, probes))

    def search(batches):
        ids, q, cells, probes = shared.value
        best = _Best(len(ids), k)
        for pdf in batches:
            if not len(pdf):
                continue
            m, allowed = _unit(pdf[vec_col]), None
            if cells is not None:
                home = np.argmax(m @ cells.T, axis=1)
                allowed = lambda rows, columns: probes[rows][:, home[columns]]
            best.add_dot(q, m, pdf[id_col].to_numpy(), allowed=allowed)
        yield best.rows(ids, id_col)

    return corpus.select(id_col, vec_col).mapInPandas(search, schema)


def _blocks(queries, corpus, query_id, id_col, vec_col, k, schema, sizes):
    """Top k per query and corpus block, for query sets too large to broadcast.

    Both sides are cut by a hash of their id into blocks of bounded size, so
    copies of one vector do not meet in one block; every query block meets
    every corpus block once.
    """
    n_q, n_c = sizes
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col(query_id).alias("query_id"), F.col(vec_col).alias("q"),
                          block(query_id, n_q).cast("int").alias("qb"), each(n_c).alias("cb"))
    right = corpus.select(id_col, vec_col, block(id_col, n_c).cast("int").alias("cb"), each(n_q).alias("qb"))

    def search(q, c):
        best = _Best(len(q), k)
        if len(q) and len(c):
            best.add_dot(_unit(q["q"]), _unit(c[vec_col]), c[id_col].to_numpy())
        return best.rows(q["query_id"].to_numpy(), id_col)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(search, schema)


def _bytes(df, vec_col):
    return df.agg(F.sum(F.size(vec_col).cast("long") * 8)).first()[0] or 0


def _fetch(queries, query_id, vec_col):
    rows = queries.select(query_id, vec_col).orderBy(query_id).collect()  # size-checked
    return [r[0] for r in rows], _unit([r[1] for r in rows])


def _merge(out, id_col, k):
    w = W.partitionBy("query_id").orderBy(F.desc("vector_score"), id_col)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k=20, query_id="query_id", id_col="vec_id",
        vec_col="embedding") -> DataFrame:
    """Exact top k per query: query_id, id, vector_score, rank."""
    schema = _schema(corpus, id_col, queries.schema[query_id].dataType)
    size = _bytes(queries, vec_col)
    if size > MAX_QUERY_BYTES:
        sizes = -(-size // MAX_QUERY_BYTES), max(1, -(-_bytes(corpus, vec_col) // MAX_CORPUS_BYTES))
        return _merge(_blocks(queries, corpus, query_id, id_col, vec_col, k, schema, sizes), id_col, k)
    if not size:
        return _merge(corpus.sparkSession.createDataFrame([], schema), id_col, k)
    ids, q = _fetch(queries, query_id, vec_col)
    return _merge(_scan(corpus, id_col, vec_col, ids, q, k, schema), id_col, k)


def ann(queries: DataFrame, corpus: DataFrame, k=20, lists=16, probe=4, seed=42, fit_rows=100_000,
        query_id="query_id", id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Approximate top k: only corpus vectors in the ``probe`` cells nearest to
    a query are scored.

    Cells come from k-means on a sample (the index-building step).  Corpus rows
    find their cell while they are scanned, so a cell that holds a third of the
    corpus is still spread over all tasks.  ``probe == lists`` is exact; so is
    the block join that answers query sets too large to broadcast.
    """
    if not 0 < _bytes(queries, vec_col) <= MAX_QUERY_BYTES:
        return knn(queries, corpus, k, query_id, id_col, vec_col)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from lurewatch.operators.sampling import sample_n

    sample = sample_n(corpus.select(id_col, vec_col), id_col, fit_rows, seed)
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine").fit(
        sample.select(array_to_vector(vec_col).alias("features")))
    cells = _unit(model.clusterCenters())
    schema = _schema(corpus, id_col, queries.schema[query_id].dataType)
    ids, q = _fetch(queries, query_id, vec_col)
    near = np.argsort(-(q @ cells.T), axis=1)[:, :probe]
    probes = np.zeros((len(ids), len(cells)), dtype=bool)
    np.put_along_axis(probes, near, True, axis=1)
    return _merge(_scan(corpus, id_col, vec_col, ids, q, k, schema, cells, probes), id_col, k)


def recall(found: DataFrame, truth: DataFrame, id_col="vec_id") -> DataFrame:
    """Share of the exact neighbours that were found."""
    hit = truth.join(found.select("query_id", id_col), ["query_id", id_col], "left_semi")
    n = truth.agg(F.count("*").alias("n")).scalar()
    return hit.agg((F.count("*") / n).alias("recall"))
