"""A stored inverted-list index over vectors.

    path/cells     one row per cell: cell, center, n
    path/vectors   the rows, one folder per cell (``cell=<n>``), files of bounded length

Cells come from k-means on a bounded sample (``fit_rows``); every row is indexed.  A cell that holds a
third of all rows becomes many files.  A search reads only the folders of the cells that its queries probe.
Queries that fit one matrix travel to the files; larger query sets meet the files of their cells in groups
of bounded size on both sides.  Both ways score the same pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.operators import vectors as V
from lurewatch.operators.sampling import sample_n

ROWS_PER_FILE = 250_000
MAX_CENTER_BYTES = 64 << 20


def _cell_of(centers, probe=1):
    """The ``probe`` nearest cells of a unit vector; the smaller number on ties."""
    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        sims = V._unit(vectors) @ centers.value.T if len(vectors) else np.empty((0, 1))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :probe].astype("int32")
        return pd.Series(list(order), index=vectors.index)
    return near


def build_index(corpus: DataFrame, path, lists=None, fit_rows=100_000, seed=42, id_col="vec_id", vec_col="embedding",
                rows_per_file=ROWS_PER_FILE) -> None:
    """Write the index of all rows that have a vector, other columns included.

    ``lists`` is the number of cells, by default the root of the number of rows; k-means may settle on fewer.
    The centers must fit ``MAX_CENTER_BYTES``.  Columns called cell or slice_ are refused.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    taken = {"cell", "slice_"} & {c.lower() for c in corpus.columns}
    if taken:
        raise ValueError(f"column names in use by the index: {sorted(taken)}")
    spark = corpus.sparkSession
    rows = corpus.filter(F.col(vec_col).isNotNull())
    n, width = rows.agg(F.count("*"), F.max(F.size(vec_col))).first()
    if not n:
        raise ValueError("no vectors to index")
    lists = lists or max(1, math.isqrt(n))
    if lists * width * 8 > MAX_CENTER_BYTES:
        raise ValueError(f"{lists} centers of {width} numbers exceed {MAX_CENTER_BYTES} bytes; ask for fewer lists")
    if lists > 1:
        sample = sample_n(rows.select(id_col, vec_col), id_col, fit_rows, seed)
        model = KMeans(k=lists, seed=seed, distanceMeasure="cosine").fit(sample.select(array_to_vector(V.l2_normalize(vec_col)).alias("features")))
        centers = V._unit(model.clusterCenters())
    else:
        centers = np.zeros((1, width))
    shared = spark.sparkContext.broadcast(centers)
    placed = rows.withColumn("cell", F.get(_cell_of(shared)(vec_col), F.lit(0)))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    found = {r.cell: r.n for r in sizes.collect()}      # at most ``lists`` rows
    slices = spark.createDataFrame([(c, -(-m // rows_per_file)) for c, m in found.items()], "cell int, slices int")
    dealt = placed.join(F.broadcast(slices), "cell").withColumn("slice_", F.pmod(F.xxhash64(id_col), F.col("slices")).cast("int"))
    (dealt.drop("slices").repartition("cell", "slice_").write.mode("overwrite")
     .partitionBy("cell", "slice_").parquet(f"{path}/vectors"))
    cells = [(i, [float(x) for x in c], found.get(i, 0)) for i, c in enumerate(centers)]
    spark.createDataFrame(cells, "cell int, center array<double>, n long").write.mode("overwrite").parquet(f"{path}/cells")


def probed_vectors(spark: SparkSession, path, cells) -> DataFrame:
    """The rows of some cells; only their folders are read."""
    return spark.read.parquet(f"{path}/vectors").filter(F.col("cell").isin(list(cells)))


def search_index(queries: DataFrame, path, k=20, probe=8, query_id="query_id", id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Top k of the rows in the ``probe`` cells nearest to each query: query_id, id, vector_score, rank.

    Equal scores go by id.  With ``probe`` at the number of cells the result is exact.  Queries without a vector have no rows.
    """
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()    # bounded when the index was built
    centers = np.array([c.center for c in cells])
    probe = min(probe, len(cells))
    queries = queries.filter(F.col(vec_col).isNotNull()).select(query_id, vec_col)
    # keys of queries are distinct by contract; the nearest cells are found where the queries lie
    probes = queries.withColumn("cells", _cell_of(spark.sparkContext.broadcast(centers), probe)(vec_col))
    wanted = [r.cell for r in probes.select(F.explode("cells").alias("cell")).distinct().collect()]     # at most ``lists``
    rows = probed_vectors(spark, path, wanted).select(id_col, vec_col, "cell", "slice_")
    schema = V._schema(rows, id_col, queries.schema[query_id].dataType)
    if not wanted:
        return V._merge(spark.createDataFrame([], schema), id_col, k)
    size = V._bytes(queries, vec_col)
    if size <= V.MAX_QUERY_BYTES:
        return V._merge(_scan_cells(probes, rows, query_id, id_col, vec_col, k, schema, len(cells)), id_col, k)
    return V._merge(_meet_cells(probes, rows, query_id, id_col, vec_col, k, schema, -(-size // V.MAX_QUERY_BYTES)), id_col, k)


def probe_for_recall(queries: DataFrame, path, k=20, target=0.9, query_id="query_id", id_col="vec_id", vec_col="embedding") -> int:
    """The smallest ``probe`` with which the given queries find at least ``target`` of their exact top k.

    The exact neighbours are searched once by brute force; a neighbour is found as soon as its cell is
    probed, so the shares of all values of ``probe`` follow from the place of its cell in the query's order.
    """
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    rows = spark.read.parquet(f"{path}/vectors").select(id_col, vec_col, "cell")
    queries = queries.filter(F.col(vec_col).isNotNull()).select(query_id, vec_col)
    near = _cell_of(spark.sparkContext.broadcast(np.array([c.center for c in cells])), len(cells))
    order = queries.select(F.col(query_id).alias("query_id"), near(vec_col).alias("cells"))
    truth = V.knn(queries, rows.drop("cell"), k, query_id, id_col, vec_col).select("query_id", id_col)
    home = truth.join(rows.select(F.col(id_col).alias(id_col), F.col("cell").alias("home")), id_col).join(order, "query_id")
    places = home.groupBy(F.array_position("cells", F.col("home")).alias("place")).count().orderBy("place").collect()  # <= cells
    total, seen = sum(r["count"] for r in places), 0
    for r in places:
        seen += r["count"]
        if seen >= target * total:
            return int(r.place)
    return len(cells)


def _scan_cells(probes, rows, query_id, id_col, vec_col, k, schema, n_cells):
    got = probes.orderBy(query_id).collect()        # size-checked
    ids, q = [r[0] for r in got], V._unit([r[1] for r in got])
    asks = [[] for _ in range(n_cells)]
    for i, r in enumerate(got):
        for c in r.cells:
            asks[c].append(i)
    shared = rows.sparkSession.sparkContext.broadcast((ids, q, [np.array(a, dtype=int) for a in asks]))

    def search(batches):
        ids, q, asks = shared.value
        best = V._Best(len(ids), k)
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                best.add_dot(q, V._unit(part[vec_col]), part[id_col].to_numpy(), asks[cell])
        yield best.rows(ids, id_col)

    return rows.drop("slice_").mapInPandas(search, schema)


def _meet_cells(probes, rows, query_id, id_col, vec_col, k, schema, blocks):
    """Query blocks against slices of cells, each pair of them in one task."""
    slices = rows.select(F.col("cell").alias("cell"), F.col("slice_").alias("slice_")).distinct()
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int")
    left = probes.select(F.col(query_id).alias("query_id"), F.col(vec_col).alias("q"), block.alias("qb"), F.explode("cells").alias("cell"))
    left = left.join(slices, "cell")
    right = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"))

    def search(q, c):
        best = V._Best(len(q), k)
        if len(q) and len(c):
            best.add_dot(V._unit(q["q"]), V._unit(c[vec_col]), c[id_col].to_numpy())
        return best.rows(q["query_id"].to_numpy(), id_col)

    keys = ["cell", "slice_", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)
