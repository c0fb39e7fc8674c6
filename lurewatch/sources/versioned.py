"""A keyed Parquet table with versions, for batch and streamed upserts.

Rows live in hash buckets of their key.  A commit writes the buckets that its keys touch into a
folder of its own and then one manifest row that says, for every bucket, which version holds it;
other buckets are neither read nor written.  A version can be read from the moment its manifest is
there, and a failed commit leaves nothing but a folder that the next attempt replaces.  A micro-batch that is
delivered again finds its number in the manifest and changes nothing.  Two writers at once: the second fails at
the manifest, which is never overwritten.

    path/data/v=<version>/bucket=<n>/part-*.parquet
    path/manifest/v=<version>/part-*.json
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.operators.sampling import first_per_key

BUCKETS = 64
MANIFEST = "version long, stream string, batch long, buckets int, `schema` string, holds map<string,long>"


def manifest(spark: SparkSession, path) -> DataFrame:
    """One row per committed version; empty for a table that does not exist yet."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest/v=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _state(spark, path, version=None):
    rows = manifest(spark, path)
    rows = rows if version is None else rows.filter(F.col("version") <= version)
    return rows.orderBy(F.desc("version")).first()


def _read(spark, path, holds, schema):
    """Rows of the given buckets (bucket -> version)."""
    if not holds:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/v={v}/bucket={b}" for b, v in sorted(holds.items())])


def read_version(spark: SparkSession, path, version=None) -> DataFrame:
    """The table as of a version, by default the newest."""
    state = _state(spark, path, version)
    if state is None:
        raise ValueError(f"{path} has no such version")
    return _read(spark, path, state.holds, state.schema)


def commit(updates: DataFrame, path, keys, order=None, buckets=BUCKETS, stream="", batch=None) -> int:
    """Add or replace rows by key; returns the version that holds them.

    Of several updates of one key the last by ``order`` counts (without it any).  Null keys are a key
    like any other.  ``batch`` numbers the commits of a ``stream``; a number not above the last one is skipped.
    The number of buckets is set by the first commit.
    """
    spark, keys = updates.sparkSession, list(keys)
    state = _state(spark, path)
    if batch is not None:
        last = manifest(spark, path).filter(F.col("stream") == stream).agg(F.max("batch")).first()[0]
        if last is not None and batch <= last:
            return state.version
    version, buckets = (state.version + 1, state.buckets) if state else (1, buckets)
    held = dict(state.holds) if state else {}
    number = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")
    schema = state.schema if state else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema.fields)
    new = first_per_key(updates, keys, [F.desc(order)]) if order is not None else updates.dropDuplicates(keys)
    new = new.select(*[f"`{f}`" for f in spark.createDataFrame([], schema).columns]).withColumn("bucket", number)
    touched = sorted(r.bucket for r in updates.select(number.alias("bucket")).distinct().collect())     # at most ``buckets``
    old = _read(spark, path, {str(b): held[str(b)] for b in touched if str(b) in held}, schema).withColumn("bucket", number)
    same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys] + [F.col("o.bucket") == F.col("n.bucket")]
    kept = old.alias("o").join(new.select("bucket", *[f"`{k}`" for k in keys]).alias("n"), same, "left_anti")
    if touched:
        new.unionByName(kept).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={version}")
    holds = held | {str(b): version for b in touched}
    row = spark.createDataFrame([(version, stream, batch, buckets, schema, holds)], MANIFEST)
    row.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest/v={version}")
    return version


def upsert_stream(rows: DataFrame, path, keys, order=None, name="stream", buckets=BUCKETS):
    """Stream writer that commits each micro-batch once; start it with a checkpoint location."""
    return rows.writeStream.outputMode("update").foreachBatch(
        lambda batch, number: commit(batch, path, keys, order, buckets, name, number) and None)
