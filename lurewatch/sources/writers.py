"""Writers and keyed updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lurewatch.operators.sampling import first_per_key
from lurewatch.operators.scans import audit_rows
from lurewatch.session import materialize


def write_quoted_csv(df: DataFrame, path, mode="overwrite"):
    """CSV with a header and every field quoted; line breaks become blanks."""
    text = {c: F.regexp_replace(c, r"[\r\n]+", " ") for c, t in df.dtypes if t == "string"}
    df.withColumns(text).write.mode(mode).option("header", True).option("quoteAll", True) \
        .option("escape", '"').option("emptyValue", "").csv(path)


def write_report(df: DataFrame, path, mode="overwrite"):
    """Nested rows as JSON lines."""
    df.write.mode(mode).json(path)


def write_request_log(df: DataFrame, folder, mode="append"):
    df.write.mode(mode).json(folder)


def stored(spark: SparkSession, path, schema):
    """A stored parquet table, empty if it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def missing_rows(df: DataFrame, done: DataFrame, key) -> DataFrame:
    """Rows whose key has not been stored; the first of repeated keys."""
    return df.dropDuplicates([key]).join(done.select(key), key, "left_anti")


def append_missing(df: DataFrame, path, key):
    """Append only rows whose key is not stored yet.  Can be re-run after a
    failure: finished rows are skipped."""
    done = stored(df.sparkSession, path, df.schema)
    missing_rows(df, done, key).write.mode("append").parquet(path)


def upsert(target: DataFrame, updates: DataFrame, keys, order=None) -> DataFrame:
    """Target with the update rows replaced or added.

    If a key is updated twice the last row by ``order`` counts.
    """
    if order is not None:
        updates = first_per_key(updates, list(keys), [F.desc(order)])
    return updates.unionByName(target.join(updates.select(*keys), list(keys), "left_anti"))


def upsert_table(updates: DataFrame, path, keys, order=None):
    """Upsert into a parquet table.

    Parquet has no MERGE, so the new state is written to the scratch folder
    first and then replaces the table; the staged copy survives a failure in
    between.
    """
    spark = updates.sparkSession
    merged = upsert(stored(spark, path, updates.schema), updates, keys, order)
    materialize(merged, "upsert").write.mode("overwrite").parquet(path)


def append_scans(df: DataFrame, path):
    df.write.mode("append").parquet(path)


def append_audit(df: DataFrame, path, max_chars=None):
    audit_rows(df, max_chars).write.mode("append").parquet(path)
