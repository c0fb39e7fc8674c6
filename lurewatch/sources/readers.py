"""Readers.  Everything stays a lazy, splittable Spark scan."""

from __future__ import annotations

import email
import email.policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurewatch import fixed
from lurewatch.functions.text import WS, html_to_text, strip
from lurewatch.operators.sampling import sample_n

REQUEST_LOG = ("ts TIMESTAMP, request_id STRING, path STRING, method STRING, status INT, "
               "latency_ms DOUBLE, user_id LONG, ip STRING")


def read_url_list(spark: SparkSession, path) -> DataFrame:
    """One URL per line; blank lines and ``#`` comments are dropped."""
    url = strip("value")
    return spark.read.text(path).select(url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_feeds(spark: SparkSession, paths) -> DataFrame:
    """Distinct http(s) URLs of one or more feed files."""
    lines = spark.read.text(paths).select(strip("value").alias("url"))
    return lines.filter(F.col("url").rlike("(?i)^https?://")).distinct()


def read_ranked_domains(spark: SparkSession, path, cap=None, seed=42) -> DataFrame:
    """``https://domain/`` from the Domain column, or the third one."""
    df = spark.read.option("header", True).csv(path)
    c = "Domain" if "Domain" in df.columns else df.columns[2]
    urls = df.select(F.concat(F.lit("https://"), F.lower(strip(c)), F.lit("/")).alias("url"))
    return sample_n(urls.distinct(), "url", cap, seed) if cap else urls


def read_csv_records(spark: SparkSession, path) -> DataFrame:
    """CSV with a header and line breaks inside quoted fields, read by many tasks per file.

    Spark splits the files at line feeds.  Whether a line begins inside a quoted field follows from the parity of
    the quotes before it: parities of splits are summed over the splits of a file (one row each), those of
    lines inside their split.  Lines are then put together to records, which Spark's CSV parser reads.

    Quotes stand around whole fields and are doubled inside them, as CSV writers do; a single quote inside an
    unquoted field shifts the records behind it (read such files with ``multiLine``).  Columns are strings; empty
    fields are null, blank lines are dropped, short records are filled with null, fields beyond the header are left out.
    Every file needs the header of the first one.  A file compressed as a whole is one split.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    value = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))).alias("quotes"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    upto = before.rowsBetween(W.unboundedPreceding, 0)
    skipped = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))

    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    splits = splits.select("file", "block", skipped("quotes").alias("open"))
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) + F.col("open")
    starts = lines.join(splits, ["file", "block"]).withColumn("starts", F.when(inside % 2 == 0, 1).otherwise(0))
    counts = starts.groupBy("file", "block").agg(F.sum("starts").alias("starts"))
    counts = counts.select("file", "block", skipped("starts").alias("skip"))
    numbered = starts.join(counts, ["file", "block"]).withColumn("record", F.sum("starts").over(upto) + F.col("skip"))

    joined = numbered.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("lines"))
    text = F.regexp_replace(F.concat_ws("\n", "lines.value"), "\r$", "")
    records = joined.filter("record > 1").select(text.alias("value")).filter("value <> ''")
    names = header.columns
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    fields = records.select(F.from_csv("value", schema, {"escape": '"'}).alias("r"))
    return fields.select(*[F.col(f"r._c{i}").alias(c) for i, c in enumerate(names)])


def read_mail_corpora(spark: SparkSession, paths, whole_files=False) -> DataFrame:
    """Labeled mail files with differing headers -> text, label.

    text_combined, else subject + body, else text; files without a label
    column are skipped.  Only the header line decides, no schema inference.
    ``whole_files`` reads each file in one task, for files with stray quotes.
    """
    out = None
    for path in paths:
        if whole_files:
            df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        else:
            df = read_csv_records(spark, path)
        have = {c.lower(): F.col(f"`{c}`") for c in df.columns}
        if "label" not in have:
            continue
        if "text_combined" in have:
            text = have["text_combined"]
        elif "body" in have:
            parts = [F.coalesce(have[c], F.lit("")) for c in ("subject", "body") if c in have]
            text = strip(F.concat_ws(" ", *parts))
        elif "text" in have:
            text = have["text"]
        else:
            continue
        part = df.select(text.alias("text"), have["label"].try_cast("int").alias("label"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no mail file with a label column")
    return out


def read_corpus(spark: SparkSession, path) -> DataFrame:
    """JSON array of documents."""
    return spark.read.schema("doc_id STRING, title STRING, source STRING, text STRING") \
        .option("multiLine", True).json(path)


def read_calibration(spark: SparkSession, path) -> DataFrame:
    """Model configuration -> knot table pos, x, y (and its threshold)."""
    cfg = spark.read.option("multiLine", True).schema(
        "features ARRAY<STRING>, threshold DOUBLE, calibration STRUCT<x ARRAY<DOUBLE>, y ARRAY<DOUBLE>>").json(path)
    knots = cfg.select("threshold", F.posexplode(F.arrays_zip("calibration.x", "calibration.y")).alias("pos", "k"))
    return knots.select("pos", F.col("k.x").alias("x"), F.col("k.y").alias("y"), "threshold")


def read_features(spark: SparkSession, path, columns=fixed.FEATURES_V1, label="phishing") -> DataFrame:
    """Feature matrix CSV -> the wanted columns as doubles, in order."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in [*columns, label] if c not in df.columns]
    if missing:
        raise ValueError(f"features missing from {path}: {missing}")
    extra = ["url"] if "url" in df.columns else []
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns],
                     F.col(label).cast("int").alias(label), *extra)


def read_table(spark: SparkSession, path, schema=None, jdbc=None) -> DataFrame:
    """A stored table: parquet by default, or a partitioned JDBC read.

    ``jdbc``: options with url, dbtable, partitionColumn, lowerBound,
    upperBound and numPartitions.
    """
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).load()
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_request_log(spark: SparkSession, folder, stream=False) -> DataFrame:
    """JSON-lines request log, as a batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST_LOG).json(folder)


# -------------------------------------------------------------------- mbox
def _parse_mail(raw):
    """Subject, sender, plain text and HTML of one mail; attachments are left out."""
    # the first line is the rest of the mbox "From " separator
    msg = email.message_from_bytes(raw.partition(b"\n")[2], policy=email.policy.default)
    bodies = [msg.get_body((kind,)) for kind in ("plain", "html")]
    return str(msg["Subject"] or ""), str(msg["From"] or ""), *[_content(b) if b else "" for b in bodies]


def _content(part):
    try:
        return part.get_content()
    except LookupError:     # a character set that is not known
        return part.get_payload(decode=True).decode("utf-8", errors="replace")


def read_mbox(spark: SparkSession, path) -> DataFrame:
    """Mail archive -> msg_idx, subject, from_hdr, body.

    The file is split by Spark at ``From `` lines, so one large archive is read
    by many tasks on any file system.  Bytes reach the parser unchanged.
    ``msg_idx`` numbers the messages of a file: rank inside a split plus the
    messages of earlier splits.
    """
    raw = spark.read.option("lineSep", "\nFrom ").text(path).select(
        F.col("value").cast("binary").alias("raw"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"))

    def parse(batches):
        for pdf in batches:
            rows = [_parse_mail(r) for r in pdf["raw"]]
            out = pd.DataFrame(rows, columns=["subject", "from_hdr", "plain", "markup"])
            for c in ("file", "block", "seq"):
                out[c] = pdf[c].to_numpy()
            yield out

    raw = raw.filter(F.col("raw").isNotNull() & (F.length("raw") > 0))
    mails = raw.mapInPandas(parse, "subject string, from_hdr string, plain string, markup string, file string, block long, seq long")
    return _number(mails.withColumn("body", F.when(F.col("plain") != "", F.col("plain")).otherwise(html_to_text("markup"))), raw)


def _number(df: DataFrame, raw: DataFrame) -> DataFrame:
    # counted before the mails are parsed
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = W.partitionBy("file", "block").orderBy("seq")
    return (df.join(sizes, ["file", "block"])
            .withColumn("msg_idx", F.row_number().over(inside) - 1 + F.col("skip"))
            .select("msg_idx", "subject", "from_hdr", "body", "file"))
