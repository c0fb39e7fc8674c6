"""Proportional stratified interleaving of a corpus into shards.

Rows of each source are shuffled by a seeded hash and ranked; the fractional
rank ``(rank + 1/2) / rows of the source`` spreads every source evenly over
[0, 1).  Sorted by it and cut into equal counts, each shard has the mixture of
the whole.  Law: ``rows`` (shard sizes differ by one row at most).

Native DataFrame operations.  No rank is computed in one task: hash prefixes
split each source, slices of the fractional rank split the whole, and only the
small tables of group counts are summed up in order.

Defined cases: a null source is a source of its own; equal rows, also equal
keys, each get a slot; null text has size 1 and checksum 0; with fewer rows than
shards some shards stay empty; an empty table gives an empty result; given
columns are kept, helper columns begin with ``__``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 16, "interleave-1"
GROUP_ROWS = 200_000   # rows aimed at per rank group


def _rank(rows: DataFrame, group: list[str], part: str, order: list, name: str) -> DataFrame:
    """Adds the position within ``group`` where ``part`` is a monotone prefix of the order."""
    counts = rows.groupBy(*group, part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*group, part).orderBy(*order)
    ranked = rows.withColumn("__k", F.row_number().over(inner) - 1).join(bases, [*group, part])
    return ranked.withColumn(name, F.col("__base") + F.col("__k")).drop("__base", "__k")


def interleave(docs: DataFrame, key="doc_id", source="source", shards: int = SHARDS, seed: str = SEED,
               ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``shard`` and ``slot``; ``ties`` are columns that order rows of one key."""
    n = docs.count()       # from the file footers
    digits = max(2, -(-max(n // GROUP_ROWS, 1).bit_length() // 4))
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.col(f"`{key}`").cast("string")))
    rows = docs.withColumns({
        # prefixed, so that null and the empty name differ
        "__source": F.when(F.col(f"`{source}`").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(f"`{source}`").cast("string"))),
        "__hash": hashed, "__prefix": F.substring(hashed, 1, digits)})
    order = ["__hash", F.col(f"`{key}`"), *ties]
    rows = _rank(rows, ["__source"], "__prefix", order, "__rank")
    totals = docs.groupBy(F.when(F.col(f"`{source}`").isNull(), "0").otherwise(
        F.concat(F.lit("1"), F.col(f"`{source}`").cast("string"))).alias("__source")).agg(F.count("*").alias("__total"))
    slices = 16 ** digits
    fraction = (F.col("__rank") * 2 + 1).cast("double") / (F.col("__total") * 2).cast("double")
    rows = rows.join(totals, "__source").withColumn("__fraction", fraction).withColumns({
        "__slice": F.floor(F.col("__fraction") * slices).cast("long"), "__all": F.lit(0)})
    rows = _rank(rows, ["__all"], "__slice", ["__fraction", "__source"], "__place")
    shard = F.expr(f"__place * {shards} div {max(n, 1)}")
    return rows.withColumn("shard", shard.cast("int")).withColumn(
        "slot", F.col("__place") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).select(
        *[f"`{c}`" for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_stratified_shards(spark, sf_dir):
    """Shard and slot of every document; the texts stay out of the shuffles."""
    from lurewatch.llm.common import documents
    t = F.coalesce(F.col("text"), F.lit("")).cast("string")
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    return interleave(rows, ties=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source")


# The checksum is reduced byte by byte with the usual table of the reflected polynomial.
ORACLE = """
WITH bits AS (SELECT n, list_reduce([n] || list_transform(range(8), lambda k: 0::BIGINT),
        lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a // 2) ELSE a // 2 END) AS c FROM range(256) t(n)),
crc AS (SELECT list(c ORDER BY n) AS tbl FROM bits),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, md5('interleave-1|' || doc_id) AS h FROM documents),
e AS (SELECT *, octet_length(encode(text)) + 1 AS size, xor(4294967295::BIGINT, list_reduce(
        [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
        lambda a, b: xor(a // 256, tbl[xor(a % 256, b) + 1]))) AS crc FROM d, crc),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, crc) - 1) * 2 + 1 AS k,
        count(*) OVER (PARTITION BY source) * 2 AS m, count(*) OVER () AS n FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY k::DOUBLE / m::DOUBLE, source NULLS FIRST) - 1 AS place FROM r)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (place * 16 // n)::INT AS shard,
 (place - ((place * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM p"""
