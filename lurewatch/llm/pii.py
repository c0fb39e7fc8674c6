"""Personal data: base patterns and bootstrapped contextual extraction.

Base entities (email, ip, card, phone) are found by fixed patterns and checks.
They are the seeds.  Each identifier-like mention (a run of non-space characters
with a digit or an at sign) has lexical patterns: the word before it, the two
words before it, and the words around it.  Patterns and instances form a
bipartite graph.  Rounds of two aggregations score it until no pattern is added: an
instance is worth the noisy-or of its trusted patterns, seeds stay at 1; a pattern
is worth the mean score of its distinct seeds, discovered instances (from the second
round on) and values that are not shaped like identifiers, which score 0.  Unseen
identifier-shaped values count neither way.  Patterns with enough distinct seeds and
discovered instances and a high score mark further mentions as kind ``id``.

Native DataFrame operations.  Match positions come from lining up the matches
with the gaps that the same pattern leaves.  The patterns are written with
possessive quantifiers and start conditions so that a search is linear; they
match exactly what the plain forms match.  Edges are made distinct before they
are scored, scores are summed map-side, so a frequent context word or value is
no hot spot.

Defined cases: null and empty texts have no spans; equal rows have equal spans;
a value in a thousand copies counts once per context; other columns are not
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import sealed
from lurewatch.llm.common import keyed_text
from lurewatch.session import materialize

KINDS = ("email", "ip", "card", "phone")
SPACE = "\\x20\\x09-\\x0D"
# Linear forms of: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#                  [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#                  [0-9]([\x20-]?[0-9])+  of 16 to 19 digits
#                  \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){15,18}+(?![\\x20-]?[0-9])",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
MENTION = f"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
CONTEXT = 80            # characters beside a mention that hold its lexical pattern
MIN_SEEDS, MIN_SCORE = 5, 0.9
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, value) of the leftmost non-overlapping matches."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc, p):
        start = acc.at + F.length(p.g)
        end = start + F.length(p.h)
        return F.struct(end.alias("at"), F.concat(acc.spans, F.array(F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), p.h.alias("value")))).alias("spans"))

    return F.aggregate(pairs, first, step, lambda acc: acc.spans)


def luhn(value: Column) -> Column:
    """Check digit test of a string of digits with blanks and hyphens."""
    digits = F.filter(F.split(F.reverse(F.translate(value, " -", "")), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.get(F.array(*[F.lit((2 * k) // 10 + (2 * k) % 10) for k in range(10)]),
                                                                        d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    digits = F.length(F.regexp_replace(span.value, "[^0-9]", ""))
    if kind == "ip":   # leading zeros are allowed, parts at most 255
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(span.value, "\\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255)
                        .otherwise(False))
    if kind == "card":
        return luhn(span.value)
    if kind == "phone":
        return (digits >= 8) & (digits <= 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds one array of spans per base kind to (doc_id, text)."""
    none = F.array().cast(SPAN)
    found = {f"__{k}": F.when(F.col("text").rlike(NEEDS[k]), matches(F.col("text"), PATTERNS[k], k)).otherwise(none)
             for k in KINDS}
    rows = sealed(docs, docs.columns, found)
    return rows.select(*docs.columns, *[F.filter(f"__{k}", partial(_valid, k)).alias(f"__{k}") for k in KINDS])


def with_mentions(rows: DataFrame) -> DataFrame:
    """Replaces the text by its identifier-like mentions with their context words.

    A mention that a base span begins in stands for that span; one that only
    continues a span is left out.
    """
    gaps = F.split("text", MENTION, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:array<string>,after:string,seed:boolean>>")
    has = F.col("text").rlike("[0-9@]")
    rows = sealed(rows, rows.columns, {"__hits": F.when(has, matches(F.col("text"), MENTION, "id")).otherwise(F.array().cast(SPAN)),
                                       "__gaps": F.when(has, gaps).otherwise(F.array().cast("array<string>"))})
    rows = sealed(rows, [c for c in rows.columns if c != "text"], {"__base": F.concat(*[F.col(f"__{k}") for k in KINDS])})
    words = lambda s: F.filter(F.split(F.lower(s), f"[{SPACE}]+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")

    def mention(m, i):
        left = F.transform(F.slice(F.reverse(words(F.right(F.get("__gaps", i), F.lit(CONTEXT)))), 1, 2), bare)
        right = F.get(words(F.left(F.get("__gaps", i + 1), F.lit(CONTEXT))), F.lit(0))
        # identifiers are reported without the marks around them; a key before = or : is context
        key = F.regexp_extract(m.value, "^([\\p{L}_-]{2,}[=:])", 1)
        tail = F.length(F.regexp_extract(m.value, "[^\\p{L}\\p{N}]*$", 0))
        head = F.greatest(F.length(F.regexp_extract(m.value, "^[^\\p{L}\\p{N}]*", 0)), F.length(key))
        over = F.filter("__base", lambda b: (b.start < m.end) & (b.end > m.start))
        return F.struct((m.start + head).alias("start"), (m.end - tail).alias("end"),
                        F.substr(m.value, head + 1, F.length(m.value) - head - tail).alias("value"),
                        F.when(key != "", F.concat(F.array(F.lower(key)), left)).otherwise(left).alias("before"),
                        F.coalesce(bare(right), F.lit("")).alias("after"),
                        F.when(F.size(over) == 0, False).when(F.exists(over, lambda b: b.start >= m.start), True).alias("seed"))

    found = F.filter(F.transform("__hits", mention), lambda m: m.seed.isNotNull() & (m.end > m.start))
    return rows.withColumn("__mentions", F.when(F.size("__hits") > 0, found).otherwise(none)).drop("__hits", "__gaps", "__base")


def patterns_of(mention: Column) -> Column:
    """Lexical patterns of a mention: word before, two before, one on either side."""
    b = F.col(f"{mention}.before")
    one, two = F.coalesce(F.get(b, F.lit(0)), F.lit("")), F.coalesce(F.get(b, F.lit(1)), F.lit(""))
    return F.array(F.concat(one, F.lit(" _")), F.concat(two, F.lit(" "), one, F.lit(" _")),
                   F.concat(one, F.lit(" _ "), F.col(f"{mention}.after")))


def score_patterns(edges: DataFrame, rounds: int | None, min_seeds: int, min_score: float) -> DataFrame:
    """(pattern, trust) of trusted patterns from distinct (pattern, value, seed, shaped) edges.

    Seeds and discovered instances support a pattern, unseen values that are not
    shaped like identifiers speak against it, other unseen ones do neither.  A
    pattern keeps the trust it is admitted with; a discovered instance scores no
    less than ``min_score``, so further ones never make an admitted pattern unfit.
    Ends when a round adds no pattern, or after ``rounds``.
    """
    unseen = ~F.col("seed") & F.col("shaped")
    counts = edges.groupBy("pattern").agg(*[F.sum(c.cast("long")).alias(n) for n, c in (
        ("seeds", F.col("seed")), ("unseen", unseen), ("against", ~F.col("seed") & ~F.col("shaped")))])
    fits = lambda n, score: (n >= min_seeds) & (score >= min_score * (n + F.col("against")))
    # the others stay below the bounds even if all their unseen values are found
    able = F.col("seeds") + F.col("unseen")
    counts = materialize(counts.filter(fits(able, able)), "patterns")
    open_ = materialize(edges.filter(unseen).select("pattern", "value").join(counts.select("pattern"), "pattern"), "unseen")
    trusted = materialize(counts.filter(fits(F.col("seeds"), F.col("seeds"))).select(
        "pattern", (F.col("seeds") / (F.col("seeds") + F.col("against"))).alias("trust")), "trusted")
    added, k = trusted.count(), 1
    while added and (rounds is None or k < rounds):
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))
        values = open_.join(trusted, "pattern").groupBy("value").agg((1 - doubt).alias("found"))
        support = open_.join(trusted, "pattern", "left_anti").join(values, "value").groupBy("pattern").agg(
            F.sum("found").alias("found"), F.count("*").alias("n"))
        n, score = F.col("seeds") + F.col("n"), F.col("seeds") + F.col("found")
        more = materialize(counts.join(support, "pattern").filter(fits(n, score)).select(
            "pattern", (score / (n + F.col("against"))).alias("trust")), "trusted")
        added, k = more.count(), k + 1
        trusted = trusted.unionByName(more)
    return trusted


def find_pii(docs: DataFrame, key="doc_id", text="text", rounds: int | None = None, min_seeds: int = MIN_SEEDS,
             min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, text_hash and ``spans`` (kind, start, end, value), base kinds first, of every row."""
    rows = keyed_text(docs, key, text).withColumn("text_hash", F.xxhash64("text"))
    rows = materialize(with_mentions(base_spans(rows)), "pii")      # small: spans only, read twice
    mentions = rows.select("doc_id", "text_hash", F.explode("__mentions").alias("m")).select(
        "doc_id", "text_hash", "m.start", "m.end", "m.value", "m.seed", patterns_of("m").alias("patterns"))
    # only mentions that look like identifiers: six characters, two digits
    shaped = F.col("value").rlike("^[^\\s]*[0-9][^\\s]*[0-9][^\\s]*$") & (F.length("value") >= 6)
    edges = materialize(mentions.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(
        F.max("seed").alias("seed")).withColumn("shaped", shaped), "edges")
    trusted = score_patterns(edges, rounds, min_seeds, min_score)
    shaped = mentions.filter(~F.col("seed") & shaped).select(
        "doc_id", "text_hash", "start", "end", "value", F.explode("patterns").alias("pattern"))
    new = shaped.join(trusted, "pattern").select("doc_id", "text_hash", F.struct(
        F.lit("id").alias("kind"), "start", "end", "value").alias("span")).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("span")).alias("new"))
    base = F.concat(*[F.col(f"__{k}") for k in KINDS])
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    return rows.alias("a").join(new.alias("b"), same, "left").select(
        "a.doc_id", "a.text_hash", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"),
        F.concat(base, F.coalesce(F.col("new"), F.array().cast(SPAN))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its kind in brackets; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("minus"), s.kind.alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s.start >= acc.at
        out = F.when(fresh, F.concat(acc.out, F.substr(text, acc.at + 1, s.start - acc.at),
                                     F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, -s.minus).alias("at"), out.alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        ordered, first, step, lambda a: F.concat(a.out, F.substr(text, a.at + 1, F.length(text)))))


def redact(docs: DataFrame, key="doc_id", text="text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind; the column ``length``, if there is one, follows."""
    found = find_pii(docs, key, text).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__found"), F.col("spans").alias("__spans"))
    rows = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__found"))
    out = rows.join(found, same, "left").withColumn(text, F.when(F.col("__spans").isNull(), F.col(f"`{text}`")).otherwise(
        redacted(F.col(f"`{text}`"), F.col("__spans"))))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col("__spans").isNull(), F.col(f"`{length}`")).otherwise(
            F.length(F.col(f"`{text}`"))).cast(docs.schema[length].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op2_pii_bootstrap(spark, sf_dir):
    """Base and discovered spans of every document."""
    from lurewatch.llm.common import documents
    found = find_pii(documents(spark, sf_dir))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_id"))
