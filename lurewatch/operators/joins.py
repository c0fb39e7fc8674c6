"""Joins: enrichment, ranges, chains, grids and look-ups.

Range joins are turned into equi-joins on cells or network prefixes; look-up
keys are reduced to distinct values before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurewatch import fixed
from lurewatch.dims import Dims
from lurewatch.functions import hosts as H
from lurewatch.functions import urls as U
from lurewatch.functions.calc import age_days, safe_div
from lurewatch.functions.common import col, sealed, strings
from lurewatch.session import materialize

# A side is broadcast only if its row count is known to stay below this.
BROADCAST_ROWS = 200_000


# -------------------------------------------------------------- plain joins
def left_anti(df: DataFrame, other: DataFrame, key) -> DataFrame:
    """Rows whose key is not in ``other``."""
    return df.join(other.select(key), key, "left_anti")


def recent_scans(scans: DataFrame, users: DataFrame, n=10) -> DataFrame:
    """Newest n scans with the user name; scans of unknown users do not count.

    Each user's newest n are found first (a literal row bound, applied before
    the shuffle), so at most n scans per user reach the join, not the table.
    """
    w = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    few = scans.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    named = few.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
    return (named.select("id", "username", "scan_type", "result", "confidence", "created_at")
            .orderBy(F.desc("created_at"), F.desc("id")).limit(n))


def parity(a: DataFrame, b: DataFrame, key="url", flag="is_phishing", p="p") -> DataFrame:
    """One row: compared, missing, mismatches and largest probability gap."""
    left = a.select(key, F.col(flag).alias("fa"), F.col(p).alias("pa"))
    right = b.select(key, F.col(flag).alias("fb"), F.col(p).alias("pb"))
    both = left.join(right, key, "full_outer")
    missing = F.col("fa").isNull() | F.col("fb").isNull()
    out = both.agg(F.count("*").alias("compared"), F.count_if(missing).alias("missing"),
                   F.count_if(missing | (F.col("fa") != F.col("fb"))).alias("mismatches"),
                   F.coalesce(F.max(F.abs(F.col("pa") - F.col("pb"))), F.lit(0.0)).alias("max_dp"))
    return out.withColumn("parity", F.col("mismatches") == 0)


# -------------------------------------------------------------- calibration
def segments(knots: DataFrame, cells=512) -> DataFrame:
    """Calibration knots (x, y) -> straight pieces, one row per covered cell."""
    span = knots.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    nxt = W.orderBy("x")  # knot tables have a few hundred rows
    seg = (knots.select("x", "y", F.lead("x").over(nxt).alias("x1"), F.lead("y").over(nxt).alias("y1"))
           .filter("x1 > x"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    seg = seg.withColumns({"lo": lo, "hi": hi})
    return seg.withColumn("cell", F.explode(F.sequence(
        _cell("x", cells), _cell("x1", cells)))).select("cell", "x", "y", "x1", "y1")


def _cell(c, cells) -> Column:
    share = (col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return F.least(F.greatest(F.floor(share * cells), F.lit(0)), F.lit(cells - 1)).cast("int")


def calibrate(df: DataFrame, knots: DataFrame, p="p", out="calibrated", cells=512) -> DataFrame:
    """Piecewise-linear interpolation, clamped at both ends.

    A range join written as a broadcast equi-join: the x axis is cut into
    cells, a score only meets the one or two pieces that touch its cell.
    ``knots`` is a model file (hundreds of rows).
    """
    ends = knots.agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                     F.min_by("y", "x").alias("y_lo"), F.max_by("y", "x").alias("y_hi"))
    cols = {n: ends.select(n).scalar() for n in ("lo", "hi", "y_lo", "y_hi")}
    rows = df.withColumns(cols).withColumn("cell", _cell(p, cells))
    seg = F.broadcast(segments(knots, cells)).alias("s")
    inside = ((F.col("d.cell") == F.col("s.cell")) & (F.col(f"d.{p}") >= F.col("s.x"))
              & (F.col(f"d.{p}") < F.col("s.x1")) & (F.col(f"d.{p}") > F.col("d.lo")) & (F.col(f"d.{p}") < F.col("d.hi")))
    joined = rows.alias("d").join(seg, inside, "left")
    value = (F.when(F.col(f"d.{p}") <= F.col("d.lo"), F.col("d.y_lo"))
             .when(F.col(f"d.{p}") >= F.col("d.hi"), F.col("d.y_hi"))
             .otherwise(F.col("s.y") + (F.col(f"d.{p}") - F.col("s.x"))
                        * (F.col("s.y1") - F.col("s.y")) / (F.col("s.x1") - F.col("s.x"))))
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], value.alias(out))


# --------------------------------------------------------------- enrichment
def enrich_domain(df: DataFrame, domain_info: DataFrame, now, key="domain") -> DataFrame:
    """Add the looked-up network features; -1 where nothing is known.

    ``domain_info``: domain, created, expires, ttl, time_response, asn.  Of several
    rows of a domain the latest registration counts, so no row of ``df`` is doubled.
    """
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    names = ["created", "expires", "ttl", "time_response", "asn"]
    one = domain_info.groupBy("domain").agg(F.max(F.struct(*names)).alias("i")).select("domain", "i.*")
    info = one.select(
        F.col("domain").alias(key),
        F.col("time_response").cast("double"),
        F.col("asn").cast("long").alias("asn_ip"),
        age_days("created", now).alias("time_domain_activation"),
        age_days(now, "expires").alias("time_domain_expiration"),
        F.col("ttl").cast("long").alias("ttl_hostname"))
    joined = df.join(info, key, "left")
    marked = {n: F.coalesce(F.col(n).cast("double"), F.lit(-1.0)) for n in fixed.NETWORK_FEATURES}
    return joined.select(*df.columns, *[c.alias(n) for n, c in marked.items()])


def asn_for_ip(df: DataFrame, prefixes: DataFrame, ip="ip") -> DataFrame:
    """Add ``asn`` of the longest matching IPv4 prefix, -1 if there is none.

    ``prefixes``: network (dotted), bits, asn.  Each distinct address is tried
    against its own network for every prefix length in use (33 at most), which
    is an equi-join; the longest hit wins.
    """
    table = prefixes.select("bits", F.floor(U.ipv4_number("network") / F.pow(F.lit(2.0), 32 - F.col("bits")))
                            .cast("long").alias("net"), "asn")
    table = table.groupBy("bits", "net").agg(F.min("asn").alias("asn"))
    lengths = table.agg(F.array_sort(F.collect_set("bits")).alias("b")).scalar()
    ips = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_n", U.ipv4_number("_ip"))
    tries = (ips.filter("_n IS NOT NULL").withColumn("bits", F.explode(lengths))
             .withColumn("net", F.floor(F.col("_n") / F.pow(F.lit(2.0), 32 - F.col("bits"))).cast("long")))
    found = (tries.join(table, ["bits", "net"]).groupBy("_ip")
             .agg(F.max_by("asn", "bits").alias("asn")))
    return (df.join(found, F.col(ip) == F.col("_ip"), "left").drop("_ip")
            .withColumn("asn", F.coalesce("asn", F.lit(-1)).cast("long")))


# ---------------------------------------------------------------- redirects
def resolve_redirects(df: DataFrame, edges: DataFrame, c="url", max_hops=5) -> DataFrame:
    """Follow recorded redirects to the final URL.

    ``edges``: url, status, location, public (host has only public addresses).
    Locations may be relative.  Stops at a non-redirect, a missing location, a self or repeated link, a
    blocked host (private by the table or an address literal that is not public), or after ``max_hops``, which is
    what a browser-like client follows (``truncated`` tells); :func:`redirect_ends` follows chains of any length.
    Distinct URLs are followed, one join per hop; the result is joined back, so repeated URLs cost nothing extra.
    """
    # an edge's target and safety depend on the edge alone: worked out once, not per hop
    step = materialize(edges.select(F.col("url").alias("_from"), "status", _target("url", "location").alias("_to"),
                                    _safe("url", "public").alias("_safe")), "redirects")
    first = U.default_scheme("_key", ci=False, strip=False)
    cur = df.select(F.col(c).alias("_key")).distinct().select(
        "_key", first.alias("_first"), first.alias("_cur"), F.array().cast("array<string>").alias("_chain"),
        F.lit(False).alias("_blocked"), F.lit(True).alias("_open"))
    for _ in range(max_hops):
        # finished chains look up keys that are spread and match nothing
        none = F.concat(F.lit(" "), F.pmod(F.xxhash64("_key"), F.lit(4096)).cast("string"))
        hop = cur.withColumn("_at", F.when(F.col("_open"), F.col("_cur")).otherwise(none)) \
                 .join(step, F.col("_at") == F.col("_from"), "left")
        go = (F.col("_open") & F.col("_safe") & F.col("status").between(300, 399)
              & (F.coalesce("_to", F.lit("")) != "") & (F.col("_to") != F.col("_cur"))
              & ~F.array_contains("_chain", F.col("_to")))
        hop = hop.withColumn("_go", F.coalesce(go, F.lit(False)))
        cur = hop.select(
            "_key", "_first", F.when(F.col("_go"), F.col("_to")).otherwise(F.col("_cur")).alias("_cur"),
            F.when(F.col("_go"), F.array_append("_chain", F.col("_to"))).otherwise(F.col("_chain")).alias("_chain"),
            (F.col("_blocked") | (F.col("_open") & ~F.coalesce("_safe", F.lit(True)))).alias("_blocked"), F.col("_go").alias("_open"))
    done = cur.select("_key", F.col("_first").alias("original_url"), F.col("_cur").alias("final_url"),
                      (F.size("_chain") > 0).alias("redirected"), F.col("_chain").alias("redirect_chain"),
                      U.is_shortener(U.host_of("_first")).alias("was_shortener"),
                      (F.col("_blocked") | (~F.col("_open") & ~_safe("_cur", F.lit(True)))).alias("blocked"),
                      F.col("_open").alias("truncated"))
    return df.join(done, F.col(c).eqNullSafe(F.col("_key"))).drop("_key")


def _safe(url, public) -> Column:
    """The host may be asked: not marked private, and no literal address that is not public."""
    host = U.host_of(url)
    literal = U.is_ipv4_host(host) | host.contains(":")
    return F.coalesce(col(public), F.lit(True)) & (~literal | H.is_public_ip(host))


def _target(url, location) -> Column:
    return F.when(F.coalesce(col(location), F.lit("")) != "", U.join_url(url, location))


def redirect_ends(edges: DataFrame) -> DataFrame:
    """(url, final_url, hops, cycle) of every recorded URL, for chains of any length.

    Pointer doubling: each round joins every open pointer with the pointer of its target, so a chain
    of n hops is closed after about log2(n) rounds; closed pointers are only looked up from then on.  What is
    still open after more hops than there are URLs runs into a cycle and has no end.
    ``edges``: url, status, location, public; of several rows of one URL the least by
    location counts.  A private or not public host is asked for nothing, so it ends its chains.
    """
    one = edges.groupBy("url").agg(F.min_by(F.struct("status", "location", "public"), F.struct("location", "status")).alias("e"))
    to = _target("url", "e.location")
    goes = F.coalesce(_safe("url", "e.public") & F.col("e.status").between(300, 399) & to.isNotNull() & (to != F.col("url")), F.lit(False))
    step = materialize(one.select("url", F.when(goes, to).otherwise(F.col("url")).alias("to"), goes.cast("long").alias("n")), "redirects")
    going = step.filter("n > 0").select(F.col("url").alias("_next"))
    marked = materialize(step.join(going, F.col("to") == F.col("_next"), "left").select(
        "url", "to", "n", ((F.col("n") > 0) & F.col("_next").isNotNull()).alias("open")), "redirects")
    closed, open_, n_urls, reach = [marked.filter("not open")], marked.filter("open"), step.count(), 1
    while reach <= n_urls and not open_.isEmpty():
        known = reduce(DataFrame.union, closed, open_).filter("n > 0").select(
            F.col("url").alias("_next"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("open").alias("_open"))
        moved = materialize(open_.join(known, F.col("to") == F.col("_next")).select(
            "url", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"), F.col("_open").alias("open")), "redirects")
        closed.append(moved.filter("not open"))
        open_, reach = moved.filter("open"), 2 * reach
    end = lambda c: F.when(~F.col("open"), F.col(c))
    return reduce(DataFrame.union, closed, open_).select(
        "url", end("to").alias("final_url"), end("n").alias("hops"), F.col("open").alias("cycle"))


# -------------------------------------------------------------------- grids
def grid(spark: SparkSession, **columns) -> DataFrame:
    """Every combination of the given lists, first column slowest.

    Combination i is computed from its number, so the rows are produced evenly
    by all tasks and nothing is joined.
    """
    sizes = [len(v) for v in columns.values()]
    total = reduce(lambda a, b: a * b, sizes, 1)
    df, block = spark.range(total).withColumnRenamed("id", "combo"), total
    for (name, values), size in zip(columns.items(), sizes):
        block //= size
        at = (F.floor(F.col("combo") / block) % size).cast("int")
        df = df.withColumn(name, F.get(strings(values), at))
    return df


def deep_link_probe(domains: DataFrame, templates, c="domain") -> DataFrame:
    """Every base address with every deep-link template (``{id}`` is replaced
    by a hash of the address)."""
    return (domains.select(c, F.explode(strings(templates)).alias("template"))
            .withColumn("url", F.concat(F.col(c), F.replace("template", F.lit("{id}"), F.md5(c)))))


def cctld_candidates(dims: Dims, spark: SparkSession, suffixes=fixed.CCTLD_SUFFIXES) -> DataFrame:
    """Regional variants of trusted domains that are not trusted yet.

    One row per candidate; the alphabetically first brand and source win.
    """
    trusted = dims.table(spark, "brand_domains").filter(F.col("domain").contains("."))
    cand = trusted.select("brand", F.col("domain").alias("source"),
                          F.explode(strings(suffixes)).alias("suffix"))
    cand = cand.withColumn("candidate", F.concat_ws(".", F.substring_index("source", ".", 1), "suffix"))
    cand = cand.filter(~F.col("candidate").isin(dims.legit_domains) & (F.col("candidate") != F.col("source")))
    return cand.groupBy("candidate").agg(F.min(F.struct("brand", "source")).alias("o")).select(
        F.col("o.brand").alias("brand"), F.col("o.source").alias("source"), "candidate")


def confirm_candidates(cands: DataFrame, cert_names: DataFrame) -> DataFrame:
    """Candidates with a certificate; confirmed if a name contains the source root.

    ``cert_names``: host, names (array).  Candidates without a row did not
    resolve and are left out.
    """
    joined = cands.join(cert_names.withColumnRenamed("host", "candidate"), "candidate")
    root = F.substring_index("source", ".", 1)
    return joined.select(
        "brand", "source", "candidate", F.slice(F.array_sort("names"), 1, 3).alias("cert_names"),
        F.exists("names", lambda n: n.contains(root)).alias("confirmed"))


# --------------------------------------------------------------- typosquats
def typosquats(brands: DataFrame) -> DataFrame:
    """Typosquat hosts of ``brand, domain`` rows: brand, family, host."""
    b, tld = F.col("brand"), F.regexp_extract("domain", r"^[^.]*\.(.*)$", 1)
    n = F.length(b)
    cut = lambda i, j: F.substring(b, i, j)  # 1-based start, length
    inner = F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2)))
    with_tld = lambda x: F.concat(x, F.lit("."), tld)
    leet = F.array(*[F.when(b.contains(a), with_tld(F.concat(
        F.substring_index(b, a, 1), F.lit(d), F.substring(b, F.instr(b, a) + 1, n))))
        for a, d in zip(*fixed.SQUAT_LEET)])
    doubled = F.transform(inner, lambda i: with_tld(F.concat(cut(F.lit(1), i), cut(i, n))))
    dropped = F.transform(inner, lambda i: with_tld(F.concat(cut(F.lit(1), i - 1), cut(i + 1, n))))
    swapped = F.transform(inner, lambda i: with_tld(F.concat(
        cut(F.lit(1), i - 1), cut(i + 1, F.lit(1)), cut(i, F.lit(1)), cut(i + 2, n))))
    affix = F.flatten(F.transform(strings(fixed.SQUAT_AFFIXES), lambda s: F.array(
        with_tld(F.concat(b, F.lit("-"), s)), with_tld(F.concat(s, F.lit("-"), b)), with_tld(F.concat(b, s)))))
    alt = F.transform(F.filter(strings(fixed.SQUAT_TLDS), lambda t: t != tld), lambda t: F.concat(b, F.lit("."), t))
    sub = F.flatten(F.transform(strings(fixed.SQUAT_HOSTS), lambda h: F.array(
        F.concat(b, F.lit("."), h), F.concat(b, F.lit("-secure."), h))))
    country = F.transform(strings(fixed.SQUAT_COUNTRY), lambda s: F.concat(b, F.lit("."), s))
    families = {"leet": leet, "doubled": doubled, "dropped": dropped, "swapped": swapped, "affix": affix,
                "alt_tld": alt, "subdomain": sub, "country": country}

    def tag(name):
        return lambda h: F.struct(F.lit(name).alias("family"), h.alias("host"))

    tagged = F.flatten(F.array(*[F.transform(F.array_compact(v), tag(f)) for f, v in families.items()]))
    # a two-letter brand has no inner characters
    rows = brands.select("brand", F.explode(tagged).alias("t")).filter(
        ~((F.length("brand") < 3) & F.col("t.family").isin("doubled", "dropped", "swapped")))
    # two equal neighbours swapped give the brand itself: genuine domains are no squats
    genuine = brands.select(F.col("domain").alias("host"))
    return rows.groupBy("brand", "t.host").agg(F.min("t.family").alias("family")).join(genuine, "host", "left_anti").select(
        "brand", "host", "family")


def squat_urls(brands: DataFrame, seed=42) -> DataFrame:
    """Probe URLs: one typosquat host with a path picked by hash."""
    n = F.conv(F.substring(F.md5(F.concat("host", F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")
    path = F.get(strings(fixed.SQUAT_PATHS), F.pmod(n, F.lit(len(fixed.SQUAT_PATHS))).cast("int"))
    return typosquats(brands).withColumn("url", F.concat(F.lit("https://"), "host", path))


def find_squats(observed: DataFrame, brands: DataFrame, c="url") -> DataFrame:
    """Observed URLs whose host is a typosquat of a brand.

    The squat table has about a hundred rows per brand; it is broadcast while
    that stays below ``BROADCAST_ROWS`` and shuffled otherwise.
    """
    squats = typosquats(brands)
    if brands.count() * 150 <= BROADCAST_ROWS:
        squats = F.broadcast(squats)
    host = F.regexp_replace(U.host_of(U.default_scheme(c)), r"^www\.", "")
    return observed.withColumn("host", host).join(squats, "host")


def harvest_lookalikes(feed: DataFrame, brand_names, legit, c="url", n=None, tie=()) -> DataFrame:
    """Feed URLs that name a brand in sub-domain or registered domain without
    belonging to it; with ``n`` the first by URL (a report)."""
    df = U.with_domain(U.with_url_parts(feed, c, "_h_"), "_h_host", "_h_")
    host = F.concat_ws(".", "_h_subdomain", "_h_registered")
    named = reduce(lambda a, b: a | b, [host.contains(b) for b in brand_names])
    hits = df.filter(named & ~F.col("_h_registered").isin(list(legit)))
    hits = hits.select(*feed.columns)
    return hits.orderBy(c, *tie).limit(n) if n else hits


# --------------------------------------------------------------------- quiz
def grade_quiz(answers: DataFrame, questions: DataFrame, by="quiz_id"):
    """(graded rows, summary).  ``answers``: by, pos, answer; ``questions``:
    pos, correct_answer.  A missing answer is wrong.

    Every taker gets one row per question; the question list (a quiz) is
    carried as an array, so nothing is cross-joined.
    """
    sheet = questions.agg(F.array_sort(F.collect_list(F.struct("pos", "correct_answer"))).alias("q")).scalar()
    asked = answers.select(by).distinct().withColumn("q", F.explode(sheet)).select(by, "q.*")
    graded = asked.join(answers.select(by, "pos", "answer"), [by, "pos"], "left").select(
        by, "pos", "correct_answer", F.col("answer").alias("user_answer"),
        F.coalesce(F.col("answer") == F.col("correct_answer"), F.lit(False)).alias("is_correct"))
    score = graded.groupBy(by).agg(F.count_if("is_correct").alias("score"), F.count("*").alias("total"))
    band = (F.when(F.col("score") == F.col("total"), "Excellent! You have a strong understanding of phishing.")
            .when(F.col("score") >= F.col("total") * 0.6,
                  "Good job! You understand the basics, but there's room for improvement.")
            .otherwise("Keep learning! Review phishing tactics to improve your awareness."))
    return graded, score.withColumn("feedback", band)


def repo_urls(df: DataFrame) -> DataFrame:
    """Repository rows (owner, repo, homepage) -> distinct page URLs."""
    host = F.concat(F.lower("owner"), F.lit(".github.io"))
    page = F.when(F.lower("repo") == host, F.concat(F.lit("https://"), host, F.lit("/"))) \
            .otherwise(F.concat(F.lit("https://"), host, F.lit("/"), F.col("repo"), F.lit("/")))
    home = F.trim(F.coalesce("homepage", F.lit("")))
    extra = F.when(home.startswith("https://") & ~home.contains("github.io"), home)
    return (df.filter((F.coalesce("owner", F.lit("")) != "") & (F.coalesce("repo", F.lit("")) != ""))
            .select(F.explode(F.array_compact(F.array(page, extra))).alias("url")).distinct())
