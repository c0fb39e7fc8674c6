"""URL and host columns.

All builders are plain expressions, so they stay in the scan stage.  Regular
expressions are used instead of ``parse_url`` because that returns NULL for
hosts with underscores or non-ASCII letters, which are exactly the interesting
ones here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import fixed
from lurewatch.functions.common import alternation, col, count_of, count_re, flag, once, ratio, sealed
from lurewatch.functions.suffixes import with_suffix_size

IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


# ------------------------------------------------------------- whole URLs
def default_scheme(c, ci=True, strip=True) -> Column:
    """Prefix ``http://`` unless the URL already starts with http(s)://."""
    raw = F.coalesce(col(c), F.lit(""))
    raw = F.regexp_replace(raw, r"^\s+|\s+$", "") if strip else raw
    has = raw.rlike(r"(?i)^https?://") if ci else raw.rlike(r"^https?://")
    return F.when(has, raw).otherwise(F.concat(F.lit("http://"), raw))


def defang(c) -> Column:
    out = F.replace(col(c), F.lit("https://"), F.lit("hxxps://"))
    out = F.replace(out, F.lit("http://"), F.lit("hxxp://"))
    return F.replace(out, F.lit("."), F.lit("[.]"))


def refang(c) -> Column:
    out = F.replace(col(c), F.lit("[.]"), F.lit("."))
    out = F.replace(out, F.lit("hxxps://"), F.lit("https://"))
    return F.replace(out, F.lit("hxxp://"), F.lit("http://"))


def cache_key(c) -> Column:
    return F.concat(F.lit("url_features:"), F.sha2(col(c), 256))


def slash_depth(c) -> Column:
    """Slashes left after trailing ones are dropped."""
    return count_of(F.rtrim(col(c), F.lit("/")), "/")


def is_deep(c, max_len=500) -> Column:
    """A URL with a real path: more than the two scheme slashes."""
    return (slash_depth(c) > 2) & (F.length(col(c)) < max_len)


def validate_url(c, max_len=2048):
    """(is_valid, error) columns for a submitted URL."""
    raw = F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")
    ok = raw.rlike(r"(?iU)^(https?://)?([\w\-]+\.)+[\w\-]+(/[^\s]*)?$")
    error = (F.when(F.coalesce(F.length(col(c)), F.lit(0)) == 0, "No URL provided")
             .when(F.length(raw) > max_len, f"URL too long (max {max_len} characters)")
             .when(~ok, "Invalid URL format"))
    return error.isNull(), error


def url_counts(c) -> dict:
    """Character counts over the full URL (feature-table names)."""
    c = col(c)
    return {
        "length_url": F.length(c).cast("long"),
        "qty_slash_url": count_of(c, "/"),
        "qty_dot_url": count_of(c, "."),
        "qty_hyphen_url": count_of(c, "-"),
        "qty_digit_url": count_re(c, r"\p{Nd}"),
        "qty_at_url": count_of(c, "@"),
        "qty_question_url": count_of(c, "?"),
        "qty_equal_url": count_of(c, "="),
        "qty_percent_url": count_of(c, "%"),
        "qty_underscore_url": count_of(c, "_"),
    }


# ------------------------------------------------------------ URL parsing
def with_url_parts(df: DataFrame, c="url", prefix="u_", ci=True, strip=True) -> DataFrame:
    """Add raw, scheme, netloc, host, path, query and fragment columns.

    Added in steps so that each regular expression runs once per row.
    """
    p = prefix
    df = df.withColumn(p + "raw", default_scheme(c, ci, strip))
    clean = F.translate(F.col(p + "raw"), "\t\r\n", "")
    df = df.withColumn(p + "netloc", F.regexp_extract(clean, r"^[^:/?#]+://([^/?#]*)", 1))
    tail = F.regexp_extract(clean, r"(?s)^[^:/?#]+://[^/?#]*(.*)$", 1)
    df = df.withColumn(p + "tail", tail)
    after_at = F.regexp_extract(F.col(p + "netloc"), r"([^@]*)$", 1)
    host = F.when(after_at.startswith("["), F.regexp_extract(after_at, r"^\[([^\]]*)", 1)) \
            .otherwise(F.substring_index(after_at, ":", 1))
    before_query = F.regexp_extract(F.col(p + "tail"), r"^([^?#]*)", 1)
    return df.select(
        "*",
        F.lower(F.regexp_extract(F.col(p + "raw"), r"^([^:/?#]+)://", 1)).alias(p + "scheme"),
        F.lower(host).alias(p + "host"),
        # ";parameters" of the last path segment are not part of the path
        F.regexp_extract(before_query, r"(?s)^((?:.*/)?[^/;]*)", 1).alias(p + "path"),
        F.regexp_extract(F.col(p + "tail"), r"(?s)^[^?#]*\?([^#]*)", 1).alias(p + "query"),
        F.regexp_extract(F.col(p + "tail"), r"(?s)^[^#]*#(.*)$", 1).alias(p + "fragment"),
    ).drop(p + "tail")


def unparsable(netloc) -> Column:
    """Unbalanced IPv6 brackets: the one case a URL parser rejects outright."""
    n = col(netloc)
    return n.contains("[") != n.contains("]")


def suffix_labels(host, suffixes) -> Column:
    """How many labels of the host form its public suffix (0 = none)."""
    host = col(host)
    out = F.when(host.rlike(IPV4) | host.contains(":"), 0)
    by_size = {}
    for s in suffixes:
        by_size.setdefault(s.count(".") + 1, []).append(s)
    for size in sorted((n for n in by_size if n > 1), reverse=True):
        out = out.when(F.substring_index(host, ".", -size).isin(by_size[size]), size)
    return out.otherwise(last_label_size(host))


def last_label_size(host) -> Column:
    """1 where the last label can be a top-level domain, else 0: the suffix of a host that meets no rule."""
    host = col(host)
    last = F.substring_index(host, ".", -1)
    return F.when(~host.rlike(IPV4) & ~host.contains(":") & last.rlike(r"(?U)^(?:[^\W\d_]{2,}|xn--[a-z0-9\-]+)$"), 1).otherwise(0)


def with_domain(df: DataFrame, host="u_host", prefix="u_", suffixes=fixed.MULTI_SUFFIXES) -> DataFrame:
    """Add registered domain, its first label, suffix and sub-domain.

    ``suffixes`` is a short list, looked up in the row (the longest wins), or a rule table of
    :func:`lurewatch.functions.suffixes.suffix_rules`, which knows wildcards and exceptions and
    is joined.  Without a rule the last label is the suffix.  IP addresses and single labels have
    no registered domain.
    """
    p, given = prefix, df.columns
    h = F.rtrim(F.col(host), F.lit("."))
    n_labels = count_of(h, ".") + 1
    if isinstance(suffixes, DataFrame):
        df = with_suffix_size(df, h, p + "suffix_n", suffixes, last_label_size(h))
    else:
        df = df.withColumn(p + "suffix_n", suffix_labels(h, suffixes))
    k = F.col(p + "suffix_n")
    registered = F.when((k > 0) & (n_labels > k),
                        F.call_function("substring_index", h, F.lit("."), -(k + 1))).otherwise("")
    df = df.withColumn(p + "registered", registered)
    reg = F.col(p + "registered")
    is_addr = h.rlike(IPV4) | h.contains(":")
    label = (F.when(reg != "", F.substring_index(reg, ".", 1))
             .when(is_addr, h)
             .when(k > 0, F.lit(""))
             .otherwise(F.substring_index(h, ".", -1)))
    suffix = F.when(k > 0, F.call_function("substring_index", h, F.lit("."), -k)).otherwise("")
    df = df.select("*", label.alias(p + "label"), suffix.alias(p + "suffix"))
    whole = F.when(reg != "", reg).otherwise(
        F.when(F.col(p + "label") == "", F.col(p + "suffix")).otherwise(F.col(p + "label")))
    sub = F.when(F.length(h) > F.length(whole),
                 F.substring(h, F.lit(1), F.length(h) - F.length(whole) - 1)).otherwise("")
    return sealed(df, given, {p + "registered": reg, p + "label": F.col(p + "label"),
                              p + "suffix": F.col(p + "suffix"), p + "subdomain": sub})


def registered_domain(df: DataFrame, c="url", out="registered", suffixes=fixed.MULTI_SUFFIXES) -> DataFrame:
    """Add only the registered domain of a URL column."""
    tmp = with_domain(with_url_parts(df, c, prefix="_r_"), "_r_host", "_r_", suffixes)
    return tmp.withColumn(out, F.col("_r_registered")).drop(
        *[x for x in tmp.columns if x.startswith("_r_")])


# ---------------------------------------------------------- path and query
def directory_v2(path) -> Column:
    """Directory part; empty unless a slash is left inside the trimmed path."""
    path = col(path)
    inner = F.trim(path, F.lit("/"))
    return F.when(inner.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/", 1)).otherwise("")


def file_v2(path) -> Column:
    path = col(path)
    inner = F.trim(path, F.lit("/"))
    return F.when(inner.contains("/"), F.substring_index(path, "/", -1)).otherwise(inner)


def directory_v1(path) -> Column:
    """Everything before the last slash."""
    return F.regexp_extract(col(path), r"(?s)^(.*)/", 1)


def file_v1(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def qty_params(query) -> Column:
    """Parameters with a value; blank ones do not count."""
    return F.size(F.filter(F.split(col(query), "&"), lambda x: x.rlike(r"(?s)^[^=]*=."))).cast("long")


# ------------------------------------------------------------- sub-domains
def sub_labels(sub) -> Column:
    return F.filter(F.split(col(sub), r"\."), lambda x: (x != "") & (x != "www"))


def entropy(c) -> Column:
    """Shannon entropy in bits."""
    c = col(c)
    n = F.length(c).cast("double")
    chars = F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    term = lambda ch: (F.length(c) - F.length(F.replace(c, ch, F.lit("")))) / n
    total = F.aggregate(chars, F.lit(0.0), lambda acc, ch: acc - term(ch) * F.log2(term(ch)))
    return F.when(F.length(c) > 0, total).otherwise(F.lit(0.0))


def letters(c) -> Column:
    return count_re(F.lower(col(c)), r"\p{L}")


def vowels(c) -> Column:
    return count_re(F.lower(col(c)), "[aeiou]")


def digits(c) -> Column:
    return count_re(c, r"\p{Nd}")


def vowel_ratio(c) -> Column:
    return ratio(vowels(c), letters(c))


def digit_ratio(c) -> Column:
    return ratio(digits(c), F.length(col(c)))


def max_consonant_run(c) -> Column:
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}&&[^aeiou]]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long")


def digit_runs(c) -> Column:
    return count_re(c, r"\p{Nd}+")


def is_wordlike(vowel, n_letters, run, digit) -> Column:
    """Looks like a word: given vowel ratio, letters, longest run, digit ratio."""
    return (col(n_letters) >= 3) & col(vowel).between(0.20, 0.60) & (col(run) <= 4) & (col(digit) < 0.25)


def word_tokens(sub) -> Column:
    return F.filter(F.split(F.lower(col(sub)), r"[-_.\p{Nd}]+"), lambda t: t != "")


def has_word(token, dictionary) -> Column:
    """Token (letters only) is a word, contains one of four letters or more, or
    is too short to judge.

    Every substring is looked up in a hash set, so the cost depends on the
    token, not on the size of the dictionary.
    """
    long_words = [w for w in dictionary if len(w) >= 4]
    known = (F.length(token) < 3) | token.isin(list(dictionary))
    if not long_words:
        return known
    sizes = sorted({len(w) for w in long_words})
    starts = F.sequence(F.lit(1), F.greatest(F.length(token) - sizes[0] + 1, F.lit(1)))
    lengths = F.array(*[F.lit(s) for s in sizes])
    inside = F.exists(starts, lambda at: F.exists(
        lengths, lambda n: F.substring(token, at, n).isin(long_words)))
    return known | inside


def nonword_counts(sub, dictionary):
    """(tokens, tokens without any recognisable word) of a sub-domain."""
    toks = F.transform(word_tokens(sub), lambda t: F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.size(word_tokens(sub)).cast("long"),
            F.size(F.filter(toks, lambda t: ~has_word(t, dictionary))).cast("long"))


def deleet(c) -> Column:
    """Undo common character substitutions and drop separators."""
    return F.translate(F.translate(col(c), *fixed.LEET), "-_.", "")


def without_hosts(df: DataFrame, c, fragments) -> DataFrame:
    """Rows whose URL names none of the given hosts or host parts (any case); null URLs stay."""
    url = F.lower(F.coalesce(col(c), F.lit("")))
    return df.filter(~F.exists(F.array(*[F.lit(x.lower()) for x in fragments]), lambda x: F.contains(url, x))) if fragments else df


# ------------------------------------------------------------------- hosts
def is_shortener(host, hosts=fixed.SHORTENERS) -> Column:
    h = F.lower(F.coalesce(col(host), F.lit("")))
    h = F.regexp_replace(F.ltrim(h, F.lit(".")), r"^www\.", "")
    return h.isin(list(hosts))


def ipv4_number(c) -> Column:
    """Dotted IPv4 text as a number, NULL when it is not one."""
    c = col(c)
    ok = c.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    part = lambda i: F.try_element_at(F.split(c, r"\."), F.lit(i)).try_cast("long")
    number = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    return F.when(ok, number)


# text form of the IPv4 blocks that are not public
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NON_PUBLIC = "^(?:" + "|".join([
    r"(?:0|10|127)\.", r"(?:22[4-9]|2[3-5][0-9])\.", r"169\.254\.", r"172\.(?:1[6-9]|2[0-9]|3[01])\.",
    r"192\.168\.", r"192\.0\.0\.(?!(?:9|10)$)", r"192\.0\.2\.", r"198\.1[89]\.", r"198\.51\.100\.",
    r"203\.0\.113\.",
]) + ")"


def is_public_ipv4(c) -> Column:
    """True for a public IPv4 literal, False for anything else."""
    c = col(c)
    return F.coalesce(c.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$") & ~c.rlike(_NON_PUBLIC), F.lit(False))


def brand_flags(hay, hay_deleet, registered, brands, domains):
    """(present, impersonation): a brand is named / by a domain it does not own."""
    hay, hay_deleet, registered = col(hay), col(hay_deleet), col(registered)
    present, fake = F.lit(False), F.lit(False)
    for b in brands:
        hit = hay.contains(b) | hay_deleet.contains(b)
        present = present | hit
        own = domains.get(b)
        fake = fake | ((hit & ~registered.isin(own)) if own else hit)
    return flag(present), flag(fake)


def has_action_token(path, tokens=fixed.ACTION_TOKENS) -> Column:
    return F.lower(col(path)).rlike(alternation(tokens))


def is_ipv4_host(host) -> Column:
    return col(host).rlike(IPV4)


def in_list(c, items) -> Column:
    return F.coalesce(col(c).isin(list(items)), F.lit(False))


def host_of(c) -> Column:
    """Lower-case host of a URL with a scheme (single expression); an IPv6 literal without its brackets."""
    netloc = F.regexp_extract(F.regexp_extract(col(c), r"^[^:/?#]+://([^/?#]*)", 1), r"([^@]*)$", 1)
    literal = F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(literal != "", literal).otherwise(F.substring_index(netloc, ":", 1)))


def without_dots(path) -> Column:
    """Path with ``.`` and ``..`` segments resolved; a leading slash and a closing one stay."""
    return once(F.split(col(path), "/"), _resolved)


def _resolved(parts):
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), lambda out, x: F.when(
        x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.array_append(out, x)))
    folder = F.element_at(parts, -1).isin(".", "..")
    return once(kept, lambda xs: F.concat(F.lit("/"), F.array_join(xs, "/"), F.when(folder & (F.size(xs) > 0), "/").otherwise("")))


def join_url(base, reference) -> Column:
    """Absolute form of a reference found at ``base``, an absolute URL: other schemes, ``//host``, ``/path``,
    ``path``, ``?query`` and ``#fragment``; empty or null gives the base."""
    return once(F.struct(col(base).alias("base"), F.coalesce(col(reference), F.lit("")).alias("ref")), lambda x: _joined(x["base"], x["ref"]))


def _joined(base, ref):
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    site = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    plain = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    ref_path = F.regexp_extract(ref, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    below = F.concat(F.when(folder == "", "/").otherwise(folder), ref_path)
    return (F.when(ref == "", base)
            .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.startswith("?"), F.concat(plain, ref))
            .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), ref))
            .otherwise(F.concat(site, without_dots(F.when(ref.startswith("/"), ref_path).otherwise(below)), rest)))
