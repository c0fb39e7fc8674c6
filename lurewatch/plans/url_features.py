"""URL feature tables: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import fixed
from lurewatch.dims import Dims
from lurewatch.functions import urls as U
from lurewatch.functions.common import col, count_of, flag, ratio, sealed
from lurewatch.functions.dictionary import with_nonwords


def url_features_v2(df: DataFrame, c="url", dims: Dims | None = None) -> DataFrame:
    """Add the 37 string-only features (``fixed.FEATURES_V2``) as doubles.

    With lists in ``dims`` this is one scan; a word or suffix table (``Dims.from_tables``) is joined by
    sub-domain or host.  The default word list is technical terms only, so the three word features need a table
    to know ordinary words.
    """
    dims = dims or Dims()
    given = df.columns
    df = U.with_domain(U.with_url_parts(df, c, "_f_"), "_f_host", "_f_", dims.suffixes)
    df = df.withColumn("_f_labels", U.sub_labels("_f_subdomain"))
    df = df.withColumn("_f_sub", F.array_join("_f_labels", "."))
    if isinstance(dims.words, DataFrame):
        df = with_nonwords(df, "_f_sub", dims.words, U.word_tokens, "_f_tok", "_f_bad")
        n_tok, n_bad = F.col("_f_tok"), F.col("_f_bad")
    else:
        n_tok, n_bad = U.nonword_counts("_f_sub", dims.words)
    sub, path, query, reg = (F.col("_f_" + x) for x in ("sub", "path", "query", "registered"))
    df = df.select(
        *[c for c in df.columns if c not in ("_f_tok", "_f_bad")],
        U.directory_v2(path).alias("_f_dir"),
        U.file_v2(path).alias("_f_file"),
        U.letters(sub).alias("_f_letters"),
        U.vowel_ratio(sub).alias("_f_vowel"),
        U.digit_ratio(sub).alias("_f_digit"),
        U.max_consonant_run(sub).alias("_f_run"),
        n_tok.alias("_f_tok"), n_bad.alias("_f_bad"),
        F.lower(F.concat_ws(" ", sub, path, query)).alias("_f_hay"),
        U.deleet(F.lower(F.concat_ws(" ", F.col("_f_host"), path, query))).alias("_f_hay2"),
    )
    present, fake = U.brand_flags("_f_hay", "_f_hay2", "_f_registered",
                                  dims.feature_brands, dims.feature_brand_domains)
    df = df.select(
        "*",
        flag(U.in_list(reg, dims.feature_platforms)).alias("_f_platform"),
        flag(U.is_wordlike("_f_vowel", "_f_letters", "_f_run", "_f_digit")).alias("_f_wordlike"),
        flag((F.col("_f_tok") > 0) & (F.col("_f_bad") == F.col("_f_tok"))).alias("_f_nowords"),
        present.alias("_f_present"), fake.alias("_f_fake"),
    )
    random_sub = (F.length(sub) >= 4) & ((F.col("_f_wordlike") == 0) | (F.col("_f_nowords") == 1))
    directory = F.col("_f_dir")
    feats = {
        **U.url_counts("_f_raw"),
        "domain_length": F.length(reg),
        "qty_dot_domain": count_of(reg, "."),
        "qty_hyphen_domain": count_of(reg, "-"),
        "qty_digit_domain": U.digits(reg),
        "directory_length": F.length(directory),
        "qty_slash_directory": count_of(directory, "/"),
        "file_length": F.length("_f_file"),
        "qty_params": U.qty_params(query),
        "is_hosting_platform": F.col("_f_platform"),
        "subdomain_length": F.length(sub),
        "subdomain_label_count": F.size("_f_labels"),
        "subdomain_entropy": U.entropy(sub),
        "subdomain_digit_ratio": F.col("_f_digit"),
        "subdomain_hyphen_count": count_of(sub, "-"),
        "subdomain_max_consonant_run": F.col("_f_run"),
        "subdomain_vowel_ratio": F.col("_f_vowel"),
        "subdomain_is_wordlike": F.col("_f_wordlike"),
        "subdomain_nonword_ratio": ratio(F.col("_f_bad"), F.col("_f_tok")),
        "subdomain_has_no_words": F.col("_f_nowords"),
        "platform_and_random_subdomain": flag((F.col("_f_platform") == 1) & random_sub),
        "brand_token_present": F.col("_f_present"),
        "brand_impersonation": F.col("_f_fake"),
        "action_token_in_path": flag(U.has_action_token(path, dims.action_tokens)),
        "suspicious_tld": flag(U.in_list(F.lower(F.substring_index("_f_suffix", ".", -1)), dims.feature_tlds)),
        "is_https": flag(F.col("_f_scheme") == "https"),
        "has_ip_host": flag(U.is_ipv4_host("_f_host")),
        "qty_subdomain_digits_runs": U.digit_runs(sub),
    }
    bad = U.unparsable("_f_netloc")
    return sealed(df, given, {n: safe(bad, feats[n].cast("double"), 0.0) for n in fixed.FEATURES_V2})


def safe(bad: Column, value: Column, fill: float) -> Column:
    """Feature value, or ``fill`` for a URL that cannot be parsed."""
    return F.when(bad, F.lit(fill)).otherwise(F.coalesce(value, F.lit(fill)))


def url_features_v1_lexical(df: DataFrame, c="url", suffixes=fixed.MULTI_SUFFIXES) -> DataFrame:
    """Add the 15 lexical features of the first model as doubles."""
    given = df.columns
    df = U.with_url_parts(df, c, "_g_", ci=False, strip=False)
    df = U.with_domain(df, "_g_host", "_g_", suffixes)
    path = F.col("_g_path")
    dom = (F.when(F.col("_g_registered") != "", F.col("_g_registered"))
           .when(F.col("_g_suffix") != "", F.concat(F.lit("."), "_g_suffix"))
           .otherwise(F.col("_g_label")))
    df = df.select("*", dom.alias("_g_dom"), U.directory_v1(path).alias("_g_dir"),
                   U.file_v1(path).alias("_g_file"))
    raw, dom, d, f = (F.col("_g_" + x) for x in ("raw", "dom", "dir", "file"))
    feats = [count_of(raw, "/"), F.length(raw), count_of(dom, "."), F.length(dom)]
    feats += [count_of(d, ch) for ch in "./=@&%"] + [F.length(d)]
    feats += [count_of(f, ch) for ch in "-+$"] + [F.length(f)]
    bad = U.unparsable("_g_netloc")
    return sealed(df, given, {n: safe(bad, x.cast("double"), -1.0) for n, x in zip(fixed.FEATURES_V1, feats)})


def degraded_features(names=fixed.NETWORK_FEATURES) -> Column:
    """How many network features carry the -1 failure mark."""
    total = F.lit(0)
    for n in names:
        total = total + F.when(F.col(n) == -1, 1).otherwise(0)
    return total.cast("long")


def features_to_json(names) -> Column:
    """Ordered feature values as a JSON array (the cached form)."""
    return F.to_json(F.array(*[F.col(n).cast("double") for n in names]))


def features_from_json(c, names) -> list:
    values = F.from_json(col(c), "array<double>")
    return [F.get(values, i).alias(n) for i, n in enumerate(names)]
