"""Dimensions: the small lists the rules and features look up.

A :class:`Dims` is a bounded set of Python lists.  Column builders turn them
into literals (``IN`` sets, ``CASE`` chains, array literals), so look-ups run
inside the scan stage without any join.  :meth:`Dims.table` gives the same
content as DataFrames for jobs that start *from* a dimension.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch import fixed
from lurewatch.functions.dictionary import word_table

# Largest list that is turned into literals; longer ones are refused rather
# than silently shipped with every task.
MAX_LITERALS = 50_000


@dataclass(frozen=True)
class Dims:
    brand_domains: dict = field(default_factory=lambda: dict(fixed.BRAND_DOMAINS))
    known_legitimate: dict = field(default_factory=lambda: dict(fixed.KNOWN_LEGITIMATE))
    rule_platforms: list = field(default_factory=lambda: list(fixed.RULE_PLATFORMS))
    code_hosts: list = field(default_factory=lambda: list(fixed.CODE_HOSTS))
    rule_tlds: list = field(default_factory=lambda: list(fixed.RULE_TLDS))
    corroborating: list = field(default_factory=lambda: list(fixed.CORROBORATING_WORDS))
    feature_platforms: list = field(default_factory=lambda: list(fixed.FEATURE_PLATFORMS))
    feature_brands: list = field(default_factory=lambda: list(fixed.FEATURE_BRANDS))
    feature_brand_domains: dict = field(default_factory=lambda: dict(fixed.FEATURE_BRAND_DOMAINS))
    feature_tlds: list = field(default_factory=lambda: list(fixed.FEATURE_TLDS))
    action_tokens: list = field(default_factory=lambda: list(fixed.ACTION_TOKENS))
    words: list = field(default_factory=lambda: list(fixed.TECH_WORDS))
    suffixes: list = field(default_factory=lambda: list(fixed.MULTI_SUFFIXES))

    def __post_init__(self):
        for name in ("words", "suffixes", "rule_platforms", "feature_platforms"):
            value = getattr(self, name)
            if not isinstance(value, DataFrame) and len(value) > MAX_LITERALS:
                raise ValueError(f"{name} has more than {MAX_LITERALS} entries; give a table")

    @property
    def brands(self):
        return list(self.brand_domains)

    @property
    def legit_domains(self):
        return sorted({d for ds in self.brand_domains.values() for d in ds})

    @classmethod
    def from_tables(cls, words: DataFrame | None = None, suffixes: DataFrame | None = None, **lists):
        """Dims whose dictionary (column word) or public-suffix rules are joined tables of any length.

        See ``functions.dictionary.read_words`` and ``functions.suffixes.read_suffix_rules``.
        """
        if words is not None:
            lists["words"] = word_table(words)
        if suffixes is not None:
            lists["suffixes"] = suffixes
        return cls(**lists)

    @classmethod
    def from_files(cls, words=None, suffixes=None, **lists):
        """Dims with a short word list and suffix list read on the driver (one entry a line).

        Wildcard and exception rules need :meth:`from_tables`; a file that holds any is refused.
        """
        if words:
            lists["words"] = sorted({*fixed.TECH_WORDS, *_entries(words)})
        if suffixes:
            rules = _entries(suffixes)
            if any(s[0] in "*!" for s in rules):
                raise ValueError("wildcard and exception rules need Dims.from_tables")
            lists["suffixes"] = [s for s in rules if "." in s]
        return cls(**lists)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """One dimension as a DataFrame (order column ``ord`` keeps list order)."""
        value = getattr(self, name)
        if isinstance(value, dict):
            if name == "known_legitimate":
                data = [(i, k, v) for i, (k, v) in enumerate(value.items())]
                return spark.createDataFrame(data, "ord int, domain string, why string")
            data = [(i, k, d) for i, (k, ds) in enumerate(value.items()) for d in ds]
            return spark.createDataFrame(data, "brand_ord int, brand string, domain string")
        return spark.createDataFrame(list(enumerate(value)), "ord int, value string")

    def with_approved(self, allow: DataFrame, platforms: DataFrame | None = None) -> "Dims":
        """Dims with the approved rows of a review file added.

        ``allow`` has ``brand, domain, approved``; ``platforms`` has ``domain,
        approved``.  Unknown brands are skipped.  Both are hand-reviewed files,
        so reading them on the driver is bounded by ``MAX_LITERALS``.
        """
        brands = {k: list(v) for k, v in self.brand_domains.items()}
        for row in _bounded(apply_approved(self.table(allow.sparkSession, "brand_domains"), allow)):
            if row.domain not in brands[row.brand]:
                brands[row.brand].append(row.domain)
        plats = list(self.rule_platforms)
        if platforms is not None:
            approved = platforms.filter("approved").select("domain").distinct()
            plats += sorted(r.domain for r in _bounded(approved) if r.domain not in plats)
        return replace(self, brand_domains=brands, rule_platforms=plats)


def apply_approved(dim: DataFrame, proposals: DataFrame) -> DataFrame:
    """Brand dimension plus the approved proposals for brands it knows."""
    known = dim.select("brand", "brand_ord").distinct()
    added = (proposals.filter("approved").select("brand", "domain")
             .join(known, "brand").select("brand_ord", "brand", "domain"))
    return (dim.select("brand_ord", "brand", "domain").unionByName(added)
            .groupBy("brand", "domain").agg(F.min("brand_ord").alias("brand_ord"))
            .select("brand_ord", "brand", "domain"))


def _bounded(df):
    got = df.limit(MAX_LITERALS + 1).collect()
    if len(got) > MAX_LITERALS:
        raise ValueError(f"dimension has more than {MAX_LITERALS} rows")
    return got


def _entries(path):
    with open(path, encoding="utf-8") as lines:
        return [s for line in lines
                if (s := line.strip().lower()) and not s.startswith(("#", "//"))]
