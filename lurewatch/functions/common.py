"""Helpers shared by the column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alternation(items) -> str:
    """Regex that finds any of ``items`` literally.

    Items that contain another item are left out (the shorter one finds them
    too) and the rest is grouped by first character, so that most positions of
    a text are dismissed after one comparison.
    """
    short = [i for i in items if not any(o != i and o in i for o in items)]
    groups = {}
    for i in dict.fromkeys(short):
        groups.setdefault(i[0], []).append(_escape(i[1:]))
    return "(?:" + "|".join(f"{_escape(c)}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"


def _escape(text):
    return re.escape(text).replace("\\ ", " ")


def strings(items) -> Column:
    """Array literal of strings (typed even when empty)."""
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def count_of(c, text: str) -> Column:
    """How often a single character occurs."""
    c = col(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))).cast("long")


def count_re(c, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("long")


def count_chars(c, char_class: str) -> Column:
    """How many characters fall into a regex class such as ``\\p{L}``.

    Whole runs are removed and the lengths compared, which is much cheaper on
    long texts than collecting every match.
    """
    c = col(c)
    return (F.length(c) - F.length(F.regexp_replace(c, f"[{char_class}]+", ""))).cast("long")


def flag(cond) -> Column:
    """Boolean -> 1.0 / 0.0, null counts as no."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def ratio(num, den) -> Column:
    """num / max(den, 1)."""
    return num.cast("double") / F.greatest(den.cast("double"), F.lit(1.0))


def sealed(df: DataFrame, keep, columns: dict) -> DataFrame:
    """``keep`` plus computed columns that filters are not pushed through.

    A filter on a column that is built in many steps would otherwise be
    rewritten in terms of the raw input, and the optimizer would copy every
    step into it.  The columns are therefore produced by a one-element
    ``inline``, which is row-local and compiled like a projection.  Filters on
    the kept columns still reach the scan.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def once(value, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(col(value)), use), F.lit(0))
