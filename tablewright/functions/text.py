"""Text and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings that make a two-valued column boolean.
TRUE_TOKENS = ("true", "1", "yes", "y")
FALSE_TOKENS = ("false", "0", "no", "n")
BOOLEAN_TOKENS = TRUE_TOKENS + FALSE_TOKENS

# Fixed value: how a date-like cell begins.
DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"

# Tried in this order; the first pattern that fits a cell wins.
DATE_PATTERNS = (
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "yyyyMMdd",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
)


def parse_timestamp(c: Column, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    """Text to zone-less timestamp; NULL where nothing fits.

    The ISO forms (with ``T``, fractions, time only to the minute ...) go through
    the engine's own cast, the other spellings through explicit patterns.
    """
    trimmed = F.trim(c)
    tries = [trimmed.try_cast("timestamp_ntz")]
    tries += [
        F.try_to_timestamp(trimmed, F.lit(p)).cast("timestamp_ntz")
        for p in patterns
        if p != "yyyy-MM-dd"
    ]
    return F.coalesce(*tries)


def normalize_category(c: Column) -> Column:
    """Trim, lower-case, and collapse inner white space, Unicode spaces included."""
    trimmed = F.regexp_replace(c, r"(?U)(^\s+)|(\s+$)", "")
    return F.lower(F.regexp_replace(trimmed, r"(?U)\s+", " "))


def lexical_kind(c: Column) -> Column:
    """What a text cell looks like: integer, decimal, date, boolean or other."""
    return (
        F.when(c.isNull(), None)
        .when(c.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(c.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "decimal")
        .when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date")
        .when(F.lower(c).isin("true", "false", "yes", "no", "y", "n"), "boolean")
        .otherwise("other")
    )


def boolean_code(c: Column) -> Column:
    """1.0 / 0.0 for the boolean spellings, NULL for anything else."""
    word = F.lower(c.cast("string"))
    return F.when(word.isin(*TRUE_TOKENS), 1.0).when(word.isin(*FALSE_TOKENS), 0.0)


def feature_name(raw: str) -> str:
    """Anything that is not a word character becomes ``_``; then lower case."""
    import re

    return re.sub(r"\W", "_", raw).lower()


def unique_feature_names(raw: list[str]) -> list[str]:
    """Cleaned names with a running suffix where two of them collide."""
    taken: dict[str, int] = {}
    out: list[str] = []
    for name in (feature_name(r) for r in raw):
        candidate = name
        while candidate in taken:
            taken[name] += 1
            candidate = f"{name}_{taken[name]}"
        taken.setdefault(candidate, 1)
        out.append(candidate)
    return out
