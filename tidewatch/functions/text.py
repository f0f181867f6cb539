"""Names, labels and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(x: Column, keep: str = "A-Za-z0-9._-") -> Column:
    """Other characters, in runs, as one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, f"[^{keep}]+", "_"), "^_+|_+$", "")


def bounded_stem(x: Column, limit: int = 72, digits: int = 12) -> Column:
    """A file name stem of at most ``limit`` characters; longer ones end in a digest."""
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit - digits - 1), F.lit("_"), F.substring(F.sha2(x, 256), 1, digits)))


def bracket_value(label: Column) -> Column:
    """The number in a trailing bracket, null if there is none."""
    return F.regexp_extract(label, r"\[(-?[0-9]+(?:\.[0-9]+)?)\]\s*$", 1).try_cast("double")


def method_of(label: Column) -> Column:
    """A label without its trailing bracket."""
    return F.regexp_replace(label, r"\s*\[[^\]]*\]\s*$", "")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of a canonical JSON of columns: keys in order, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def number_text(x: Column) -> Column:
    """A number in up to six significant digits without trailing zeros, the point as ``p``."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", ""), r"\.", "p")


def tri_state(x: Column) -> Column:
    """Text as true, false or null."""
    low = F.lower(F.trim(x))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
