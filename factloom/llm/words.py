"""The word as the duplicate operators see it, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
NO_WORD = r"[^\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Without letter case; an eszett is the lower case of SS as well."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """All maximal runs of letters or digits in order; null for a null text."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def key128(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: together an identity for any corpus size."""
    return F.xxhash64(text), F.xxhash64(F.lit(0x5EED), F.reverse(text))
