"""Text normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point with the Unicode property White_Space, and the four separators U+001C to U+001F.
WHITE_SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def strip_space(c: Column) -> Column:
    """Without white space (every Unicode kind) at both ends; null stays null."""
    return F.regexp_replace(c, rf"\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def squeeze_space(c: Column) -> Column:
    """As strip_space, and each inner run of white space becomes one space."""
    return F.regexp_replace(strip_space(c), f"[{WHITE_SPACE}]+", " ")


def unless_clean(c: Column, clean: str, otherwise: Column) -> Column:
    """c where it matches the pattern of an already normal value, else the normalising expression: most rows of a log skip the costly replacements."""
    return F.when(c.rlike(clean), c).otherwise(otherwise)
