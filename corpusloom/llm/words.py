"""Words of a text, as Spark columns: maximal runs without U+0020 and U+0009 to U+000D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "\\x20\\x09-\\x0D"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of the words in order; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+", -1), lambda w: w != "")
