"""Words and word sets as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased, in order. Null gives null."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def word_set(c: Column) -> Column:
    """Sorted distinct 64-bit hashes of the words; null and texts without words give the empty list."""
    return F.coalesce(F.sort_array(F.array_distinct(F.transform(words(c), lambda w: F.xxhash64(w)))), F.array().cast("array<bigint>"))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Distinct words in common over distinct words in either; 0 when neither has any."""
    common = overlap(a, b)
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, F.lit(0.0)).otherwise(common / either)
