"""JSON in model replies, and replies that hold a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(c: Column) -> Column:
    """Without a code fence, trailing commas and single backslashes that JSON does not know."""
    c = F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    c = F.regexp_replace(c, r",\s*([}\]])", "$1")
    return F.regexp_replace(c, r'\\(?!["\\/bfnrtu])', r"\\\\")


def braced(c: Column) -> Column:
    """From the first brace to the last one."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def robust(c: Column, schema: str) -> Column:
    """The reply as a struct: as it stands, cleaned, or what stands in braces; null when nothing can be read."""
    tries = [c, cleaned(c), braced(c), cleaned(braced(c))]
    parsed = [F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema)) for t in tries]
    return F.coalesce(*parsed)


def field(c: Column, name: str) -> Column:
    tries = [c, cleaned(c), braced(c), cleaned(braced(c))]
    return F.coalesce(*[F.get_json_object(t, f"$.{name}") for t in tries])


#: Words that stand for a likeness, the most telling first (fixed values).
WORDS = [("identical|exactly the same|same", 0.9), ("very similar|highly similar", 0.8), ("somewhat similar|moderately similar", 0.4), ("dissimilar|different|unrelated", 0.2), ("similar", 0.6)]


def reply_score(c: Column) -> Column:
    """A score in [0, 1]: that of a JSON field, else the first such number, else that of the words used, else 0.5."""
    low = F.lower(c)
    named = F.get_json_object(braced(c), "$.score").cast("double")
    number = F.regexp_extract(low, r"(?:^|[^0-9.])(0?\.[0-9]+|1\.0+|0|1)(?:$|[^0-9.]|\.(?:$|[^0-9]))", 1)
    words = F.lit(0.5)
    for w, v in reversed(WORDS):
        words = F.when(low.rlike(rf"(?:^|[^a-z])(?:{w})(?:$|[^a-z])"), v).otherwise(words)
    return F.coalesce(F.when(named.between(0, 1), named), F.when(number != "", number.cast("double")), words)


def thinking(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"(?s)<thinking>(.*?)</thinking>", 1), r"^\s+|\s+$", "")


def without_thinking(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<thinking>.*?</thinking>", ""), r"^\s+|\s+$", "")


def code_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)```[a-z]*\n(.*?)```"), F.lit(1))
