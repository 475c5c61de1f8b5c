"""URL functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^(?i:https?)://([^/?#]*)", 1))


def path(c: Column) -> Column:
    """Without the closing slash; the root is a slash."""
    found = F.regexp_replace(F.regexp_extract(c, r"^(?i:https?)://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(found == "", "/").otherwise(found)


def base_url(c: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(c, r"^(?i:https?)", 0)), F.lit("://"), host(c))


def normalise(c: Column) -> Column:
    """Without fragment, query and closing slash; scheme and host in small letters."""
    return F.regexp_replace(F.concat(base_url(c), path(c)), "/$", "")


def repair_scheme(c: Column) -> Column:
    """Adds the scheme that a web address or host lacks; other text stays, blank text becomes null."""
    c = F.trim(c)
    bare = c.startswith("www.") | (c.contains(".") & ~c.startswith("/") & c.rlike(r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"))
    return F.when(c == "", None).when(c.rlike("^https?://"), c).when(c.startswith("//"), F.concat(F.lit("https:"), c)).when(bare, F.concat(F.lit("https://"), c)).otherwise(c)


def depth(c: Column) -> Column:
    return F.size(F.filter(F.split(path(c), "/"), lambda p: p != ""))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.array_max(same), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """1 when equal, the ratio of lengths when one holds the other, else that of the common prefix to the longer one."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), shorter / longer).otherwise(common_prefix(a, b) / longer)


SKIPPED = ("javascript:", "mailto:", "tel:", "#", ".pdf", ".zip", ".jpg", ".png", "logout", "login")


def explorable(href: Column, page: Column, skipped: tuple[str, ...] = SKIPPED) -> Column:
    """On the page's domain or one above or below it, and nothing that is skipped."""
    h, p = host(href), host(page)
    bad = F.lit(False)
    for s in skipped:
        bad = bad | F.lower(href).contains(s)
    near = (h == p) | h.endswith(F.concat(F.lit("."), p)) | p.endswith(F.concat(F.lit("."), h))
    return href.rlike("(?i)^https?://") & ~bad & near & (h != "")
