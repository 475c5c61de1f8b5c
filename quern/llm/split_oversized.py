r"""Cutting oversized texts into pieces at natural boundaries.

One regular expression with bounded quantifiers does the cutting. Its alternatives stand in the order of boundary strength (end of a
paragraph, end of a sentence, end of a word), first with at least half a piece before them, then with less, and each takes as much as fits;
the last one takes characters as they come. The
overlap is looked up by the pieces' offsets, so that no piece depends on the one before and everything stays inside one row.

Defined results: null texts and texts within the limit give no piece; every piece has at most ``limit`` code points; the pieces without
their overlaps give the text again, character by character; an overlap holds the ``overlap`` code points before the piece, without the
word that it would begin inside of; repeated rows give their pieces each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.runtime import in_force, table

LIMIT, OVERLAP = 2000, 100


def _cutter(limit: int) -> str:
    ends = [
        r"(?<=\n[ \t\r]{0,8}\n)(?!\s*\z)",
        r"(?<=[.!?…。][\"'”’»)\]]{0,2}\s)(?=\S)",
        r"(?<=\s)(?=\S)",
    ]
    # first those that fill half a piece at least, so that a heading does not become a piece of its own
    takes = [rf"[\s\S]{{{max(limit // 2, 1)},{limit}}}" + end for end in ends] + [rf"[\s\S]{{1,{limit}}}" + end for end in ends]
    return "|".join([rf"[\s\S]{{1,{limit}}}\z", *takes, rf"[\s\S]{{1,{limit}}}"])


def segments(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The text cut into consecutive segments: the first within ``limit``, the others leaving room for their overlap."""
    first, more = _cutter(limit), _cutter(limit - overlap)
    return F.regexp_extract_all(text, F.lit(rf"\A(?:{first})|(?:{more})"), F.lit(0))


def _lead(parts: Column, i: Column, overlap: int) -> Column:
    """What piece ``i`` repeats: the last ``overlap`` code points before it, without the word that they would begin inside of."""
    end = lambda x: F.right(x, F.lit(overlap + 1))
    last = F.element_at(parts, i)
    # as a rule they lie in the segment before; segments have a code point at least, so overlap + 1 of them always suffice
    first = F.greatest(i - overlap, F.lit(1))
    more = F.aggregate(F.slice(parts, first, i - first + 1), F.lit(""), lambda acc, p: end(F.concat(acc, p)))
    near = F.when(F.length(last) > overlap, end(last)).otherwise(more)
    at_word = F.regexp_extract(near, r"(?s)(?<=\s)\S.*\z", 0)
    return F.when(F.length(near) <= overlap, near).when(at_word != "", at_word).otherwise(F.right(near, F.lit(overlap)))


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, start, own_start, content) for each piece of the texts longer than ``limit`` code points.

    ``start`` is the offset of the piece in the text, ``own_start`` the offset behind its overlap; both count code points from 0.
    """
    if not 0 < overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > limit)
    parts = F.col("parts")
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))

    def piece(i: Column) -> Column:
        lead = F.when(i == 0, F.lit("")).otherwise(_lead(parts, F.greatest(i, F.lit(1)), overlap))
        own = F.element_at("ends", i + 1)
        return F.struct(i.alias("chunk_index"), (own - F.length(lead)).alias("start"), own.alias("own_start"), F.concat(lead, F.element_at(parts, i + 1)).alias("content"))

    cut = src.select("id", segments(F.col("text"), limit, overlap).alias("parts")).withColumn("ends", ends)
    return cut.select(F.col("id").alias(id_col), F.inline(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), piece)))


def oversized_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunk_nodes").select("node_id", "content", "ingested_at")
    return split_oversized(in_force(chunks, "node_id", "ingested_at"), "node_id", "content")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_pieces(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the operator cut: those with a first piece."""
    return oversized_pieces(spark, sf_dir).where("chunk_index = 0").select("node_id")
