"""Long spans that stand, character by character, in more than one text.

Every window of a fixed number of code points gets its Rabin-Karp hash. Windows that stand in one text only are most of them, and need not be
counted: a span of ``length`` code points holds several consecutive shorter windows, and of any so many consecutive ones the one with the
least hash is counted first. Both texts choose the same window of a common span, whatever stands around it, so all windows of the full
length that a second text may hold lie around such repeated choices. These are hashed (128 bits) and counted in Spark; repeated windows
merge into maximal intervals of their text. No pairs of texts are formed for that.

Pairs are formed when they are asked for: of the windows that stand in the same texts one is enough, its characters are compared, and the
texts of a window that many have are dealt out.

Equal texts are one class all the way and are told apart at the end only.

Defined results: null texts and texts under ``length`` code points share nothing; repeated rows with one id are one document; documents
without id are left out; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.runtime import stored, table

LENGTH, WINDOW = 300, 250
#: Texts of one window that are compared in one go with all its texts.
DEALT = 2000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + n // 2, base, np.uint64))])
    return _powers[0][:n], _powers[1][:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window, modulo 2^64, by differences of prefix sums."""
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = _power(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return _mix((sums[width:] - sums[:-width]) * down[:n])


def chosen_windows(hashes: np.ndarray, run: int) -> np.ndarray:
    """The distinct least hashes of any ``run`` consecutive windows."""
    n = len(hashes)
    if n <= run:
        return hashes.min(keepdims=True) if n else hashes
    padded = np.concatenate([hashes, np.full(-n % run, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, run)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.unique(np.minimum(behind[: n - run + 1], ahead[run - 1 : n]))


def _fingerprints(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found = chosen_windows(window_hashes(points(text), window), length - window + 1)
                prints.append(found.view(np.int64))
                ids.append(np.full(len(found), i, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prints)), pa.array(np.concatenate(ids))], names=["print", "id"])

    return run


def windows_around(codes: np.ndarray, prints: np.ndarray, length: int, window: int) -> np.ndarray:
    """Starts of the windows of ``length`` that hold a shorter one with one of the hashes ``prints``."""
    at = np.flatnonzero(np.isin(window_hashes(codes, window), prints))
    n = len(codes) - length + 1
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(at + window - length, 0, n), 1)
    np.add.at(change, np.clip(at + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def _windows(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes = points(batch.column("text")[k].as_py())
                starts = windows_around(codes, batch.column("prints")[k].values.to_numpy().view(np.uint64), length, window)
                # the second hash is that of other code points
                h = [window_hashes(c, length)[starts].view(np.int64) for c in (codes, codes ^ np.uint32(0x5A5A5A))]
                for at in range(0, len(starts), 65_536):
                    part = slice(at, at + 65_536)
                    n = len(starts[part])
                    yield pa.RecordBatch.from_arrays([pa.array(h[0][part]), pa.array(h[1][part]), pa.array(np.full(n, batch.column("id")[k].as_py())), pa.array(starts[part].astype(np.int32))], names=["h0", "h1", "id", "start"])

    return run


class SharedSpans:
    """Classes of equal texts (``members``: id, class, size) and the intervals that other texts hold too (``spans``: class, start, end)."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, window: int = WINDOW) -> None:
        if not 0 < window <= length:
            raise ValueError("the window must not be longer than the span")
        self.length = length
        src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).where((F.length("text") >= length) & F.col("id").isNotNull())
        keyed = src.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
        classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.countDistinct("id").alias("size"))
        self.members = keyed.select("id", "h1", "h2").distinct().join(classes, ["h1", "h2"]).select("id", "class", "size")
        self.reps = stored(keyed.join(classes, ["h1", "h2"]).where("id = class").groupBy("id").agg(F.first("text").alias("text")))
        prints = self.reps.mapInArrow(_fingerprints(length, window), "print bigint, id bigint").repartition("print")
        often = prints.groupBy("print").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("print")
        around = prints.join(often, "print").groupBy("id").agg(F.collect_list("print").alias("prints"))
        windows = self.reps.join(around, "id").mapInArrow(_windows(length, window), "h0 bigint, h1 bigint, id bigint, start int")
        count = windows.groupBy("h0", "h1").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("id").bitwiseAND(F.lit(2**31 - 1).cast("bigint"))).alias("texts"), F.bit_xor(F.xxhash64("id")).alias("texts_xor")).where("low < high")
        self.windows = stored(windows.join(count, ["h0", "h1"]))
        order = Window.partitionBy("id").orderBy("start")
        fresh = F.coalesce(F.col("start") - F.lag("start").over(order) > length, F.lit(True))
        islands = self.windows.select("id", "start").withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        self.spans = islands.groupBy(F.col("id").alias("class"), "island").agg(F.min("start").alias("start"), (F.max("start") + length).alias("end")).drop("island")

    def pairs(self) -> DataFrame:
        """(a, b): the classes that share a span, a < b."""
        key = ["n", "texts", "texts_xor", "low", "high"]
        one = self.windows.groupBy(*key).agg(F.min(F.struct("h0", "h1")).alias("h")).select("h.h0", "h.h1")
        some = self.windows.join(one, ["h0", "h1"]).groupBy("h0", "h1", "id").agg(F.min("start").alias("start"), F.first("n").alias("n"))
        held = some.join(self.reps, "id").select("h0", "h1", "id", F.substring("text", F.col("start") + 1, F.lit(self.length)).alias("span"), F.ceil(F.col("n") / DEALT).cast("int").alias("parts"))
        held = stored(held)
        left = held.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumnRenamed("id", "a").drop("parts")
        right = held.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumnRenamed("id", "b").drop("parts")
        return left.join(right, ["h0", "h1", "span", "part"]).where("a < b").select("a", "b").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SharedSpans(table(spark, sf_dir, "documents"), "doc_id", "text")
    copies = found.members.where("size > 1")
    of = lambda df, c, i: df.select(F.col("class").alias(c), F.col("id").alias(i))
    across = found.pairs().join(of(found.members, "a", "x"), "a").join(of(found.members, "b", "y"), "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    within = of(copies, "c", "doc_a").join(of(copies, "c", "doc_b"), "c").where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(within)


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document that shares a span: how many of its code points stand in other documents, and in how many intervals."""
    docs = table(spark, sf_dir, "documents")
    found = SharedSpans(docs, "doc_id", "text")
    partly = found.spans.groupBy("class").agg(F.sum(F.col("end") - F.col("start")).alias("part"), F.count("*").alias("spans"))
    sizes = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("chars")).distinct()
    rows = found.members.join(partly, "class", "left").join(sizes, "id")
    whole = F.col("size") > 1
    out = rows.select(F.col("id").alias("doc_id"), F.when(whole, F.col("chars")).otherwise(F.col("part")).cast("bigint").alias("shared_chars"), F.when(whole, F.lit(1)).otherwise(F.col("spans")).cast("bigint").alias("spans"), F.col("chars").cast("bigint").alias("chars"))
    return out.where("shared_chars is not null")
