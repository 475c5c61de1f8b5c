"""Records of the evaluation splits that stand, exactly or nearly, in the training split.

Each text gets a fingerprint of bits that two texts share the more, the more alike their word sets are: 12 segments of 63 bits, each the lower bits
of three minima of hash functions over the words, and 128 parity bits. Codes of the two sides are joined on equal segments. What meets must lie
within the Hamming radius that the wanted likeness allows for the parity bits (a word flips one bit, so two sets differ in no more bits than
words), and then have the likeness itself. Of the pairs with a likeness of 0.7, 0.8 and 0.9 the segments bring together 99.3 %, 99.98 % and all
but one in 10^6; ``exact`` finds all, by the index lists of ``near_dup``, in more time.

Bits of minima are used, rather than signs of random projections, because signs at a likeness of 0.7 differ in one place of five: a segment of 16
signs stays equal in 3 % of such pairs, so that it would take over 200 segments to find them.

Texts with equal word sets are one class until the end; a class counts for a side when one of its rows does.

Defined results: texts without words are like nothing; rows of neither side take no part; null sample ids are equal to nothing; repeated rows
are told apart by row id; rows without row id are left out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.words import overlap, word_set
from quern.llm.near_dup import EPS, LEAST, AlikeSets, _mix, parity_bits
from quern.plans.runtime import stored, table

SEGMENTS, SLOTS, SLOT_BITS = 12, 3, 21
_SEEDS = np.random.default_rng(71).integers(1, 2**63, (SEGMENTS, SLOTS)).astype(np.uint64)


def fingerprints(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The segments of each set's code, one row a set."""
    out = np.zeros((len(offsets), SEGMENTS), np.uint64)
    for s in range(SEGMENTS):
        for k in range(SLOTS):
            least = np.minimum.reduceat(_mix(words ^ _SEEDS[s, k]), offsets)
            out[:, s] = (out[:, s] << np.uint64(SLOT_BITS)) | (least & np.uint64(2**SLOT_BITS - 1))
    return out


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            col = part.column("words")
            words = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(col.offsets.to_numpy(zero_copy_only=False))
            offsets = np.cumsum(sizes) - sizes
            low, up = parity_bits(words, offsets)
            code = fingerprints(words, offsets).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * SEGMENTS, pa.int32()), pa.array(code.ravel()))
            keep = [part.column(c) for c in ("field", "id", "train", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sizes.astype(np.int32)), pa.array(low), pa.array(up), lists], names=["field", "id", "train", "h1", "h2", "n", "b0", "b1", "code"])


class SplitOverlap:
    """``alike``: field, train_id, eval_id of the alike classes of different word sets; ``members``: field, class, id, train of every row."""

    def __init__(self, rows: DataFrame, least: float = LEAST, exact: bool = False) -> None:
        """``rows``: field int, id bigint, train boolean, text string."""
        rows = rows.where("id is not null and train is not null")
        sets = stored(rows.select("field", "id", "train", word_set(F.col("text")).alias("words")).where(F.size("words") > 0).select("*", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2")))
        coded = sets.mapInArrow(_code, "field int, id bigint, train boolean, h1 bigint, h2 bigint, n int, b0 bigint, b1 bigint, code array<bigint>")
        classes = stored(
            coded.groupBy("field", "h1", "h2").agg(
                F.min("id").alias("id"), F.count("*").alias("size"), F.max("train").alias("has_train"), F.max(~F.col("train")).alias("has_eval"), *[F.any_value(c).alias(c) for c in ("n", "b0", "b1", "code")]
            )
        )
        crowded = classes.where("size > 1").select("field", "h1", "h2", F.col("id").alias("class"))
        copies = sets.select("field", "h1", "h2", "id", "train").join(crowded, ["field", "h1", "h2"]).select("field", "class", "id", "train").distinct()
        self.members = stored(copies.unionByName(classes.where("size = 1").select("field", F.col("id").alias("class"), "id", F.col("has_train").alias("train"))))
        side = lambda name: classes.where(f"has_{name}")
        if exact:
            ids = lambda name: side(name).select("field", F.col("id").alias(f"{name}_id"))
            found = AlikeSets(rows.select(F.col("field").alias("space"), "id", "text").distinct(), least).pairs.withColumnRenamed("space", "field")
            both = found.toDF("field", "train_id", "eval_id").unionByName(found.toDF("field", "eval_id", "train_id"))
            self.alike = both.join(ids("train"), ["field", "train_id"]).join(ids("eval"), ["field", "eval_id"]).select("field", "train_id", "eval_id")
            return
        blocks = lambda name: side(name).select("field", "id", "n", "b0", "b1", F.posexplode("code").alias("segment", "bits")).select(
            F.xxhash64("field", "segment", "bits").alias("key"), *[F.col(c).alias(f"{name}_{c}") for c in ("field", "id", "n", "b0", "b1")]
        )
        n, m = F.col("train_n"), F.col("eval_n")
        need = F.ceil(F.lit(least / (1 + least)) * (n + m) - EPS)
        apart = F.bit_count(F.col("train_b0").bitwiseXOR(F.col("eval_b0"))) + F.bit_count(F.col("train_b1").bitwiseXOR(F.col("eval_b1")))
        met = blocks("train").join(blocks("eval"), "key").where((F.col("train_field") == F.col("eval_field")) & (F.col("train_id") != F.col("eval_id")) & (F.least(n, m) >= need) & (apart <= n + m - 2 * need))
        met = stored(met.select(F.col("train_field").alias("field"), "train_id", "eval_id").distinct())
        some = met.select("field", F.explode(F.array("train_id", "eval_id")).alias("id")).distinct()
        words = stored(sets.select("field", "id", "words").join(some, ["field", "id"], "left_semi").dropDuplicates(["field", "id"]))
        of = lambda c: words.select("field", F.col("id").alias(f"{c}_id"), F.col("words").alias(c))
        common = overlap(F.col("train"), F.col("eval"))
        self.alike = met.join(of("train"), ["field", "train_id"]).join(of("eval"), ["field", "eval_id"]).where(common >= F.lit(least) * (F.size("train") + F.size("eval") - common) - EPS).select("field", "train_id", "eval_id")

    def _rows(self, name: str) -> DataFrame:
        return self.members.where(F.col("train") == (name == "train")).select("field", F.col("class").alias(f"{name}_id"), F.col("id").alias(f"{name}_row"))

    @property
    def pairs(self) -> DataFrame:
        """(field, train_row, eval_row): the classes spelled out."""
        across = self.alike.join(self._rows("train"), ["field", "train_id"]).join(self._rows("eval"), ["field", "eval_id"])
        same = self._rows("train").withColumnRenamed("train_id", "class").join(self._rows("eval").withColumnRenamed("eval_id", "class"), ["field", "class"])
        return across.select("field", "train_row", "eval_row").unionByName(same.select("field", "train_row", "eval_row"))

    def counts(self) -> DataFrame:
        """(field, eval_row, pairs): with how many training rows each evaluation row overlaps; pairs are counted by class, not spelled out."""
        trained = self._rows("train").groupBy("field", "train_id").agg(F.count("*").alias("n"))
        both = self.alike.unionByName(trained.select("field", "train_id", F.col("train_id").alias("eval_id")))
        per = both.join(trained, ["field", "train_id"]).groupBy("field", "eval_id").agg(F.sum("n").alias("pairs"))
        return self._rows("eval").join(per, ["field", "eval_id"]).select("field", "eval_row", "pairs")


def split_name(c: Column) -> Column:
    """The split, however it is written: train, validation, test; null for anything else."""
    name = F.lower(F.trim(c))
    name = F.when(name == "val", "validation").otherwise(name)
    return F.when(name.isin("train", "validation", "test"), name)


HOW = ("prompt", "context")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "training_samples").select("row_id", "prompt", "context", "source", split_name(F.col("split")).alias("split"), F.regexp_replace("sample_id", "_(para|emph|reorder)$", "").alias("base")).withColumn("train", F.col("split") == "train")


def _texts(samples: DataFrame) -> SplitOverlap:
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("text")) for k, c in enumerate(HOW)])
    return SplitOverlap(samples.select(F.col("row_id").alias("id"), "train", F.inline(fields)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    base = samples.where("base is not null and train is not null")
    ids = base.where("train").select("base", F.col("row_id").alias("train_row")).join(base.where("not train").select("base", F.col("row_id").alias("eval_row")), "base")
    both = _texts(samples).pairs.select("train_row", "eval_row").unionByName(ids.select("train_row", "eval_row"))
    return both.select(F.least("train_row", "eval_row").alias("row_a"), F.greatest("train_row", "eval_row").alias("row_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation rows and pairs, per split and source of the evaluation row and way of overlap."""
    samples = _samples(spark, sf_dir)
    base = samples.where("base is not null and train is not null")
    trained = base.where("train").groupBy("base").agg(F.count("*").alias("pairs"))
    ids = base.where("not train").join(trained, "base").select(F.col("row_id").alias("eval_row"), F.lit("sample_id").alias("how"), "pairs")
    texts = _texts(samples).counts().select("eval_row", F.element_at(F.array(*[F.lit(h) for h in HOW]), F.col("field") + 1).alias("how"), "pairs")
    rows = samples.select(F.col("row_id").alias("eval_row"), "split", "source")
    return texts.unionByName(ids).join(rows, "eval_row").groupBy("split", "source", "how").agg(F.countDistinct("eval_row").alias("eval_rows"), F.sum("pairs").alias("pairs"))
