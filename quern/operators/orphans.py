"""References to records that do not exist (yet, or any more).

The keys of the parents are cut into ranges, at bounds taken from a sample of them. Each range's parents are stored once, as sorted arrays; the
references to it come in batches of bounded size, each of which is probed by one vectorised binary search. A hot key's references are
dealt to several batches, each with its own copy of that range's arrays, so that no task meets more than a batch of them.

Defined results: keys are compared trimmed and lower-cased; null and blank keys are no references; a key that several parents carry
counts as one that is there from the first of their creation times on, and as deleted only when each of them is; a parent without
creation time is never late, one without deletion time never deleted; a reference without time is only ever missing. Columns other
than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quern.plans.runtime import in_force, table

#: Parents a range aims at, references a batch aims at, most ranges of one run. What the driver sees of them: ``PER_RANGE`` sampled keys a range
#: and, for each range, its bound and its size.
RANGE_ROWS, BATCH_ROWS, MOST_RANGES, PER_RANGE = 20_000, 50_000, 2**14, 16
#: Keys are compared by at most so many bytes: of longer ones by a beginning and a digest.
WIDEST = 96
FAR, UNKNOWN = 2**62, -(2**61)


def normal_key(c: Column) -> Column:
    """Trimmed of white space and lower-cased; null when nothing is left."""
    key = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(key != "", key)


def search_keys(keys: Iterable[str]) -> np.ndarray:
    """Keys as bytes of one width, in an order of their own. A closing byte keeps apart keys that end in NUL characters."""
    out = []
    for k in keys:
        b = k.encode("utf-8", "surrogatepass")
        out.append((b if len(b) < WIDEST else b[:32] + hashlib.blake2b(b, digest_size=WIDEST - 33).digest()) + b"\x01")
    return np.array(out, dtype=np.bytes_) if out else np.zeros(0, "S1")


def _ranged(bounds: np.ndarray):
    """Adds the number of the range that each key lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, search_keys(batch.column("key").to_pylist()), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "range"])

    return run


def _sorted_arrays(parents: pd.DataFrame) -> pd.DataFrame:
    """The parents of one range as one row: keys in order, and their times."""
    keys = search_keys(parents["key"])
    order = np.argsort(keys, kind="stable")
    return pd.DataFrame({"range": parents["range"].iloc[:1], "width": [keys.dtype.itemsize], "keys": [keys[order].tobytes()], "made": [parents["made"].to_numpy(np.int64)[order].tobytes()], "gone": [parents["gone"].to_numpy(np.int64)[order].tobytes()]})


def _probe(key: tuple, refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """Binary search of a batch of references in the sorted keys of one range."""
    if not len(refs):
        return pd.DataFrame({"ref_id": [], "endpoint": [], "at": [], "kind": []})
    want = search_keys(refs["key"])
    at = refs["at"].to_numpy(np.int64)
    unknown = at == UNKNOWN
    if len(parents):
        held = parents.iloc[0]
        keys, made, gone = np.frombuffer(held["keys"], f"S{held['width']}"), np.frombuffer(held["made"], np.int64), np.frombuffer(held["gone"], np.int64)
        k = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        there, made, gone = keys[k] == want, made[k], gone[k]
    else:
        there = np.zeros(len(want), bool)
        made, gone = np.full(len(want), -FAR), np.full(len(want), FAR)
    kind = np.where(~there, "missing", np.where(~unknown & (gone <= at), "deleted", np.where(~unknown & (made > at), "late", "")))
    miss = kind != ""
    return pd.DataFrame({"ref_id": refs["ref_id"][miss], "endpoint": refs["endpoint"][miss], "at": refs["at"][miss], "kind": kind[miss]})


def orphans(refs: DataFrame, parents: DataFrame, range_rows: int = RANGE_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(ref_id, endpoint, at, kind) of each reference without a valid target at its time.

    ``refs`` has ref_id, endpoint, key and at (timestamp); ``parents`` has key, created_at, deleted_at (one row a record in force).
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = (
        parents.where("key is not null")
        .groupBy("key")
        .agg(F.min(F.coalesce(micros("created_at"), F.lit(-FAR))).alias("made"), F.max(F.coalesce(micros("deleted_at"), F.lit(FAR))).alias("gone"))
    )
    asked = refs.where("key is not null").select("ref_id", "endpoint", "key", F.coalesce(micros("at"), F.lit(UNKNOWN)).alias("at"))
    total = parents.count()
    ranges = min(MOST_RANGES, max(1, round(total / range_rows)))
    # those keys whose hashes are divisible by a number are a sample of them, of about PER_RANGE keys a range
    step = max(1, total // (ranges * PER_RANGE))
    some = np.sort(search_keys(known.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key").toArrow().column("key").to_pylist())) if ranges > 1 else search_keys([])
    bounds = np.unique(some[(np.arange(1, ranges) * len(some)) // ranges]) if len(some) else some
    with_range = lambda df: df.mapInArrow(_ranged(bounds), StructType([*df.schema.fields, StructField("range", IntegerType())]))
    known, asked = with_range(known), with_range(asked)
    arrays = known.groupBy("range").applyInPandas(_sorted_arrays, "range int, width int, keys binary, made binary, gone binary")
    # how many batches each range needs: at most MOST_RANGES rows
    parts = asked.groupBy("range").agg(F.ceil(F.count("*") / batch_rows).cast("int").alias("batches"))
    sizes = F.broadcast(parts)
    dealt = asked.join(sizes, "range").withColumn("batch", F.pmod(F.xxhash64("ref_id", "endpoint"), F.col("batches")).cast("int")).drop("batches")
    copies = arrays.join(sizes, "range").withColumn("batch", F.explode(F.expr("sequence(0, batches - 1)"))).drop("batches")
    kind = refs.schema["ref_id"].dataType.simpleString()
    missed = dealt.groupBy("range", "batch").cogroup(copies.groupBy("range", "batch")).applyInPandas(_probe, f"ref_id {kind}, endpoint string, at bigint, kind string")
    return missed.withColumn("at", F.timestamp_micros(F.when(F.col("at") != UNKNOWN, F.col("at"))).cast(refs.schema["at"].dataType))


def edge_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each end of an edge; repeated deliveries of an edge count once, by the last of them."""
    edges = in_force(table(spark, sf_dir, "edges").select("edge_id", "source_node_id", "target_node_id", "created_at", "ingested_at"), "edge_id", "ingested_at")
    ends = F.array(F.struct(F.lit("source").alias("endpoint"), F.col("source_node_id").alias("id")), F.struct(F.lit("target").alias("endpoint"), F.col("target_node_id").alias("id")))
    return edges.select(F.col("edge_id").alias("ref_id"), F.col("created_at").alias("at"), F.inline(ends)).select("ref_id", "endpoint", normal_key(F.col("id")).alias("key"), "at")


def graph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, creation and deletion time of the records that edges may refer to, by the rows in force."""
    never = F.lit(None).cast("timestamp_ntz").alias("deleted_at")
    nodes = in_force(table(spark, sf_dir, "nodes").select("node_id", "created_at", "deleted_at", "ingested_at"), "node_id", "ingested_at")
    chunks = in_force(table(spark, sf_dir, "chunk_nodes").select("node_id", "created_at", "ingested_at"), "node_id", "ingested_at")
    key = normal_key(F.col("node_id")).alias("key")
    made = F.col("created_at").cast("timestamp_ntz").alias("created_at")
    return (
        nodes.select(key, made, F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))
        .unionByName(chunks.select(key, made, never))
        .unionByName(table(spark, sf_dir, "entity_nodes").select(key, made, never))
    )


def _edge_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(edge_references(spark, sf_dir), graph_records(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_orphans(spark, sf_dir).select(F.col("ref_id").alias("edge_id"), "endpoint", "kind")


def p5_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses per endpoint, kind and month of the edge's creation."""
    return _edge_orphans(spark, sf_dir).groupBy("endpoint", "kind", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
