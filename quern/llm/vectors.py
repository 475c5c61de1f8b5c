"""The most similar vectors of every vector, by cross-polytope hashing.

A vector of unit length is turned by three rounds of random signs and a fast Hadamard transform; its hash is the signed axis nearest to
the result. Tables of such hashes collect candidates, multi-probe: besides its own bucket a vector also asks for those that the second
nearest axes name. Candidates are ranked by their exact cosines.

Defined results: only vectors of exactly ``dim`` finite numbers, not all zero, take part; of several rows for one id the caller says which
holds (``in_force``); repeated vectors are each other's neighbours with a cosine of 1; ties go to the lesser id; columns other than id and
vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.runtime import in_force, stored, table

DIM, SEED, SIGNS = 64, 20240917, 192
#: Near pairs: the chance that a pair at the least cosine is found, and mean vectors a bucket. Buckets with more than HOT_LOAD rows, by a sample of one
#: vector in SAMPLED, are dealt out.
PAIR_RECALL, BUCKET_LOAD, HOT_LOAD, SAMPLED = 0.998, 64, 8192, 16
#: Tables of one hash each, and axes probed in each, for the k most similar vectors.
NEIGHBOUR_TABLES, PROBES = 12, 10
#: Queries a pass of the search holds in memory (a quarter of a kB each).
BLOCK = 16_384


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, a power of two wide, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def rotations(count: int, dim: int, seed: int = SEED) -> np.ndarray:
    """The pseudo-rotations as matrices, count x dim x dim: applying one is then a single product."""
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (count, 3, dim))
    out = []
    for s in signs:
        m = np.eye(dim, dtype=np.float32)
        for k in range(3):
            m = hadamard(m * s[k])
        out.append(m)
    return np.stack(out)


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # also very long and very short ones
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_axes(turned: np.ndarray, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first; axis d + i is the negative of axis i."""
    both = np.concatenate([turned, -turned], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    top = np.argpartition(-both, probes, axis=1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, axis=1), axis=1, kind="stable"), axis=1)


def usable(c: Column, dim: int) -> Column:
    """Whether a vector has exactly ``dim`` finite numbers, not all zero."""
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(c) == dim) & ~bad & F.exists(c, lambda v: v != 0), F.lit(False))


def _keys(x: np.ndarray, turn: np.ndarray, depth: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Own bucket and next bucket of each row in each table (tables x rows): the next one differs in the axis that was decided most narrowly."""
    own, near = [], []
    for t in range(len(turn) // depth):
        axes, margin = [], []
        for m in turn[t * depth : (t + 1) * depth]:
            r = x @ m.T
            two = nearest_axes(r, 2)
            size = np.abs(np.take_along_axis(r, two % dim, axis=1))
            axes.append(two)
            margin.append(size[:, 0] - size[:, 1])
        least = np.argmin(np.stack(margin), axis=0)
        a, b = np.full(len(x), t, np.int64), np.full(len(x), t, np.int64)
        for k, two in enumerate(axes):
            a = a * 2 * dim + two[:, 0]
            b = b * 2 * dim + np.where(least == k, two[:, 1], two[:, 0])
        own.append(a)
        near.append(b)
    return np.stack(own), np.stack(near)


def table_recall(least: float, depth: int, dim: int) -> float:
    """The chance that one table brings two vectors with a cosine of ``least`` together, by simulation."""
    rng = np.random.default_rng(SEED)
    x = rng.normal(size=(20_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = least * x + np.sqrt(max(1 - least * least, 0)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    turn = rotations(depth, dim)
    (own_x, near_x), (own_y, near_y) = _keys(x.astype(np.float32), turn, depth, dim), _keys(y.astype(np.float32), turn, depth, dim)
    return float(((own_x == own_y) | (own_x == near_y) | (near_x == own_y)).mean())


def _buckets(tables: int, depth: int, dim: int):
    """Rows (bucket, id, sign bits): a vector's own bucket in each table, and the one it most nearly fell into.

    The last sign bit tells which of the two it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, signs = rotations(tables * depth, dim), rotations(-(-SIGNS // dim), dim, SEED + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = unit_rows(part.column("v"), dim).astype(np.float32)
                ids = part.column("id").to_numpy()
                bits = np.packbits(np.concatenate([(x @ m.T) > 0 for m in signs], axis=1)[:, :SIGNS], axis=1).view(np.int64)
                own, near = _keys(x, turn, depth, dim)
                home = np.repeat(np.array([1, 0]), tables * len(x))
                last = (np.tile(bits[:, 2], 2 * tables) & ~1) | home
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own.ravel(), near.ravel()])), pa.array(np.tile(ids, 2 * tables)), pa.array(np.tile(bits[:, 0], 2 * tables)), pa.array(np.tile(bits[:, 1], 2 * tables)), pa.array(last)], names=["bucket", "id", "s0", "s1", "s2"])

    return run


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = (unit_rows(batch.column("va"), dim) * unit_rows(batch.column("vb"), dim)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cos)], names=["a", "b", "cosine"])

    return run


def near_pairs(df: DataFrame, id_col: str, vector_col: str, version_col: str, least: float = 0.9, recall: float = PAIR_RECALL, dim: int = DIM, load: int = BUCKET_LOAD) -> DataFrame:
    """(a, b, cosine) of the ids whose vectors, in the rows with the latest version, have a cosine of at least ``least``; a < b.

    Equal vectors are one class until the end. The number of hashes a table grows with the logarithm of the number of classes, so that the mean
    bucket stays under ``load`` vectors, and the number of tables so that a pair at ``least`` is found with a chance of ``recall`` (pairs nearer
    than that with a greater one). Buckets that a sample shows to hold many times more are dealt out. Before vectors are fetched, 191 signs of random
    projections are compared; the signs two vectors differ in are binomial, and the bound lies 3.5 deviations over their mean at ``least``.
    """
    if dim & (dim - 1):
        raise ValueError("the Hadamard transform wants a power of two")
    kind = df.schema[id_col].dataType.simpleString()
    v = F.col(f"`{vector_col}`")
    # a class is told by the hash of its vector; two vectors that should share a hash are both fetched and compared
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("name"), F.col(f"`{version_col}`").alias("version"), v.cast("array<float>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v"), dim), F.col("v"))).withColumn("id", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    last = F.max(F.struct(F.col("version").isNotNull().alias("known"), "version", F.coalesce("id", F.lit(0)).alias("tie"), "id"))
    members = stored(rows.groupBy("name").agg(last.alias("last")).select("name", F.col("last.id").alias("id")).where("id is not null"))
    classes = stored(rows.where("id is not null").groupBy("id").agg(F.any_value("v").alias("v")))
    depth = max(2, math.ceil(math.log(max(classes.count(), 1) / load) / math.log(2 * dim))) if load else 2
    chance = table_recall(least, depth, dim)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - chance)) if chance < 1 else 1
    put = classes.mapInArrow(_buckets(tables, depth, dim), "bucket bigint, id bigint, s0 bigint, s1 bigint, s2 bigint")
    p = np.arccos(least) / np.pi
    far = int(np.ceil(SIGNS * p + 3.5 * np.sqrt(SIGNS * p * (1 - p))))
    differ = [F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}")) for k in range(3)]
    apart = F.bit_count(differ[0]) + F.bit_count(differ[1]) + F.bit_count(differ[2].bitwiseAND(F.lit(-2)))
    home = F.col("a2").bitwiseOR(F.col("b2")).bitwiseAND(F.lit(1)) == 1

    def meeting(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
        a, b = left.withColumnsRenamed({"id": "a", "s0": "a0", "s1": "a1", "s2": "a2"}), right.withColumnsRenamed({"id": "b", "s0": "b0", "s1": "b1", "s2": "b2"})
        return a.join(b, key).where((F.col("a") < F.col("b")) & home & (apart <= far)).select("a", "b")

    some = classes.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SAMPLED)) == 0).mapInArrow(_buckets(tables, depth, dim), put.schema)
    hot = stored(some.groupBy("bucket").agg(F.ceil(F.count("*") * SAMPLED / HOT_LOAD).cast("int").alias("parts")).where("parts > 1"))
    if hot.isEmpty():
        met = meeting(put, put, ["bucket"])
    else:
        cold = put.join(hot, "bucket", "left_anti")
        left = put.join(hot, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        right = put.join(hot, "bucket").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
        met = meeting(cold, cold, ["bucket"]).unionByName(meeting(left, right, ["bucket", "part"]))
    met = stored(met.distinct())
    asked = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = stored(classes.join(asked, "id", "left_semi"))
    of = lambda c: found.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    near = met.join(of("a"), "a").join(of("b"), "b").mapInArrow(_cosines(dim), "a bigint, b bigint, cosine double").where(F.col("cosine") >= least)
    name = lambda c: members.select(F.col("id").alias(c), F.col("name").alias(f"name_{c}"))
    across = near.join(name("a"), "a").join(name("b"), "b").select("name_a", "name_b", "cosine")
    within = name("a").join(name("b"), F.col("a") == F.col("b")).where("name_a < name_b").select("name_a", "name_b", F.lit(1.0).alias("cosine"))
    return across.unionByName(within).select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "cosine")


def _search(names: list, q: np.ndarray, k: int, tables: int, probes: int, dim: int):
    """The k best of each batch of vectors for each query of a block; candidates are those in a probed bucket of any table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(tables, dim)
        probed = np.zeros((tables, 2 * dim, len(q)), bool)
        for t in range(tables):
            axes = nearest_axes(q @ turn[t].T, probes)
            probed[t, axes.ravel(), np.repeat(np.arange(len(q)), probes)] = True
        best, best_id = np.full((len(q), k), -2, np.float32), np.full((len(q), k), None, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = unit_rows(part.column("v"), dim).astype(np.float32)
                ids = np.array(part.column("id").to_pylist(), object)
                asked = np.zeros((len(x), len(q)), bool)
                for t in range(tables):
                    asked |= probed[t, (nearest_axes(x @ turn[t].T, 1))[:, 0]]
                s = np.where(asked, x @ q.T, np.float32(-2))
                # only vectors better than a query's last one are looked at
                i, j = np.nonzero(s > best[:, -1] - np.float32(1e-6))
                keep = ids[i] != names[j]
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                jj, who = np.unique(j, return_inverse=True)
                order = np.lexsort((ids[i].astype(str), -s[i, j], who))
                i, who = i[order], who[order]
                rank = np.arange(len(i)) - np.searchsorted(who, who)
                i, who, rank = i[rank < k], who[rank < k], rank[rank < k]
                new, new_id = np.full((len(jj), k), -2, np.float32), np.full((len(jj), k), None, object)
                new[who, rank], new_id[who, rank] = s[i, jj[who]], ids[i]
                all_s, all_id = np.concatenate([best[jj], new], axis=1), np.concatenate([best_id[jj], new_id], axis=1)
                top = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
                best[jj], best_id[jj] = np.take_along_axis(all_s, top, axis=1), np.take_along_axis(all_id, top, axis=1)
        i, r = np.nonzero(best > -2)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(names[i].tolist()), pa.array(best_id[i, r].tolist()), pa.array(best[i, r].astype(np.float64))], names=["query", "neighbour", "cosine"])

    return run


def neighbours(queries: DataFrame, df: DataFrame, id_col: str, vector_col: str, k: int = 10, tables: int = NEIGHBOUR_TABLES, probes: int = PROBES, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """(query, neighbour, cosine, rank): for each row of ``queries`` its k most similar vectors among all of ``df``, itself left out.

    The queries pass in blocks of bounded size; each partition keeps the k best of its own vectors for each query.
    """
    kind = df.schema[id_col].dataType.simpleString()
    v = F.col(f"`{vector_col}`")
    ready = lambda x: x.where(usable(v, dim)).select(F.col(f"`{id_col}`").alias("id"), v.cast("array<float>").alias("v"))
    base = ready(df)
    asked = stored(ready(queries).withColumn("block", F.lit(0)))
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow()
        if not held.num_rows:
            continue
        q = unit_rows(held.column("v").combine_chunks(), dim).astype(np.float32)
        part = base.mapInArrow(_search(np.array(held.column("id").to_pylist(), object), q, k, tables, probes, dim), f"query {kind}, neighbour {kind}, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = base.select(F.col("id").alias("query"), F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine")).limit(0)
    order = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_force(table(spark, sf_dir, "nodes").select("node_id", "embedding", "ingested_at"), "node_id", "ingested_at").select("node_id", "embedding")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nodes").select("node_id", "embedding", "ingested_at")
    return near_pairs(rows, "node_id", "embedding", "ingested_at").select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors of each node whose number is divisible by 50, among all vectors."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where(F.try_to_number(F.regexp_extract("node_id", r"(\d{1,18})$", 1), F.lit("9" * 18)) % 50 == 0)
    return neighbours(asked, rows, "node_id", "embedding").select("query", "neighbour", F.round("cosine", 4).alias("cosine"), "rank")
