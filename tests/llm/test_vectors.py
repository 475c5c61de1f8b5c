import numpy as np
import pytest
from pyspark.sql import functions as F
from quern.llm import vectors as V


def table(spark, vectors):
    rows = [(f"n{i:05}", [float(x) for x in v] if v is not None else None, 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "node_id string, embedding array<float>, version int").withColumn("id", F.lit(0)).withColumn("v", F.lit("x"))


def near(rng, x, cos):
    z = rng.normal(size=x.shape)
    z -= (z @ x) * x
    return cos * x + np.sqrt(1 - cos * cos) * z / np.linalg.norm(z)


def test_rotations_keep_lengths_and_hadamard():
    assert np.allclose(V.hadamard(np.eye(4, dtype=np.float32))[1], [0.5, -0.5, 0.5, -0.5])
    m = V.rotations(2, 64)
    assert np.allclose(m[0] @ m[0].T, np.eye(64), atol=1e-5) and not np.allclose(m[0], m[1])


def test_near_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    extra = [near(rng, x[i], c) for i in range(120) for c in (0.88, 0.92, 0.96)]
    odd = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, [1e-30] * 64, [1e30] * 64]
    all_ = [*x * 3, *extra, x[0], x[0], *odd]
    df = table(spark, all_)
    stale = df.where("node_id < 'n00050'").withColumn("version", F.lit(0)).withColumn("embedding", F.lit(all_[400].tolist()).cast("array<float>"))
    got = {(r["a"], r["b"]) for r in V.near_pairs(df.unionByName(stale), "node_id", "embedding", "version").collect()}
    ok = [i for i, v in enumerate(all_) if v is not None and len(v) == 64 and np.isfinite(np.float32(v)).all() and np.any(np.float32(v) != 0)]
    m = np.array([np.float32(all_[i]).astype(float) / np.abs(np.float32(all_[i])).max() for i in ok])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(m @ m.T, 1) >= 0.9)
    want = {(f"n{ok[a]:05}", f"n{ok[b]:05}") for a, b in zip(i, j)}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 200
    assert V.near_pairs(df.limit(0), "node_id", "embedding", "version").count() == 0


@pytest.mark.parametrize("block", [16384, 10])
def test_neighbours_recall(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 64))
    x = np.repeat(centres, 60, axis=0) + rng.normal(size=(1200, 64))
    df = table(spark, x).select("node_id", "embedding")
    got = V.neighbours(df.where("node_id like '%50'"), df, "node_id", "embedding", block=block).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    queries = sorted({r["query"] for r in got})
    for q in queries:
        k = int(q[1:])
        s = x @ x[k]
        s[k] = -2
        hits += len({f"n{i:05}" for i in np.argsort(-s)[:10]} & {r["neighbour"] for r in got if r["query"] == q})
    assert len(queries) == 12 and hits >= 0.9 * 10 * len(queries)
    assert sorted(r["rank"] for r in got if r["query"] == queries[0]) == list(range(1, 11))
    assert V.neighbours(df.limit(0), df, "node_id", "embedding").count() == 0
