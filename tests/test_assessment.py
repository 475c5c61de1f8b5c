import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from quern.operators import assessment as A


def test_kept_sets_against_going_through_in_order(spark):
    rng = random.Random(5)
    sets = {}
    for k in range(60):
        base = sets[rng.choice(sorted(sets))] if sets and rng.random() < 0.7 else {f"n{rng.randrange(40)}" for _ in range(10)}
        sets[f"s{k:02}"] = {x if rng.random() > 0.06 else f"n{rng.randrange(40)}" for x in base}
    kept: list[str] = []
    for s in sorted(sets):
        if not any(len(sets[s] & sets[o]) > 0.7 * len(sets[s] | sets[o]) for o in kept):
            kept.append(s)
    rows = spark.createDataFrame([(s, n) for s, ns in sets.items() for n in sorted(ns)], "sample string, node string")
    assert sorted(r["sample"] for r in A.kept_sets(rows).collect()) == kept and len(kept) < len(sets)
    assert A.kept_sets(rows.limit(0)).count() == 0


def test_reasoning_steps(spark):
    rows = [
        ("1. **Read**: the table\n2. **Add** the rows\n- last: done", ["Read: the table", "Add: the rows"]),
        ("We check the first table of the file. Short check. Nothing here at all, really.", ["We check the first table of the file"]),
        ("", []),
    ]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = [r[0] for r in df.select(A.reasoning_steps(F.col("t"))).collect()]
    assert got[0][:2] == rows[0][1] and got[1:] == [w for _, w in rows[1:]]


def test_split_by_count(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    n = {r["part"]: r["count"] for r in A.split_by_count(df, "k", {"a": 0.7, "b": 0.15, "c": 0.15}).groupBy("part").count().collect()}
    assert n == {"a": 700, "b": 150, "c": 150}
    assert A.split_by_count(df.limit(0), "k", {"a": 0.5, "b": 0.5}).count() == 0


def test_mocks_and_assessments(spark):
    df = spark.createDataFrame([(A.MOCK_ANSWERS[0] + " ", []), ("x", ["chunk_1", "para_2"]), ("x", ["chunk_1", "para_3"]), (None, [])], "a string, c array<string>")
    assert [r[0] for r in df.select(A.is_mock(F.col("a"), F.col("c"))).collect()] == [True, True, False, False]
    replies = spark.createDataFrame([('So: {"relevance": 0.5, "completeness": "x"} ok',), ("none",), (None,)], "r string")
    assert [tuple(r["a"]) for r in replies.select(A.assessment(F.col("r")).alias("a")).collect()] == [(0.0, 0.5, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_semantic_search_over_many_pairs(spark):
    """8 million pairs: the ten best with copies, scaled copies and vectors of another size among them; pair by pair in the JVM they took minutes."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20_000, 64)).astype(np.float32)
    v[5000:5030], v[6000:6015], v[19_990:] = v[7], 2 * v[8], v[399]
    ids = [f"n{i:05}" for i in rng.permutation(len(v))]
    nodes = spark.createDataFrame(pd.DataFrame({"node_id": [*ids, "short", "zero", "nan"], "embedding": [*v.tolist(), [1.0, 2.0], [0.0] * 64, [float("nan")] * 64]}), "node_id string, embedding array<float>").repartition(3).persist()
    nodes.count()
    gold = [["zero", "nowhere", ids[i], ids[i + 1]] for i in range(400)] + [["short"], ["nan"], []]
    tasks = spark.createDataFrame([(f"t{i:03}", g) for i, g in enumerate(gold)], "task_id string, gold_nodes array<string>")
    began = time.time()
    got = {(r["task_id"], r["rank"]): (r["node"], r["score"]) for r in A.semantic_search(tasks, nodes).collect()}
    assert time.time() - began < 60
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    want = {("t400", 1): ("short", 1.0)}
    for i, scores in enumerate(np.round(unit[:400] @ unit.T, 6)):
        for rank, j in enumerate(sorted(np.argsort(-scores)[:200], key=lambda j: (-scores[j], ids[j]))[:10], 1):
            want[f"t{i:03}", rank] = (ids[j], scores[j])
    assert {k: (n, round(float(x), 5)) for k, (n, x) in got.items()} == {k: (n, round(float(x), 5)) for k, (n, x) in want.items()}
    nodes.unpersist()
