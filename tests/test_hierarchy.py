import random

from pyspark.sql import functions as F
from quern.operators.hierarchy import hierarchy, parents_of


def by_hand(parent):
    out = {}
    for n in parent:
        path, seen, x = [], set(), n
        while x is not None and x not in seen:
            seen.add(x)
            path.append(x)
            x = parent[x]
        out[n] = ("cycle", -1, None) if x is not None else (path[-1], len(path) - 1, path[::-1])
    return out


def run(spark, parent, paths=True):
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    return {r["node"]: r for r in hierarchy(df, paths).collect()}


def test_random_forests_with_cycles_and_a_long_chain(spark):
    rng = random.Random(4)
    parent = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(150)}
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(120)}
    parent |= {"x1": "x2", "x2": "x3", "x3": "x1", "y1": "x2", "y2": "y1", "self": "self", "z": "self"}
    want = by_hand(parent)
    got = run(spark, parent)
    assert set(got) == set(want)
    for n, (root, depth, path) in want.items():
        assert (got[n]["root"], got[n]["depth"], got[n]["path"]) == (root, depth, path)
        if depth >= 0:
            assert got[n]["descendants"] == sum(1 for r, d, p in want.values() if p and n in p[:-1])
    shallow = run(spark, parent, paths=False)
    assert {n: (r["root"], r["depth"]) for n, r in shallow.items()} == {n: (r, d) for n, (r, d, _) in want.items()}


def test_flat_and_empty(spark):
    assert all(r["depth"] == 1 for n, r in run(spark, {"r": None, **{f"k{i}": "r" for i in range(300)}}).items() if n != "r")
    assert hierarchy(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_parents(spark):
    rows = [
        ("a", None, ["b", "b", "zz", None]),
        ("b", " ", None),
        ("c", "a", []),
        ("d", "gone", None),
        ("e", None, ["c"]),  # contradicts the entry of c
        ("f", "", ["e"]),
        (None, None, ["f"]),
    ]
    df = spark.createDataFrame(rows, "id string, up string, down array<string>").withColumn("node", F.lit(1)).withColumn("parent", F.lit(2)).where("id is not null")
    got = {r["node"]: r["parent"] for r in parents_of(df, "id", "up", "down").collect()}
    assert got == {"a": None, "b": "a", "c": "a", "d": None, "e": "f", "f": None}
