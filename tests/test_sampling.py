import pytest
from pyspark.sql import functions as F
from quern.operators import sampling as S

EDGE = "edge_id string, edge_type string, source string, target string"


def edges(spark, pairs, kind="t"):
    return spark.createDataFrame([(f"e{i}", kind, a, b) for i, (a, b) in enumerate(pairs)], EDGE).withColumn("weight", F.lit(1.0))


def test_greedy_clusters_as_in_order(spark):
    pairs = [("a", "c"), ("b", "c"), ("b", "d"), ("d", "e"), ("e", "f"), ("x", "x")]
    got = {(r["seed"], r["node"]) for r in S.greedy_clusters(edges(spark, pairs)).collect()}
    near, left, want = {}, set(), set()
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    left = set(near)
    for n in sorted(near):
        if n in left:
            group = {n} | (near[n] & left)
            want |= {(n, x) for x in group}
            left -= group
    assert got == want


def test_samples_are_bounded_and_connected(spark):
    pairs = [("hub", f"n{i:03}") for i in range(200)] + [(f"n{i:03}", f"m{i:03}") for i in range(200)]
    e = edges(spark, pairs)
    seeds = spark.createDataFrame([("hub",), ("m000",)], "node string")
    got = S.sample_around(e, seeds, 2, 7)
    assert {r["sample"]: r["count"] for r in got.groupBy("sample").count().collect()} == {"hub": 7, "m000": 3}
    links = S.sample_edges(got, e)
    assert all(r["connected"] for r in S.connected(got, links).collect())


def test_chains_do_not_come_back(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a"), ("b", "c")])
    for r in S.chains(e, ["t"], 3).collect():
        assert len(set(r["path"])) == len(r["path"]) and r["path"][0] == r["start"]


def test_motifs(spark):
    rows = [("s", 3, ["heading", "paragraph"], ["contains"]), ("t", 1, ["paragraph"], ["sequence"]), ("u", 2, ["figure", "paragraph"], ["refers_to", "sequence"])]
    got = S.matching_motifs(spark.createDataFrame(rows, "sample string, size int, kinds array<string>, links array<string>"))
    assert {(r["sample"], r["motif"]) for r in got.collect()} == {("s", "hierarchy"), ("u", "reference"), ("u", "sequence")}


def test_steps(spark):
    rows = [("t", "navigate", "http://A/x", "http://a/x/y"), ("t", "click", "M1", " m1"), ("t", "input", "two words", "words"), ("t", "extract", "a b c d", "a b x"), ("u", "click", "x", None)]
    df = spark.createDataFrame(rows, "task string, kind string, want string, got string").withColumn("accuracy", S.step_accuracy(F.col("kind"), F.col("want"), F.col("got")))
    assert [r["accuracy"] for r in df.collect()] == [1.0, 1.0, 0.5, 0.5, 0.0]
    got = {r["task"]: (r["navigation"], r["interaction"], r["extraction"]) for r in S.kind_accuracies(df).collect()}
    assert got == {"t": (1.0, 0.75, 0.5), "u": (1.0, 0.0, 1.0)}


def test_sentence_clusters():
    same = ["the valve feeds the ledger", "the valve feeds the page", "quite other words here now"]
    assert len(S.cluster_in_order(same, 0.5, 10, 1000)) == 2
    assert len(S.cluster_in_order(same, 0.5, 100, 1000)) == 1
    assert all(len(x.split()) <= 4 for x in S.cluster_in_order(["w " * 50], 0.5, 1, 24))
    assert S.cluster_in_order([], 0.5, 1, 10) == []


def test_reminders(spark):
    df = spark.createDataFrame([("k", "a\nb\nc")], "k string, t string")
    r = df.select(*[S.with_line(F.col("t"), "NOTE", w, F.col("k")).alias(w) for w in ("prepend", "append", "random")]).collect()[0]
    assert r["prepend"] == "NOTE\n\na\nb\nc" and r["append"].endswith("NOTE")
    assert sorted(r["random"].split("\n")) == ["NOTE", "a", "b", "c"]
    with pytest.raises(KeyError):
        S.with_line(F.col("t"), "x", "sideways", F.col("k"))
