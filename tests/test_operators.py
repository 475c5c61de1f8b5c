"""Order-sensitive and defined cases on small tables made by hand."""

import pytest
from pyspark.sql import functions as F
from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import elements as E
from quern.operators import graph as G
from quern.operators import scoring as S
from quern.operators import tasks as K

ROWS = "doc_id bigint, pos int, kind string, content string"


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


def test_paragraph_merge_measures_the_merged_text(spark):
    rows = [(1, 0, "paragraph", "Intro:"), (1, 1, "paragraph", "first part,"), (1, 2, "paragraph", "second."), (1, 3, "paragraph", "x" * 501), (1, 4, "heading", "H"), (1, 5, "paragraph", "a" * 400), (1, 6, "paragraph", "b" * 400), (1, 7, "paragraph", "c")]
    got = values(E.merge_paragraphs(spark.createDataFrame(rows, ROWS)), "pos", "merged")
    assert got == [(0, 3), (3, 1), (4, 1), (5, 2), (7, 1)]


def test_levels_sections_and_equals(spark):
    rows = [(1, 0, "heading", "early", 2), (1, 1, "heading", "one", 1), (1, 2, "paragraph", "Text ", None), (1, 3, "heading", "sub", 3), (1, 4, "heading", "two", 3), (1, 5, "heading", "deep", 5), (1, 6, "paragraph", "text", None)]
    df = spark.createDataFrame(rows, ROWS + ", level int")
    assert [x[1] for x in values(E.dense_levels(df), "pos", "level")] == [2, 1, 3, 3, 4]
    assert [x[0] for x in values(E.sections(df), "pos")] == [1, 2, 3, 4, 5, 6]
    assert (6,) not in values(E.first_of_equals(df), "pos")


def test_word_windows_and_fixed_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, ""), (3, None), (4, "x" * 50)], "doc_id bigint, text string")
    got = values(E.word_windows(df.where("doc_id < 4"), 60, 12), "window", "content")
    assert [w for w, _ in got] == [0, 1, 2] and got[1][1].split()[0] == "w8" and len(got[0][1].split()) == 10
    pieces = E.fixed_chunks(df, 20, 5).orderBy("doc_id", "chunk").collect()
    assert all(0 < len(p["content"]) <= 20 for p in pieces)
    for doc, text in ((1, " ".join(f"w{i}" for i in range(20))), (4, "x" * 50)):
        covered = set()
        for p in (x for x in pieces if x["doc_id"] == doc):
            assert text[p["start"] : p["start"] + len(p["content"])] == p["content"]
            covered |= set(range(p["start"], p["start"] + len(p["content"])))
        assert covered == set(range(len(text)))


def test_empty_sets_of_words(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    got = df.select(T.jaccard(F.col("x"), F.col("y")).alias("j"), T.jaccard(F.col("x"), F.col("y"), 1.0).alias("e"), T.set_f1(F.col("x"), F.col("y")).alias("f")).collect()
    assert [(r["j"], r["e"]) for r in got] == [(0.5, 0.5), (0.0, 1.0), (0.0, 0.0)]
    assert [r["f"] for r in got] == [pytest.approx(2 / 3), 1.0, 0.0]


def test_citation_scores(spark):
    rows = [(["a", "b"], ["a", "c"], True), ([], [], True), ([], ["a"], True), (["a"], [], True), (None, None, None), (["a"], ["b"], False)]
    df = spark.createDataFrame(rows, "g array<string>, f array<string>, n boolean")
    got = [tuple(r) for r in df.select(*S.citation_scores(F.col("g"), F.col("f"), F.col("n"))).collect()]
    assert got == [(0.5, 0.5, 0.5), (1, 1, 1), (0, 1, 0), (0, 0, 0), (1, 1, 1), (1, 1, 1)]


def test_rouge_l(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b c d", "a c x d"), (None, "a"), ("", "")], "g string, f string")
    assert [r[0] for r in df.select(S.rouge_l(F.col("g"), F.col("f"))).collect()] == [1.0, 0.75, 0.0, 0.0]


def test_steps(spark):
    rows = [("t", i, ok, slow) for i, (ok, slow) in enumerate([(True, False), (False, True), (True, False), (False, False), (True, True)])] + [("u", 0, True, False)]
    df = spark.createDataFrame(rows, "task string, ord int, ok boolean, slow boolean")
    got = {r["task"]: r["factor"] for r in K.order_penalty(df).collect()}
    assert got == {"t": pytest.approx(0.8**2 * 0.9**2), "u": 1.0}
    assert [r["ord"] for r in K.until_failure(df).where("task = 't'").orderBy("ord").collect()] == [0, 1]


def test_components_hops_loops_and_reverses(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("z", "z")] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    edges = spark.createDataFrame([(f"e{i}", "t", s, t, 1.0, i == 0) for i, (s, t) in enumerate(pairs)], "edge_id string, edge_type string, source string, target string, weight double, bidirectional boolean")
    got = dict(values(G.components(edges), "node", "component"))
    assert got == {**{x: "a" for x in "abc"}, **{x: "d" for x in "def"}, "z": "z", **{f"p{i:03}": "p000" for i in range(61)}}
    seeds = spark.createDataFrame([("a",), ("p000",)], "node string")
    assert dict(values(G.within_hops(edges, seeds, 2), "node", "hop")) == {"a": 0, "b": 1, "c": 1, "p000": 0, "p001": 1, "p002": 2}
    assert G.incident(edges).where("node = 'z'").count() == 1
    assert values(G.with_reverses(edges).where("is_reverse"), "edge_id", "source", "target") == [("e0_reverse", "b", "a")]


def test_patterns(spark):
    nodes = spark.createDataFrame([("h", "heading"), ("p", "paragraph"), ("f", "figure")], "node_id string, node_type string")
    edges = spark.createDataFrame([("contains", "h", "p"), ("refers_to", "p", "f"), ("contains", "h", "f")], "edge_type string, source string, target string")
    match = lambda text: values(G.Pattern(text).match(nodes, edges), "n0", "n1") if text.count("(") == 2 else [tuple(r) for r in G.Pattern(text).match(nodes, edges).collect()]
    assert match("(heading)-[contains]->(paragraph|figure)") == [("h", "f"), ("h", "p")]
    assert set(match("(heading)-[*]->(*)-[refers_to]?->(figure)")) == {("h", "p", "f"), ("h", "f", None)}
    with pytest.raises(ValueError):
        G.Pattern("(heading)-contains->(x)")


def test_urls(spark):
    rows = [("HTTP://A.org/x/y/?q#f", "http://a.org/x/y", "/x/y", 2), ("https://a.org", "https://a.org", "/", 0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "u string, normal string, path string, depth int")
    for r in df.select("*", U.normalise(F.col("u")).alias("a"), U.path(F.col("u")).alias("b"), U.depth(F.col("u")).alias("c")).where("u is not null").collect():
        assert (r["a"], r["b"], r["c"]) == (r["normal"], r["path"], r["depth"])
    fixed = spark.createDataFrame([("www.a.org",), ("//a.org",), ("a.org",), ("/rel",), (" ",), ("http://a",)], "u string").select(U.repair_scheme(F.col("u"))).collect()
    assert [r[0] for r in fixed] == ["https://www.a.org", "https://a.org", "https://a.org", "/rel", None, "http://a"]
    alike = spark.createDataFrame([("abcd", "abcd"), ("abcd", "ab"), ("abxx", "abyyyy")], "a string, b string").select(U.similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in alike] == [1.0, 0.5, pytest.approx(2 / 6)]


def test_splits_and_samples_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.lit(1.0).alias("w"))
    parts = [dict(values(K.split_by_hash(d, "row_id"), "row_id", "part")) for d in (df, df.repartition(7))]
    assert parts[0] == parts[1] and 0.65 < list(parts[0].values()).count("train") / 2000 < 0.75
    assert K.weighted_sample(df, "w", "row_id", 5).count() == 5


def test_alike_texts_by_hand(spark):
    import random
    import re

    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        base = rng.sample(words, 12)
        texts += [" ".join(base), " ".join([*base[:-2], *rng.sample(words, 2)]), " ".join(base[::-1])]
    texts += ["", None, "one", "One!", "two one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    sets = [frozenset(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    want = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if a and a == sets[j]:
                if i == sets.index(a):
                    want.add((i, j))
            elif a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.65 and sets.index(a) == i and sets.index(sets[j]) == j:
                want.add((i, j))
    assert {(r["a"], r["b"]) for r in K.alike_texts(df).collect()} == want


def test_context_text_is_cut_once(spark):
    rows = [("t", "n1", "paragraph", "x" * 900, 3.0), ("t", "n2", "table", "y" * 900, 2.0), ("t", "n3", "figure", "z" * 900, 1.0), ("t", "n4", "figure", "q", 0.5)]
    got = S.context_text(spark.createDataFrame(rows, "task_id string, node string, node_type string, content string, score double")).collect()[0]
    assert got["nodes"] == 3 and got["context"].endswith("...") and "q" not in got["context"].replace("FIGURE", "")


def test_diverse_choice_one_by_one(spark):
    rows = [("g", 1, 0.9, [1, 2, 3]), ("g", 2, 0.9, [1, 2, 3]), ("g", 3, 0.1, [7, 8]), ("g", 4, 0.5, [1, 2, 9]), ("h", 5, 0.0, [1])]
    got = K.diverse_choice(spark.createDataFrame(rows, "g string, id bigint, quality double, words array<bigint>"), "g", 3)
    assert values(got, "g", "place", "id") == [("g", 1, 1), ("g", 2, 3), ("g", 3, 4), ("h", 1, 5)]
