from pyspark.sql import functions as F
from quern.operators import web as W

ELEMENT = "page string, pos int, element_id string, kind string, text string, href string, mark string"
A, B = "https://a.org/", "https://a.org/list/7"
ROWS = [
    (A, 0, "l1", "link", "one", "https://a.org/list/7", "M1"),
    (A, 1, "l2", "link", "two", "/list/7?x=1#y", "M1"),
    (A, 2, "l3", "link", "three", "list/77", "M2"),
    (A, 3, "l4", "link", "four", "https://b.org/", None),
    (A, 4, "l5", "link", "mail", "mailto:x", None),
    (B, 0, "i1", "input", "", None, "M1"),
    (B, 1, "t1", "table", "", None, None),
    (B, 2, "s1", "submit", "go", None, None),
    (B, 3, "i2", "search", "", None, None),
    (B, 4, "t2", "table", "", None, None),
    (B, 5, "t3", "list", "", None, None),
    (B, 6, "t4", "result", "", None, None),
    (B, 7, "b1", "button", "open", None, None),
    *[(B, 10 + k, f"m{k}", "modal", "", None, None) for k in range(4)],
]


def elements(spark):
    return spark.createDataFrame(ROWS, ELEMENT)


def pages(spark):
    return spark.createDataFrame([(A, "Home"), (B, "Search results")], "url string, title string")


def test_link_targets(spark):
    got = {r["element_id"]: (r["target"], r["how"]) for r in W.link_targets(elements(spark), pages(spark)).collect()}
    assert got == {"l1": (B, "exact"), "l2": (B, "resolved"), "l3": (B, "similar"), "l4": (A, "path")}


def test_edges_within_a_page(spark):
    e = elements(spark)
    pairs = lambda df: {(r["source"], r["target"]) for r in df.collect()}
    assert pairs(W.control_edges(e)) == {("s1", "i1")}
    assert pairs(W.trigger_edges(e)) == {("b1", "m0"), ("b1", "m1")}
    assert pairs(W.flow_edges(e)) == {("i1", "t1"), ("i1", "t2"), ("i2", "t2"), ("i2", "t3")}
    assert pairs(W.capped_page_edges(e)) == {("i2", "t1"), ("i2", "t2"), ("i1", "t4")}
    assert {(r["page"], r["mark"], r["element_id"]) for r in W.by_mark(e).collect()} == {(A, "M1", "l1"), (A, "M2", "l3"), (B, "M1", "i1")}


def test_roles_and_order(spark):
    roles = {r["url"]: r for r in W.page_roles(pages(spark), elements(spark)).collect()}
    assert roles[A]["skeleton"] and not roles[A]["entry"] and not roles[A]["form"]
    assert roles[B]["listing"] and roles[B]["entry"] and not roles[B]["form"] and not roles[B]["detail"]
    got = {r["url"]: r["priority"] for r in W.page_priority(W.page_roles(pages(spark), elements(spark))).collect()}
    assert got == {A: 1000, B: 800 + 600 - 100}
    assert [(r["page"], r["href"]) for r in W.first_links(elements(spark), 1).collect()] == [(A, B)]
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("d", "e"), ("e", "f")], "page string, href string")
    seen = W.crawl_order(links, spark.createDataFrame([("a",)], "url string"), 3, 5).orderBy("visit").collect()
    assert [(r["url"], r["depth"]) for r in seen] == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "a")], "parent string, child string")
    assert {r["url"] for r in W.essential_pages(parents, spark.createDataFrame([("c",)], "url string")).collect()} == {"a", "b", "c"}


def test_coherence(spark):
    useful = [1, 0, 0, 0, 0, 0, 1, 0]
    rows = [("c", i, f"u{i}", bool(u), i == 7, i == 5) for i, u in enumerate(useful)]
    df = spark.createDataFrame(rows, "crawl string, visit int, url string, useful boolean, navigation boolean, essential boolean")
    assert [r["visit"] for r in W.coherent(df, 3).orderBy("visit").collect()] == [0, 1, 2, 3, 5, 6, 7]
    long = spark.createDataFrame([("c", i, "u", i == 0 or i % 5 == 4, False, False) for i in range(20)], df.schema)
    kept = {r["visit"] for r in W.coherent(long, 9).collect()}
    assert {0, 9} <= kept and 18 not in kept


def test_states_and_kinds(spark):
    s = W.signature(elements(spark)).collect()
    assert len({r["signature"] for r in s}) == 2
    states = spark.createDataFrame([("u", "x", 1), ("u", "x", 2), ("u", "y", 3)], "url string, signature string, visit int")
    assert sorted(r["visit"] for r in W.visited_once(states).collect()) == [1, 3]
    kinds = spark.createDataFrame([("A",), ("textarea",), ("other",)], "k string").select(W.canonical_kind(F.col("k"))).collect()
    assert [r[0] for r in kinds] == ["link", "input", "other"]
    assert spark.createDataFrame([("My Cart items",), ("Cart",), (None,)], "t string").select(W.page_type(F.col("t"))).collect()[0][0] == "product"
