"""Set-similarity joins against brute force, and their defined cases."""

import random
import re

import pytest
from pyspark.sql import functions as F
from quern.llm import near_dup
from quern.llm.near_dup import AlikeSets
from quern.llm.split_overlap import SplitOverlap, split_name


def words(t):
    return frozenset(re.findall(r"[^\W_]+", (t or "").lower()))


def texts(seed, groups=25, vocabulary=300, size=20):
    """Groups of texts that differ by a few words, with common words in all of them."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)]
    common = ["the", "of", "and", "Käse", "ÉTÉ"]
    out = []
    for _ in range(groups):
        base = common + rng.sample(pool, size)
        for edits in (0, 1, 2, 3, 5):
            t = base[:]
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(pool)
            rng.shuffle(t)
            out.append(", ".join(t))
    return out + [None, "", " \t", "...", "solo", "Solo!", "two words", "words; TWO"] + [out[0]] * 6


def brute(rows, least=0.7):
    sets = [(i, words(t)) for i, t in rows if i is not None]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if i != j and a and b and len(a & b) >= least * len(a | b) - 1e-9}


@pytest.mark.parametrize("least", [0.7, 0.85])
def test_pairs_against_brute_force(spark, least):
    rows = list(enumerate(texts(1)))
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("space", F.lit(0))
    df = df.unionByName(df.withColumn("space", F.lit(1)).withColumn("text", F.when(F.col("id") % 2 == 0, F.col("text"))))
    got = AlikeSets(df, least).row_pairs().collect()
    assert len(got) == len(set(got))
    assert {(r["row_a"], r["row_b"]) for r in got if r["space"] == 0} == brute(rows, least)
    assert {(r["row_a"], r["row_b"]) for r in got if r["space"] == 1} == brute([(i, t) for i, t in rows if i % 2 == 0], least)


def test_long_lists_and_leaders(spark, monkeypatch):
    # keys of three and four words, lists that stay long and are dealt out, and groups of followers
    monkeypatch.setattr(near_dup, "FREQUENT_LEAST", 1)
    monkeypatch.setattr(near_dup, "FREQUENT_SHARE", 0.0)
    monkeypatch.setattr(near_dup, "LONG", 3)
    monkeypatch.setattr(near_dup, "SAMPLED", 1)
    rng = random.Random(9)
    rows = list(enumerate(texts(4, groups=12, vocabulary=40, size=14)))
    base = [f"v{i}" for i in range(60)]
    for k in range(60):
        t = base[:]
        for _ in range(rng.randrange(8)):
            t[rng.randrange(60)] = f"u{rng.randrange(20)}"
        rows.append((2000 + k, " ".join(t)))
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("space", F.lit(0))
    found = AlikeSets(df)
    assert found.followers.count() > 5
    want = brute(rows)
    assert {(r["row_a"], r["row_b"]) for r in found.row_pairs().collect()} == want
    ids = {r["id"]: r["class"] for r in found.copies.collect()}
    classes = {tuple(sorted((ids.get(a, a), ids.get(b, b)))) for a, b in want if ids.get(a, a) != ids.get(b, b)}
    assert {r["class"]: r["links"] for r in found.links().where("links > 0").collect()} == {c: sum(c in p for p in classes) for c in {x for p in classes for x in p}}


def test_frequent_words_and_long_texts(spark, monkeypatch):
    # all words frequent, and sets on both sides of the bound for pairs of words
    monkeypatch.setattr(near_dup, "FREQUENT_LEAST", 1)
    monkeypatch.setattr(near_dup, "FREQUENT_SHARE", 0.0)
    monkeypatch.setattr(near_dup, "PAIRS_UP_TO", 22)
    rows = list(enumerate(texts(3, vocabulary=60)))
    big = [f"v{i}" for i in range(4000)]
    rows += [(1000, " ".join(big)), (1001, " ".join(big[:3500])), (1002, " ".join(big[:2500]))]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("space", F.lit(0))
    assert {(r["row_a"], r["row_b"]) for r in AlikeSets(df).row_pairs().collect()} == brute(rows)


def test_hot_group_repeated_rows_and_empty_table(spark):
    rows = [(i, "a copy that a third of all rows hold") for i in range(60)] + [(3, "a copy that a third of all rows hold"), (None, "a copy that a third of all rows hold")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("space", F.lit(0))
    found = AlikeSets(df)
    assert found.pairs.count() == 0 and found.row_pairs().count() == 60 * 59 // 2
    none = AlikeSets(df.limit(0))
    assert none.row_pairs().count() == 0


def test_split_overlap_against_brute_force(spark):
    rows = list(enumerate(texts(7)))
    sides = {i: [True, False, None][i % 3] if i % 7 else False for i, _ in rows}
    data = [(f, i, sides[i], t) for f in (0, 1) for i, t in rows if f == 0 or i % 2] + [(0, None, True, rows[0][1])]
    df = spark.createDataFrame(data, "field int, id bigint, train boolean, text string").withColumn("words", F.lit("x"))
    got = {(r["field"], r["train_row"], r["eval_row"]) for r in SplitOverlap(df, exact=True).pairs.collect()}
    assert got == {(r["field"], r["train_row"], r["eval_row"]) for r in SplitOverlap(df).pairs.collect()}
    assert sum(r["pairs"] for r in SplitOverlap(df).counts().collect()) == len(got)
    want = {(f, a, b) if sides[a] else (f, b, a) for f in (0, 1) for a, b in brute([(i, t) for i, t in rows if f == 0 or i % 2]) if {sides[a], sides[b]} == {True, False}}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert SplitOverlap(df.limit(0)).pairs.count() == 0


def test_split_names(spark):
    df = spark.createDataFrame([(" Train ",), ("VAL",), ("validation",), ("test",), (None,), ("other",)], "s string")
    assert [r[0] for r in df.select(split_name(F.col("s"))).collect()] == ["train", "validation", "validation", "test", None, None]
