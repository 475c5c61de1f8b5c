"""Encoding, splitting, shared spans and leaks against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quern.llm import encode as E
from quern.llm.leaks import common_subsequence, leaks
from quern.llm.shared_spans import SharedSpans, chosen_windows, points, window_hashes
from quern.llm.split_oversized import split_oversized

ODD = ["plain text", "", None, "naïve café — “quotes” … 日本語 😀😀 \r\n\t  end  ", "<|endoftext|> a b", "   ", "a" * 3000, "x y " * 900, "\n\n\n" * 400, "don't I'll  we've\n\n  123 4567", "😀" * 700, "mixed  \n \n  spaces   " * 200]


@pytest.mark.parametrize("chunk,overlap", [(64, 20), (300, 100), (4096, 512)])
def test_encoding_equals_the_tokenizer(spark, chunk, overlap):
    rng = random.Random(chunk)
    texts = ODD + ["".join(rng.choice("ab \n.,é😀1") for _ in range(rng.randrange(2000))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit(2))
    got = {r["doc_id"]: r["ids"] for r in E.encode(df, "doc_id", "text", chunk=chunk, overlap=overlap).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (E.encoder().encode_ordinary(t) if t else []), (i, t and t[:40])
        assert E.decode(got[i]) == (t or "")


def test_encoding_repeated_rows_null_ids_and_no_rows(spark):
    long = "word and word " * 500
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (None, "short"), (1, "other " * 2000)], "doc_id bigint, text string")
    got = E.encode(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] is None, len(r["ids"])) for r in got) == sorted((i is None, len(E.encoder().encode_ordinary(t))) for i, t in [tuple(r) for r in df.collect()])
    assert E.encode(df.limit(0), "doc_id", "text").count() == 0


def pieces_of(spark, texts, limit, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("content", F.lit("x")).withColumn("parts", F.lit(1))
    out = {}
    for r in split_oversized(df, "id", "text", limit, overlap).orderBy("id", "chunk_index").collect():
        out.setdefault(r["id"], []).append(r)
    return out


def test_a_heading_is_no_piece(spark):
    text = "Title\n\n" + "Some words stand here. " * 220
    sizes = [len(p["content"]) for p in pieces_of(spark, [text], 2000, 100)[0]]
    assert len(sizes) == 3 and min(sizes) > 1000 and max(sizes) <= 2000
    assert len(pieces_of(spark, ["short\n\n" + "x" * 4000], 2000, 100)[0][0]["content"]) == 7  # the only boundary there is


def test_splitting_round_trip(spark):
    rng = random.Random(5)
    texts = [t for t in ODD] + ["".join(rng.choice(["word ", "Sentence end. ", "para\n\n", "x" * 40 + " ", "日本 ", "\n", "😀"]) for _ in range(rng.randrange(300))) for _ in range(25)]
    for limit, overlap in ((200, 30), (2000, 100)):
        got = pieces_of(spark, texts, limit, overlap)
        for i, t in enumerate(texts):
            if not t or len(t) <= limit:
                assert i not in got
                continue
            rest, before = "", None
            for k, p in enumerate(got[i]):
                lead = p["own_start"] - p["start"]
                assert p["chunk_index"] == k and len(p["content"]) <= limit and t[p["start"] : p["start"] + len(p["content"])] == p["content"]
                if before is not None:
                    assert before.endswith(p["content"][:lead]) or lead > len(before)
                    assert lead <= overlap
                    if lead < min(overlap, p["own_start"]):
                        assert lead == 0 or (t[p["start"] - 1].isspace() and not t[p["start"]].isspace())
                rest, before = rest + p["content"][lead:], p["content"]
            assert rest == t


def test_splitting_prefers_strong_boundaries(spark):
    text = "One sentence here. Another one. " * 4 + "\n\n" + "tail words only " * 20
    first = pieces_of(spark, [text], 200, 20)[0][0]["content"]
    assert first.endswith("\n\n")
    assert pieces_of(spark, ["Short one. " * 40], 100, 20)[0][0]["content"].endswith(". ")
    assert pieces_of(spark, ["word " * 100], 97, 20)[0][0]["content"].endswith("word ")
    assert len(pieces_of(spark, ["x" * 500], 97, 20)[0][0]["content"]) == 97


def test_windows():
    rng = np.random.default_rng(1)
    codes = rng.integers(97, 100, 500).astype(np.uint32)
    h = window_hashes(codes, 20)
    same = {}
    for i in range(len(h)):
        same.setdefault(codes[i : i + 20].tobytes(), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(h.tolist()))
    assert set(chosen_windows(h, 7).tolist()) == {int(h[i : i + 7].min()) for i in range(len(h) - 6)}
    assert len(points("a😀b")) == 3


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(9)
    alphabet = "abcdefgh 😀\n"
    noise = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    spans = [noise(n) for n in (29, 30, 31, 60, 200)]
    texts = [noise(rng.randrange(40)) + (s if rng.random() < 0.8 else s[1:]) + noise(rng.randrange(40)) for s in spans for _ in range(5)]
    texts += [spans[3], spans[3], "a" * 100, "a" * 150, None, "", noise(20), "boiler plate " * 2 + noise(30), "boiler plate " * 2 + noise(30)]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("class", F.lit(1))
    found = SharedSpans(df, "id", "text", 30, 25)
    members = {r["id"]: r["class"] for r in found.members.collect()}
    pairs = {(r["a"], r["b"]) for r in found.pairs().collect()}
    windows = {i: {t[k : k + 30] for k in range(len(t) - 29)} for i, t in enumerate(texts) if t and len(t) >= 30}
    for i in windows:
        for j in windows:
            if i < j:
                a, b = members[i], members[j]
                assert bool(windows[i] & windows[j]) == (a == b or (min(a, b), max(a, b)) in pairs), (i, j)
    spans: dict[int, list[tuple[int, int]]] = {}
    for r in found.spans.collect():
        spans.setdefault(r["class"], []).append((r["start"], r["end"]))
    for i in {c for c in members.values()}:
        mine, others = texts[i], set().union(*(windows[j] for j in windows if members[j] != i))
        want = {k for at in range(len(mine) - 29) if mine[at : at + 30] in others for k in range(at, at + 30)}
        assert {k for s, e in spans.get(i, []) for k in range(s, e)} == want
        assert all(b < c for (_, b), (c, _) in zip(sorted(spans.get(i, [])), sorted(spans.get(i, []))[1:]))
    assert SharedSpans(df.limit(0), "id", "text").pairs().count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 20
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(rng.randrange(8, 40)) for _ in range(30)]
    docs = []
    for k in range(150):
        t = say(rng.randrange(0, 120))
        if k % 2:
            p = rng.choice(passages)
            n = min(len(p), rng.choice([10, 11, 12, 13, 20]))
            s = rng.randrange(len(p) - n + 1)
            at = rng.randrange(len(t) + 1)
            t[at:at] = p[s : s + n]
        docs.append(rng.choice([" ", ", ", "\n– "]).join(x.upper() if rng.random() < 0.1 else x for x in t))
    rows = list(enumerate(docs)) + [(900, None), (901, ""), (0, docs[0]), (None, docs[1])]
    items = [(i, "  " + "; ".join(p), " ".join(p[:2])) for i, p in enumerate(passages)] + [(500, None, None), (501, "too short", "x"), (None, "; ".join(passages[0]), "y")]
    got = leaks(spark.createDataFrame(rows, "id bigint, text string"), spark.createDataFrame(items, "item bigint, passage string, answer string"))
    found = {(r["doc"], r["item"]) for r in got.collect()}
    grams = lambda ws: {tuple(ws[k : k + 12]) for k in range(len(ws) - 11)}
    low = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = {(d, i) for d, t in enumerate(docs) for i, p in enumerate(passages) if grams(low(t)) & grams(p)}
    assert found <= want and len(found) >= 0.98 * len(want) and len(want) > 20
    nothing = spark.createDataFrame([], "item bigint, passage string, answer string")
    assert leaks(spark.createDataFrame(rows, "id bigint, text string"), nothing).count() == 0
    assert leaks(spark.createDataFrame([], "id bigint, text string"), spark.createDataFrame(items, "item bigint, passage string, answer string")).count() == 0


def test_paraphrases(spark):
    passage = [f"p{i}" for i in range(30)]
    loose = [w for k, w in enumerate(passage) for w in ([w, f"x{k}"] if k % 5 == 0 else [w])]
    docs = spark.createDataFrame([(1, " ".join(loose)), (2, " ".join(passage[::-1]))], "id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(passage), "p3")], "item bigint, passage string, answer string")
    got = leaks(docs, items, paraphrase=0.7).collect()
    assert [(r["doc"], r["kind"], r["words"], r["answer"]) for r in got] == [(1, "paraphrase", 30, True)]
    assert common_subsequence([1, 2, 3, 4], [9, 1, 3, 8, 4]) == 3 and common_subsequence([], [1]) == 0
