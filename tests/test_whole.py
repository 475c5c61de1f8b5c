"""Queries over whole tables against brute force on small tables."""

import datetime
import random

import numpy as np
import pytest
from quern.operators import graph as G
from quern.plans import registry

DAY = datetime.datetime(2025, 1, 1)
TYPES = ("sequence", "contains", "refers_to", "semantic_sim", "entity_relation", "table_context")


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    """(folder, edges as (type, source, target), gold nodes)"""
    d, rng = str(tmp_path_factory.mktemp("graph")), random.Random(6)
    edges = [(rng.choice(TYPES), f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(70)] + [(TYPES[i % 6], f"p{i:02}", f"p{i + 1:02}") for i in range(20)] + [("sequence", "loop", "loop")]
    rows = [(f"e{i}", t, f" {a.upper()} " if i % 7 == 0 else a, b, 1.0, False, DAY, DAY) for i, (t, a, b) in enumerate(edges)]
    rows += [rows[0][:7] + (DAY - datetime.timedelta(1),), ("none", "contains", None, "n1", 1.0, False, DAY, DAY)]
    spark.createDataFrame(rows, "edge_id string, edge_type string, source_node_id string, target_node_id string, weight double, bidirectional boolean, created_at timestamp, ingested_at timestamp").write.parquet(f"{d}/edges.parquet")
    gold = ["n1", "n2", "p00", "table_9", "nowhere"]
    spark.createDataFrame([("t", gold + [None]), ("u", ["n1"]), ("v", None)], "task_id string, gold_nodes array<string>").write.parquet(f"{d}/tasks.parquet")
    return d, edges, gold


def distances(edges, seeds, most=10**9):
    near = {}
    for _, a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, front = dict.fromkeys(seeds, 0), set(seeds)
    for h in range(1, most + 1):
        front = {y for x in front for y in near.get(x, ())} - set(out)
        if not front:
            break
        out |= dict.fromkeys(front, h)
    return out


def found(spark, name, d, *cols):
    return [tuple(r[c] for c in cols) for r in registry.QUERIES[name](spark, d).collect()]


def test_components_and_distances_over_all_edge_types(spark, graph):
    d, edges, gold = graph
    want = {n: min(distances(edges, [n])) for _, a, b in edges for n in (a, b)}
    got = found(spark, "g09_components", d, "node", "component")
    assert len(got) == len(want) and dict(got) == want
    sizes = sorted(((sum(v == c for v in want.values()), c) for c in set(want.values())), key=lambda x: (-x[0], x[1]))[:10]
    assert [(n, c) for c, n in found(spark, "g08_largest_components", d, "component", "size")] == sizes
    got = found(spark, "g10_distances", d, "node", "hop")
    assert len(got) == len(dict(got)) and dict(got) == distances(edges, gold)


def test_two_hops_from_all_gold_nodes_over_all_edges(spark, graph):
    d, edges, gold = graph
    want = distances(edges, gold, 2)
    got = found(spark, "g01_two_hops", d, "node", "hop")
    assert len(got) == len(want) and dict(got) == want
    inside = [t for t, a, b in edges if a in want and b in want]
    assert dict(found(spark, "g02_two_hop_edges", d, "edge_type", "n")) == {t: inside.count(t) for t in set(inside)}


def test_similarity_over_pages_of_a_file(spark, tmp_path):
    rng = random.Random(8)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)] + [[0.0] * 6, [float("nan")] + [1.0] * 5, [1.0, 2.0], [2.0, 1.0], [], None, [1.0, None, 1.0, 1.0, 1.0, 1.0]]
    rows = [(f"n{i:02}", f"f{i % 3}" if i % 11 else None, rng.choice([None, 1, 2, 3]), "paragraph", v, DAY, None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "node_id string, source_file string, page_num int, node_type string, embedding array<float>, ingested_at timestamp, deleted_at timestamp")
    df.write.parquet(f"{tmp_path}/nodes.parquet")
    want = {}
    for a, f, _, _, v, *_ in rows:
        for b, g, _, _, w, *_ in rows:
            if a < b and f and f == g and v and w and len(v) == len(w) and None not in v + w:
                x, y = np.array(v), np.array(w)
                if (n := np.linalg.norm(x) * np.linalg.norm(y)) > 0 and x @ y / n >= 0.3:
                    want[a, b] = x @ y / n
    for got, least in ((registry.QUERIES["j06_similarity"](spark, str(tmp_path)), 0.7), (G.similarity_edges(df, 0.3, block=4), 0.3)):
        found = {(r["source"], r["target"]): r["cosine"] for r in got.collect()}
        assert got.count() == len(found) and found.keys() == {k for k, v in want.items() if v >= least} and all(abs(found[k] - want[k]) < 1e-5 for k in found)


def test_hierarchies_on_and_below_cycles(spark, tmp_path):
    rng = random.Random(3)
    parent = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(60)}
    parent |= {"x1": "x2", "x2": "x3", "x3": "x1", "y1": "x2", "y2": "y1", "y3": "y1", "y4": "x3", "self": "self", "z": "self", "zz": "z"}
    parent |= {f"o{i:02}": f"o{(i + 1) % 40:02}" for i in range(40)} | {f"q{i}": f"q{i - 1}" if i else "o07" for i in range(25)}
    rows = [(n, p, None, DAY) for n, p in parent.items()]
    spark.createDataFrame(rows, "node_id string, parent_chunk_id string, child_chunk_ids array<string>, ingested_at timestamp").write.parquet(f"{tmp_path}/chunk_nodes.parquet")
    want = {}
    for n in parent:
        path, x = [], n
        while x is not None and x not in path:
            path.append(x)
            x = parent[x]
        want[n] = (path[::-1], "cycle" if x is not None else path[-1], -1 if x is not None else len(path) - 1)
    got = {r["node_id"]: r for r in registry.QUERIES["p4_paths"](spark, str(tmp_path)).collect()}
    assert {n: (r["path"].split("/"), r["root_id"], r["depth"]) for n, r in got.items()} == want
    below = [(a, n, len(path) - 1 - i) for n, (path, _, _) in want.items() for i, a in enumerate(path) if a != n]
    assert {n: r["descendants"] for n, r in got.items()} == {n: sum(a == n for a, _, _ in below) for n in parent}
    assert sorted(found(spark, "p4_descendants", str(tmp_path), "node_id", "descendant", "distance")) == sorted(below)
