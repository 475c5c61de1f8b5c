"""The property graph: building edges, finding nodes, walking, patterns and changes.

Nodes and edges are plain tables: nodes (node_id, node_type, content, ...), edges (edge_id, edge_type, source, target, weight, bidirectional).
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import display
from quern.functions.vectors import spatial_relation
from quern.functions.words import words
from quern.operators.orphans import normal_key
from quern.plans.runtime import Stored, in_force, table

NODE_TYPES = ("paragraph", "table", "heading", "figure", "chunk", "entity")
EDGE_TYPES = ("sequence", "contains", "refers_to", "semantic_sim", "entity_relation", "table_context", "figure_context")
#: How much of a score an edge passes on, by type; 0.5 for others (fixed values).
PASSES = {"refers_to": 1.0, "contains": 0.8, "semantic_sim": 0.7, "sequence": 0.6, "entity_relation": 0.9, "table_context": 0.8, "figure_context": 0.8}


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    """The nodes in force that are not deleted."""
    return in_force(table(spark, d, "nodes"), "node_id", "ingested_at").where("deleted_at is null")


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    """Each edge once, by its last delivery, with both ends given."""
    e = in_force(table(spark, d, "edges"), "edge_id", "ingested_at")
    ends = e.withColumn("source", normal_key(F.col("source_node_id"))).withColumn("target", normal_key(F.col("target_node_id")))
    return ends.where("source is not null and target is not null").select("edge_id", "edge_type", "source", "target", "weight", "bidirectional", "created_at")


def gold_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select(F.explode("gold_nodes").alias("node")).where("node is not null").distinct()


# ---- filters


def find_nodes(nodes: DataFrame, content_contains: str | None = None, **equal) -> DataFrame:
    """All given columns must be equal; ``content_contains`` is a plain part of the content in any case; unknown columns do not matter."""
    for k, v in equal.items():
        if k in nodes.columns:
            nodes = nodes.where(F.col(k) == v)
    return nodes if content_contains is None else nodes.where(F.contains(F.lower("content"), F.lit(content_contains.lower())))


def find_edges(edges: DataFrame, **equal) -> DataFrame:
    return reduce(lambda e, kv: e.where(F.col(kv[0]) == kv[1]) if kv[0] in e.columns else e, equal.items(), edges)


# ---- adjacency


def incident(edges: DataFrame) -> DataFrame:
    """(node, neighbour, edge_id, edge_type, weight): each edge from both ends; a loop once."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "edge_id", "edge_type", "weight")
    back = edges.where("source != target").select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "edge_id", "edge_type", "weight")
    return out.unionByName(back)


def neighbours(edges: DataFrame, some: DataFrame, edge_types: list[str] | None = None) -> DataFrame:
    """Two equi-joins, one for each end, instead of a join on either."""
    around = incident(edges if edge_types is None else edges.where(F.col("edge_type").isin(edge_types)))
    return around.join(some, "node", "left_semi")


def induced(edges: DataFrame, some: DataFrame) -> DataFrame:
    """The edges with both ends among ``some``."""
    return edges.join(some.select(F.col("node").alias("source")), "source", "left_semi").join(some.select(F.col("node").alias("target")), "target", "left_semi")


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, hop): the least number of edges, in any direction, from a seed; up to ``hops``, or as far as there are edges.

    The neighbours of a round's nodes were met in that round or the one before, or are new: each round looks at these two only, and what was
    found before is never written again.
    """
    links = Stored(incident(edges).select("node", "neighbour").distinct())
    steps = [Stored(seeds.select("node", F.lit(0).alias("hop")).distinct())]
    while hops is None or len(steps) <= hops:
        last = reduce(DataFrame.unionByName, [x.df.select("node") for x in steps[-2:]])
        new = steps[-1].df.join(links.df, "node").select(F.col("neighbour").alias("node")).distinct().join(last, "node", "left_anti").withColumn("hop", F.lit(len(steps)))
        step = Stored(new)
        if step.df.isEmpty():
            step.drop()
            break
        steps.append(step)
    links.drop()
    return seeds.sparkSession.read.schema(steps[0].df.schema).parquet(*[x.path for x in steps])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least id of each connected component.

    Rounds of large-star and small-star: every node points at its least neighbour, and its other neighbours with it; a logarithmic number of
    rounds is enough, and no node's neighbours are ever brought together in one row.
    """
    pairs = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    state = Stored(pairs.where("a != b").distinct())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else df.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        joined = both.join(least, "a").withColumn("m", F.least("m", "a"))
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b") if large else joined.select(F.col("m").alias("a"), "b").unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b")))
        return moved.where("a != b").distinct()

    while True:
        after = Stored(star(star(state.df, True), False))
        same = after.df.exceptAll(state.df).isEmpty() and state.df.exceptAll(after.df).isEmpty()
        state.drop()
        state = after
        if same:
            break
    roots = state.df.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    found = state.df.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): the number of incident edges, over the greatest such number."""
    d = incident(edges).groupBy("node").agg(F.count("*").alias("degree"))
    return d.join(F.broadcast(d.agg(F.max("degree").alias("most"))), F.lit(True)).select("node", "degree", (F.col("degree") / F.col("most")).alias("centrality"))


def passes(edge_type: Column) -> Column:
    w = F.lit(0.5)
    for k, v in PASSES.items():
        w = F.when(edge_type == k, v).otherwise(w)
    return w


def propagate(edges: DataFrame, sources: DataFrame, depth: int = 2, decay: float = 0.7) -> DataFrame:
    """(node, score): what reaches a node in one step adds up; of the steps the greatest counts."""
    links = incident(edges).select("node", "neighbour", passes(F.col("edge_type")).alias("w"))
    step = sources.select("node", "score")
    steps = step
    for _ in range(depth):
        step = step.join(links, "node").groupBy(F.col("neighbour").alias("node")).agg(F.sum(F.col("score") * decay * F.col("w")).alias("score"))
        steps = steps.unionByName(step)
    return steps.groupBy("node").agg(F.max("score").alias("score"))


# ---- path patterns


class Pattern:
    """``(heading)-[contains]->(paragraph|table)-[refers_to]?->(figure)``: node types and edge types, each a choice of several or ``*``.

    A ``?`` behind an edge makes it, and what follows, optional.
    """

    _NODE, _EDGE = re.compile(r"\(([\w*|]+)\)"), re.compile(r"-\[([\w*|]+)\](\?)?->")

    def __init__(self, text: str) -> None:
        self.nodes, self.edges, at = [], [], 0
        while True:
            if not (m := self._NODE.match(text, at)):
                raise ValueError(f"a node is expected at {at} in {text!r}")
            self.nodes.append(m[1].split("|"))
            at = m.end()
            if at == len(text):
                break
            if not (m := self._EDGE.match(text, at)):
                raise ValueError(f"an edge is expected at {at} in {text!r}")
            self.edges.append((m[1].split("|"), bool(m[2])))
            at = m.end()

    def match(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """(n0, n1, ...): the nodes bound, null where an optional part is missing. No node is bound twice."""
        of = lambda kinds, i: (nodes if kinds == ["*"] else nodes.where(F.col("node_type").isin(kinds))).select(F.col("node_id").alias(f"n{i}"))
        out = of(self.nodes[0], 0)
        for i, (kinds, optional) in enumerate(self.edges):
            step = (edges if kinds == ["*"] else edges.where(F.col("edge_type").isin(kinds))).select(F.col("source").alias(f"n{i}"), F.col("target").alias(f"n{i + 1}"))
            step = step.join(of(self.nodes[i + 1], i + 1), f"n{i + 1}", "left_semi").distinct()
            joined = out.join(step, f"n{i}", "left" if optional else "inner")
            fresh = reduce(lambda a, b: a & b, [F.col(f"n{k}") != F.col(f"n{i + 1}") for k in range(i + 1)])
            out = joined.where(F.col(f"n{i + 1}").isNull() | fresh)
        return out.select(*[f"n{i}" for i in range(len(self.nodes))])


# ---- building edges


def _y(c: str) -> Column:
    return F.col(c)["y0"]


def sequence_edges(nodes: DataFrame) -> DataFrame:
    """(source, target): a node and the next one on its page."""
    placed = nodes.where("bbox is not null and page_num is not null")
    order = Window.partitionBy("source_file", "page_num").orderBy(_y("bbox"), F.col("bbox")["x0"], "node_id")
    return placed.withColumn("target", F.lead("node_id").over(order)).where("target is not null").select(F.col("node_id").alias("source"), "target")


def containment_edges(nodes: DataFrame) -> DataFrame:
    """(source, target): a heading and everything below it on its page but headings."""
    n = nodes.where("bbox is not null and page_num is not null").select("source_file", "page_num", "node_id", "node_type", _y("bbox").alias("y"))
    h = n.where("node_type = 'heading'").select("source_file", "page_num", F.col("node_id").alias("source"), F.col("y").alias("top"))
    return h.join(n.where("node_type != 'heading'"), ["source_file", "page_num"]).where("y > top").select("source", F.col("node_id").alias("target"))


def reference_edges(nodes: DataFrame) -> DataFrame:
    """(source, mention, target): each mention of a table, figure or section and the first node of that kind in the same file."""
    kinds = F.create_map(*[F.lit(x) for kv in (("table", "table"), ("figure", "figure"), ("section", "heading")) for x in kv])
    found = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(?:table|figure|section) [0-9]+"), F.lit(0)))
    mentions = nodes.where(F.col("node_type").isin("paragraph", "heading")).select("source_file", F.col("node_id").alias("source"), F.explode(found).alias("mention")).withColumn("kind", kinds[F.split("mention", " ")[0]])
    first = nodes.groupBy("source_file", F.col("node_type").alias("kind")).agg(F.min(F.struct(F.coalesce("page_num", F.lit(0)), F.coalesce(_y("bbox"), F.lit(0.0)), "node_id")).alias("first"))
    return mentions.join(first, ["source_file", "kind"]).select("source", "mention", F.col("first.node_id").alias("target")).where("source != target")


def _alike_in_blocks(least: float):
    """The alike pairs of two blocks of vectors, or of one with itself."""

    def pairs(group: pa.Table) -> pa.Table:
        ids, block = np.array(group.column("node_id").to_pylist(), object), group.column("block").to_numpy()
        v = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        with np.errstate(invalid="ignore", over="ignore"):
            length = np.linalg.norm(v, axis=1)
        good = np.isfinite(length) & (length > 0)
        ids, block, v = ids[good], block[good], v[good] / length[good, None]
        low = block == block.min(initial=2**31 - 1)
        first, other = np.flatnonzero(low), np.flatnonzero(~low)
        if group.column("low")[0] == group.column("high")[0]:
            other = first
        elif not len(other):  # all of one of the blocks is unusable
            first = other
        cos = v[first] @ v[other].T
        i, j = np.nonzero(cos >= least)
        a, b, c = ids[first[i]], ids[other[j]], cos[i, j]
        if other is first:
            a, b, c = a[keep := i < j], b[keep], c[keep]
        turn = np.array(a > b, bool)
        return pa.table({"source": pa.array(np.where(turn, b, a), pa.string()), "target": pa.array(np.where(turn, a, b), pa.string()), "cosine": pa.array(c, pa.float64())})

    return pairs


def similarity_edges(nodes: DataFrame, least: float = 0.7, block: int = 2048) -> DataFrame:
    """(source, target, cosine): alike nodes of one file, on whichever pages or on none, source < target; nodes without file are in none.

    Exact: the vectors of a file are dealt out to blocks, and each pair of blocks is one group, so that no task holds more than two.
    """
    v = nodes.where("source_file is not null and size(embedding) > 0").select("source_file", F.size("embedding").alias("length"), "node_id", "embedding")
    blocks = v.groupBy("source_file", "length").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = v.join(blocks, ["source_file", "length"]).withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).groupBy("source_file", "length", "low", "high")
    return groups.applyInArrow(_alike_in_blocks(least), "source string, target string, cosine double")


def mention_edges(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(node_id, entity_id): nodes whose text holds the canonical name of an entity, as whole words.

    Names have few lengths; for each the runs of so many words of a text are looked up among the names, so that no text is copied.
    """
    e = entities.select(F.col("node_id").alias("entity_id"), words(F.col("canonical_name")).alias("name")).where("size(name) > 0").select("entity_id", F.array_join("name", " ").alias("run"), F.size("name").alias("n"))
    lengths = sorted(r["n"] for r in e.select("n").distinct().collect())
    runs = lambda n: F.transform(F.when(F.size("said") >= n, F.sequence(F.lit(1), F.size("said") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("said", i, n), " "))
    said = nodes.select("node_id", words(F.col("content")).alias("said"))
    each = said.select("node_id", F.explode(F.array_distinct(F.concat(*[runs(n) for n in lengths]) if lengths else F.array().cast("array<string>"))).alias("run"))
    return each.join(e.select("entity_id", "run"), "run").select("node_id", "entity_id").distinct()


def context_edges(nodes: DataFrame, reach: int = 200) -> DataFrame:
    """(source, target, distance, position): texts near a table or figure of their page; only neighbouring bands of the page are compared."""
    n = nodes.where("bbox is not null and page_num is not null").select("source_file", "page_num", "node_id", "node_type", _y("bbox").alias("y")).withColumn("band", F.floor(F.col("y") / reach))
    t = n.where(F.col("node_type").isin("table", "figure")).select("source_file", "page_num", F.col("node_id").alias("target"), F.col("y").alias("ty"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    near = n.where(F.col("node_type").isin("paragraph", "heading")).join(t, ["source_file", "page_num", "band"]).where(F.abs(F.col("y") - F.col("ty")) < reach)
    return near.select(F.col("node_id").alias("source"), "target", (F.floor(F.abs(F.col("y") - F.col("ty")) / 100) + 1).alias("distance"), F.when(F.col("y") < F.col("ty"), "before").otherwise("after").alias("position"))


def spatial_edges(nodes: DataFrame, batch: int = 50) -> DataFrame:
    """(source, target, relation): near nodes of one page, within batches of their order."""
    order = Window.partitionBy("source_file", "page_num").orderBy("node_id")
    n = nodes.where("bbox is not null and page_num is not null").select("source_file", "page_num", "node_id", "bbox").withColumn("batch", F.floor((F.row_number().over(order) - 1) / batch))
    a, b = (n.select("source_file", "page_num", "batch", F.col("node_id").alias(i), F.col("bbox").alias(f"b_{i}")) for i in ("source", "target"))
    both = a.join(b, ["source_file", "page_num", "batch"]).where("source < target")
    return both.withColumn("relation", spatial_relation(F.col("b_source"), F.col("b_target"))).where("relation is not null").select("source", "target", "relation")


def entity_table(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(canonical_name, entity_type, mentions, first_nodes): mentions grouped by name; of the types that of the least id."""
    m = mention_edges(nodes, entities).join(entities.select(F.col("node_id").alias("entity_id"), "canonical_name", "entity_type"), "entity_id")
    return m.groupBy("canonical_name").agg(F.min_by("entity_type", "entity_id").alias("entity_type"), F.countDistinct("node_id").alias("mentions"), F.min("node_id").alias("first_node"))


# ---- changes


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those with the same key; the last wins among themselves by ``version``."""
    fresh = in_force(new, key, "version")
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes and the edges that hang on them."""
    g = gone.select(F.col("node").alias("node_id"))
    left = edges.join(g.withColumnRenamed("node_id", "source"), "source", "left_anti").join(g.withColumnRenamed("node_id", "target"), "target", "left_anti")
    return nodes.join(g, "node_id", "left_anti"), left


def with_reverses(edges: DataFrame) -> DataFrame:
    """Also the reverse of each edge that goes both ways."""
    back = edges.where("bidirectional").select(F.concat("edge_id", F.lit("_reverse")).alias("edge_id"), "edge_type", F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("is_reverse"))
    return edges.select("edge_id", "edge_type", "source", "target", F.lit(False).alias("is_reverse")).unionByName(back)


def with_all_types(counts: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Counts by type, zero for known types without rows."""
    known = counts.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return known.join(counts, "type", "full").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def _cascade(s: SparkSession, d: str) -> DataFrame:
    n, e = delete_nodes(nodes_of(s, d), edges_of(s, d), gold_nodes(s, d))
    return n.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).count().unionByName(e.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).count()).withColumnRenamed("count", "n")


def _upserted(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "nodes").where("node_id is not null").select("node_id", "node_type", "page_num", F.col("ingested_at").alias("version"))
    return upsert(rows.where("version < timestamp'2025-05-01'").groupBy("node_id").agg(F.max_by("node_type", "version").alias("node_type"), F.max_by("page_num", "version").alias("page_num"), F.max("version").alias("version")), rows.where("version >= timestamp'2025-05-01'"), "node_id").select("node_id", "page_num", "version")


PATTERN = "(heading)-[sequence]->(paragraph|table)-[refers_to|semantic_sim]?->(figure|paragraph)"

QUERIES = {
    "f01_find_nodes": lambda s, d: find_nodes(nodes_of(s, d), content_contains="Policy", node_type="paragraph").select("node_id", "page_num"),
    "f02_find_edges": lambda s, d: find_edges(edges_of(s, d), edge_type="contains").select("edge_id", "source", "target"),
    "f03_get_nodes": lambda s, d: nodes_of(s, d).join(gold_nodes(s, d).withColumnRenamed("node", "node_id"), "node_id", "left_semi").select("node_id", "node_type"),
    "p03_display_text": lambda s, d: nodes_of(s, d).select("node_id", display(F.col("content")).alias("shown")),
    "j01_neighbours": lambda s, d: neighbours(edges_of(s, d), gold_nodes(s, d)).select("node", "neighbour", "edge_id"),
    "j02_induced": lambda s, d: induced(edges_of(s, d), gold_nodes(s, d)).select("edge_id", "source", "target"),
    "j03_sequence": lambda s, d: sequence_edges(nodes_of(s, d)),
    "j04_containment": lambda s, d: containment_edges(nodes_of(s, d)),
    "j05_references": lambda s, d: reference_edges(nodes_of(s, d)),
    "j06_similarity": lambda s, d: similarity_edges(nodes_of(s, d).where("node_type in ('paragraph', 'heading')")).select("source", "target", F.round("cosine", 6).alias("cosine")),
    "j07_mentions": lambda s, d: mention_edges(nodes_of(s, d), table(s, d, "entity_nodes")),
    "j08_context": lambda s, d: context_edges(nodes_of(s, d)),
    "j17_spatial": lambda s, d: spatial_edges(nodes_of(s, d)),
    "g01_two_hops": lambda s, d: within_hops(edges_of(s, d), gold_nodes(s, d), 2),
    "g02_two_hop_edges": lambda s, d: induced(edges_of(s, d), within_hops(edges_of(s, d), gold_nodes(s, d), 2)).groupBy("edge_type").agg(F.count("*").alias("n")),
    "g09_components": lambda s, d: components(edges_of(s, d)),
    "g08_largest_components": lambda s, d: components(edges_of(s, d)).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(10),
    "g10_distances": lambda s, d: within_hops(edges_of(s, d), gold_nodes(s, d)),
    "g13_centrality": lambda s, d: degree_centrality(edges_of(s, d)),
    "g20_path_pattern": lambda s, d: Pattern(PATTERN).match(nodes_of(s, d), edges_of(s, d)),
    "g24_propagation": lambda s, d: propagate(edges_of(s, d), gold_nodes(s, d).withColumn("score", F.lit(0.8))),
    "a02_edge_types": lambda s, d: edges_of(s, d).groupBy("edge_type").agg(F.count("*").alias("n"), F.avg("weight").alias("mean_weight"), F.count_if("bidirectional").alias("both_ways")),
    "k01_type_counts": lambda s, d: with_all_types(nodes_of(s, d).groupBy(F.col("node_type").alias("type")).agg(F.count("*").alias("n")), NODE_TYPES),
    "a27_entities": lambda s, d: entity_table(nodes_of(s, d), table(s, d, "entity_nodes")),
    "u01_upsert": _upserted,
    "u02_delete_cascade": _cascade,
    "u04_reverses": lambda s, d: with_reverses(edges_of(s, d)),
}

_N = "WITH RECURSIVE n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM nodes) WHERE rn = 1 AND deleted_at IS NULL)"
_K = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_E = f""", e AS (SELECT edge_id, edge_type, source, target, weight, bidirectional FROM (SELECT *, {_K.format("source_node_id")} AS source, {_K.format("target_node_id")} AS target, row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC) AS rn FROM edges)
    WHERE rn = 1 AND source <> '' AND target <> ''),
i AS (SELECT source AS node, target AS neighbour, edge_id, edge_type FROM e UNION ALL SELECT target, source, edge_id, edge_type FROM e WHERE source <> target),
g AS (SELECT DISTINCT node FROM (SELECT unnest(gold_nodes) AS node FROM tasks) WHERE node IS NOT NULL)"""
_PLACED = "bbox IS NOT NULL AND page_num IS NOT NULL"
_PASS = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PASSES.items()) + " ELSE 0.5 END"
_COMP = ", k(node, component) USING KEY (node) AS (SELECT DISTINCT node, node FROM i UNION SELECT i.neighbour, min(k.component) FROM k JOIN i ON i.node = k.node JOIN recurring.k AS o ON o.node = i.neighbour WHERE k.component < o.component GROUP BY i.neighbour)"
_HOP = ", h(node, hop) USING KEY (node) AS (SELECT node, 0 FROM g UNION SELECT i.neighbour, min(h.hop) + 1 FROM h JOIN i ON i.node = h.node LEFT JOIN recurring.h AS o ON o.node = i.neighbour WHERE o.node IS NULL AND h.hop < {most} GROUP BY i.neighbour)"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_MENTION = f""", m AS (SELECT DISTINCT n.node_id, v.node_id AS entity_id FROM (SELECT node_id, ' ' || array_to_string({_WORDS.format("content")}, ' ') || ' ' AS said FROM n) n
    JOIN (SELECT node_id, ' ' || array_to_string({_WORDS.format("canonical_name")}, ' ') || ' ' AS name FROM entity_nodes) v ON contains(n.said, v.name) WHERE trim(v.name) <> '')"""

SQL = {
    "f01_find_nodes": _N + " SELECT node_id, page_num FROM n WHERE node_type = 'paragraph' AND contains(lower(content), 'policy')",
    "f02_find_edges": _N + _E + " SELECT edge_id, source, target FROM e WHERE edge_type = 'contains'",
    "f03_get_nodes": _N + _E + " SELECT node_id, node_type FROM n WHERE node_id IN (SELECT node FROM g)",
    "p03_display_text": _N + " SELECT node_id, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS shown FROM n",
    "j01_neighbours": _N + _E + " SELECT node, neighbour, edge_id FROM i WHERE node IN (SELECT node FROM g)",
    "j02_induced": _N + _E + " SELECT edge_id, source, target FROM e WHERE source IN (SELECT node FROM g) AND target IN (SELECT node FROM g)",
    "j03_sequence": _N + f" SELECT * FROM (SELECT node_id AS source, lead(node_id) OVER (PARTITION BY source_file, page_num ORDER BY bbox.y0, bbox.x0, node_id) AS target FROM n WHERE {_PLACED}) WHERE target IS NOT NULL",
    "j04_containment": _N + f" SELECT h.node_id AS source, n.node_id AS target FROM n h JOIN n ON h.source_file = n.source_file AND h.page_num = n.page_num AND n.bbox.y0 > h.bbox.y0 WHERE h.node_type = 'heading' AND n.node_type <> 'heading'",
    "j05_references": _N + """, f AS (SELECT source_file, node_type, arg_min(node_id, (coalesce(page_num, 0), coalesce(bbox.y0, 0), node_id)) AS target FROM n GROUP BY ALL),
        m AS (SELECT source_file, node_id AS source, unnest(list_distinct(regexp_extract_all(lower(content), '(?:table|figure|section) [0-9]+'))) AS mention FROM n WHERE node_type IN ('paragraph', 'heading'))
        SELECT source, mention, target FROM m JOIN f ON f.source_file = m.source_file AND f.node_type = CASE split_part(mention, ' ', 1) WHEN 'section' THEN 'heading' ELSE split_part(mention, ' ', 1) END WHERE source <> target""",
    "j06_similarity": _N + """, v AS (SELECT source_file, node_id, embedding::DOUBLE[] AS v FROM n WHERE node_type IN ('paragraph', 'heading') AND source_file IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.node_id AS source, b.node_id AS target, list_cosine_similarity(a.v, b.v) AS cosine FROM v a JOIN v b ON a.source_file = b.source_file AND a.node_id < b.node_id AND len(a.v) = len(b.v)) SELECT source, target, round(cosine, 6) AS cosine FROM p WHERE cosine >= 0.7""",
    "j07_mentions": _N + _MENTION + " SELECT * FROM m",
    "j08_context": _N + f""" SELECT n.node_id AS source, t.node_id AS target, (floor(abs(n.bbox.y0 - t.bbox.y0) / 100) + 1)::BIGINT AS distance, CASE WHEN n.bbox.y0 < t.bbox.y0 THEN 'before' ELSE 'after' END AS position
        FROM n JOIN n t ON n.source_file = t.source_file AND n.page_num = t.page_num WHERE n.node_type IN ('paragraph', 'heading') AND t.node_type IN ('table', 'figure') AND abs(n.bbox.y0 - t.bbox.y0) < 200""",
    "j17_spatial": _N + f""", b AS (SELECT *, (row_number() OVER (PARTITION BY source_file, page_num ORDER BY node_id) - 1) // 50 AS batch, (bbox.x0 + bbox.x1) / 2 AS cx, (bbox.y0 + bbox.y1) / 2 AS cy FROM n WHERE {_PLACED}),
        p AS (SELECT a.node_id AS source, z.node_id AS target, sqrt((a.cx - z.cx) ** 2 + (a.cy - z.cy) ** 2) AS d, abs(a.cx - z.cx) AS dx, abs(a.cy - z.cy) AS dy FROM b a JOIN b z ON a.source_file = z.source_file AND a.page_num = z.page_num AND a.batch = z.batch AND a.node_id < z.node_id),
        q AS (SELECT source, target, CASE WHEN d < 20 THEN 'contains' WHEN dy < 30 AND d < 100 THEN 'sequence' WHEN dx < 50 AND d < 100 THEN 'layout' END AS relation FROM p) SELECT * FROM q WHERE relation IS NOT NULL""",
    "g01_two_hops": _N + _E + _HOP.format(most=2) + " SELECT * FROM h",
    "g02_two_hop_edges": _N + _E + _HOP.format(most=2) + " SELECT edge_type, count(*) AS n FROM e WHERE source IN (SELECT node FROM h) AND target IN (SELECT node FROM h) GROUP BY edge_type",
    "g09_components": _N + _E + _COMP + " SELECT * FROM k",
    "g08_largest_components": _N + _E + _COMP + " SELECT component, count(*) AS size FROM k GROUP BY component ORDER BY size DESC, component LIMIT 10",
    "g10_distances": _N + _E + _HOP.format(most=10**6) + " SELECT * FROM h",
    "g13_centrality": _N + _E + ", d AS (SELECT node, count(*) AS degree FROM i GROUP BY node) SELECT node, degree, degree / max(degree) OVER () AS centrality FROM d",
    "g20_path_pattern": _N + _E + """, t AS (SELECT DISTINCT source, target, edge_type, node_type FROM e JOIN n ON n.node_id = e.target), a AS (SELECT node_id AS n0, target AS n1 FROM n JOIN t ON t.source = n.node_id WHERE n.node_type = 'heading' AND t.edge_type = 'sequence' AND t.node_type IN ('paragraph', 'table') AND node_id <> target),
        b AS (SELECT DISTINCT source, target FROM t WHERE edge_type IN ('refers_to', 'semantic_sim') AND node_type IN ('figure', 'paragraph'))
        SELECT DISTINCT n0, n1, target AS n2 FROM a LEFT JOIN b ON b.source = a.n1 WHERE target IS NULL OR (target <> n0 AND target <> n1)""",
    "g24_propagation": _N + _E + f""", w AS (SELECT node, neighbour, {_PASS} AS w FROM i), s0 AS (SELECT node, 0.8::DOUBLE AS score FROM g), s1 AS (SELECT neighbour AS node, sum(score * 0.7::DOUBLE * w) AS score FROM s0 JOIN w USING (node) GROUP BY ALL),
        s2 AS (SELECT neighbour AS node, sum(score * 0.7::DOUBLE * w) AS score FROM s1 JOIN w USING (node) GROUP BY ALL) SELECT node, max(score) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY node""",
    "a02_edge_types": _N + _E + " SELECT edge_type, count(*) AS n, avg(weight) AS mean_weight, count_if(bidirectional)::BIGINT AS both_ways FROM e GROUP BY edge_type",
    "k01_type_counts": _N + " SELECT type, count(node_id) AS n FROM (SELECT unnest(['" + "', '".join(NODE_TYPES) + "']) AS type) LEFT JOIN n ON node_type = type GROUP BY type",
    "a27_entities": _N + _MENTION + " SELECT canonical_name, arg_min(entity_type, v.node_id) AS entity_type, count(DISTINCT m.node_id) AS mentions, min(m.node_id) AS first_node FROM m JOIN entity_nodes v ON v.node_id = m.entity_id GROUP BY canonical_name",
    "u01_upsert": "SELECT node_id, page_num, ingested_at AS version FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM nodes) WHERE rn = 1 AND node_id IS NOT NULL",
    "u02_delete_cascade": _N + _E + " SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM n WHERE node_id NOT IN (SELECT node FROM g) GROUP BY ALL UNION ALL SELECT 'edge', edge_type, count(*) FROM e WHERE source NOT IN (SELECT node FROM g) AND target NOT IN (SELECT node FROM g) GROUP BY ALL",
    "u04_reverses": _N + _E + " SELECT edge_id, edge_type, source, target, FALSE AS is_reverse FROM e UNION ALL SELECT edge_id || '_reverse', edge_type, target, source, TRUE FROM e WHERE bidirectional",
}
