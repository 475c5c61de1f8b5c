"""Subgraph samples, motifs and chains over the graph, their checks, and clusters of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import jsons as J
from quern.functions import text as T
from quern.operators.graph import edges_of, gold_nodes, incident, nodes_of
from quern.operators.scoring import tasks_of
from quern.operators.tasks import uniform
from quern.plans.runtime import stored, table
from quern.sources.documents import html_elements, lines_of, paragraphs_of

#: Small patterns of the graph: node and edge types they need, and how many nodes they have (fixed values).
MOTIFS = [
    ("hierarchy", ["heading", "paragraph"], ["contains"], 2, 10),
    ("table_in_text", ["table", "paragraph"], ["table_context"], 2, 6),
    ("reference", ["paragraph", "figure"], ["refers_to"], 2, 5),
    ("sequence", ["paragraph"], ["sequence"], 2, 8),
    ("alike", ["paragraph"], ["semantic_sim"], 2, 8),
    ("entities", ["paragraph"], ["entity_relation"], 2, 12),
]
MOTIF = "name string, kinds array<string>, links array<string>, least int, most int"


# ---- samples


def sample_around(edges: DataFrame, seeds: DataFrame, hops: int = 2, most: int = 15, edge_types: list[str] | None = None, directed: bool = False) -> DataFrame:
    """(sample, node, hop): from each seed outwards, at most ``most`` nodes: the nearer first, of equals the least id.

    The bound holds for every round, so that a hot node cannot make a sample grow beyond it.
    """
    e = edges if edge_types is None else edges.where(F.col("edge_type").isin(edge_types))
    links = (e.select(F.col("source").alias("node"), F.col("target").alias("neighbour")) if directed else incident(e).select("node", "neighbour")).distinct()
    # of a node's neighbours no more than a sample holds can ever be taken
    links = links.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("neighbour"))).where(F.col("n") <= 2 * most).drop("n")
    seen = seeds.select(F.col("node").alias("sample"), "node", F.lit(0).alias("hop")).distinct()
    for h in range(1, hops + 1):
        new = seen.where(F.col("hop") == h - 1).join(links, "node").select("sample", F.col("neighbour").alias("node")).distinct().join(seen.select("sample", "node"), ["sample", "node"], "left_anti").withColumn("hop", F.lit(h))
        both = seen.unionByName(new)
        order = Window.partitionBy("sample").orderBy("hop", "node")
        seen = stored(both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n"))
    return seen


def sample_edges(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample, edge_id, edge_type, source, target): the edges with both ends in a sample."""
    a, b = samples.select("sample", F.col("node").alias("source")), samples.select("sample", F.col("node").alias("target"))
    return edges.join(a, "source").join(b, ["sample", "target"]).select("sample", "edge_id", "edge_type", "source", "target")


def sample_types(samples: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample, size, kinds, links): sizes and the sets of types of samples."""
    kinds = samples.join(nodes.select(F.col("node_id").alias("node"), "node_type"), "node", "left").groupBy("sample").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("node_type")).alias("kinds"))
    types = links.groupBy("sample").agg(F.array_sort(F.collect_set("edge_type")).alias("links"))
    return kinds.join(types, "sample", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def connected(samples: DataFrame, links: DataFrame) -> DataFrame:
    """(sample, connected): whether a sample's edges reach all its nodes from its seed. A sample is small; rounds go on while any grows."""
    both = stored(links.select("sample", F.col("source").alias("node"), F.col("target").alias("other")).unionByName(links.select("sample", F.col("target").alias("node"), F.col("source").alias("other"))).distinct())
    reached = stored(samples.where("hop = 0").select("sample", "node"))
    count = 0
    while count < (count := reached.count()):
        reached = stored(reached.unionByName(reached.join(both, ["sample", "node"]).select("sample", F.col("other").alias("node"))).distinct())
    n, r = samples.groupBy("sample").agg(F.count("*").alias("n")), reached.groupBy("sample").agg(F.count("*").alias("r"))
    return n.join(r, "sample", "left").select("sample", (F.col("n") == F.coalesce("r", F.lit(0))).alias("connected"))


def matching_motifs(types: DataFrame) -> DataFrame:
    """(sample, motif): the motifs whose types a sample has and whose size it fits. There are six motifs."""
    m = F.broadcast(types.sparkSession.createDataFrame(MOTIFS, MOTIF))
    fits = (F.size(F.array_except("m.kinds", "t.kinds")) == 0) & (F.size(F.array_except("m.links", "t.links")) == 0) & F.col("size").between(F.col("least"), F.col("most"))
    return types.alias("t").join(m.alias("m"), fits).select("sample", F.col("name").alias("motif"))


def motif_stars(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, str], link: str, most: int = 5) -> DataFrame:
    """(centre, nodes): nodes of one type with their neighbours of another along one type of edge, at most ``most``."""
    of = lambda t, c: nodes.where(F.col("node_type") == t).select(F.col("node_id").alias(c))
    near = incident(edges.where(F.col("edge_type") == link)).select(F.col("node").alias("centre"), F.col("neighbour").alias("leaf")).distinct()
    met = near.join(of(kinds[0], "centre"), "centre", "left_semi").join(of(kinds[1], "leaf"), "leaf", "left_semi").where("centre != leaf")
    ranked = met.withColumn("n", F.row_number().over(Window.partitionBy("centre").orderBy("leaf"))).where(F.col("n") <= most)
    return ranked.groupBy("centre").agg(F.array_join(F.array_sort(F.collect_list("leaf")), ",").alias("nodes"))


def chains(edges: DataFrame, types: list[str], length: int = 3, seed: str = "chain") -> DataFrame:
    """(start, path): from each node with two or more ways out along a way drawn by hash, without coming back.

    Of a node's ways the first ``length`` are enough: fewer nodes than that can have been visited.
    """
    e = edges.where(F.col("edge_type").isin(types)).select("source", "target").distinct()
    ways = e.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(uniform(seed, F.col("source"), F.col("target")), "target"))).where(F.col("n") <= length)
    out = e.groupBy("source").agg(F.count("*").alias("out")).where("out >= 2").select(F.col("source").alias("start"), F.array("source").alias("path"))
    for _ in range(length - 1):
        step = out.withColumn("source", F.element_at("path", -1)).join(ways, "source", "left")
        fresh = F.when(F.col("target").isNotNull() & ~F.array_contains("path", F.col("target")), F.struct("n", "target"))
        out = step.groupBy("start", "path").agg(F.min(fresh).alias("next")).select("start", F.when(F.col("next").isNotNull(), F.concat("path", F.array("next.target"))).otherwise(F.col("path")).alias("path"))
    return out


def distinct_sets(rows: DataFrame, key: str, items: str) -> DataFrame:
    """Of rows with the same set of items the one with the least key."""
    s = rows.select(key, F.array_sort(F.array_distinct(items)).alias("set")).where(F.size("set") > 0)
    return s.groupBy("set").agg(F.min(key).alias(key), F.count("*").alias("rows"))


def greedy_clusters(edges: DataFrame) -> DataFrame:
    """(seed, node): the least node left takes its neighbours that are left, and so on, all seeds of a round at once.

    A node is a seed when no lesser neighbour is left; this gives what going through the nodes in order would.
    """
    near = stored(incident(edges).where("node != neighbour").select("node", "neighbour").distinct())
    left = stored(near.select("node").distinct())
    found = None
    while True:
        live = near.join(left, "node", "left_semi").join(left.select(F.col("node").alias("neighbour")), "neighbour", "left_semi")
        seeds = left.join(live.where("neighbour < node").select("node").distinct(), "node", "left_anti")
        taken = live.join(seeds, "node", "left_semi").groupBy("neighbour").agg(F.min("node").alias("seed")).select("seed", F.col("neighbour").alias("node"))
        step = stored(seeds.select(F.col("node").alias("seed"), "node").unionByName(taken))
        found = step if found is None else found.unionByName(step)
        left = stored(left.join(step.select("node"), "node", "left_anti"))
        if left.isEmpty():
            break
    return found.where(F.col("seed").isNotNull())


# ---- coverage and novelty


def coverage(counts: DataFrame, known: int) -> Column:
    return F.countDistinct("type") / known


def task_likeness(a: str, b: str) -> Column:
    """Mean of: same type, same difficulty, and how near the numbers of gold nodes are."""
    steps = F.greatest(F.col(f"{a}_steps"), F.col(f"{b}_steps"))
    near = F.when(steps == 0, 1.0).otherwise(1 - F.abs(F.col(f"{a}_steps") - F.col(f"{b}_steps")) / steps)
    same = lambda c: (F.col(f"{a}_{c}") == F.col(f"{b}_{c}")).cast("double")
    return (same("type") + same("difficulty") + near) / 3


def focus_set(rows: DataFrame, quality: float = 0.5, confidence: float = 0.6, most: int = 100) -> DataFrame:
    """The records worth another training: bad ones first, then the least certain, at most ``most``."""
    bad = (F.coalesce("quality_score", F.lit(0.0)) < quality).cast("int")
    unsure = (F.coalesce("attribution_confidence", F.lit(0.0)) < confidence).cast("int")
    return rows.withColumns({"bad": bad, "unsure": unsure}).where("bad + unsure > 0").orderBy(F.desc("bad"), F.desc("unsure"), F.col("quality_score").asc_nulls_first(), "row_id").limit(most)


def quota(rows: DataFrame, by: str, quotas: dict[str, int], order: str) -> DataFrame:
    """The first rows of each class, as many as its quota."""
    most = F.lit(0)
    for k, v in quotas.items():
        most = F.when(F.col(by) == k, v).otherwise(most)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("n") <= most).drop("n")


def variations(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """(row_id, variation, prompt, quality): a share of the rows drawn by hash, each in one of three wordings, their quality lowered."""
    drawn = rows.where(uniform("augment", F.col("row_id").cast("string")) < share).withColumn("variation", F.floor(uniform("kind", F.col("row_id").cast("string")) * 3).cast("int"))
    prompt = F.when(F.col("variation") == 0, F.concat(F.lit("Please answer: "), "prompt")).when(F.col("variation") == 1, F.concat("prompt", F.lit(" Explain your answer."))).otherwise(F.concat(F.lit("Question: "), "prompt"))
    factor = F.when(F.col("variation") == 1, 0.95).otherwise(0.9)
    return drawn.select("row_id", "variation", prompt.alias("prompt"), (F.col("quality_score") * factor).alias("quality"))


# ---- web steps


def step_accuracy(kind: Column, want: Column, got: Column) -> Column:
    """Navigation: one holds the other; clicks: equal; extraction and others: share of the wanted words."""
    w, g = F.lower(F.trim(want)), F.lower(F.trim(got))
    words = T.plain_tokens(want)
    share = F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, T.plain_tokens(got))) / F.size(words))
    held = (w.contains(g) | g.contains(w)).cast("double")
    return F.coalesce(F.when(kind == "navigate", held).when(kind == "click", (w == g).cast("double")).otherwise(share), F.lit(0.0))


def kind_accuracies(steps: DataFrame) -> DataFrame:
    """(task, navigation, interaction, extraction): means by kind of step, 1 where there is none."""
    mean = lambda *k: F.coalesce(F.avg(F.when(F.col("kind").isin(*k), F.col("accuracy"))), F.lit(1.0))
    return steps.groupBy("task").agg(mean("navigate").alias("navigation"), mean("click", "input").alias("interaction"), mean("extract").alias("extraction"))


# ---- texts of nodes and sentences


def embedding_text() -> Column:
    """What a node is known by: headings and paragraphs their content, tables their content and cells, figures their content marked so."""
    cells = F.when(F.col("table_data").isNotNull(), F.array_join(F.transform("table_data", lambda r: F.array_join(r, " ", "")), " | "))
    return F.when(F.col("node_type") == "table", F.concat_ws(" | ", "content", cells)).when(F.col("node_type") == "figure", F.concat(F.lit("Figure: "), F.coalesce("content", F.lit("")))).otherwise(F.coalesce("content", F.lit("")))


def with_line(text: Column, line: str, where: str, key: Column) -> Column:
    """A line set before a text, behind it, or between its lines at a place drawn by hash."""
    lines = F.split(text, "\n", -1)
    at = F.floor(uniform("place", key) * (F.size(lines) + 1)).cast("int")
    inside = F.array_join(F.concat(F.slice(lines, 1, at), F.array(F.lit(line)), F.slice(lines, at + 1, F.size(lines))), "\n")
    return {"prepend": F.concat(F.lit(line + "\n\n"), text), "append": F.concat(text, F.lit("\n\n" + line)), "random": inside}[where]


def hashed_vectors(sentences: list[str], dim: int = 64):
    import zlib

    import numpy as np

    v = np.zeros((len(sentences), dim))
    for i, s in enumerate(sentences):
        for w in s.lower().split():
            v[i, zlib.crc32(w.encode()) % dim] += 1
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def cluster_in_order(sentences: list[str], least: float, shortest: int, longest: int) -> list[str]:
    """Sentences go on with the cluster while they are like its mean; short clusters join the one before, long ones are cut at words."""
    import numpy as np

    clusters: list[tuple[list[str], np.ndarray]] = []
    for s, v in zip(sentences, hashed_vectors(sentences)):
        if clusters:
            said, total = clusters[-1]
            n = np.linalg.norm(total)
            if n and float(total @ v) / n >= least:
                said.append(s)
                total += v
                continue
        clusters.append(([s], v.copy()))
    out: list[str] = []
    for said, _ in clusters:
        text = ". ".join(said) + "."
        if out and len(text) < shortest and len(out[-1]) + len(text) + 1 <= longest:
            out[-1] += " " + text
        elif len(text) > longest:
            words, size = text.split(), max(longest // 6, 1)
            out += [" ".join(words[k : k + size]) for k in range(0, len(words), size)]
        else:
            out.append(text)
    return out


def semantic_chunks(docs: DataFrame, least: float = 0.25, shortest: int = 100, longest: int = 1000) -> DataFrame:
    """(doc_id, chunk, content): each depends on the sentences before, so a text is gone through in its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c) for i, s in zip(b["doc_id"], b["s"]) for k, c in enumerate(cluster_in_order(list(s), least, shortest, longest))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "content"])

    return docs.where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s")).mapInPandas(run, "doc_id bigint, chunk int, content string")


def capped_per_page(nodes: DataFrame, most: int = 3) -> DataFrame:
    """The first elements of each page, tables and figures before others."""
    order = Window.partitionBy("source_file", "page_num").orderBy(F.when(F.col("node_type").isin("table", "figure"), 0).otherwise(1), "node_id")
    return nodes.where("page_num is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def type_decay(nodes: DataFrame, preferred: list[str], per_type: int = 5) -> DataFrame:
    """(source_file, node_id, score): the first nodes of each preferred type, worth less by type and by place."""
    rank = F.array_position(F.array(*[F.lit(t) for t in preferred]), F.col("node_type")).cast("int")
    first = nodes.withColumn("r", rank).where("r > 0").withColumn("n", F.row_number().over(Window.partitionBy("source_file", "node_type").orderBy("node_id"))).where(F.col("n") <= per_type)
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("r", "n"))
    return first.withColumn("score", (1 - (F.col("r") - 1) / len(preferred)) / place).select("source_file", "node_id", "score")


# ---- pages and lines made of nodes


def pages_of(nodes: DataFrame) -> DataFrame:
    """(page_id, html): a page of HTML for each page of a file, as a source for the parsers."""
    esc = F.replace(F.replace(F.replace(F.coalesce("content", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.coalesce(c, F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    rows = F.array_join(F.transform(F.coalesce("table_data", F.array().cast("array<array<string>>")), lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), "")
    tag = F.concat(F.lit("h"), F.coalesce(F.least("level", F.lit(6)), F.lit(1)).cast("string"))
    html = F.when(F.col("node_type") == "heading", F.concat(F.lit("<"), tag, F.lit(">"), esc, F.lit("</"), tag, F.lit(">"))).when(F.col("node_type") == "table", F.concat(F.lit("<table>"), rows, F.lit("</table>"))).otherwise(F.concat(F.lit("<p>"), esc, F.lit("</p>")))
    page = F.concat_ws(":", "source_file", F.col("page_num").cast("string"))
    parts = nodes.where("page_num is not null and source_file is not null").groupBy(page.alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("node_id", html.alias("h")))).alias("parts"))
    return parts.select("page_id", F.concat(F.lit("<html><head><title>"), "page_id", F.lit("</title></head><body>"), F.array_join(F.transform("parts", lambda p: p["h"]), "\n"), F.lit("</body></html>")).alias("html"))


def words_of(nodes: DataFrame) -> DataFrame:
    """Words with boxes: those of a node's content, side by side at its top edge."""
    said = nodes.where("bbox is not null and page_num is not null and source_file is not null and content is not null").select("source_file", "page_num", "bbox", F.posexplode(F.split("content", " ")).alias("k", "text"))
    return said.select(F.col("source_file").alias("doc_id"), F.col("page_num").alias("page"), (F.col("bbox.x0") + F.col("k") * 10.0).alias("x0"), (F.col("bbox.x0") + F.col("k") * 10.0 + 8).alias("x1"), F.col("bbox.y0").alias("top"), (F.col("bbox.y0") + 12).alias("bottom"), F.lit(11.0).alias("size"), "text")


def _samples(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = edges_of(s, d)
    n = sample_around(e, gold_nodes(s, d), 2, 15, ["contains", "refers_to", "sequence"])
    return n, sample_edges(n, e)


def _typed(s: SparkSession, d: str) -> DataFrame:
    n, e = _samples(s, d)
    return sample_types(n, e, nodes_of(s, d))


def _pairs_of_responses(s: SparkSession, d: str) -> DataFrame:
    t = tasks_of(s, d).select("task_id", F.col("template_id").alias("template"), F.col("task_type").alias("type"), F.lower("difficulty").alias("difficulty"), F.coalesce(F.array_size("gold_nodes"), F.lit(0)).alias("steps")).where("template is not null")
    near = Window.partitionBy("template").orderBy("task_id")
    cols = ["task_id", "type", "difficulty", "steps"]
    both = t.select("*", *[F.lead(c).over(near).alias(f"b_{c}") for c in cols]).where("b_task_id is not null")
    return both.select(F.col("task_id").alias("a"), F.col("b_task_id").alias("b"), *[F.col(c).alias(f"a_{c}") for c in cols[1:]], *[f"b_{c}" for c in cols[1:]])


PREFERRED = ["table", "figure", "heading"]
QUERIES = {
    "g02_samples": lambda s, d: _samples(s, d)[0],
    "g03_directed_samples": lambda s, d: sample_around(edges_of(s, d), gold_nodes(s, d), 2, 10, directed=True).groupBy("sample").agg(F.count("*").alias("nodes")),
    "g07_connected": lambda s, d: connected(*_samples(s, d)),
    "f15_motifs": lambda s, d: matching_motifs(_typed(s, d)).groupBy("motif").agg(F.count("*").alias("n")),
    "f17_valid_samples": lambda s, d: _typed(s, d).where("size between 2 and 15 and size(links) > 0").select("sample", "size", F.array_join("kinds", ",").alias("kinds"), F.array_join("links", ",").alias("links")),
    "g16_motif_stars": lambda s, d: motif_stars(nodes_of(s, d), edges_of(s, d), ("heading", "paragraph"), "sequence"),
    "g15_chains": lambda s, d: chains(edges_of(s, d), ["refers_to", "semantic_sim"]).select("start", F.array_join("path", ">").alias("path")),
    "g14_clusters": lambda s, d: greedy_clusters(edges_of(s, d).where("edge_type = 'semantic_sim'")),
    "a04_node_sets": lambda s, d: distinct_sets(tasks_of(s, d), "task_id", "gold_nodes").select("task_id", "rows"),
    "a11_coverage": lambda s, d: tasks_of(s, d).groupBy("task_type").agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("difficulty"))).alias("difficulties"), F.countDistinct("template_id").alias("templates")),
    "a12_touched_types": lambda s, d: tasks_of(s, d).select("task_id", F.explode("gold_nodes").alias("node_id")).join(nodes_of(s, d).select("node_id", "node_type"), "node_id").groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("node_type")), ",").alias("types")),
    "m24_task_likeness": lambda s, d: _pairs_of_responses(s, d).select("a", "b", F.round(task_likeness("a", "b"), 6).alias("likeness")),
    "f34_focus": lambda s, d: focus_set(table(s, d, "training_samples")).select("row_id", "bad", "unsure"),
    "t17_quota": lambda s, d: quota(tasks_of(s, d), "task_type", {"analysis": 10, "reasoning": 20, "table_qa": 5}, "task_id").select("task_type", "task_id"),
    "x09_variations": lambda s, d: variations(table(s, d, "training_samples")).select("row_id", "variation", F.length("prompt").alias("chars"), F.round("quality", 6).alias("quality")),
    "p02_embedding_text": lambda s, d: nodes_of(s, d).select("node_id", embedding_text().alias("text")),
    "p16_reminders": lambda s, d: table(s, d, "tasks").distinct().select("task_id", with_line(F.col("prompt"), "Keep to the rules.", "prepend", F.col("task_id")).alias("before"), with_line(F.col("prompt"), "Keep to the rules.", "random", F.col("task_id")).alias("inside")),
    "w07_semantic_chunks": lambda s, d: semantic_chunks(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "chunk", "content"),
    "w15_type_decay": lambda s, d: type_decay(nodes_of(s, d), PREFERRED).withColumn("score", F.round("score", 6)),
    "w17_page_cap": lambda s, d: capped_per_page(nodes_of(s, d)).select("node_id", "n"),
    "c30_json": lambda s, d: table(s, d, "events").select("event_id", J.robust(F.concat(F.lit("Result:\n```json\n"), F.replace("props", F.lit("}"), F.lit(",}")), F.lit("\n```")), "k bigint")["k"].alias("k")),
    "c38_reply_scores": lambda s, d: table(s, d, "no_rag_responses").where("answer is not null").select("row_id", J.reply_score(F.col("answer")).alias("score")),
    "s02_lines": lambda s, d: lines_of(words_of(nodes_of(s, d))).select("doc_id", "page", "line", "text", "x0", "bottom"),
    "s03_paragraphs": lambda s, d: paragraphs_of(lines_of(words_of(nodes_of(s, d)))),
}

_N = "WITH RECURSIVE n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM nodes) WHERE rn = 1 AND deleted_at IS NULL)"
_K = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_E = f""", e AS (SELECT edge_id, edge_type, source, target FROM (SELECT *, {_K.format("source_node_id")} AS source, {_K.format("target_node_id")} AS target, row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC) AS rn FROM edges) WHERE rn = 1 AND source <> '' AND target <> ''),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC) AS rn FROM tasks) WHERE rn = 1), g AS (SELECT DISTINCT node FROM (SELECT unnest(gold_nodes) AS node FROM tasks) WHERE node IS NOT NULL)"""


def _around(types: str, directed: bool, most: int) -> str:
    links = f"SELECT DISTINCT source AS node, target AS neighbour FROM e WHERE {types}" + ("" if directed else f" UNION SELECT target, source FROM e WHERE {types}")
    cap = lambda q: f"SELECT sample, node, hop FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY hop, node) AS k FROM ({q})) WHERE k <= {most}"
    out = f", l AS (SELECT node, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY neighbour) AS k FROM ({links})) WHERE k <= {2 * most}), s0 AS (SELECT node AS sample, node, 0 AS hop FROM g)"
    for h in (1, 2):
        new = f"SELECT DISTINCT s.sample, l.neighbour AS node, {h} AS hop FROM s{h - 1} s JOIN l ON l.node = s.node WHERE s.hop = {h - 1} AND NOT EXISTS (SELECT 1 FROM s{h - 1} o WHERE o.sample = s.sample AND o.node = l.neighbour)"
        out += f", s{h} AS ({cap(f'SELECT * FROM s{h - 1} UNION ALL {new}')})"
    return out


_S = _N + _E + _around("edge_type IN ('contains', 'refers_to', 'sequence')", False, 15)
_SE = ", se AS (SELECT a.sample, e.edge_type, e.source, e.target FROM e JOIN s2 a ON a.node = e.source JOIN s2 b ON b.node = e.target AND b.sample = a.sample)"
_ST = _SE + ", ty AS (SELECT s2.sample, count(*) AS size, list_sort(list_filter(list(DISTINCT node_type), lambda x: x IS NOT NULL)) AS kinds FROM s2 LEFT JOIN n ON n.node_id = s2.node GROUP BY ALL), tl AS (SELECT sample, list_sort(list(DISTINCT edge_type)) AS links FROM se GROUP BY ALL), tt AS (SELECT ty.*, coalesce(links, []) AS links FROM ty LEFT JOIN tl USING (sample))"
_UNI = lambda seed, c: f"('0x' || substr(md5('{seed}|' || {c}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_MO = " UNION ALL ".join(f"SELECT '{n}' AS motif, {k} AS mk, {e} AS ml, {a} AS least, {b} AS most" for n, k, e, a, b in MOTIFS)

_LINES = """, w AS (SELECT source_file AS doc_id, page_num AS page, bbox.y0 AS top, bbox.x0 AS left_, unnest(string_split(content, ' ')) AS text, unnest(range(len(string_split(content, ' ')))) AS k FROM n WHERE bbox IS NOT NULL AND page_num IS NOT NULL AND source_file IS NOT NULL AND content IS NOT NULL),
        l AS (SELECT *, left_ + k * 10.0::DOUBLE AS x0 FROM w), f AS (SELECT *, coalesce((abs(top - lag(top) OVER o) >= 5)::INT, 0) AS fresh FROM l WINDOW o AS (PARTITION BY doc_id, page ORDER BY top, x0, text)),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM f)"""

SQL = {
    "g02_samples": _S + " SELECT * FROM s2",
    "g03_directed_samples": _N + _E + _around("TRUE", True, 10) + " SELECT sample, count(*) AS nodes FROM s2 GROUP BY sample",
    "f15_motifs": _S + _ST + f" SELECT motif, count(*) AS n FROM tt JOIN ({_MO}) ON list_has_all(kinds, mk) AND list_has_all(links, ml) AND size BETWEEN least AND most GROUP BY motif",
    "f17_valid_samples": _S + _ST + " SELECT sample, size, array_to_string(kinds, ',') AS kinds, array_to_string(links, ',') AS links FROM tt WHERE size BETWEEN 2 AND 15 AND len(links) > 0",
    "g16_motif_stars": _N + _E + """, i AS (SELECT source AS c, target AS l FROM e WHERE edge_type = 'sequence' UNION SELECT target, source FROM e WHERE edge_type = 'sequence'),
        m AS (SELECT c, l, row_number() OVER (PARTITION BY c ORDER BY l) AS k FROM i JOIN n a ON a.node_id = c AND a.node_type = 'heading' JOIN n b ON b.node_id = l AND b.node_type = 'paragraph' WHERE c <> l) SELECT c AS centre, string_agg(l, ',' ORDER BY l) AS nodes FROM m WHERE k <= 5 GROUP BY c""",
    "a04_node_sets": _N + _E + ", z AS (SELECT task_id, list_sort(list_distinct(gold_nodes)) AS s FROM t WHERE len(list_distinct(gold_nodes)) > 0) SELECT min(task_id) AS task_id, count(*) AS rows FROM z GROUP BY s",
    "a11_coverage": _N + _E + " SELECT task_type, count(*) AS n, count(DISTINCT lower(trim(difficulty, ' '))) AS difficulties, count(DISTINCT template_id) AS templates FROM t GROUP BY task_type",
    "a12_touched_types": _N + _E + " SELECT task_id, array_to_string(list_sort(list(DISTINCT node_type)), ',') AS types FROM (SELECT task_id, unnest(gold_nodes) AS node_id FROM t) JOIN n USING (node_id) GROUP BY task_id",
    "m24_task_likeness": _N + _E + """, q AS (SELECT task_id, template_id, task_type, lower(difficulty) AS difficulty, coalesce(len(gold_nodes), 0) AS steps FROM t WHERE template_id IS NOT NULL), w AS (SELECT *, lead(task_id) OVER o AS b, lead(task_type) OVER o AS bt, lead(difficulty) OVER o AS bd, lead(steps) OVER o AS bs FROM q WINDOW o AS (PARTITION BY template_id ORDER BY task_id))
        SELECT task_id AS a, b, round(((task_type = bt)::INT + (difficulty = bd)::INT + CASE WHEN greatest(steps, bs) = 0 THEN 1.0::DOUBLE ELSE 1 - abs(steps - bs) / greatest(steps, bs)::DOUBLE END) / 3, 6) AS likeness FROM w WHERE b IS NOT NULL""",
    "f34_focus": "WITH z AS (SELECT *, (coalesce(quality_score, 0) < 0.5)::INT AS bad, (coalesce(attribution_confidence, 0) < 0.6)::INT AS unsure FROM training_samples) SELECT row_id, bad, unsure FROM z WHERE bad + unsure > 0 ORDER BY bad DESC, unsure DESC, quality_score ASC NULLS FIRST, row_id LIMIT 100",
    "t17_quota": _N + _E + " SELECT task_type, task_id FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY task_id) AS k FROM t) WHERE k <= CASE task_type WHEN 'analysis' THEN 10 WHEN 'reasoning' THEN 20 WHEN 'table_qa' THEN 5 ELSE 0 END",
    "x09_variations": f"WITH z AS (SELECT *, floor({_UNI('kind', 'row_id')} * 3)::INT AS variation FROM training_samples WHERE {_UNI('augment', 'row_id')} < 0.3) SELECT row_id, variation, (length(prompt) + CASE variation WHEN 0 THEN 15 WHEN 1 THEN 21 ELSE 10 END)::INT AS chars, round(quality_score * CASE variation WHEN 1 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END, 6) AS quality FROM z",
    "p02_embedding_text": _N + " SELECT node_id, CASE node_type WHEN 'table' THEN concat_ws(' | ', content, CASE WHEN table_data IS NOT NULL THEN array_to_string(list_transform(table_data, lambda r: array_to_string(r, ' ')), ' | ') END) WHEN 'figure' THEN 'Figure: ' || coalesce(content, '') ELSE coalesce(content, '') END AS text FROM n",
    "w15_type_decay": _N + ", r AS (SELECT *, list_position(['table', 'figure', 'heading'], node_type) AS r FROM n), f AS (SELECT *, row_number() OVER (PARTITION BY source_file, node_type ORDER BY node_id) AS k FROM r WHERE r > 0) SELECT source_file, node_id, round((1 - (r - 1) / 3.0::DOUBLE) / row_number() OVER (PARTITION BY source_file ORDER BY r, k), 6) AS score FROM f WHERE k <= 5",
    "w17_page_cap": _N + " SELECT node_id, k AS n FROM (SELECT node_id, row_number() OVER (PARTITION BY source_file, page_num ORDER BY CASE WHEN node_type IN ('table', 'figure') THEN 0 ELSE 1 END, node_id)::INT AS k FROM n WHERE page_num IS NOT NULL) WHERE k <= 3",
    "c30_json": "SELECT event_id, (props->>'k')::BIGINT AS k FROM events",
    "s02_lines": _N + _LINES + " SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY top, x0, text) AS text, min(x0) AS x0, max(top) + 12 AS bottom FROM g GROUP BY ALL",
    # what ends a paragraph lies below all of it, so the lowest line so far is the lowest of the page so far
    "s03_paragraphs": _N + _LINES + """, ln AS (SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY top, x0, text) AS text, min(top) AS top, max(top) + 12 AS bottom FROM g GROUP BY ALL),
        pn AS (SELECT *, coalesce((top - max(bottom) OVER (PARTITION BY doc_id, page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 10)::INT, 0) AS fresh FROM ln),
        pp AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING)::INT AS paragraph FROM pn)
        SELECT doc_id, page, paragraph, string_agg(text, ' ' ORDER BY line) AS text, min(top) AS top, max(bottom) AS bottom, 11.0::DOUBLE AS size FROM pp GROUP BY ALL""",
}
