"""Retrieval lists and their merging, conversations, replies and their fields, roll-ups of evaluations, choice among samples, and rows changed in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import jsons as J
from quern.functions import text as T
from quern.operators import sampling as S
from quern.operators import scoring as R
from quern.operators.graph import edges_of, nodes_of
from quern.operators.nearest import nearest
from quern.operators.tasks import SAFETY_TYPES, alike_texts, distributions, uniform
from quern.operators import web as W
from quern.plans.runtime import stored, table
from quern.sources.documents import block_kind, lines_of
from quern.sources.sinks import instruction

#: Ids that a stand-in for a model cites, and an answer of such a stand-in (fixed values).
MOCK_CITATIONS = ["chunk_1", "chunk_2", "chunk_3", "chunk_4", "entity_1", "entity_2", "entity_3", "para_2"]
MOCK_ANSWERS = ("Based on the provided context, the system demonstrates advanced capabilities in knowledge representation and retrieval.",)
#: Where citations may stand in an answer, in order (fixed values).
CITATION_PATTERNS = [r"\[([^\]]+)\]", r"\(([^)]+)\)", r"node[_\s]+(\w+)", r"para[_\s]+(\w+)", r"table[_\s]+(\w+)", r'"([^"]*node[^"]*)"', r"'([^']*node[^']*)'"]
#: Numbered or dashed steps with a title, and words of sentences that reason (fixed values).
STEP_PATTERNS = [
    r"(?is)\d+\.\s*\*\*([^*]+)\*\*[:\s]*(.+?)(?=\n\d+\.|\n-|\n\*|$)", r"(?is)\d+\.\s*([^:\n]+)[:\s]*(.+?)(?=\n\d+\.|\n-|\n\*|$)",
    r"(?is)-\s*\*\*([^*]+)\*\*[:\s]*(.+?)(?=\n\d+\.|\n-|\n\*|$)", r"(?is)-\s*([^:\n]+)[:\s]*(.+?)(?=\n\d+\.|\n-|\n\*|$)",
]
REASONING_WORDS = ["analyze", "identify", "confirm", "check", "determine", "assess", "evaluate", "examine"]
#: What an answer's steps must reach on the whole, and errors that rule success out (fixed values).
THRESHOLDS = {"navigation": 0.8, "interaction": 0.8, "extraction": 0.8}
FATAL = ("navigation_error", "element_not_found", "timeout_error")
#: Elements of a document and the nodes they become; others become none (fixed values).
NODE_OF = {"paragraph": "paragraph", "heading": "heading", "table": "table", "figure": "figure", "list": "paragraph", "list_item": "paragraph"}


# ---- retrieval


def usable(c: Column) -> Column:
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(c, lambda v: v != 0), F.lit(False))


def queried_tasks(s: SparkSession, d: str) -> DataFrame:
    """The tasks whose number is divisible by 50: the stated set of queries for searches over all nodes."""
    return R.tasks_of(s, d).where(F.regexp_extract("task_id", "([0-9]{1,18})$", 1).cast("bigint") % 50 == 0)


def semantic_search(tasks: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """(task_id, node, score, rank): the k nodes most similar to the first gold node of a task that has a vector, itself among them."""
    v = stored(nodes.where(usable(F.col("embedding"))).select(F.col("node_id").alias("node"), "embedding"))
    gold = tasks.select("task_id", F.posexplode("gold_nodes").alias("pos", "node")).join(v.select("node"), "node")
    first = stored(gold.groupBy("task_id").agg(F.min_by("node", "pos").alias("query")))
    # tasks with the same first node ask once
    asked = stored(v.join(first.select(F.col("query").alias("node")).distinct(), "node", "left_semi"))
    found = first.join(nearest(asked, v, k), "query")
    return R.best(found.select("task_id", "node", F.round("cosine", 6).alias("score")), "task_id", k)


def merged(lists: list[DataFrame], k: int = 10) -> DataFrame:
    """(task_id, node, score, rank): each node with the best of its scores in several lists."""
    rows = reduce(DataFrame.unionByName, [x.select("task_id", "node", "score") for x in lists])
    return R.best(rows.groupBy("task_id", "node").agg(F.max("score").alias("score")), "task_id", k)


def hybrid(s: SparkSession, d: str) -> DataFrame:
    q = stored(queried_tasks(s, d))
    # a second search for the five nearest would find rows of the first only
    return merged([R.retrieved(s, d, tasks=q), semantic_search(q, nodes_of(s, d))])


def contextual(s: SparkSession, d: str, k: int = 10, history: int = 10, headings: int = 5) -> DataFrame:
    """(task_id, node, score, rank): the merged list, gold nodes of the tasks before it of the same template 0.6, and headings among the first that share a word with the prompt 0.5."""
    base = stored(hybrid(s, d))
    n = nodes_of(s, d)
    order = Window.partitionBy("template_id").orderBy("created_at", "task_id").rowsBetween(-history, -1)
    past = R.tasks_of(s, d).withColumn("past", F.flatten(F.collect_list(F.coalesce("gold_nodes", F.array().cast("array<string>"))).over(order)))
    q = queried_tasks(s, d)
    before = past.join(q.select("task_id"), "task_id", "left_semi").select("task_id", F.explode(F.array_distinct("past")).alias("node")).join(n.select(F.col("node_id").alias("node")), "node", "left_semi").withColumn("score", F.lit(0.6))
    first = n.where("node_type = 'heading'").orderBy("node_id").limit(headings).select(F.col("node_id").alias("node"), T.plain_tokens(F.col("content")).alias("w"))
    near = q.select("task_id", T.plain_tokens(F.col("prompt")).alias("p")).join(F.broadcast(first), F.arrays_overlap("p", "w")).select("task_id", "node", F.lit(0.5).alias("score"))
    # a later list adds only what those before it have not
    known = base.select("task_id", "node")
    before = before.join(known, ["task_id", "node"], "left_anti")
    near = near.join(known.unionByName(before.select("task_id", "node")), ["task_id", "node"], "left_anti")
    return R.best(base.select("task_id", "node", "score").unionByName(before.select("task_id", "node", "score")).unionByName(near), "task_id", k)


def retrieval_quality(s: SparkSession, d: str) -> DataFrame:
    """(task_id, relevance, coverage): the mean score of what was retrieved, and the share of the gold answer's key terms that stand in it; 0.8 where there is none."""
    t = R.tasks_of(s, d).select("task_id", F.array_distinct(T.key_terms(F.coalesce("gold_answer", F.lit("")))).alias("terms"))
    found = R.retrieved(s, d)
    mean = found.groupBy("task_id").agg(F.avg("score").alias("relevance"))
    said = t.select("task_id", F.explode("terms").alias("term")).join(found.select("task_id", F.lower("content").alias("content")), "task_id", "left")
    held = said.groupBy("task_id", "term").agg(F.coalesce(F.max(F.contains("content", F.col("term"))), F.lit(False)).alias("held")).groupBy("task_id").agg(F.avg(F.col("held").cast("double")).alias("coverage"))
    return t.select("task_id").join(mean, "task_id", "left").join(held, "task_id", "left").select("task_id", F.round(F.coalesce("relevance", F.lit(0.8)), 6).alias("relevance"), F.round(F.coalesce("coverage", F.lit(0.8)), 6).alias("coverage"))


# ---- replies


def cited_anywhere(c: Column, most: int = 5) -> Column:
    """The first citations a text makes, by pattern after pattern, each once."""
    found = F.concat(*[F.transform(F.regexp_extract_all(c, F.lit("(?i)" + p), F.lit(1)), lambda x: F.trim(x)) for p in CITATION_PATTERNS])
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, most)


def reasoning_steps(c: Column, most: int = 5) -> Column:
    """Steps with a title and what they say; where there are none, the longer sentences that reason."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    pairs = [F.zip_with(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.regexp_extract_all(c, F.lit(p), F.lit(2)), lambda a, b: F.concat(strip(a), F.lit(": "), strip(b))) for p in STEP_PATTERNS]
    listed = F.concat(*pairs)
    said = F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda x: (F.length(x) > 20) & T._any(F.lower(x), REASONING_WORDS))
    return F.slice(F.when(F.size(listed) > 0, listed).otherwise(said), 1, most)


def assessment(c: Column) -> Column:
    """What a reply says of quality, relevance and completeness; 0 for what it does not say or what cannot be read."""
    return F.struct(*[F.coalesce(F.try_to_number(F.get_json_object(J.braced(c), f"$.{n}"), F.lit("9.99")).cast("double"), F.lit(0.0)).alias(n) for n in ("answer_quality", "relevance", "completeness")])


def is_mock(answer: Column, citations: Column, answers: tuple[str, ...] = MOCK_ANSWERS) -> Column:
    known = F.trim(F.coalesce(answer, F.lit(""))).isin(*answers)
    return known | ((F.size(citations) > 0) & F.forall(citations, lambda x: x.isin(*MOCK_CITATIONS)))


def exchanges_before(rows: DataFrame, by: str, order: list[str], most: int = 3) -> DataFrame:
    """``rows`` with ``context``: the exchanges before each, as lines of user and assistant. ``rows``: prompt, answer."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-most, -1)
    line = F.concat(F.lit("User: "), F.coalesce("prompt", F.lit("")), F.lit("\nAssistant: "), F.coalesce("answer", F.lit("")))
    return rows.withColumn("context", F.array_join(F.collect_list(line).over(w), "\n"))


# ---- web steps


def web_steps(s: SparkSession, d: str) -> DataFrame:
    """(task, kind, want, got, ...): events as steps of their users; what was wanted and what came of it are made of the number in the event."""
    kind = F.when(F.col("event_type") == "view", "navigate").when(F.col("event_type").isin("click", "error"), "click").otherwise("extract")
    k = F.get_json_object("props", "$.k").cast("bigint")
    want = F.when(kind == "navigate", F.concat(F.lit("/page/"), k.cast("string"))).when(kind == "click", F.concat(F.lit("m"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("row "), (k % 4).cast("string"), F.lit(" of table")))
    got = F.when(kind == "navigate", F.concat(F.lit("https://a.org/page/"), F.when(k % 5 == 0, "x").otherwise(k.cast("string")))).when(kind == "click", F.concat(F.lit("M"), (k % 2).cast("string"))).otherwise("Row 1 of table")
    return table(s, d, "events").select("event_id", F.col("user_id").alias("task"), kind.alias("kind"), want.alias("want"), got.alias("got"), "value", (F.col("event_type") == "error").alias("failed")).withColumn("accuracy", S.step_accuracy(F.col("kind"), F.col("want"), F.col("got")))


def overall_success(s: SparkSession, d: str) -> DataFrame:
    """(task, navigation, interaction, extraction, success): whether every accuracy reaches its threshold and no step failed."""
    steps = web_steps(s, d)
    a = S.kind_accuracies(steps).join(steps.groupBy("task").agg(F.max("failed").alias("failed"), F.avg("value").alias("seconds")), "task")
    return a.withColumn("success", ~F.col("failed") & reduce(lambda x, y: x & y, [F.col(c) >= v for c, v in THRESHOLDS.items()]))


# ---- samples and texts that are alike


def kept_sets(samples: DataFrame, least: float = 0.7) -> DataFrame:
    """(sample): samples in order of their ids, but those whose nodes are more than ``least`` alike to one kept before. ``samples``: sample, node."""
    # each node as one word, so that alike samples are found by their rare nodes
    word = F.concat(F.lit("x"), F.hex(F.encode("node", "utf-8")))
    texts = samples.groupBy(F.col("sample").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(word)), " ").alias("text"))
    pairs = alike_texts(texts, least).where(F.col("likeness") > least)
    # a copy stands as near to the others as the least of its kind, which comes before it: it is never kept
    copies = pairs.where("likeness = 1").select(F.col("b").alias("id"))
    links = pairs.where("likeness < 1").select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("").alias("edge_id"), F.lit("alike").alias("edge_type"), F.lit(1.0).alias("weight"))
    gone = S.greedy_clusters(links).where("seed != node").select(F.col("node").alias("id")).unionByName(copies)
    return texts.join(gone, "id", "left_anti").select(F.col("id").alias("sample"))


def contradictions(nodes: DataFrame, least: float = 0.7, most: float = 0.9) -> DataFrame:
    """(node, partner): texts that say nearly, but not quite, the same: each with the first such partner after it."""
    rows = nodes.where("node_type = 'paragraph'").select(F.col("node_id").alias("id"), F.col("content").alias("text"))
    return alike_texts(rows, least).where(F.col("likeness") <= most).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("partner"))


def novelty(likeness: Column) -> Column:
    """By bands of the likeness to what is chosen already (fixed values)."""
    return F.when(likeness >= 0.8, 0.0).when(likeness >= 0.5, 0.3 * (1 - likeness)).otherwise(0.6 + 0.4 * (1 - likeness))


def _novelties(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("template_id").orderBy("created_at", "task_id")
    t = R.tasks_of(s, d).where("template_id is not null").withColumn("before", F.lag("prompt").over(order))
    like = T.jaccard(T.plain_tokens(F.col("prompt")), T.plain_tokens(F.col("before")))
    same = F.lower(F.trim("prompt")) == F.lower(F.trim("before"))
    return t.select("task_id", F.round(F.when(F.col("before").isNull(), 1.0).when(same, 0.0).otherwise(novelty(like)), 6).alias("novelty"))


# ---- roll-ups


def rollup(ev: DataFrame) -> DataFrame:
    """(metric, value): sums, means and ends over all evaluations, and means over some of them."""
    ok = F.coalesce("success", F.lit(False))
    share = lambda c, n: F.sum(F.when(c, F.col(n))) / F.greatest(F.lit(1), F.count_if(c & F.col(n).isNotNull()))
    one = ev.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.sum("tokens_used").alias("tokens"), F.avg("tokens_used").alias("mean_tokens"), F.max("tokens_used").alias("most_tokens"), F.min("tokens_used").alias("least_tokens"),
        F.avg("execution_time").alias("mean_seconds"), F.max("execution_time").alias("most_seconds"), share(ok, "f1_score").alias("f1_of_successful"), share(F.col("requires_citations"), "citation_f1").alias("citation_f1_where_needed"),
        share(F.col("task_type").isin(*SAFETY_TYPES), "safety").alias("safety_of_safety_tasks"),
    )
    return one.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in one.columns]).unpivot([], one.columns, "metric", "value").withColumn("value", F.round("value", 5))


def last_of_each(rows: DataFrame, by: str, order: list[Column], most: int = 5) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= most)


def split_by_count(rows: DataFrame, key: str, shares: dict[str, float], seed: str = "count") -> DataFrame:
    """``rows`` with ``part``: shares of their number, in an order drawn by hash. The places of the rows come from the sizes of ranges of the hash, so that no task sorts them all."""
    u = uniform(seed, F.col(key).cast("string"))
    ranged = rows.withColumn("u", u).withColumn("range", F.floor(F.col("u") * 4096).cast("int"))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))
    # 4096 ranges at most
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("size").over(Window.partitionBy(F.lit(1))))
    placed = ranged.join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("u", key)))
    part, upto, names = F.lit(list(shares)[-1]), 0.0, []
    for name, share in list(shares.items())[:-1]:
        upto += share
        names.append((name, upto))
    for name, bound in reversed(names):
        part = F.when(F.col("place") <= F.floor(F.col("total") * bound), name).otherwise(part)
    return placed.withColumn("part", part).select(*rows.columns, "part")


def _safety(s: SparkSession, d: str) -> DataFrame:
    return R.tasks_of(s, d).where(F.col("task_type").isin(*SAFETY_TYPES)).select("task_type", F.lower(F.trim("difficulty")).alias("difficulty"), F.col("passed_quality_check").cast("string").alias("passed"), "quality_score", "template_id")


def _touched(s: SparkSession, d: str) -> DataFrame:
    """One row: how much of the graph's kinds and of the templates the tasks reach."""
    t = R.tasks_of(s, d)
    gold = t.select(F.explode("gold_nodes").alias("node")).distinct()
    kinds = gold.join(nodes_of(s, d).select(F.col("node_id").alias("node"), "node_type"), "node").agg(F.countDistinct("node_type").alias("node_types"))
    links = edges_of(s, d).join(gold.withColumnRenamed("node", "source"), "source", "left_semi").agg(F.countDistinct("edge_type").alias("edge_types"))
    one = t.agg(F.countDistinct("template_id").alias("templates"), F.countDistinct(F.lower(F.trim("difficulty"))).alias("difficulties"))
    all_ = table(s, d, "text_task_templates").agg(F.countDistinct("template_id").alias("known"))
    both = kinds.crossJoin(links).crossJoin(one).crossJoin(all_)  # of one row each
    return both.select((F.col("node_types") / 6).alias("node_types"), (F.col("edge_types") / 7).alias("edge_types"), (F.col("templates") / F.col("known")).alias("templates"), "difficulties")


def _responses(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "no_rag_responses").join(R.tasks_of(s, d).select("task_id", "prompt"), "task_id", "left")


QUERIES = {
    "t05_semantic_search": lambda s, d: semantic_search(queried_tasks(s, d), nodes_of(s, d)).select("task_id", "node", "rank"),
    "j22_hybrid": lambda s, d: hybrid(s, d).select("task_id", "node", "score", "rank"),
    "t06_contextual": lambda s, d: contextual(s, d).select("task_id", "node", "score", "rank"),
    "m09_retrieval_quality": retrieval_quality,
    "f28_mock": lambda s, d: table(s, d, "no_rag_responses").select("row_id", is_mock(F.col("answer"), R.cited(F.col("answer"))).alias("mock")),
    "c32_cited_ids": lambda s, d: table(s, d, "no_rag_responses").where("answer is not null").select("row_id", F.array_join(cited_anywhere(F.col("answer")), "|").alias("cited")),
    "c33_reasoning_steps": lambda s, d: table(s, d, "no_rag_responses").where("answer is not null").select("row_id", F.array_join(reasoning_steps(F.col("answer")), "|").alias("steps")),
    "c34_assessments": lambda s, d: table(s, d, "events").select("event_id", assessment(F.concat(F.lit("My view:\n"), F.replace("props", F.lit('"k": '), F.lit('"relevance": 0.')), F.lit(" as said"))).alias("a")).select("event_id", "a.*"),
    "c21_feature_text": lambda s, d: R.tasks_of(s, d).join(table(s, d, "text_task_templates").select("template_id", "description"), "template_id", "left").select("task_id", F.concat_ws(" ", "prompt", "description", F.array_join("gold_nodes", " ")).alias("text")),
    "c36_json": lambda s, d: nodes_of(s, d).where("bbox is not null").select("node_id", F.to_json(F.struct("node_type", "page_num", "level")).alias("json")),
    "c37_set_likeness": lambda s, d: R.evaluations(s, d).select("row_id", F.round(F.when((F.coalesce(F.array_size("gold_nodes"), F.lit(0)) == 0) | (F.size(R.cited(F.col("answer"))) == 0), 0.0).otherwise(T.jaccard(F.array_distinct("gold_nodes"), R.cited(F.col("answer")))), 6).alias("likeness")),
    "x03_types_within": lambda s, d: table(s, d, "text_task_templates").select("template_id", (F.size(F.array_except(F.coalesce("required_node_types", F.array().cast("array<string>")), F.array(F.lit("paragraph"), F.lit("table")))) == 0).alias("within")),
    "x04_uncited_gold": lambda s, d: (lambda e: e.select("row_id", F.explode("gold_nodes").alias("node")).join(e.select("row_id", F.explode(R.cited(F.col("answer"))).alias("node")), ["row_id", "node"], "left_anti").distinct())(R.evaluations(s, d)),
    "w19_context": lambda s, d: exchanges_before(_responses(s, d), "model_used", ["responded_at", "row_id"]).select("row_id", "context"),
    "m06_step_accuracy": lambda s, d: web_steps(s, d).select("event_id", F.round("accuracy", 6).alias("accuracy")),
    "m07_accuracies": lambda s, d: S.kind_accuracies(web_steps(s, d)).select("task", *[F.round(c, 6).alias(c) for c in THRESHOLDS]),
    "f33_success": lambda s, d: overall_success(s, d).select("task", "success"),
    "a13_web_report": lambda s, d: overall_success(s, d).agg(F.count("*").alias("total"), F.count_if("success").alias("successful"), *[F.round(F.avg(c), 6).alias(c) for c in THRESHOLDS], F.round(F.avg("seconds"), 6).alias("seconds")),
    "a15_last_results": lambda s, d: last_of_each(table(s, d, "no_rag_responses"), "model_used", [F.desc_nulls_last("responded_at"), F.col("row_id")]).select("row_id", "model_used", "n"),
    "a17_safety_report": lambda s, d: distributions(_safety(s, d), "task_type", "difficulty", "passed", "template_id").withColumn("share", F.round("share", 6)),
    "a17_safety_scores": lambda s, d: _safety(s, d).agg(F.avg("quality_score").alias("mean"), F.min("quality_score").alias("least"), F.max("quality_score").alias("most"), F.count_if(F.col("passed") == "true").alias("passed")),
    "a19_rollup": lambda s, d: rollup(R.evaluations(s, d)),
    "a11_reach": _touched,
    "a25_patterns": lambda s, d: R.attributed(R.hybrid_attribution(s, d).withColumn("score", F.round("score", 6))).join(R.judged(s, d).select("row_id", R.failure_types()["centrality"].alias("failure")), "row_id").groupBy("failure").agg(F.count("*").alias("n"), F.round(F.avg("nodes"), 5).alias("nodes")),
    "a29_reminders": lambda s, d: table(s, d, "tasks").distinct().select(uniform("remind", F.col("task_id")).alias("u"), "prompt").agg(F.count("*").alias("total"), F.count_if(F.col("u") < 0.3).alias("reminded"), F.count_if(F.col("u") < 0.1).alias("before")),
    "a05_kept_sets": lambda s, d: kept_sets(S._samples(s, d)[0]),
    "j21_contradictions": lambda s, d: contradictions(nodes_of(s, d)),
    "m17_novelty": _novelties,
    "x07_split_by_count": lambda s, d: split_by_count(table(s, d, "training_samples").select("row_id"), "row_id", {"train": 0.70, "validation": 0.15, "test": 0.15}),
    "x08_holdout": lambda s, d: split_by_count(table(s, d, "training_samples").select("row_id"), "row_id", {"kept": 0.8, "held_out": 0.2}, "holdout"),
    "u03_delete_edges": lambda s, d: edges_of(s, d).join(edges_of(s, d).where("edge_type = 'contains'").select("edge_id"), "edge_id", "left_anti").select("edge_id", "edge_type"),
    "u05_update": lambda s, d: edges_of(s, d).select("edge_id", F.when(F.col("weight").isNull(), 0.5).otherwise(F.col("weight")).alias("weight")),
    "u05_insert_ignore": lambda s, d: (lambda old, new: old.unionByName(new.join(old.select("id"), "id", "left_anti")))(table(s, d, "entity_nodes").select(F.col("canonical_name").alias("id")).where("id is not null").distinct(), table(s, d, "entity_nodes").select(F.col("entity_type").alias("id")).where("id is not null").distinct()),
    "u06_index_add": lambda s, d: nodes_of(s, d).where(usable(F.col("embedding")) & (F.size("embedding") == 64)).join(table(s, d, "tasks").select(F.explode("gold_nodes").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id"),
    "c02_without_addresses": lambda s, d: table(s, d, "documents").where("doc_id is not null and text is not null").select("doc_id", F.regexp_replace(F.regexp_replace("text", T.URL, ""), T.EMAIL, "").alias("text")),
    "c35_reply_parts": lambda s, d: table(s, d, "events").select("event_id", _made_reply().alias("r")).select("event_id", J.thinking(F.col("r")).alias("thought"), J.without_thinking(F.col("r")).alias("said"), F.array_join(J.code_blocks(F.col("r")), "|").alias("code")),
    "p13_kinds": lambda s, d: table(s, d, "events").groupBy(W.canonical_kind(F.element_at(F.array(*[F.lit(f" {k.upper()}") for k in _RAW]), (F.col("event_id") % len(_RAW) + 1).cast("int"))).alias("kind")).agg(F.count("*").alias("n")),
    "s05_block_kinds": lambda s, d: lines_of(S.words_of(nodes_of(s, d))).select("doc_id", "page", "line", block_kind(F.col("text"), F.col("size")).alias("kind")),
    "k03_instruction_rows": lambda s, d: instruction(table(s, d, "training_samples").where("row_id is not null")).select(F.get_json_object("value", "$.instruction").alias("instruction"), F.get_json_object("value", "$.output").alias("output")),
    "j23_joined": lambda s, d: R.evaluations(s, d).join(R.tasks_of(s, d).select("task_id", F.col("template_id")), "task_id").select("row_id", "task_id", "template_id", "task_type", F.round("f1_score", 6).alias("f1_score")),
    "p04_nodes_of_elements": lambda s, d: (lambda e: e.select("doc_id", "pos", F.element_at(F.create_map(*[F.lit(x) for kv in NODE_OF.items() for x in kv]), F.col("kind")).alias("node_type")).where("node_type is not null"))(_document_elements(s, d)),
}


_RAW = [*W.KIND_NAMES, "link", "other"]


def _made_reply() -> Column:
    k = F.get_json_object("props", "$.k")
    return F.concat(F.lit("<thinking>\n so "), k, F.lit(" </thinking>\nThen run\n```python\nprint("), k, F.lit(")\n```\nand\n```\nx\n```"))


def _document_elements(s: SparkSession, d: str) -> DataFrame:
    from quern.operators.elements import _elements

    return _elements(s, d)


_TV = ", v AS (SELECT node_id AS node, embedding::DOUBLE[] AS v FROM n WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
_QT = """, qt AS (SELECT * FROM t WHERE regexp_extract(task_id, '([0-9]{1,18})$', 1)::BIGINT % 50 = 0),
qv AS (SELECT task_id, arg_min(v, pos) AS q FROM (SELECT task_id, unnest(gold_nodes) AS node, unnest(range(len(gold_nodes))) AS pos FROM qt) JOIN v USING (node) GROUP BY task_id),
se AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, node)::INT AS rank FROM (SELECT task_id, node, round(list_cosine_similarity(v, q), 6) AS score FROM qv JOIN v ON len(v) = len(q))),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, node)::INT AS rank FROM (SELECT task_id, node, max(score) AS score FROM (SELECT task_id, node, score FROM top SEMI JOIN qt USING (task_id) UNION ALL SELECT task_id, node, score FROM se WHERE rank <= 10) GROUP BY ALL)) WHERE rank <= 10)"""
_CO = f""", pa AS (SELECT task_id, list_distinct(flatten(list(coalesce(gold_nodes, [])) OVER (PARTITION BY template_id ORDER BY created_at NULLS FIRST, task_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))) AS past FROM t),
hb AS (SELECT task_id, node FROM (SELECT task_id, unnest(past) AS node FROM pa SEMI JOIN qt USING (task_id)) SEMI JOIN n ON n.node_id = node ANTI JOIN hy USING (task_id, node)),
hd AS (SELECT node_id AS node, {R._PLAIN.format("content")} AS w FROM n WHERE node_type = 'heading' ORDER BY node_id LIMIT 5),
nr AS (SELECT task_id, node FROM (SELECT task_id, {R._PLAIN.format("prompt")} AS p FROM qt) JOIN hd ON list_has_any(p, w)),
cx AS (SELECT task_id, node, score FROM hy UNION ALL SELECT task_id, node, 0.6 FROM hb UNION ALL SELECT task_id, node, 0.5 FROM nr ANTI JOIN hy USING (task_id, node) ANTI JOIN hb USING (task_id, node))"""


def _all_cited(c: str) -> str:
    parts = ["regexp_extract_all({}, '{}', 1, 'i')".format(c, p.replace("'", "''")) for p in CITATION_PATTERNS]
    return reduce(lambda a, b: f"list_concat({a}, {b})", parts)


_K = "(props->>'k')::BIGINT"
_ST = f"""WITH w AS (SELECT event_id, user_id AS task, value, event_type = 'error' AS failed, CASE WHEN event_type = 'view' THEN 'navigate' WHEN event_type IN ('click', 'error') THEN 'click' ELSE 'extract' END AS kind, {_K} AS k FROM events),
st AS (SELECT *, CASE kind WHEN 'navigate' THEN (k % 5 <> 0)::INT::DOUBLE WHEN 'click' THEN (k % 3 = k % 2)::INT::DOUBLE ELSE CASE WHEN k % 4 = 1 THEN 1.0 ELSE 0.75 END END AS accuracy FROM w),
ac AS (SELECT task, coalesce(avg(accuracy) FILTER (WHERE kind = 'navigate'), 1.0) AS navigation, coalesce(avg(accuracy) FILTER (WHERE kind = 'click'), 1.0) AS interaction, coalesce(avg(accuracy) FILTER (WHERE kind = 'extract'), 1.0) AS extraction, bool_or(failed) AS failed, avg(value) AS seconds FROM st GROUP BY task),
su AS (SELECT *, NOT failed AND navigation >= 0.8 AND interaction >= 0.8 AND extraction >= 0.8 AS success FROM ac)"""
_T = "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC) AS rn FROM tasks) WHERE rn = 1)"
_SAFE = _T + f", sf AS (SELECT task_type, lower(trim(difficulty, ' ')) AS difficulty, passed_quality_check::VARCHAR AS passed, quality_score, template_id FROM t WHERE task_type IN {SAFETY_TYPES})"
_NODES = "WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM nodes) WHERE rn = 1 AND deleted_at IS NULL)"
_EDGES = f"WITH e AS (SELECT edge_id, edge_type, source, target, weight FROM (SELECT *, {R._K.format('source_node_id')} AS source, {R._K.format('target_node_id')} AS target, row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC) AS rn FROM edges) WHERE rn = 1 AND source <> '' AND target <> '')"
_UNI = lambda seed, c: f"('0x' || substr(md5('{seed}|' || {c}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_BYCOUNT = lambda seed, cases: f"SELECT row_id, CASE {cases} END AS part FROM (SELECT row_id, row_number() OVER (ORDER BY u, row_id) AS k, count(*) OVER () AS n FROM (SELECT row_id, {_UNI(seed, 'row_id')} AS u FROM training_samples))"
_MEAN = lambda c, v: f"coalesce(sum(CASE WHEN {c} THEN {v} END), 0) / greatest(1, count(*) FILTER (WHERE {c} AND {v} IS NOT NULL))"
_ROLL = {
    "total": "count(*)", "successful": "count(*) FILTER (WHERE success)", "tokens": "sum(tokens_used)", "mean_tokens": "avg(tokens_used)", "most_tokens": "max(tokens_used)", "least_tokens": "min(tokens_used)", "mean_seconds": "avg(execution_time)", "most_seconds": "max(execution_time)",
    "f1_of_successful": _MEAN("success", "f1_score"), "citation_f1_where_needed": _MEAN("requires_citations", "citation_f1"), "safety_of_safety_tasks": _MEAN(f"task_type IN {SAFETY_TYPES}", "safety"),
}
_EL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS content FROM l)
    SELECT doc_id, pos, CASE WHEN regexp_matches(content, '^#{1,6} ') THEN 'heading' WHEN content LIKE '|%' THEN 'table' ELSE 'paragraph' END AS node_type FROM s WHERE content <> ''"""

SQL = {
    "t05_semantic_search": R._EV + R._REL + _TV + _QT + " SELECT task_id, node, rank FROM se WHERE rank <= 10",
    "j22_hybrid": R._EV + R._REL + _TV + _QT + " SELECT * FROM hy",
    "t06_contextual": R._EV + R._REL + _TV + _QT + _CO + " SELECT task_id, node, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, node)::INT AS rank FROM cx) WHERE rank <= 10",
    "m09_retrieval_quality": R._EV + R._REL + r""", tm AS (SELECT task_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(coalesce(gold_answer, '')), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3))) AS term FROM t),
        hl AS (SELECT task_id, term, coalesce(bool_or(contains(lower(content), term)), FALSE) AS held FROM tm LEFT JOIN top USING (task_id) GROUP BY ALL)
        SELECT task_id, round(coalesce(relevance, 0.8), 6) AS relevance, round(coalesce(coverage, 0.8), 6) AS coverage FROM t LEFT JOIN (SELECT task_id, avg(score) AS relevance FROM top GROUP BY task_id) USING (task_id) LEFT JOIN (SELECT task_id, avg(held::INT) AS coverage FROM hl GROUP BY task_id) USING (task_id)""",
    "f28_mock": R._EV + f" SELECT row_id, trim(coalesce(answer, '')) IN ('{MOCK_ANSWERS[0]}') OR (len(ci) > 0 AND len(list_filter(ci, lambda x: x NOT IN {tuple(MOCK_CITATIONS)})) = 0) AS mock FROM ev",
    "c32_cited_ids": f"""WITH m AS (SELECT row_id, list_filter(list_transform({_all_cited("answer")}, lambda x: trim(x)), lambda x: x <> '') AS c FROM no_rag_responses WHERE answer IS NOT NULL), u AS (SELECT row_id, x, min(k) AS k FROM (SELECT row_id, unnest(c) AS x, unnest(range(len(c))) AS k FROM m) GROUP BY ALL),
        w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY k) AS n FROM u) SELECT m.row_id, coalesce(string_agg(x, '|' ORDER BY k), '') AS cited FROM m LEFT JOIN w ON w.row_id = m.row_id AND n <= 5 GROUP BY m.row_id""",
    "c34_assessments": "SELECT event_id, 0.0::DOUBLE AS answer_quality, ('0.' || (props->>'k'))::DOUBLE AS relevance, 0.0::DOUBLE AS completeness FROM events",
    "c21_feature_text": _T + " SELECT task_id, concat_ws(' ', prompt, description, array_to_string(gold_nodes, ' ')) AS text FROM t LEFT JOIN text_task_templates p USING (template_id)",
    "c36_json": _NODES + """ SELECT node_id, '{' || concat_ws(',', '"node_type":"' || node_type || '"', '"page_num":' || page_num, '"level":' || level) || '}' AS json FROM n WHERE bbox IS NOT NULL""",
    "c37_set_likeness": R._EV + " SELECT row_id, round(CASE WHEN len(gn) = 0 OR len(ci) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(gn), ci)) / (len(list_distinct(gn)) + len(ci) - len(list_intersect(list_distinct(gn), ci)))::DOUBLE END, 6) AS likeness FROM ev",
    "x03_types_within": "SELECT template_id, len(list_filter(coalesce(required_node_types, []), lambda x: x NOT IN ('paragraph', 'table'))) = 0 AS within FROM text_task_templates",
    "x04_uncited_gold": R._EV + " SELECT DISTINCT row_id, node FROM (SELECT row_id, unnest(gn) AS node, ci FROM ev) WHERE node IS NOT NULL AND NOT list_contains(ci, node)",
    "w19_context": R._EV + " SELECT row_id, coalesce(string_agg('User: ' || coalesce(prompt, '') || chr(10) || 'Assistant: ' || coalesce(answer, ''), chr(10)) OVER (PARTITION BY model_used ORDER BY responded_at NULLS FIRST, row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM ev",
    "m06_step_accuracy": _ST + " SELECT event_id, round(accuracy, 6) AS accuracy FROM st",
    "m07_accuracies": _ST + " SELECT task, round(navigation, 6) AS navigation, round(interaction, 6) AS interaction, round(extraction, 6) AS extraction FROM ac",
    "f33_success": _ST + " SELECT task, success FROM su",
    "a13_web_report": _ST + " SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful, round(avg(navigation), 6) AS navigation, round(avg(interaction), 6) AS interaction, round(avg(extraction), 6) AS extraction, round(avg(seconds), 6) AS seconds FROM su",
    "a15_last_results": "SELECT row_id, model_used, n FROM (SELECT row_id, model_used, row_number() OVER (PARTITION BY model_used ORDER BY responded_at DESC NULLS LAST, row_id)::INT AS n FROM no_rag_responses) WHERE n <= 5",
    "a17_safety_report": _SAFE + ", a AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM sf GROUP BY ALL" for c in ("task_type", "difficulty", "passed", "template_id")) + " UNION ALL SELECT 'all', NULL, count(*) FROM sf) SELECT *, round(n / (SELECT count(*) FROM sf)::DOUBLE, 6) AS share FROM a",
    "a17_safety_scores": _SAFE + " SELECT avg(quality_score) AS mean, min(quality_score) AS least, max(quality_score) AS most, count(*) FILTER (WHERE passed = 'true') AS passed FROM sf",
    "a19_rollup": R._EV + " " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round(coalesce(({v})::DOUBLE, 0.0), 5) AS value FROM ev" for k, v in _ROLL.items()),
    "a11_reach": R._EV + R._N + R._I + """, gd AS (SELECT DISTINCT node FROM (SELECT unnest(gold_nodes) AS node FROM t)) SELECT (SELECT count(DISTINCT node_type) FROM n JOIN gd ON gd.node = n.node_id) / 6.0::DOUBLE AS node_types, (SELECT count(DISTINCT edge_type) FROM e JOIN gd ON gd.node = e.source) / 7.0::DOUBLE AS edge_types,
        (SELECT count(DISTINCT template_id) FROM t) / (SELECT count(DISTINCT template_id) FROM text_task_templates)::DOUBLE AS templates, (SELECT count(DISTINCT lower(trim(difficulty, ' '))) FROM t) AS difficulties""",
    "a25_patterns": R._EV + R._INV + f", b AS (SELECT row_id, count(*) AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, node) AS rank FROM m14) WHERE rank <= 5 AND score >= 0.2 GROUP BY row_id) SELECT {R._FAIL['centrality']} AS failure, count(*) AS n, round(avg(nodes), 5) AS nodes FROM b JOIN jd USING (row_id) GROUP BY ALL",
    "a29_reminders": f"WITH z AS (SELECT {_UNI('remind', 'task_id')} AS u FROM (SELECT DISTINCT * FROM tasks)) SELECT count(*) AS total, count(*) FILTER (WHERE u < 0.3) AS reminded, count(*) FILTER (WHERE u < 0.1) AS before FROM z",
    "j21_contradictions": _NODES + r""", s AS (SELECT node_id AS id, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS w FROM n WHERE node_type = 'paragraph' AND content IS NOT NULL), u AS (SELECT id, unnest(w) AS x, len(w) AS k FROM s),
        p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, a.k + b.k AS k FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.k, b.k) SELECT a AS node, min(b) AS partner FROM p WHERE c / (k - c)::DOUBLE BETWEEN 0.7 AND 0.9 GROUP BY a""",
    "m17_novelty": _T + f", b AS (SELECT task_id, prompt, lag(prompt) OVER (PARTITION BY template_id ORDER BY created_at NULLS FIRST, task_id) AS before FROM t WHERE template_id IS NOT NULL), k AS (SELECT *, {R._PLAIN.format('prompt')} AS p, {R._PLAIN.format('before')} AS q FROM b), j AS (SELECT *, {R._jac('p', 'q')} AS s FROM k) SELECT task_id, round(CASE WHEN before IS NULL THEN 1.0 WHEN lower(trim(prompt, ' ')) = lower(trim(before, ' ')) THEN 0.0 WHEN s >= 0.8 THEN 0.0 WHEN s >= 0.5 THEN 0.3 * (1 - s) ELSE 0.6 + 0.4 * (1 - s) END, 6) AS novelty FROM j",
    "x07_split_by_count": _BYCOUNT("count", "WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test'"),
    "x08_holdout": _BYCOUNT("holdout", "WHEN k <= floor(n * 0.8::DOUBLE) THEN 'kept' ELSE 'held_out'"),
    "u03_delete_edges": _EDGES + " SELECT edge_id, edge_type FROM e WHERE edge_type <> 'contains'",
    "u05_update": _EDGES + " SELECT edge_id, coalesce(weight, 0.5) AS weight FROM e",
    "u05_insert_ignore": "SELECT canonical_name AS id FROM entity_nodes WHERE canonical_name IS NOT NULL UNION SELECT entity_type FROM entity_nodes WHERE entity_type IS NOT NULL",
    "u06_index_add": _NODES + _TV + " SELECT node AS node_id FROM v WHERE len(v) = 64 AND node NOT IN (SELECT node FROM (SELECT unnest(gold_nodes) AS node FROM tasks) WHERE node IS NOT NULL)",
    "c02_without_addresses": f"SELECT doc_id, regexp_replace(regexp_replace(text, '{T.URL}', '', 'g'), '{T.EMAIL}', '', 'g') AS text FROM documents WHERE text IS NOT NULL",
    "c35_reply_parts": f"SELECT event_id, 'so ' || {_K} AS thought, 'Then run' || chr(10) || '```python' || chr(10) || 'print(' || {_K} || ')' || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' AS said, 'print(' || {_K} || ')' || chr(10) || '|x' || chr(10) AS code FROM events",
    "p13_kinds": f"SELECT coalesce(map_extract(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in W.KIND_NAMES.items())}}}, r)[1], r) AS kind, count(*) AS n FROM (SELECT {_RAW!r}[event_id % {len(_RAW)} + 1] AS r FROM events) GROUP BY ALL",
    "s05_block_kinds": S._N + S._LINES + """, ln AS (SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY top, x0, text) AS text FROM g GROUP BY ALL) SELECT doc_id, page, line,
        CASE WHEN regexp_matches(text, '^[0-9]+(?:\\.[0-9]+)*\\.? [A-Z]') OR (regexp_matches(text, '^[A-Z][A-Z0-9 ,:&-]{3,}$') AND length(text) < 100) THEN 'heading' WHEN regexp_matches(text, '^\\s*(?:[-•*]|[0-9]+[.)]) ') THEN 'list_item' ELSE 'paragraph' END AS kind FROM ln""",
    "k03_instruction_rows": "SELECT prompt AS instruction, target_answer AS output FROM training_samples",
    "j23_joined": R._EV + " SELECT row_id, ev.task_id, t.template_id, ev.task_type, round(f1_score, 6) AS f1_score FROM ev JOIN t ON t.task_id = ev.task_id",
    "p04_nodes_of_elements": _EL,
}
