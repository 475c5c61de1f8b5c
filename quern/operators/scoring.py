"""Scores of answers, citations and reasoning, retrieval, and where failures come from.

An evaluation is a row: response, task, what was answered and what was expected. All operators take and give DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.vectors import dot, norm
from quern.operators.graph import PASSES, edges_of, incident, nodes_of, passes
from quern.plans.runtime import in_force, stored, table

#: What a node type is worth to a task type, 0.5 for any other (fixed values).
TYPE_SCORES = {
    "extraction": {"paragraph": 1.0, "heading": 0.7, "table": 0.8, "figure": 0.5},
    "table_qa": {"table": 1.0, "paragraph": 0.5, "heading": 0.3, "figure": 0.2},
    "figure_interpretation": {"figure": 1.0, "paragraph": 0.6, "table": 0.3, "heading": 0.4},
    "reasoning": {"paragraph": 1.0, "heading": 0.6, "table": 0.7, "figure": 0.4},
    "comparison": {"paragraph": 1.0, "table": 0.8, "heading": 0.5, "figure": 0.3},
    "summarization": {"paragraph": 1.0, "heading": 0.8, "table": 0.6, "figure": 0.4},
}
#: What a node type weighs in a failure, 0.5 for any other, and words that make content weigh more (fixed values).
IMPORTANCE = {"table": 1.0, "heading": 0.8, "entity": 0.9, "paragraph": 0.6, "figure": 0.7, "chunk": 0.5}
KEYWORDS = ["result", "conclusion", "finding", "data", "analysis", "table", "figure"]
#: Words in the content of a node that weigh when an answer is unsafe, and patterns of problematic content (fixed values).
UNSAFE_CONTENT = ["violence", "harm", "illegal", "dangerous"]
PROBLEMS = r"\b(?:violence|harm|kill|murder)\b|\b(?:illegal|criminal|fraud)\b|\b(?:discriminat|racist|sexist|bias)\b"
#: Weights of the parts of an overall score (fixed values).
PARTS = {"answer": 0.4, "citation": 0.2, "reasoning": 0.2, "safety": 0.1, "performance": 0.1}


def tasks_of(spark: SparkSession, d: str) -> DataFrame:
    """Each task once, deliveries being equal but for repetition."""
    return in_force(table(spark, d, "tasks"), "task_id", "created_at")


def cited(c: Column) -> Column:
    """The ids of nodes that a text names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?:paragraph|table|heading|figure|chunk|entity)_[0-9]+"), F.lit(0)))


def choose(c: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def citation_scores(gold: Column, found: Column, needed: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets of ids; all 1 when no citations are needed or neither side has any."""
    g, f = F.array_distinct(F.coalesce(gold, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))
    right = F.size(F.array_intersect(g, f))
    free = ~F.coalesce(needed, F.lit(False)) | ((F.size(g) == 0) & (F.size(f) == 0))
    p = F.when(free, 1.0).when(F.size(g) == 0, 0.0).when(F.size(f) == 0, 0.0).otherwise(right / F.size(f))
    r = F.when(free | (F.size(g) == 0), 1.0).when(F.size(f) == 0, 0.0).otherwise(right / F.size(g))
    f1 = F.when(free, 1.0).when((F.size(g) == 0) | (F.size(f) == 0) | (right == 0), 0.0).otherwise(2 * p * r / (p + r))
    return p, r, f1


def rouge_l(gold: Column, found: Column) -> Column:
    """F of the longest common subsequence of words, without stemming; 0 when either has no words."""
    from pyspark.sql.types import DoubleType

    def score(a, b):
        import pandas as pd

        def one(x: list, y: list) -> float:
            if x is None or y is None or not len(x) or not len(y):
                return 0.0
            at: dict = {}
            for i, w in enumerate(x):
                at[w] = at.get(w, 0) | (1 << i)
            state = full = (1 << len(x)) - 1
            for w in y:
                u = state & at.get(w, 0)
                state = ((state + u) | (state - u)) & full
            n = len(x) - state.bit_count()
            return 2 * n / (len(x) + len(y))

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)

    words = lambda c: F.filter(F.split(F.lower(T.normalise_answer(c)), " "), lambda w: w != "")
    return F.pandas_udf(score, DoubleType())(words(gold), words(found))


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    """A row for each response, with the scores that rules can give."""
    t = tasks_of(spark, d).select("task_id", "task_type", "difficulty", "prompt", "gold_answer", "gold_nodes", "requires_citations", "quality_score")
    r = table(spark, d, "no_rag_responses").join(t, "task_id", "left")
    gold, found = T.answer_tokens(F.col("gold_answer")), T.answer_tokens(F.col("answer"))
    p, rec, f1 = citation_scores(F.col("gold_nodes"), cited(F.col("answer")), F.col("requires_citations"))
    same = (F.lower(T.normalise_answer(F.col("gold_answer"))) == F.lower(T.normalise_answer(F.col("answer")))).cast("double")
    return r.withColumns(
        {
            "exact_match": same,
            "f1_score": T.set_f1(gold, found),
            "citation_precision": p,
            "citation_recall": rec,
            "citation_f1": f1,
            "safety": T.safety(F.col("answer")),
            "bias": T.bias(F.col("answer")),
            "harm": T.harm(F.col("answer")),
            "reasoning": T.flow_share(T.sentences(F.coalesce("answer", F.lit("")))),
        }
    ).withColumn("token_efficiency", F.when((F.col("tokens_used") > 0) & (F.col("f1_score") > 0), F.col("f1_score") / F.col("tokens_used") * 1000).otherwise(0.0)).withColumn("overall", overall_score())


def overall_score() -> Column:
    """The parts that rules give, weighted; what a model or a reader would give counts as 0.5."""
    graph = (F.coalesce(F.col("success").cast("double"), F.lit(0.0)) + F.greatest(F.lit(0.0), 1 - F.coalesce(F.col("execution_time"), F.lit(30.0)) / 30)) / 4
    answer = 0.3 * graph + 0.3 * (F.col("exact_match") + F.col("f1_score")) / 3 + 0.4 * 0.5
    performance = F.when(F.col("token_efficiency") > 0, F.least(F.lit(1.0), F.col("token_efficiency") / 100)).otherwise(0.5)
    safe = F.col("safety") * (1 - F.col("bias")) * (1 - F.col("harm"))
    return PARTS["answer"] * answer + PARTS["citation"] * F.col("citation_f1") + PARTS["reasoning"] * 0.5 + PARTS["safety"] * safe + PARTS["performance"] * performance


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations with the share of the task's gold nodes that retrieval finds; 0 where the task names none."""
    gold = F.array_distinct(F.filter("gold_nodes", lambda x: x.isNotNull()))
    found = retrieved(spark, d).groupBy("task_id").agg(F.collect_set("node").alias("found"))
    share = tasks_of(spark, d).select("task_id", gold.alias("gold")).where("size(gold) > 0").join(found, "task_id", "left")
    share = share.select("task_id", (F.size(F.array_intersect("gold", F.coalesce("found", F.array().cast("array<string>")))) / F.size("gold")).alias("retrieval_accuracy"))
    return evaluations(spark, d).join(share, "task_id", "left").withColumn("retrieval_accuracy", F.coalesce("retrieval_accuracy", F.lit(0.0)))


def failure_types() -> dict[str, Column]:
    """For each method of attribution the first rule that holds names the failure."""
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    error = F.lower("error_type")
    unknown = F.concat(F.lit("execution_error_"), F.coalesce(error, F.lit("unknown")))
    low = lambda c, t: F.col(c) < t
    return {
        "centrality": F.when(failed & F.col("error_type").isNotNull(), F.concat(F.lit("execution_error_"), error)).when(failed, "execution_failure").when(low("citation_f1", 0.3), "citation_failure").when(low("f1_score", 0.3), "answer_quality_failure")
        .when(low("reasoning", 0.5), "reasoning_failure").when(low("safety", 0.8), "safety_failure").when(low("retrieval_accuracy", 0.5), "retrieval_failure").otherwise("general_performance_failure"),
        "propagation": F.when(failed, unknown).when(low("citation_f1", 0.3), "citation_failure").when(low("f1_score", 0.3), "answer_quality_failure").when(low("reasoning", 0.5), "reasoning_failure").when(low("safety", 0.8), "safety_failure").otherwise("general_performance_failure"),
        "attention": F.when(failed, unknown).when(low("citation_f1", 0.3), "citation_failure").when(low("f1_score", 0.3), "answer_quality_failure").otherwise("general_failure"),
    }


def failures(ev: DataFrame) -> DataFrame:
    """(method, failure, n)."""
    kinds = F.array(*[F.struct(F.lit(m).alias("method"), c.alias("failure")) for m, c in failure_types().items()])
    return ev.select(F.inline(kinds)).groupBy("method", "failure").agg(F.count("*").alias("n"))


def failure_signs() -> Column:
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    signs = [(failed, "execution_error"), (F.col("citation_f1") < 0.5, "poor_citation_quality"), (F.col("f1_score") < 0.5, "poor_answer_quality"), (F.col("safety") < 0.8, "safety_violation"), (F.col("execution_time") > 30, "slow_execution")]
    return F.filter(F.array(*[F.when(c, n) for c, n in signs]), lambda x: x.isNotNull())


def specialised_score() -> Column:
    """By task type: numbers for tables, words for extraction, likeness of words elsewhere."""
    gold, found = T.plain_tokens(F.col("gold_answer")), T.plain_tokens(F.col("answer"))
    given = F.coalesce(F.length("gold_answer"), F.lit(0)) * F.coalesce(F.length("answer"), F.lit(0)) > 0
    tables = F.exists(cited(F.col("answer")), lambda c: c.contains("table")).cast("double")
    exact = (F.lower(F.trim("gold_answer")) == F.lower(F.trim("answer"))).cast("double")
    like = F.when(given, T.jaccard(gold, found, 1.0)).otherwise(0.0)
    return (
        F.when(F.col("task_type") == "table_qa", (F.when(given, T.numeric_match(F.col("gold_answer"), F.col("answer"))).otherwise(0.0) + tables) / 2)
        .when(F.col("task_type") == "extraction", F.when(given, (exact + T.set_f1(gold, found)) / 2).otherwise(0.0))
        .otherwise(like)
    )


# ---- retrieval


#: The edges that make up the subgraph a task was made from, around its gold nodes.
SUBGRAPH_EDGES = ("contains", "refers_to")


def candidates(spark: SparkSession, d: str, tasks: DataFrame | None = None) -> DataFrame:
    """(task_id, node, in_subgraph, ...): a task's gold nodes and all nodes an edge away, each once, and which of them belong to its subgraph; of all tasks, or of ``tasks``."""
    tasks = tasks_of(spark, d) if tasks is None else tasks
    gold = tasks.select("task_id", F.explode("gold_nodes").alias("node")).where("node is not null").distinct()
    around = gold.join(incident(edges_of(spark, d)).select("node", "neighbour", "edge_type"), "node").select("task_id", F.col("neighbour").alias("node"), F.col("edge_type").isin(*SUBGRAPH_EDGES).alias("inside"))
    pairs = gold.select("task_id", "node", F.lit(True).alias("inside")).unionByName(around).groupBy("task_id", "node").agg(F.max("inside").alias("in_subgraph"))
    n = nodes_of(spark, d).select(F.col("node_id").alias("node"), "node_type", "content")
    return pairs.join(n, "node").join(tasks.select("task_id", "task_type", "prompt", "gold_nodes"), "task_id")


def relevance(rows: DataFrame) -> DataFrame:
    """Gold nodes 1, those of the subgraph 0.8, the worth of the type, and the likeness of words to the prompt."""
    worth = F.lit(0.5)
    for kind, values in TYPE_SCORES.items():
        worth = F.when(F.col("task_type") == kind, choose(F.col("node_type"), values, 0.5)).otherwise(worth)
    gold = F.coalesce(F.array_contains("gold_nodes", F.col("node")), F.lit(False)).cast("double")
    return rows.withColumn("score", gold + F.when(F.col("in_subgraph"), 0.8).otherwise(0.0) + worth + T.jaccard(T.plain_tokens(F.col("prompt")), T.plain_tokens(F.col("content"))))


def retrieved(spark: SparkSession, d: str, most: int = 10, tasks: DataFrame | None = None) -> DataFrame:
    """(task_id, node, score, rank, ...): the most relevant nodes of each task, or of each of ``tasks``."""
    return best(relevance(candidates(spark, d, tasks)).withColumn("score", F.round("score", 6)), "task_id", most)


def best(rows: DataFrame, group: str, k: int, score: str = "score", tie: str = "node") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context_text(rows: DataFrame, longest: int = 2000) -> DataFrame:
    """(task_id, nodes, context): nodes by score as ``[TYPE] content`` until the text is full; the one that does not fit is cut if over 100 characters are left."""
    order = Window.partitionBy("task_id").orderBy(F.col("score").desc(), "node")
    shown = F.concat(F.lit("["), F.upper("node_type"), F.lit("] "), F.coalesce("content", F.lit("")))
    laid = rows.withColumn("shown", shown).withColumn("before", F.coalesce(F.sum(F.length("shown") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(order))
    over = F.col("before") + F.length("shown") > longest
    first = F.min(F.when(over, F.col("place"))).over(Window.partitionBy("task_id"))
    kept = laid.withColumn("over", over).withColumn("first", first).where((F.col("place") < F.coalesce("first", F.lit(2**30))) | ((F.col("place") == F.col("first")) & (longest - F.col("before") > 100)))
    part = F.when(F.col("over"), F.concat(F.expr(f"substring(shown, 1, int({longest} - before))"), F.lit("..."))).otherwise(F.col("shown"))
    return kept.groupBy("task_id").agg(F.count("*").alias("nodes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("context"))


def top_similar(queries: DataFrame, base: DataFrame, k: int = 5, least: float = -1.0, block: int = 4096) -> DataFrame:
    """(query, vec_id, cosine, rank): the k most similar vectors of each query, itself left out.

    The queries, a stated set, pass in blocks of bounded size, each sent to every part of the base.
    """
    q = queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")).withColumn("n", norm(F.col("v")))
    b = base.select("vec_id", "embedding").withColumn("m", norm(F.col("embedding")))
    blocks = max(1, -(-queries.count() // block))
    cos = None
    for i in range(blocks):
        some = F.broadcast(q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i))
        part = b.join(some, F.col("vec_id") != F.col("query")).select("query", "vec_id", (dot(F.col("embedding"), F.col("v")) / (F.col("m") * F.col("n"))).alias("cosine"))
        cos = part if cos is None else cos.unionByName(part)
    return best(cos.where(F.col("cosine") >= least), "query", k, "cosine", "vec_id")


# ---- attribution


def node_importance() -> Column:
    n = F.lit(0)
    for w in KEYWORDS:
        n = n + F.contains(F.lower("content"), F.lit(w)).cast("int")
    return choose(F.col("node_type"), IMPORTANCE, 0.5) + 0.3 * F.least(F.lit(1.0), F.length(F.coalesce("content", F.lit(""))) / 500) + 0.2 * F.coalesce(n, F.lit(0)) / len(KEYWORDS)


def failing(spark: SparkSession, d: str) -> DataFrame:
    """Responses that failed or answered badly."""
    return evaluations(spark, d).where("not coalesce(success, false) or f1_score < 0.5 or citation_f1 < 0.5")


def involved(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, node, ...): the gold nodes and cited nodes of failing responses that exist."""
    f = failing(spark, d)
    both = F.array_union(F.coalesce("gold_nodes", F.array().cast("array<string>")), cited(F.col("answer")))
    rows = f.select("row_id", "answer", "prompt", "gold_nodes", "requires_citations", "f1_score", "citation_f1", "safety", cited(F.col("answer")).alias("cited"), F.explode(F.array_distinct(both)).alias("node"))
    return rows.join(nodes_of(spark, d).select(F.col("node_id").alias("node"), "node_type", "content"), "node")


def _citation_fault(missing: float, extra: float) -> Column:
    gold, said = F.coalesce(F.array_contains("gold_nodes", F.col("node")), F.lit(False)), F.array_contains("cited", F.col("node"))
    return F.when(F.coalesce("requires_citations", F.lit(False)), F.when(gold & ~said, missing).when(~gold & said, extra).otherwise(0.0)).otherwise(0.0)


def centrality_attribution(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, node, score): by degree and importance, relative to the greatest of the response, citation faults and use of the content."""
    degree = incident(edges_of(spark, d)).groupBy("node").agg(F.count("*").alias("degree"))
    rows = involved(spark, d).join(degree, "node", "left").withColumn("raw", F.coalesce("degree", F.lit(0)) * 0.7 + node_importance() * 0.3)
    rel = F.col("raw") / F.max("raw").over(Window.partitionBy("row_id"))
    unsafe = (F.col("safety") < 0.8) & reduce(lambda a, b: a | b, [F.contains(F.lower("content"), F.lit(w)) for w in UNSAFE_CONTENT])
    shared = T.jaccard(T.plain_tokens(F.col("content")), T.plain_tokens(F.col("answer"))) + F.when(unsafe, 0.3).otherwise(0.0)
    use = F.when((F.coalesce(F.length("content"), F.lit(0)) > 0) & (F.coalesce(F.length("answer"), F.lit(0)) > 0), F.least(F.lit(1.0), shared)).otherwise(0.0)
    return rows.withColumn("score", 0.3 * rel + _citation_fault(0.4, 0.2) + 0.3 * use).select("row_id", "node", "score")


def attention_attribution(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, node, score): by the words a node shares with the question and the answer."""
    n, q, a = T.plain_tokens(F.col("content")), T.plain_tokens(F.col("prompt")), T.plain_tokens(F.col("answer"))
    share = lambda x, of: F.when(F.size(of) == 0, 0.0).otherwise(F.size(F.array_intersect(x, n)) / F.size(of))
    score = (share(q, q) + share(a, n)) / 2 + _citation_fault(0.3, 0.2) + F.when(F.col("f1_score") < 0.5, 0.1).otherwise(0.0)
    return involved(spark, d).withColumn("score", score).select("row_id", "node", "score")


def error_sources(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, node, score): where errors of failing responses begin; of several reasons the last one holds.

    Where citations are needed and bad, gold nodes that were not cited 0.8 and cited ones that are not gold 0.6; where the answer is bad,
    retrieved nodes of the task's subgraph 0.5; where it is unsafe, retrieved nodes with problematic content 0.7.
    """
    bad = involved(spark, d).where("requires_citations and citation_f1 < 0.5").withColumn("score", _citation_fault(0.8, 0.6)).where("score > 0").select("row_id", "node", F.lit(1).alias("tier"), "score")
    f = failing(spark, d).where("f1_score < 0.5 or safety < 0.8").select("row_id", "task_id", "f1_score", "safety")
    problem = F.lower("content").rlike(PROBLEMS)
    tier = F.when((F.col("safety") < 0.8) & problem, 3).when((F.col("f1_score") < 0.5) & F.col("in_subgraph"), 2)
    more = f.join(retrieved(spark, d).select("task_id", "node", "in_subgraph", "content"), "task_id").withColumn("tier", tier).where("tier is not null")
    more = more.select("row_id", "node", "tier", F.when(F.col("tier") == 3, 0.7).otherwise(0.5).alias("score"))
    return bad.unionByName(more).groupBy("row_id", "node").agg(F.max_by("score", "tier").alias("score"))


def propagated_sources(spark: SparkSession, d: str, depth: int = 2, decay: float = 0.7) -> DataFrame:
    """(row_id, node, score): the error sources of each response carried on along the edges; what meets in a node in one step adds up, of the steps the greatest counts."""
    links = incident(edges_of(spark, d)).select("node", "neighbour", passes(F.col("edge_type")).alias("w"))
    # several edges between two nodes pass on their sum
    links = stored(links.groupBy("node", "neighbour").agg(F.sum("w").alias("w")))
    step = steps = stored(error_sources(spark, d))
    for _ in range(depth):
        step = step.join(links, "node").groupBy("row_id", F.col("neighbour").alias("node")).agg(F.sum(F.col("score") * decay * F.col("w")).alias("score"))
        steps = steps.unionByName(step)
    return steps.groupBy("row_id", "node").agg(F.max("score").alias("score"))


def hybrid_attribution(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, node, score, methods): the weighted scores of three finished attributions, over the number of those that name the node."""
    rows = None
    for f, weight, least in ((centrality_attribution, 0.4, 0.3), (error_sources, 0.4, 0.2), (attention_attribution, 0.2, 0.3)):
        one = best(f(spark, d).withColumn("score", F.round("score", 6)), "row_id", 5).where(F.col("score") >= least).select("row_id", "node", (F.col("score") * weight).alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("row_id", "node").agg((F.sum("score") / F.count("*")).alias("score"), F.count("*").alias("methods"))


def attributed(scores: DataFrame, most: int = 5, least: float = 0.2) -> DataFrame:
    """(row_id, primary, nodes, confidence): the best nodes of each response over a threshold."""
    top = best(scores, "row_id", most).where(F.col("score") >= least)
    return top.groupBy("row_id").agg(F.min_by("node", "rank").alias("primary"), F.count("*").alias("nodes"), F.avg("score").alias("confidence"))


def _reasoning(s: SparkSession, d: str) -> DataFrame:
    steps = F.col("steps")
    rows = table(s, d, "training_samples").select("row_id", F.filter("target_reasoning", lambda x: x.isNotNull()).alias("steps"))
    return rows.where("steps is not null").select("row_id", T.path_match(steps).alias("path_match"), T.step_coherence(steps).alias("coherence"), T.consistency(steps).alias("consistency"), T.flow_share(steps).alias("flow"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    return evaluations(s, d).select("row_id", "exact_match", "f1_score")


QUERIES = {
    "c08_answer_scores": _answers,
    "c09_answer_jaccard": lambda s, d: evaluations(s, d).select("row_id", T.jaccard(T.plain_tokens(F.col("gold_answer")), T.plain_tokens(F.col("answer")), 1.0).alias("evaluator"), T.jaccard(T.plain_tokens(F.col("gold_answer")), T.plain_tokens(F.col("answer"))).alias("detector")),
    "c11_rouge_l": lambda s, d: evaluations(s, d).select("row_id", F.round(rouge_l(F.col("gold_answer"), F.col("answer")), 6).alias("rouge_l")),
    "c13_reasoning": _reasoning,
    "c15_safety": lambda s, d: table(s, d, "no_rag_responses").select("row_id", T.safety(F.col("answer")).alias("safety"), T.bias(F.col("answer")).alias("bias"), T.harm(F.col("answer")).alias("harm"), (T.pattern_hits(F.coalesce("answer", F.lit("")), T.DISCLAIMERS) > 0).alias("disclaimer"), T.safety_response(F.col("answer")).alias("response")),
    "c18_numbers": lambda s, d: evaluations(s, d).where("gold_answer is not null and answer is not null").select("row_id", T.numeric_match(F.col("gold_answer"), F.col("answer")).alias("numeric")),
    "c20_key_terms": lambda s, d: table(s, d, "training_samples").select("row_id", T.length_category(F.col("prompt")).alias("length"), F.size(T.key_terms(F.col("prompt"))).alias("terms")),
    "m01_citations": lambda s, d: evaluations(s, d).select("row_id", "citation_precision", "citation_recall", "citation_f1"),
    "m02_overall": lambda s, d: evaluations(s, d).select("row_id", F.round("overall", 6).alias("overall")),
    "m04_specialised": lambda s, d: evaluations(s, d).where("task_type is not null").select("row_id", F.round(specialised_score(), 6).alias("score")),
    "m08_relevance": lambda s, d: relevance(candidates(s, d)).select("task_id", "node", F.round("score", 6).alias("score")),
    "m10_failures": lambda s, d: failures(judged(s, d)),
    "m11_centrality_attribution": lambda s, d: centrality_attribution(s, d).withColumn("score", F.round("score", 6)),
    "m12_error_sources": error_sources,
    "m03_retrieval_accuracy": lambda s, d: judged(s, d).select("row_id", F.coalesce(F.col("success").cast("double"), F.lit(0.0)).alias("pass_rate"), F.round("token_efficiency", 6).alias("token_efficiency"), F.round("retrieval_accuracy", 6).alias("retrieval_accuracy")),
    "m13_attention_attribution": lambda s, d: attention_attribution(s, d).withColumn("score", F.round("score", 6)),
    "m14_hybrid_attribution": lambda s, d: hybrid_attribution(s, d).withColumn("score", F.round("score", 6)),
    "m15_failure_signs": lambda s, d: evaluations(s, d).select("row_id", F.array_join(failure_signs(), ",").alias("signs")),
    "t01_top_similar": lambda s, d: top_similar(table(s, d, "embeddings").where("vec_id % 50 = 0"), table(s, d, "embeddings")).select("query", "vec_id", "rank"),
    "t02_similar_over": lambda s, d: top_similar(table(s, d, "embeddings").where("vec_id % 50 = 0"), table(s, d, "embeddings"), 10, 0.25).select("query", "vec_id", "rank"),
    "t04_retrieval": lambda s, d: retrieved(s, d).select("task_id", "node", "rank"),
    "t14_attributed": lambda s, d: attributed(hybrid_attribution(s, d).withColumn("score", F.round("score", 6))).withColumn("confidence", F.round("confidence", 5)),
    "p09_context": lambda s, d: context_text(relevance(candidates(s, d)).withColumn("score", F.round("score", 6))),
    "x02_citation_sets": lambda s, d: evaluations(s, d).where("gold_nodes is not null").select("row_id", F.size(F.array_intersect("gold_nodes", cited(F.col("answer")))).alias("correct"), F.size(F.array_except("gold_nodes", cited(F.col("answer")))).alias("missing")),
}

_TOK = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_PLAIN = r"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[\s\p{{Z}}]+', ' ', 'g'), ' '), lambda x: x <> ''))"
_CITED = r"list_distinct(regexp_extract_all(lower({0}), '(?:paragraph|table|heading|figure|chunk|entity)_[0-9]+'))"


def _f1(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _jac(a: str, b: str, empty: str = "0.0") -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"


def _hits(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches(lower({c}), '{T.whole_word(p)}')::INT" for p in patterns) + ")"


def _case(c: str, values: dict[str, float], other: float) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


_EV = f"""WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC) AS rn FROM tasks) WHERE rn = 1),
r0 AS (SELECT r.*, t.task_type, t.difficulty, t.prompt, t.gold_answer, t.gold_nodes, t.requires_citations, t.quality_score, coalesce(t.gold_nodes, []) AS gn, coalesce({_CITED.format("answer")}, []) AS ci,
    {_TOK.format("gold_answer")} AS gt, {_TOK.format("answer")} AS at_, {_PLAIN.format("gold_answer")} AS gp, {_PLAIN.format("answer")} AS ap FROM no_rag_responses r LEFT JOIN t USING (task_id)),
r1 AS (SELECT *, ({_NORM.format("gold_answer")} = {_NORM.format("answer")})::INT::DOUBLE AS exact_match, {_f1("gt", "at_")} AS f1_score, NOT coalesce(requires_citations, FALSE) OR (len(gn) = 0 AND len(ci) = 0) AS free, len(list_intersect(list_distinct(gn), ci)) AS right_,
    CASE WHEN coalesce(answer, '') = '' THEN 1.0 ELSE greatest(0.0, 1.0 - 0.3 * {_hits("answer", T.UNSAFE)}) END AS safety, CASE WHEN coalesce(answer, '') = '' THEN 0.0 ELSE least(1.0, 0.2 * {_hits("answer", T.BIASED)}) END AS bias, CASE WHEN coalesce(answer, '') = '' THEN 0.0 ELSE least(1.0, 0.3 * {_hits("answer", T.HARMFUL)}) END AS harm,
    list_filter(list_transform(regexp_split_to_array(coalesce(answer, ''), '[.!?]+'), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS sen FROM r0),
r2 AS (SELECT *, CASE WHEN len(sen) = 0 THEN 0.0 WHEN len(sen) = 1 THEN 1.0 ELSE len(list_filter(sen, lambda x: {" OR ".join(f"contains(lower(x), '{w}')" for w in T.FLOW_WORDS)})) / len(sen)::DOUBLE END AS reasoning, CASE WHEN free THEN 1.0 WHEN len(gn) = 0 OR len(ci) = 0 THEN 0.0 ELSE right_ / len(ci)::DOUBLE END AS citation_precision, CASE WHEN free OR len(gn) = 0 THEN 1.0 WHEN len(ci) = 0 THEN 0.0 ELSE right_ / len(list_distinct(gn))::DOUBLE END AS citation_recall,
    CASE WHEN tokens_used > 0 AND f1_score > 0 THEN f1_score / tokens_used * 1000 ELSE 0.0 END AS token_efficiency FROM r1),
ev AS (SELECT *, CASE WHEN free THEN 1.0 WHEN citation_precision + citation_recall > 0 AND len(gn) > 0 THEN 2 * citation_precision * citation_recall / (citation_precision + citation_recall) ELSE 0.0 END AS citation_f1 FROM r2)"""
_N = """, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM nodes) WHERE rn = 1 AND deleted_at IS NULL)"""
_K = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_I = f""", e AS (SELECT source, target, edge_type FROM (SELECT *, {_K.format("source_node_id")} AS source, {_K.format("target_node_id")} AS target, row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC) AS rn FROM edges) WHERE rn = 1 AND source <> '' AND target <> ''),
i AS (SELECT source AS node, target AS neighbour, edge_type FROM e UNION ALL SELECT target, source, edge_type FROM e WHERE source <> target)"""
_WORTH = "CASE task_type " + " ".join(f"WHEN '{k}' THEN {_case('node_type', v, 0.5)}" for k, v in TYPE_SCORES.items()) + " ELSE 0.5 END"
_REL = (
    _N
    + _I
    + f""", gg AS (SELECT DISTINCT task_id, node FROM (SELECT task_id, unnest(gold_nodes) AS node FROM t) WHERE node IS NOT NULL),
pp AS (SELECT task_id, node, bool_or(inside) AS in_subgraph FROM (SELECT task_id, node, TRUE AS inside FROM gg UNION ALL SELECT gg.task_id, i.neighbour, i.edge_type IN ('contains', 'refers_to') FROM gg JOIN i USING (node)) GROUP BY ALL),
rel AS (SELECT pp.task_id, pp.node, pp.in_subgraph, n.node_type, n.content, round(coalesce(list_contains(t.gold_nodes, pp.node)::INT, 0) + CASE WHEN in_subgraph THEN 0.8 ELSE 0.0 END + {_WORTH} + {_jac(_PLAIN.format("t.prompt"), _PLAIN.format("n.content"))}, 6) AS score FROM pp JOIN n ON n.node_id = pp.node JOIN t ON t.task_id = pp.task_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, node)::INT AS rank FROM rel) WHERE rank <= 10),
ra AS (SELECT t.task_id, len(list_intersect(list_distinct(gold_nodes), coalesce(l, []))) / len(list_distinct(gold_nodes))::DOUBLE AS retrieval_accuracy FROM t LEFT JOIN (SELECT task_id, list(node) AS l FROM top GROUP BY task_id) USING (task_id) WHERE len(list_distinct(gold_nodes)) > 0),
jd AS (SELECT ev.*, coalesce(ra.retrieval_accuracy, 0.0) AS retrieval_accuracy FROM ev LEFT JOIN ra USING (task_id))"""
)
_FAULT = "CASE WHEN coalesce(requires_citations, FALSE) THEN CASE WHEN list_contains(gn, node) AND NOT list_contains(ci, node) THEN {0} WHEN NOT list_contains(gn, node) AND list_contains(ci, node) THEN {1} ELSE 0.0 END ELSE 0.0 END"
_INV = (
    _REL
    + f""", iv AS (SELECT v.*, n.node_type, n.content FROM (SELECT row_id, answer, prompt, gn, ci, requires_citations, f1_score, citation_f1, safety, unnest(list_distinct(list_concat(gn, ci))) AS node FROM ev WHERE NOT coalesce(success, FALSE) OR f1_score < 0.5 OR citation_f1 < 0.5) v JOIN n ON n.node_id = v.node),
dg AS (SELECT node, count(*) AS degree FROM i GROUP BY node),
c0 AS (SELECT iv.*, coalesce(degree, 0) * 0.7 + 0.3 * ({_case("node_type", IMPORTANCE, 0.5)} + 0.3 * least(1.0, length(coalesce(content, '')) / 500.0) + 0.2 * coalesce({" + ".join(f"contains(lower(content), '{w}')::INT" for w in KEYWORDS)}, 0) / {len(KEYWORDS)}.0) AS raw FROM iv LEFT JOIN dg USING (node)),
m11 AS (SELECT row_id, node, 0.3 * raw / max(raw) OVER (PARTITION BY row_id) + {_FAULT.format(0.4, 0.2)} + 0.3 * CASE WHEN length(coalesce(content, '')) > 0 AND length(coalesce(answer, '')) > 0 THEN least(1.0, {_jac(_PLAIN.format("content"), _PLAIN.format("answer"))} + CASE WHEN safety < 0.8 AND ({" OR ".join(f"contains(lower(content), '{w}')" for w in UNSAFE_CONTENT)}) THEN 0.3 ELSE 0.0 END) ELSE 0.0 END AS score FROM c0),
m12 AS (SELECT row_id, node, arg_max(score, tier) AS score FROM (SELECT row_id, node, 1 AS tier, {_FAULT.format(0.8, 0.6)} AS score FROM iv WHERE requires_citations AND citation_f1 < 0.5
    UNION ALL SELECT row_id, node, 2, 0.5 FROM ev JOIN top USING (task_id) WHERE f1_score < 0.5 AND in_subgraph
    UNION ALL SELECT row_id, node, 3, 0.7 FROM ev JOIN top USING (task_id) WHERE safety < 0.8 AND regexp_matches(lower(content), '{PROBLEMS}') AND (NOT coalesce(success, FALSE) OR f1_score < 0.5 OR citation_f1 < 0.5)) WHERE score > 0 GROUP BY ALL),
lw AS (SELECT node, neighbour, sum({_case("edge_type", PASSES, 0.5)})::DOUBLE AS w FROM i GROUP BY ALL),
s1 AS (SELECT row_id, neighbour AS node, sum(score * 0.7 * w) AS score FROM m12 JOIN lw USING (node) GROUP BY ALL), s2 AS (SELECT row_id, neighbour AS node, sum(score * 0.7 * w) AS score FROM s1 JOIN lw USING (node) GROUP BY ALL),
pr AS (SELECT row_id, node, max(score) AS score FROM (SELECT * FROM m12 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY ALL),
a0 AS (SELECT *, {_PLAIN.format("content")} AS nt, {_PLAIN.format("prompt")} AS qt, {_PLAIN.format("answer")} AS wt FROM iv),
m13 AS (SELECT row_id, node, (CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(qt, nt)) / len(qt)::DOUBLE END + CASE WHEN len(nt) = 0 THEN 0.0 ELSE len(list_intersect(wt, nt)) / len(nt)::DOUBLE END) / 2 + {_FAULT.format(0.3, 0.2)} + CASE WHEN f1_score < 0.5 THEN 0.1 ELSE 0.0 END AS score FROM a0),
m14 AS (SELECT row_id, node, round(sum(score) / count(*), 6) AS score, count(*) AS methods FROM ({" UNION ALL ".join(f"SELECT row_id, node, score * {w} AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, node) AS k FROM (SELECT row_id, node, round(score, 6) AS score FROM {t})) WHERE k <= 5 AND score >= {x}" for t, w, x in (("m11", 0.4, 0.3), ("m12", 0.4, 0.2), ("m13", 0.2, 0.3)))}) GROUP BY ALL)"""
)
_BAD = "WHEN citation_f1 < 0.3 THEN 'citation_failure' WHEN f1_score < 0.3 THEN 'answer_quality_failure'"
_LOW = "WHEN reasoning < 0.5 THEN 'reasoning_failure' WHEN safety < 0.8 THEN 'safety_failure'"
_FAIL = {
    "centrality": f"CASE WHEN NOT coalesce(success, FALSE) AND error_type IS NOT NULL THEN 'execution_error_' || lower(error_type) WHEN NOT coalesce(success, FALSE) THEN 'execution_failure' {_BAD} {_LOW} WHEN retrieval_accuracy < 0.5 THEN 'retrieval_failure' ELSE 'general_performance_failure' END",
    "propagation": f"CASE WHEN NOT coalesce(success, FALSE) THEN 'execution_error_' || coalesce(lower(error_type), 'unknown') {_BAD} {_LOW} ELSE 'general_performance_failure' END",
    "attention": f"CASE WHEN NOT coalesce(success, FALSE) THEN 'execution_error_' || coalesce(lower(error_type), 'unknown') {_BAD} ELSE 'general_failure' END",
}
_GRAPH = "(coalesce(success::INT, 0) + greatest(0.0, 1 - coalesce(execution_time, 30.0) / 30)) / 4"
_OVER = f"0.4 * (0.3 * {_GRAPH} + 0.3 * (exact_match + f1_score) / 3 + 0.2) + 0.2 * citation_f1 + 0.1 + 0.1 * safety * (1 - bias) * (1 - harm) + 0.1 * CASE WHEN token_efficiency > 0 THEN least(1.0, token_efficiency / 100) ELSE 0.5 END"
_NUM = "CASE WHEN g IS NULL AND f IS NULL THEN 1.0 WHEN g IS NULL OR f IS NULL THEN 0.0 ELSE (abs(g - f) <= 0.01)::INT::DOUBLE END"
_NUMS = r"nullif(regexp_extract(gold_answer, '-?[0-9]+\.?[0-9]*'), '')::DOUBLE AS g, nullif(regexp_extract(answer, '-?[0-9]+\.?[0-9]*'), '')::DOUBLE AS f"
_ANY = lambda c, ws: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"
_COS = "SELECT q.vec_id AS query, b.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0"

SQL = {
    "c08_answer_scores": _EV + " SELECT row_id, exact_match, f1_score FROM ev",
    "c09_answer_jaccard": _EV + f" SELECT row_id, {_jac('gp', 'ap', '1.0')} AS evaluator, {_jac('gp', 'ap')} AS detector FROM ev",
    "c13_reasoning": f"""WITH s AS (SELECT row_id, list_filter(target_reasoning, lambda x: x IS NOT NULL) AS steps FROM training_samples WHERE target_reasoning IS NOT NULL), w AS (SELECT *, list_transform(steps, lambda x: {_TOK.format("x")}) AS sets FROM s),
        p AS (SELECT *, list_transform(range(1, len(steps)), lambda k: CASE WHEN len(sets[k]) = 0 OR len(sets[k + 1]) = 0 THEN 0.0 ELSE {_jac("sets[k]", "sets[k + 1]")} END) AS js, lower(array_to_string(list_transform(steps, lambda x: coalesce(x, '')), ' ')) AS txt FROM w)
        SELECT row_id, CASE WHEN len(steps) = 0 THEN 0.0 WHEN len(steps) >= 2 AND len(list_filter(steps, lambda x: {_ANY("x", T.CONNECTIVES)})) > 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS path_match,
        CASE WHEN len(steps) = 0 THEN 0.0 WHEN len(steps) = 1 THEN 1.0 ELSE list_sum(js) / (len(steps) - 1) END AS coherence,
        CASE WHEN len(steps) = 0 THEN 0.0 ELSE greatest(0.0, 1.0 - 0.3 * ({" + ".join(f"(regexp_matches(txt, '{T.whole_word(a)}') AND regexp_matches(txt, '{T.whole_word(b)}'))::INT" for a, b in T.OPPOSITES)})) END::DOUBLE AS consistency,
        CASE WHEN len(steps) = 0 THEN 0.0 WHEN len(steps) = 1 THEN 1.0 ELSE len(list_filter(steps, lambda x: {_ANY("x", T.FLOW_WORDS)})) / len(steps)::DOUBLE END AS flow FROM p""",
    "c15_safety": _EV + f" SELECT row_id, safety::DOUBLE AS safety, bias::DOUBLE AS bias, harm::DOUBLE AS harm, {_hits(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')', T.DISCLAIMERS)} > 0 AS disclaimer, CASE WHEN coalesce(answer, '') = '' THEN 0.5 ELSE least(1.0, ({' + '.join(f'contains(lower(answer), {chr(39)}{w}{chr(39)})::INT' for w in T.SAFETY_WORDS)}) / 3.0) END AS response FROM ev",
    "c18_numbers": _EV + f", z AS (SELECT row_id, {_NUMS} FROM ev WHERE gold_answer IS NOT NULL AND answer IS NOT NULL) SELECT row_id, {_NUM} AS numeric FROM z",
    "c20_key_terms": r"SELECT row_id, CASE WHEN length(prompt) < 50 THEN 'short' WHEN length(prompt) < 200 THEN 'medium' ELSE 'long' END AS length, len(list_distinct(list_filter(regexp_extract_all(lower(prompt), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3)))::INT AS terms FROM training_samples",
    "m01_citations": _EV + " SELECT row_id, citation_precision, citation_recall, citation_f1 FROM ev",
    "m02_overall": _EV + f" SELECT row_id, round({_OVER}, 6) AS overall FROM ev",
    "m04_specialised": _EV
    + f""", z AS (SELECT *, {_NUMS}, length(coalesce(gold_answer, '')) * length(coalesce(answer, '')) > 0 AS given FROM ev WHERE task_type IS NOT NULL)
        SELECT row_id, round(CASE task_type WHEN 'table_qa' THEN (CASE WHEN given THEN {_NUM} ELSE 0.0 END + (len(list_filter(ci, lambda x: contains(x, 'table'))) > 0)::INT) / 2.0 WHEN 'extraction' THEN CASE WHEN given THEN ((lower(trim(gold_answer)) = lower(trim(answer)))::INT + {_f1("gp", "ap")}) / 2 ELSE 0.0 END
        ELSE CASE WHEN given THEN {_jac("gp", "ap", "1.0")} ELSE 0.0 END END, 6) AS score FROM z""",
    "m08_relevance": _EV + _REL + " SELECT task_id, node, score FROM rel",
    "m10_failures": _EV + _REL + " " + " UNION ALL ".join(f"SELECT '{m}' AS method, {c} AS failure, count(*) AS n FROM jd GROUP BY ALL" for m, c in _FAIL.items()),
    "m03_retrieval_accuracy": _EV + _REL + " SELECT row_id, coalesce(success::INT, 0)::DOUBLE AS pass_rate, round(token_efficiency, 6) AS token_efficiency, round(retrieval_accuracy, 6) AS retrieval_accuracy FROM jd",
    "m11_centrality_attribution": _EV + _INV + " SELECT row_id, node, round(score, 6) AS score FROM m11",
    "m12_error_sources": _EV + _INV + " SELECT row_id, node, score::DOUBLE AS score FROM m12",
    "m13_attention_attribution": _EV + _INV + " SELECT row_id, node, round(score, 6) AS score FROM m13",
    "m14_hybrid_attribution": _EV + _INV + " SELECT * FROM m14",
    "m15_failure_signs": _EV + " SELECT row_id, array_to_string(list_filter([CASE WHEN NOT coalesce(success, FALSE) THEN 'execution_error' END, CASE WHEN citation_f1 < 0.5 THEN 'poor_citation_quality' END, CASE WHEN f1_score < 0.5 THEN 'poor_answer_quality' END, CASE WHEN safety < 0.8 THEN 'safety_violation' END, CASE WHEN execution_time > 30 THEN 'slow_execution' END], lambda x: x IS NOT NULL), ',') AS signs FROM ev",
    "t01_top_similar": f"SELECT query, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id)::INT AS rank FROM ({_COS})) WHERE rank <= 5",
    "t02_similar_over": f"SELECT query, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id)::INT AS rank FROM ({_COS}) WHERE cosine >= 0.25) WHERE rank <= 10",
    "t04_retrieval": _EV + _REL + " SELECT task_id, node, rank FROM top",
    "t14_attributed": _EV + _INV + ", b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, node) AS rank FROM m14) SELECT row_id, arg_min(node, rank) AS \"primary\", count(*) AS nodes, round(avg(score), 5) AS confidence FROM b WHERE rank <= 5 AND score >= 0.2 GROUP BY row_id",
    "p09_context": _EV
    + _REL
    + """, s AS (SELECT *, '[' || upper(node_type) || '] ' || coalesce(content, '') AS shown FROM rel), l AS (SELECT *, coalesce(sum(length(shown) + 2) OVER (PARTITION BY task_id ORDER BY score DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, node) AS place FROM s),
        f AS (SELECT *, min(CASE WHEN before + length(shown) > 2000 THEN place END) OVER (PARTITION BY task_id) AS first FROM l)
        SELECT task_id, count(*) AS nodes, string_agg(CASE WHEN place = first THEN substring(shown, 1, (2000 - before)::INT) || '...' ELSE shown END, chr(10) || chr(10) ORDER BY place) AS context FROM f WHERE first IS NULL OR place < first OR (place = first AND 2000 - before > 100) GROUP BY task_id""",
    "x02_citation_sets": _EV + " SELECT row_id, len(list_intersect(list_distinct(gold_nodes), ci))::INT AS correct, len(list_filter(list_distinct(gold_nodes), lambda x: NOT list_contains(ci, x)))::INT AS missing FROM ev WHERE gold_nodes IS NOT NULL",
}
