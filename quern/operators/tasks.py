"""Templates, task selection and duplicates, evaluation roll-ups, and records for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.functions.words import likeness, word_set
from quern.operators.graph import components, edges_of, nodes_of
from quern.operators.scoring import evaluations, tasks_of
from quern.plans.runtime import stored, table

SAFETY_TYPES = ("fact_verification", "analysis")
POLICY_WORDS = ["policy", "rule", "regulation", "guideline", "compliance", "must", "shall"]


def uniform(seed: str, *ids: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the ids only: the same at every run and in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *ids)), 1, 8), 16, 10).cast("double") / 2**32


# ---- templates


def applicable_templates(templates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(template_id, source_file): the files that have all node and edge types a template requires.

    Types are few, so there are few sets of them: the sets are compared, not templates with files.
    """
    ids = nodes.select("node_id", "source_file", "node_type")
    have = ids.groupBy("source_file").agg(F.array_sort(F.collect_set("node_type")).alias("kinds"))
    links = edges.join(ids.select(F.col("node_id").alias("source"), "source_file"), "source").groupBy("source_file").agg(F.array_sort(F.collect_set("edge_type")).alias("links"))
    files = have.join(links, "source_file", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    need = templates.select("template_id", F.array_sort(F.array_distinct(F.coalesce("required_node_types", F.array().cast("array<string>")))).alias("kinds"), F.array_sort(F.array_distinct(F.coalesce("required_edge_types", F.array().cast("array<string>")))).alias("links"))
    asked = need.select("kinds", "links").distinct().toDF("nk", "nl")
    given = files.select("kinds", "links").distinct().toDF("hk", "hl")
    fits = given.join(asked, (F.size(F.array_except("nk", "hk")) == 0) & (F.size(F.array_except("nl", "hl")) == 0))
    return need.join(fits, (F.col("kinds") == F.col("nk")) & (F.col("links") == F.col("nl"))).select("template_id", "hk", "hl").join(files, (F.col("kinds") == F.col("hk")) & (F.col("links") == F.col("hl"))).select("template_id", "source_file")


# ---- duplicates and selection


def alike_texts(rows: DataFrame, least: float = 0.65, frequent_share: float = 0.02) -> DataFrame:
    """(a, b, likeness) of rows (id, text) with alike word sets, a < b; rows with the same set are linked to the least of them.

    Prefix filter: with rare words first, two alike sets share one of their first words; where that is a frequent word they share two of
    them. So rare words and pairs of frequent ones are the keys, and no list is long. 128 parity bits, in which two sets differ no more often
    than in their words, are compared before the sets are.
    """
    sets = rows.select("id", word_set(F.col("text")).alias("w")).where(F.size("w") > 0)
    kinds = stored(sets.groupBy("w").agg(F.min("id").alias("id"), F.count("*").alias("size")))
    words = kinds.select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("df")).withColumn("often", F.col("df") >= max(16.0, frequent_share * kinds.count()))
    ordered = words.join(often, "word").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "df", "word"))).alias("o"))
    room = F.expr(f"size(o) - int(ceil({least} * size(o) - 1e-9)) + 1")
    first = ordered.select("id", "n", F.slice("o", 1, room).alias("p"), F.filter(F.slice("o", 1, room + 1), lambda x: x["often"]).alias("f"))
    keys = F.expr("concat(transform(filter(p, x -> not x.often), x -> xxhash64(x.word)), flatten(transform(f, (x, i) -> transform(slice(f, i + 2, size(f)), y -> xxhash64(x.word, y.word)))), if(n < 2, transform(p, x -> xxhash64(x.word)), array()))")
    bits = [F.expr(f"aggregate(w, 0L, (s, x) -> if(x % 2 = 0, {a}, {b}))") for a, b in (("s ^ shiftleft(1L, int((x >> 1) & 63))", "s"), ("s", "s ^ shiftleft(1L, int((x >> 1) & 63))"))]
    marks = kinds.select("id", bits[0].alias("b0"), bits[1].alias("b1"))
    posted = first.select("id", "n", F.explode(F.array_distinct(keys)).alias("key")).join(marks, "id").select("key", "id", "n", "b0", "b1")
    left, right = posted.toDF("key", "a", "na", "a0", "a1"), posted.toDF("key", "b", "nb", "b0", "b1")
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-9)
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    met = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= need) & (apart <= F.col("na") + F.col("nb") - 2 * need)).select("a", "b").distinct()
    of = lambda c: kinds.select(F.col("id").alias(c), F.col("w").alias(f"w{c}"))
    pairs = met.join(of("a"), "a").join(of("b"), "b").withColumn("likeness", likeness(F.col("wa"), F.col("wb"))).where(F.col("likeness") >= least).select("a", "b", "likeness")
    again = sets.join(kinds.where("size > 1").select("w", F.col("id").alias("a")), "w").where("id > a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("likeness"))
    return pairs.unionByName(again)


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    return components(pairs.select(F.col("a").alias("source"), F.col("b").alias("target")))


def keep_best(rows: DataFrame, groups: DataFrame, score: str) -> DataFrame:
    """Of each group of duplicates the row with the best score; rows without a group stay."""
    g = rows.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    order = Window.partitionBy("component").orderBy(F.col(score).desc_nulls_last(), "id")
    return g.withColumn("n", F.row_number().over(order)).where("n = 1").select("id", score)


def similarity_spread(pairs: DataFrame) -> DataFrame:
    """Count, mean, deviation, ends and five classes of the likenesses of pairs."""
    x = F.col("likeness")
    steps = [0.2, 0.4, 0.6, 0.8]
    inside = [(f"from_{int(lo * 10)}", (x >= lo) & (x < hi)) for lo, hi in zip([0.0, *steps], [*steps, 1.1])]
    return pairs.agg(F.count("*").alias("pairs"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), F.min(x).alias("least"), F.max(x).alias("most"), *[F.count_if(c).alias(n) for n, c in inside])


def diverse_choice(rows: DataFrame, group: str, most: int = 5, weight: float = 0.7) -> DataFrame:
    """(group, id, place): per group, one after the other, the row with the best of quality and distance to those chosen; ties to the least id.

    ``rows``: group, id, quality, words. Each choice depends on the ones before, so there is a round for each place; in a round all rows of all
    groups are weighed where they are, and only the best of each group are brought together.
    """
    left, chosen = rows.withColumn("near", F.lit(0.0)), None
    for place in range(1, most + 1):
        worth = weight * (1 - F.col("near")) + (1 - weight) * F.col("quality")
        # the greatest worth, and of equals the least id
        top = left.withColumn("worth", F.round(worth, 9)).groupBy(group).agg(F.max("worth").alias("best"))
        first = left.withColumn("worth", F.round(worth, 9)).join(top, group).where("worth = best").groupBy(group).agg(F.min(F.struct("id", "words")).alias("one"))
        taken = stored(first.select(group, F.col("one.id").alias("taken"), F.col("one.words").alias("taken_words")))
        step = taken.select(group, F.col("taken").alias("id"), F.lit(place).alias("place"))
        chosen = step if chosen is None else chosen.unionByName(step)
        if place < most:
            near = F.greatest("near", likeness(F.col("words"), F.col("taken_words")))
            left = stored(left.join(taken, group).where(F.col("id") != F.col("taken")).withColumn("near", near).drop("taken", "taken_words"))
    return chosen


# ---- roll-ups


def batch_metrics(ev: DataFrame) -> DataFrame:
    """One row: counts over all responses, the rest over those that succeeded."""
    ok = F.col("success")
    of = lambda c: F.when(ok, F.col(c))
    return ev.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), (F.count_if(ok) / F.count("*")).alias("success_rate"),
        *[F.avg(of(c)).alias(f"mean_{c}") for c in ("exact_match", "f1_score", "citation_f1", "safety", "execution_time")],
        F.avg(F.when(ok & (F.col("token_efficiency") > 0), F.col("token_efficiency"))).alias("mean_token_efficiency"),
        F.stddev_pop(of("f1_score")).alias("deviation"), F.min(of("f1_score")).alias("least"), F.max(of("f1_score")).alias("most"), F.median(of("f1_score")).alias("median"),
    )


def metrics_by(ev: DataFrame, *by: str) -> DataFrame:
    """Per group: responses, successes, share of right answers and means; nulls do not count."""
    return ev.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("success").alias("successful"), F.avg((F.col("f1_score") > 0.7).cast("double")).alias("accuracy"), F.avg("exact_match").alias("exact_match"), F.avg("f1_score").alias("f1_score"), F.avg("execution_time").alias("execution_time"))


def micro_macro(ev: DataFrame, data_set: str) -> DataFrame:
    """Accuracy over all responses, and the mean of the accuracies of the data sets."""
    one = ev.groupBy(data_set).agg(F.count("*").alias("n"), F.count_if(F.col("f1_score") > 0.7).alias("right"))
    return one.agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("micro"), F.avg(F.col("right") / F.col("n")).alias("macro"))


def distributions(df: DataFrame, *cols: str) -> DataFrame:
    """(dimension, value, n, share) of several columns and the total, in one pass."""
    sets = ", ".join(f"({c})" for c in cols)
    df.createOrReplaceTempView("__distributions")
    names = " ".join(f"when grouping({c}) = 0 then '{c}'" for c in cols)
    value = "coalesce(" + ", ".join(f"cast({c} as string)" for c in cols) + ")"
    rows = df.sparkSession.sql(f"select case {names} else 'all' end as dimension, {value} as value, count(*) as n from __distributions group by grouping sets ({sets}, ())")
    return rows.withColumn("share", F.col("n") / F.max(F.when(F.col("dimension") == "all", F.col("n"))).over(Window.partitionBy(F.lit(1))))


def unpivot_metrics(one: DataFrame) -> DataFrame:
    """(metric, value): a row of metrics as rows, four digits."""
    cols = one.columns
    return one.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "metric", "value").withColumn("value", F.format_string("%.4f", F.round("value", 4)))


# ---- steps in order


def order_penalty(steps: DataFrame) -> DataFrame:
    """(task, factor): 0.8 for each success after a failure, 0.9 for each slow step. ``steps``: task, ord, ok, slow."""
    order = Window.partitionBy("task").orderBy("ord")
    back = steps.withColumn("turn", (~F.lag("ok").over(order) & F.col("ok")).cast("int"))
    return back.groupBy("task").agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("turns"), F.count_if("slow").alias("slow")).withColumn("factor", F.pow(F.lit(0.8), "turns") * F.pow(F.lit(0.9), "slow"))


def until_failure(steps: DataFrame) -> DataFrame:
    """The steps up to and with the first that fails."""
    order = Window.partitionBy("task").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("failed", F.coalesce(F.sum((~F.col("ok")).cast("int")).over(order), F.lit(0))).where("failed = 0").drop("failed")


def best_per_group(rows: DataFrame, cap: int, *by: str, score: str = "quality_score", tie: str = "row_id") -> DataFrame:
    """From each group the same number of best rows, so that about ``cap`` remain, one at least."""
    groups = rows.select(*by).distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(cap) / F.count("*"))).alias("most"))
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), tie)
    return rows.withColumn("n", F.row_number().over(order)).join(F.broadcast(groups), F.col("n") <= F.col("most")).drop("n", "most")


def split_by_hash(rows: DataFrame, key: str, train: float = 0.70, validation: float = 0.15, seed: str = "split") -> DataFrame:
    u = uniform(seed, F.col(key).cast("string"))
    return rows.withColumn("part", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def weighted_sample(rows: DataFrame, weight: str, key: str, k: int, seed: str = "sample") -> DataFrame:
    """k rows without replacement, each with a chance by its weight: the largest of u ** (1 / weight)."""
    u = uniform(seed, F.col(key).cast("string"))
    return rows.where(F.col(weight) > 0).withColumn("__rank", F.pow(u, 1 / F.col(weight))).orderBy(F.col("__rank").desc(), key).limit(k).drop("__rank")


def training_records(ev: DataFrame, good: float = 0.5) -> DataFrame:
    """(row_id, kind, quality): an answer that is good, or one corrected by the gold answer, or a safe one for an unsafe answer."""
    ok = F.coalesce("success", F.lit(False)) & (F.col("f1_score") >= good)
    gold = F.coalesce(F.length("gold_answer"), F.lit(0)) > 0
    kinds = F.filter(
        F.array(
            F.when(ok, F.struct(F.lit("success").alias("kind"), F.col("f1_score").alias("quality"))),
            F.when(~ok & gold, F.struct(F.lit("failure_corrected").alias("kind"), F.lit(1.0).alias("quality"))),
            F.when(F.col("safety") < 0.8, F.struct(F.lit("safety_corrected").alias("kind"), F.lit(1.0).alias("quality"))),
        ),
        lambda x: x.isNotNull(),
    )
    return ev.select("row_id", F.inline(kinds))


def latest_real(rows: DataFrame, task: str, mock: Column, version: str, tie: str) -> DataFrame:
    """For each task its last result, one that is no stand-in if there is any."""
    order = Window.partitionBy(task).orderBy(mock.cast("int"), F.col(version).desc_nulls_last(), tie)
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def keep_least(rows: DataFrame, key: str, *same: str) -> DataFrame:
    """Of rows that are equal in the given columns the one with the least key."""
    least = rows.groupBy(*same).agg(F.min(key).alias(key))
    return rows.join(least, [*same, key], "left_semi")


def _steps(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("task"), F.struct("ts", "event_id").alias("ord"), (F.col("event_type") != "error").alias("ok"), (F.col("value") > 100).alias("slow"), "event_id")


def _samples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "training_samples").select(F.col("row_id").alias("id"), F.col("prompt").alias("text"), "quality_score")


def _task_rows(s: SparkSession, d: str) -> DataFrame:
    return tasks_of(s, d).select(F.col("task_id").alias("id"), F.col("prompt").alias("text"), "quality_score", "task_type")


def _mock() -> Column:
    return F.col("answer").isNull() | (F.trim("answer") == "") | F.col("error_type").isNotNull()


def _urls(s: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("HTTPS://Docs."), F.coalesce("source", F.lit("none")), F.lit(".Example.org/"), F.coalesce("doc_type", F.lit("x")), F.lit("/"), F.coalesce("source_file", F.lit("")), F.lit("?id="), F.col("doc_id"), F.lit("#top"))
    return table(s, d, "documents").select("doc_id", made.alias("url"), F.concat(F.lit("https://example.org/"), F.coalesce("source_file", F.lit(""))).alias("page"))


QUERIES = {
    "f14_templates": lambda s, d: applicable_templates(table(s, d, "text_task_templates"), nodes_of(s, d), edges_of(s, d)).groupBy("template_id").agg(F.count("*").alias("files")),
    "f25_policy_nodes": lambda s, d: nodes_of(s, d).where((F.length("content") > 50) & ~T._any(F.lower("content"), POLICY_WORDS)).select("node_id"),
    "f27_routing": lambda s, d: tasks_of(s, d).groupBy(F.col("task_type").isin(*SAFETY_TYPES).alias("safety")).agg(F.count("*").alias("n")),
    "f29_unfinished": lambda s, d: tasks_of(s, d).select("task_id").join(table(s, d, "no_rag_responses").where(~_mock()), "task_id", "left_anti"),
    "j20_alike_prompts": lambda s, d: alike_texts(_samples(s, d)).withColumn("likeness", F.round("likeness", 6)),
    "g09_duplicate_groups": lambda s, d: duplicate_groups(alike_texts(_samples(s, d))),
    "a08_best_of_duplicates": lambda s, d: keep_best(_samples(s, d), duplicate_groups(alike_texts(_samples(s, d))), "quality_score"),
    "a10_similarity_spread": lambda s, d: similarity_spread(alike_texts(_samples(s, d))),
    "t12_diverse_choice": lambda s, d: diverse_choice(_task_rows(s, d).select("task_type", "id", F.coalesce("quality_score", F.lit(0.0)).alias("quality"), word_set(F.col("text")).alias("words")), "task_type"),
    "j24_latest_results": lambda s, d: latest_real(table(s, d, "no_rag_responses"), "task_id", _mock(), "responded_at", "row_id").select("task_id", "row_id"),
    "j25_keep_least": lambda s, d: keep_least(table(s, d, "training_samples").select("row_id", "sample_id", "prompt"), "row_id", "sample_id", "prompt").select("row_id"),
    "j26_recount": lambda s, d: tasks_of(s, d).select("task_id").join(table(s, d, "no_rag_responses").groupBy("task_id").agg(F.count("*").alias("n")), "task_id", "left").select("task_id", F.coalesce("n", F.lit(0)).alias("responses")),
    "a14_batch": lambda s, d: batch_metrics(evaluations(s, d)),
    "a16_task_counts": lambda s, d: distributions(tasks_of(s, d).select(F.lower("task_type").alias("task_type"), F.lower(F.trim("difficulty")).alias("difficulty"), F.col("passed_quality_check").alias("passed")), "task_type", "difficulty", "passed").where("value is not null or dimension = 'all'"),
    "a20_micro_macro": lambda s, d: micro_macro(evaluations(s, d), "model_used"),
    "a21_by_type": lambda s, d: metrics_by(evaluations(s, d), "task_type"),
    "a22_by_model": lambda s, d: metrics_by(evaluations(s, d), "model_used"),
    "a23_training_set": lambda s, d: table(s, d, "training_samples").groupBy("sample_type").agg(F.count("*").alias("n"), F.avg("quality_score").alias("quality"), F.count_if(F.col("quality_score") >= 0.8).alias("good")),
    "a24_performance": lambda s, d: table(s, d, "no_rag_responses").agg(F.avg(F.when(F.col("success"), F.col("execution_time"))).alias("execution_time"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("tokens_used").alias("tokens")),
    "a25_errors": lambda s, d: table(s, d, "no_rag_responses").groupBy(F.coalesce("error_type", F.lit("none")).alias("error")).agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failed")),
    "k04_metrics": lambda s, d: unpivot_metrics(batch_metrics(evaluations(s, d)).drop("mean_execution_time", "mean_token_efficiency")),
    "w12_penalty": lambda s, d: order_penalty(_steps(s, d)),
    "w13_until_failure": lambda s, d: until_failure(_steps(s, d)).select("task", "event_id"),
    "w14_balanced": lambda s, d: best_per_group(table(s, d, "training_samples"), 200, "task_type", "sample_type").select("row_id", "task_type", "sample_type"),
    "w16_history": lambda s, d: table(s, d, "no_rag_responses").select("row_id", F.array_size(F.collect_list("row_id").over(Window.partitionBy("model_used").orderBy("responded_at", "row_id").rowsBetween(-10, -1))).alias("history"), F.min("row_id").over(Window.partitionBy("model_used").orderBy("responded_at", "row_id").rowsBetween(-10, -1)).alias("least")),
    "m26_training_records": lambda s, d: training_records(evaluations(s, d)),
    "x07_split": lambda s, d: split_by_hash(table(s, d, "training_samples").select("row_id"), "row_id"),
    "x10_weighted": lambda s, d: weighted_sample(table(s, d, "training_samples").where("quality_score is not null").select("row_id", "quality_score"), "quality_score", "row_id", 50).select("row_id"),
    "c12_step_sequences": lambda s, d: tasks_of(s, d).join(table(s, d, "text_task_templates").select("template_id", "required_node_types"), "template_id").where("gold_nodes is not null and required_node_types is not null").select("task_id", F.round(T.sequence_similarity(F.array_join(F.transform("gold_nodes", lambda x: F.substring(x, 1, 1)), ""), F.array_join(F.transform("required_node_types", lambda x: F.substring(x, 1, 1)), "")), 6).alias("likeness")),
    "c22_urls": lambda s, d: _urls(s, d).select("doc_id", U.normalise(F.col("url")).alias("normal"), U.base_url(F.col("url")).alias("base"), U.path(F.col("url")).alias("path"), U.depth(F.col("url")).alias("depth")),
    "c24_url_likeness": lambda s, d: _urls(s, d).select("doc_id", F.round(U.similarity(U.normalise(F.col("url")), F.col("page")), 6).alias("likeness")),
    "c27_norms": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 5).alias("norm")),
    "a09_label_means": lambda s, d: table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean")),
    "x01_first_seen": lambda s, d: tasks_of(s, d).select(F.posexplode("gold_nodes").alias("pos", "node"), "task_id").where("node is not null").groupBy("node").agg(F.min("task_id").alias("first_task"), F.countDistinct("task_id").alias("tasks")),
    "a28_status": lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers")),
}

from quern.operators.scoring import _EV, _K, _N  # noqa: E402

_T = "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC) AS rn FROM tasks) WHERE rn = 1)"
_PAIRS = r""", s AS (SELECT row_id AS id, list_distinct(regexp_extract_all(lower(prompt), '[\p{L}\p{N}]+')) AS words FROM training_samples), x AS (SELECT id, len(words) AS n, unnest(words) AS w FROM s),
o AS (SELECT a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*))::DOUBLE AS likeness FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n), al AS (SELECT * FROM o WHERE likeness >= 0.65)"""
_MIN = r""", cl AS (SELECT id, list_sort(words)::VARCHAR AS k, min(id) OVER (PARTITION BY list_sort(words)::VARCHAR) AS rep FROM s), ap AS (SELECT a, b, likeness FROM al JOIN cl x ON x.id = a JOIN cl y ON y.id = b WHERE (x.id = x.rep AND y.id = y.rep) OR (x.id = x.rep AND y.rep = x.id))"""
_GROUPS = ", lk AS (SELECT a AS u, b AS v FROM al UNION SELECT b, a FROM al), rc AS (SELECT DISTINCT u AS node, u AS root FROM lk UNION SELECT lk.v, rc.root FROM rc JOIN lk ON lk.u = rc.node), gr AS (SELECT node, min(root) AS component FROM rc GROUP BY node)"
_RT = _T.replace("WITH", "WITH RECURSIVE", 1)
_U = "WITH u AS (SELECT doc_id, 'HTTPS://Docs.' || coalesce(source, 'none') || '.Example.org/' || coalesce(doc_type, 'x') || '/' || coalesce(source_file, '') || '?id=' || doc_id || '#top' AS url, 'https://example.org/' || coalesce(source_file, '') AS page FROM documents), p AS (SELECT *, lower(regexp_extract(url, '^(?i:https?)://([^/?#]*)', 1)) AS host, CASE WHEN regexp_replace(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/+$', '') END AS path FROM u)"
_BASE = "lower(regexp_extract(url, '^(?i:https?)')) || '://' || host"
_NORMAL = f"regexp_replace({_BASE} || path, '/$', '')"
_MOCK = "(answer IS NULL OR trim(answer, ' ') = '' OR error_type IS NOT NULL)"
_METRICS = "count(*) AS n, count_if(success)::BIGINT AS successful, avg((f1_score > 0.7)::INT::DOUBLE) AS accuracy, avg(exact_match) AS exact_match, avg(f1_score) AS f1_score, avg(execution_time) AS execution_time"
_BATCH = "count(*) AS total, count_if(success)::BIGINT AS successful, count_if(success) / count(*)::DOUBLE AS success_rate, " + ", ".join(f"avg({c}) FILTER (success) AS mean_{n}" for n, c in (("exact_match", "exact_match"), ("f1_score", "f1_score"), ("citation_f1", "citation_f1"), ("safety", "safety::DOUBLE"), ("execution_time", "execution_time"))) + ", avg(token_efficiency) FILTER (success AND token_efficiency > 0) AS mean_token_efficiency, stddev_pop(f1_score) FILTER (success) AS deviation, min(f1_score) FILTER (success) AS least, max(f1_score) FILTER (success) AS most, median(f1_score) FILTER (success) AS median"
_UNI = lambda seed, c: f"('0x' || substr(md5('{seed}|' || {c}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_STEPS = ", st AS (SELECT user_id AS task, event_id, ts, event_type <> 'error' AS ok, value > 100 AS slow FROM events)"

SQL = {
    "f14_templates": "WITH "
    + _N[2:]
    + f""", e AS (SELECT edge_type, {_K.format("source_node_id")} AS source, {_K.format("target_node_id")} AS target, row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC) AS rn FROM edges),
        h AS (SELECT source_file, list(DISTINCT node_type) AS kinds FROM n GROUP BY ALL), l AS (SELECT n.source_file, list(DISTINCT edge_type) AS links FROM e JOIN n ON n.node_id = e.source WHERE e.rn = 1 AND source <> '' AND target <> '' GROUP BY ALL),
        f AS (SELECT h.source_file, kinds, coalesce(links, []) AS links FROM h LEFT JOIN l USING (source_file)) SELECT template_id, count(*) AS files FROM text_task_templates JOIN f ON list_has_all(kinds, coalesce(required_node_types, [])) AND list_has_all(links, coalesce(required_edge_types, [])) WHERE source_file IS NOT NULL GROUP BY ALL""",
    "f25_policy_nodes": "WITH " + _N[2:] + " SELECT node_id FROM n WHERE length(content) > 50 AND NOT (" + " OR ".join(f"contains(lower(content), '{w}')" for w in POLICY_WORDS) + ")",
    "f27_routing": _T + " SELECT task_type IN ('fact_verification', 'analysis') AS safety, count(*) AS n FROM t GROUP BY ALL",
    "f29_unfinished": _T + f" SELECT task_id FROM t WHERE task_id NOT IN (SELECT task_id FROM no_rag_responses WHERE NOT {_MOCK})",
    "j20_alike_prompts": _T + _PAIRS + _MIN + " SELECT a, b, round(likeness, 6) AS likeness FROM ap",
    "g09_duplicate_groups": _RT + _PAIRS + _GROUPS + " SELECT * FROM gr",
    "a08_best_of_duplicates": _RT + _PAIRS + _GROUPS + " SELECT id, quality_score FROM (SELECT row_id AS id, quality_score, row_number() OVER (PARTITION BY coalesce(component, row_id) ORDER BY quality_score DESC NULLS LAST, row_id) AS k FROM training_samples LEFT JOIN gr ON gr.node = row_id) WHERE k = 1",
    "a10_similarity_spread": _T + _PAIRS + _MIN + " SELECT count(*) AS pairs, avg(likeness) AS mean, stddev_pop(likeness) AS deviation, min(likeness) AS least, max(likeness) AS most, count_if(likeness < 0.2)::BIGINT AS from_0, count_if(likeness >= 0.2 AND likeness < 0.4)::BIGINT AS from_2, count_if(likeness >= 0.4 AND likeness < 0.6)::BIGINT AS from_4, count_if(likeness >= 0.6 AND likeness < 0.8)::BIGINT AS from_6, count_if(likeness >= 0.8)::BIGINT AS from_8 FROM ap",
    "j24_latest_results": f"SELECT task_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {_MOCK}::INT, responded_at DESC NULLS LAST, row_id) AS k FROM no_rag_responses) WHERE k = 1",
    "j25_keep_least": "SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY sample_id, prompt ORDER BY row_id) AS k FROM training_samples) WHERE k = 1",
    "j26_recount": _T + " SELECT task_id, (SELECT count(*) FROM no_rag_responses r WHERE r.task_id = t.task_id) AS responses FROM t",
    "a14_batch": _EV + f" SELECT {_BATCH} FROM ev",
    "a16_task_counts": _T + ", v AS (SELECT lower(task_type) AS task_type, lower(trim(difficulty, ' ')) AS difficulty, passed_quality_check AS passed FROM t), g AS (SELECT CASE WHEN grouping(task_type) = 0 THEN 'task_type' WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(passed) = 0 THEN 'passed' ELSE 'all' END AS dimension, coalesce(task_type, difficulty, passed::VARCHAR) AS value, count(*) AS n FROM v GROUP BY GROUPING SETS ((task_type), (difficulty), (passed), ())) SELECT dimension, value, n, n / (SELECT count(*) FROM v)::DOUBLE AS share FROM g WHERE value IS NOT NULL OR dimension = 'all'",
    "a20_micro_macro": _EV + ", m AS (SELECT model_used, count(*) AS n, count_if(f1_score > 0.7) AS right_ FROM ev GROUP BY ALL) SELECT sum(n)::BIGINT AS n, sum(right_) / sum(n)::DOUBLE AS micro, avg(right_ / n::DOUBLE) AS macro FROM m",
    "a21_by_type": _EV + f" SELECT task_type, {_METRICS} FROM ev GROUP BY ALL",
    "a22_by_model": _EV + f" SELECT model_used, {_METRICS} FROM ev GROUP BY ALL",
    "a23_training_set": "SELECT sample_type, count(*) AS n, avg(quality_score) AS quality, count_if(quality_score >= 0.8)::BIGINT AS good FROM training_samples GROUP BY ALL",
    "a24_performance": "SELECT avg(execution_time) FILTER (success) AS execution_time, avg(success::INT::DOUBLE) AS success_rate, avg(tokens_used) AS tokens FROM no_rag_responses",
    "a25_errors": "SELECT coalesce(error_type, 'none') AS error, count(*) AS n, count_if(NOT success)::BIGINT AS failed FROM no_rag_responses GROUP BY ALL",
    "w12_penalty": "WITH" + _STEPS[1:] + ", g AS (SELECT task, (NOT lag(ok) OVER (PARTITION BY task ORDER BY ts, event_id) AND ok)::INT AS turn, slow FROM st) SELECT task, coalesce(sum(turn), 0)::BIGINT AS turns, count_if(slow)::BIGINT AS slow, pow(0.8::DOUBLE, coalesce(sum(turn), 0)) * pow(0.9::DOUBLE, count_if(slow)) AS factor FROM g GROUP BY task",
    "w13_until_failure": "WITH" + _STEPS[1:] + ", g AS (SELECT *, coalesce(sum((NOT ok)::INT) OVER (PARTITION BY task ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM st) SELECT task, event_id FROM g WHERE failed = 0",
    "w14_balanced": "WITH g AS (SELECT greatest(1, floor(200 / count(*))) AS most FROM (SELECT DISTINCT task_type, sample_type FROM training_samples)) SELECT row_id, task_type, sample_type FROM (SELECT *, row_number() OVER (PARTITION BY task_type, sample_type ORDER BY quality_score DESC NULLS LAST, row_id) AS k FROM training_samples) JOIN g ON k <= most",
    "w16_history": "SELECT row_id, count(*) OVER w::INT AS history, min(row_id) OVER w AS least FROM no_rag_responses WINDOW w AS (PARTITION BY model_used ORDER BY responded_at NULLS FIRST, row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)",
    "m26_training_records": _EV + ", z AS (SELECT *, coalesce(success, FALSE) AND f1_score >= 0.5 AS ok FROM ev) SELECT row_id, 'success' AS kind, f1_score AS quality FROM z WHERE ok UNION ALL SELECT row_id, 'failure_corrected', 1.0::DOUBLE FROM z WHERE NOT ok AND length(gold_answer) > 0 UNION ALL SELECT row_id, 'safety_corrected', 1.0::DOUBLE FROM z WHERE safety < 0.8",
    "x07_split": f"SELECT row_id, CASE WHEN u < 0.70 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS part FROM (SELECT row_id, {_UNI('split', 'row_id')} AS u FROM training_samples)",
    "x10_weighted": f"SELECT row_id FROM (SELECT row_id, pow({_UNI('sample', 'row_id')}, 1 / quality_score) AS k FROM training_samples WHERE quality_score > 0) ORDER BY k DESC, row_id LIMIT 50",
    "c12_step_sequences": _T + ", z AS (SELECT task_id, array_to_string(list_transform(gold_nodes, lambda x: substr(x, 1, 1)), '') AS a, array_to_string(list_transform(required_node_types, lambda x: substr(x, 1, 1)), '') AS b FROM t JOIN text_task_templates p USING (template_id) WHERE gold_nodes IS NOT NULL AND required_node_types IS NOT NULL) SELECT task_id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END, 6) AS likeness FROM z",
    "c22_urls": _U + f" SELECT doc_id, {_NORMAL} AS normal, {_BASE} AS base, path, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INT AS depth FROM p",
    "c24_url_likeness": _U + f", q AS (SELECT doc_id, {_NORMAL} AS a, page AS b FROM p) SELECT doc_id, round(CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b))::DOUBLE ELSE len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: substr(a, 1, k) = substr(b, 1, k))) / greatest(length(a), length(b))::DOUBLE END, 6) AS likeness FROM q",
    "c27_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings",
    "a09_label_means": "SELECT label, dim, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INT AS dim FROM embeddings) GROUP BY ALL",
    "x01_first_seen": _T + " SELECT node, min(task_id) AS first_task, count(DISTINCT task_id) AS tasks FROM (SELECT task_id, unnest(gold_nodes) AS node FROM t) WHERE node IS NOT NULL GROUP BY node",
    "a28_status": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL",
}
