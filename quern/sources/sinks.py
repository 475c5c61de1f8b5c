"""Writing training sets, metrics and graphs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.tasks import distributions, unpivot_metrics


def _asked() -> Column:
    return F.when(F.coalesce(F.trim("context"), F.lit("")) != "", F.concat(F.lit("Context: "), "context", F.lit("\n\nQuestion: "), "prompt")).otherwise(F.col("prompt"))


def instruction(rows: DataFrame) -> DataFrame:
    return rows.select("split", F.to_json(F.struct(F.col("prompt").alias("instruction"), F.coalesce("context", F.lit("")).alias("input"), F.col("target_answer").alias("output"))).alias("value"))


def chat(rows: DataFrame) -> DataFrame:
    said = F.array(F.struct(F.lit("user").alias("role"), _asked().alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("target_answer").alias("content")))
    return rows.select("split", F.to_json(F.struct(said.alias("messages"))).alias("value"))


def records(rows: DataFrame) -> DataFrame:
    return rows.select("split", F.to_json(F.struct(*[c for c in rows.columns if c != "split"])).alias("value"))


FORMATS = {"jsonl": records, "instruction": instruction, "alpaca": instruction, "chat": chat}


def write_training_set(rows: DataFrame, path: str, form: str = "jsonl") -> None:
    """One folder a split with lines of the given form, and the set's distributions beside them."""
    FORMATS[form](rows).write.mode("overwrite").partitionBy("split").text(f"{path}/data")
    distributions(rows.select("task_type", "sample_type", "split"), "task_type", "sample_type", "split").write.mode("overwrite").json(f"{path}/info")


def write_metrics(one: DataFrame, detail: DataFrame, path: str) -> None:
    """A summary with a line a metric and the rows it comes from, as CSV."""
    unpivot_metrics(one).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in detail.dtypes]
    detail.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/detail")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges by type, so that readers of one type read no other."""
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def append_result(rows: DataFrame, path: str) -> None:
    """Adds results to the log from which unfinished tasks are told."""
    rows.write.mode("append").parquet(path)


def describe(df: DataFrame) -> str:
    return json.dumps(json.loads(df.schema.json()), indent=1)
