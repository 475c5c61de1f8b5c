"""Recorded tasks, graphs and results as tables, with declared schemas; and where the files are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = """task_id string, template_id string, task_type string, difficulty string, prompt string, gold_answer string, gold_nodes array<string>, gold_edges array<string>,
    subgraph_nodes array<string>, subgraph_edges array<string>, quality_score double, passed_quality_check boolean, requires_citations boolean, requires_reasoning_path boolean,
    web_task_type string, start_page string, som_elements_used array<string>, expected_duration int,
    task_steps array<struct<step_type: string, target_som_mark: string, action_description: string, input_value: string, expected_element: string, expected_result: string>>"""
NODE = "node_id string, node_type string, content string, metadata map<string,string>, source_file string, page_num int, embedding array<float>, level int"
EDGE = "edge_id string, edge_type string, source_node_id string, target_node_id string, weight double, metadata map<string,string>, bidirectional boolean"
RESULT = "task_id string, success boolean, answer string, citations array<string>, reasoning_path array<string>, confidence double, execution_time double, tokens_used int, model_used string, retries_needed int, error_type string, error_message string"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from JSON lines, or from a JSON list (``.json``); ``is_web`` tells the two kinds apart, row by row."""
    rows = spark.read.schema(TASK).option("multiLine", path.endswith(".json")).json(path)
    return rows.withColumn("is_web", F.col("web_task_type").isNotNull() | F.col("task_steps").isNotNull())


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph written as one JSON object."""
    g = spark.read.schema(f"nodes array<struct<{_struct(NODE)}>>, edges array<struct<{_struct(EDGE)}>>").option("multiLine", True).json(path)
    return g.select(F.inline("nodes")), g.select(F.inline("edges"))


def _struct(columns: str) -> str:
    return ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in _columns(columns))


def _columns(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    return [*out, text[last:].strip()]


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Every result in a folder with its file and time of writing; none is left out."""
    return spark.read.schema(RESULT).option("multiLine", True).json(folder).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written_at"))


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The file written last; of those written at once the last by name."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return rows.agg(F.max(F.struct("modificationTime", "path")).alias("m")).select("m.path").first()[0]
