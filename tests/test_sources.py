import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from quern.functions import jsons as J
from quern.plans import config
from quern.sources import documents as D
from quern.sources import records as R
from quern.sources import sinks
from quern.streaming import results as S

PAGE = """<html><head><title> A page </title><meta name="author" content="x"><meta property="og:t" content="y"><style>p {}</style><script>var a = "<p>no</p>";</script></head>
<body><h2 id="top">Head &amp; more</h2><p>First <b>para</b>graph.<p>Second<ul><li>one<li> two </li><li></li></ul><p> </p><p>Summary of data</p>
<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr><tr></tr></table><div><table><caption>Named</caption><tr><td>z</td></tr></table></div>
<a href="/x">link</a><a href="">none</a><a name="q">anchor</a><img src="i.png" alt="pic"></body></html>"""


def test_page_elements():
    got = D.page_elements(PAGE)
    assert [(k, i, level) for k, i, level, _, _ in got] == [("heading", 0, 2), ("paragraph", 0, None), ("paragraph", 1, None), ("paragraph", 3, None), ("list", 0, None), ("table", 0, None), ("table", 1, None), ("link", 0, None), ("image", 0, None)]
    assert got[0][3] == "Head & more" and got[1][3] == "First paragraph." and got[4][3] == "• one\n• two" and got[4][4]["item_count"] == "3"
    assert got[5][3] == "Table 1: Summary of data\n\n| k | v |\n| --- | --- |\n| a | 1 |" and got[6][3].startswith("Table 2: Named")
    assert got[7][3] == "link (/x)"
    assert D.page_metadata(PAGE) == {"title": "A page", "author": "x", "og:t": "y"}
    assert "var a" not in D.page_text(PAGE) and "Second" in D.page_text(PAGE)
    assert D.page_elements("") == [] and D.page_elements("<p>open <table>") != []


def test_html_frames(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "no tags")], "id bigint, html string")
    assert D.html_elements(df, "id", "html").groupBy("doc_id").count().collect()[0]["count"] == 9
    assert D.html_metadata(df, "id", "html").where("doc_id = '1'").collect()[0]["metadata"]["title"] == "A page"


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in (["a", "b"], ["", ""], ["1", "2"])) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title', 'Heading2')}{p('Body text')}{p('')}{table}</w:body></w:document>")
    return out.getvalue()


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "b.docx").write_bytes(_docx())
    (tmp_path / "c.txt").write_text("short\n\nA paragraph that is long enough.\n\nAnother paragraph, also long enough.")
    rows = [(r["doc_id"].rsplit("/", 1)[-1], r["kind"], r["idx"]) for r in D.read_documents(spark, str(tmp_path)).collect()]
    assert [x for x in rows if x[0] == "b.docx"] == [("b.docx", "heading", 0), ("b.docx", "paragraph", 1), ("b.docx", "table", 0)]
    assert sorted(x for x in rows if x[0] == "c.txt") == [("c.txt", "paragraph", 1), ("c.txt", "paragraph", 2)]
    assert sum(x[0] == "a.html" for x in rows) == 9
    with pytest.raises(FileNotFoundError):
        D.read_documents(spark, str(tmp_path / "none"))


def test_words_to_lines_to_paragraphs(spark):
    words = [("d", 1, 10.0, 20.0, 100.0, 110.0, 11.0, "Hello"), ("d", 1, 30.0, 50.0, 102.0, 112.0, 11.0, "world"), ("d", 1, 10.0, 40.0, 115.0, 125.0, 11.0, "again"), ("d", 1, 10.0, 40.0, 160.0, 170.0, 18.0, "TITLE"), ("d", 2, 0.0, 1.0, 0.0, 9.0, 11.0, "p2")]
    df = spark.createDataFrame(words, "doc_id string, page int, x0 double, x1 double, top double, bottom double, size double, text string")
    lines = D.lines_of(df)
    assert [(r["page"], r["text"], r["x1"]) for r in lines.orderBy("page", "line").collect()] == [(1, "Hello world", 50.0), (1, "again", 40.0), (1, "TITLE", 40.0), (2, "p2", 1.0)]
    found = D.paragraphs_of(lines).orderBy("page", "paragraph")
    assert [r["text"] for r in found.collect()] == ["Hello world again", "TITLE", "p2"]
    assert [r[0] for r in found.select(D.block_kind(F.col("text"), F.col("size"))).collect()] == ["paragraph", "heading", "paragraph"]


def test_records(spark, tmp_path):
    tasks = [{"task_id": "a", "prompt": "p", "gold_nodes": ["n"]}, {"task_id": "b", "task_steps": [{"step_type": "click"}]}, {"task_id": "c", "web_task_type": "x", "unknown": 1}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, tasks)))
    (tmp_path / "t.json").write_text(json.dumps(tasks))
    for name in ("t.jsonl", "t.json"):
        assert {r["task_id"]: r["is_web"] for r in R.read_tasks(spark, str(tmp_path / name)).collect()} == {"a": False, "b": True, "c": True}
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"node_id": "n", "embedding": [1, 2]}], "edges": [{"edge_id": "e", "source_node_id": "n", "metadata": {"a": "b"}}]}, indent=1))
    nodes, edges = R.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.collect()[0]["embedding"] == [1.0, 2.0] and edges.collect()[0]["metadata"] == {"a": "b"}
    (tmp_path / "r").mkdir()
    for i in range(2):
        (tmp_path / "r" / f"{i}.json").write_text(json.dumps({"task_id": "a", "success": bool(i)}))
    assert R.read_results(spark, str(tmp_path / "r")).count() == 2
    assert R.latest_file(spark, str(tmp_path / "r")).endswith(".json")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "q", "c", "a", "qa", "success", "train", 0.5), ("s2", "q2", None, "a2", "qa", "corrected", "test", None)], "sample_id string, prompt string, context string, target_answer string, task_type string, sample_type string, split string, quality_score double")
    for form in sinks.FORMATS:
        sinks.write_training_set(rows, str(tmp_path / form), form)
        lines = spark.read.text(str(tmp_path / form / "data"))
        assert {r["split"] for r in lines.collect()} == {"train", "test"}
        assert all(json.loads(r["value"]) for r in lines.collect())
    said = [json.loads(r["value"])["messages"] for r in spark.read.text(str(tmp_path / "chat" / "data")).orderBy("split").collect()]
    assert said[1][0]["content"] == "Context: c\n\nQuestion: q" and said[0][0]["content"] == "q2"
    sinks.write_metrics(spark.createDataFrame([(1, 0.12345)], "n int, f1 double"), rows, str(tmp_path / "m"))
    assert {r["metric"]: r["value"] for r in spark.read.option("header", True).csv(str(tmp_path / "m" / "summary")).collect()} == {"n": "1.0000", "f1": "0.1235"}


def test_json_replies(spark):
    rows = [('{"score": 0.3}', 0.3), ('```json\n{"score": 0.4,}\n```', 0.4), ("I say {\"score\": 0.25} here", 0.25), ("likeness: 0.75.", 0.75), ("they are dissimilar", 0.2), ("very similar", 0.8), ("no idea", 0.5), ("about 7 of them", 0.5)]
    df = spark.createDataFrame(rows, "r string, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", J.reply_score(F.col("r"))).collect())
    got = df.select(J.robust(F.col("r"), "score double")["score"].alias("s")).collect()
    assert [r["s"] for r in got] == [0.3, 0.4, 0.25, *[None] * 5]
    t = spark.createDataFrame([("<thinking>why</thinking> so\n```python\nx = 1\n```",)], "t string").select(J.thinking(F.col("t")), J.without_thinking(F.col("t")), J.code_blocks(F.col("t"))).collect()[0]
    assert t[0] == "why" and t[1].startswith("so") and t[2] == ["x = 1\n"]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 2}, "d": "x"}')
    env = {"QUERN_A__C": "true", "QUERN_E": "1.5", "OTHER": "1"}
    assert config.from_environment(environ=env) == {"a": {"c": True}, "e": 1.5}
    assert config.merge(config.load({"a": {"b": 1, "z": 0}}, str(tmp_path / "c.json"), "NOTHING_"), {"d": "y"}) == {"a": {"b": 2, "z": 0}, "d": "y"}
    assert [config.coerce(x) for x in ("False", "3", "x")] == [False, 3, "x"]


def test_streaming(spark, tmp_path):
    rows = [(i, f"2025-01-01 0{i % 3}:10:00", "click" if i % 2 else "view", float(i)) for i in range(12)] * 2
    spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = S.windowed_counts(S.once(stream(), "event_id", "ts"), "ts", "event_type", late=None).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r["n"] for r in spark.table("counts").collect()) <= 12
    for _ in range(2):
        S.log(stream(), str(tmp_path / "log"), str(tmp_path / "ckpt")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 24
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    done = spark.createDataFrame([("a", None), ("b", "timeout")], "task_id string, error_type string")
    assert [r["task_id"] for r in S.unfinished(tasks, done).collect()] == ["b"]
