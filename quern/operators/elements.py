"""Documents to clean, ordered elements, and elements to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans.runtime import table

CONTENT_KINDS = ("paragraph", "heading", "list", "list_item", "table")


def paragraphs(docs: DataFrame, separator: str = "\n", least: int = 20) -> DataFrame:
    """(doc_id, pos, content): the parts of each text longer than ``least``; ``pos`` counts all parts."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", separator, -1)).alias("pos", "content"))
    return parts.withColumn("content", T.strip(F.col("content"))).where(F.length("content") > least)


def kind_of(c: Column) -> Column:
    """The kind of a line by its mark-up."""
    return (
        F.when(c.rlike("^#{1,6} "), "heading")
        .when(c.rlike(r"^\|"), "table")
        .when(c.rlike(r"^(?:[-*•]|[0-9]+[.)]) "), "list_item")
        .otherwise("paragraph")
    )


def elements(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, level, content) of the lines that are not blank."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content")).withColumn("content", T.strip(F.col("content"))).where("content != ''")
    mark = F.regexp_extract("content", "^(#{1,6}) ", 1)
    return lines.withColumn("kind", kind_of(F.col("content"))).withColumn("level", F.when(mark != "", F.length(mark)))


def clean(rows: DataFrame, least: int = 20) -> DataFrame:
    """Without headers, footers, page numbers and short texts; tables and figures pass as they are."""
    as_is = F.col("kind").isin("table", "figure")
    kept = rows.where("content != ''").where(as_is | (~T.is_header_footer(F.col("content")) & ~T.is_page_number(F.col("content"))))
    cleaned = kept.withColumn("content", F.when(as_is, F.col("content")).otherwise(T.clean_text(F.col("content"))))
    return cleaned.where(as_is | (F.length("content") >= least))


def first_of_equals(rows: DataFrame) -> DataFrame:
    """Of the elements of a document that are equal but for case and outer space the first."""
    key = F.lower(T.strip(F.col("content")))
    order = Window.partitionBy("doc_id", key).orderBy("pos")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def next_in_document(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, next_pos): consecutive elements."""
    return rows.withColumn("next_pos", F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos"))).where("next_pos is not null").select("doc_id", "pos", "next_pos")


def merge_paragraphs(rows: DataFrame, longest: int = 500) -> DataFrame:
    """Adjacent paragraphs become one while the text so far is incomplete and neither is long.

    The length that counts is that of the text merged so far, so this is a fold over each run of paragraphs, not a window.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    other = F.col("kind") != "paragraph"
    run = F.sum(other.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("run", run)
    alone = marked.where(other).select("doc_id", "pos", "kind", "content", F.lit(1).alias("merged"))
    runs = marked.where(~other).groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("parts"))
    kind = "array<struct<pos: int, content: string, merged: int>>"
    fold = f"""aggregate(parts, cast(array() as {kind}), (done, p) ->
        if(size(done) > 0 and length(element_at(done, -1).content) <= {longest} and length(p.content) <= {longest} and not rtrim(element_at(done, -1).content) rlike '[.!?]$',
           concat(slice(done, 1, size(done) - 1), array(named_struct('pos', element_at(done, -1).pos, 'content', concat(element_at(done, -1).content, ' ', p.content), 'merged', element_at(done, -1).merged + 1))),
           concat(done, array(named_struct('pos', p.pos, 'content', p.content, 'merged', 1)))))"""
    merged = runs.select("doc_id", F.inline(F.expr(fold))).select("doc_id", "pos", F.lit("paragraph").alias("kind"), "content", "merged")
    return alone.unionByName(merged)


def merge_lists(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, items, content): consecutive list items as one list."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    item = F.col("kind") == "list_item"
    run = F.sum((~item).cast("int")).over(order)
    return (
        rows.withColumn("run", run)
        .where(item)
        .groupBy("doc_id", "run")
        .agg(F.min("pos").alias("pos"), F.count("*").alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("content"))
        .drop("run")
    )


def table_context(rows: DataFrame, reach: int = 2, words: tuple[str, ...] = ("table", "figure", "shows", "linked")) -> DataFrame:
    """(doc_id, pos, before, after): for each table the texts near it that hold one of the words."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    named = F.lit(False)
    for w in words:
        named = named | F.lower("content").contains(w)
    text = F.when(F.col("kind").isin("paragraph", "heading") & named, F.col("content"))
    around = rows.withColumn("before", F.collect_list(text).over(order.rowsBetween(-reach, -1))).withColumn("after", F.collect_list(text).over(order.rowsBetween(1, reach)))
    return around.where("kind = 'table'").select("doc_id", "pos", F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after"))


def dense_levels(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, level): the heading levels of a document without gaps."""
    return rows.where("level is not null").withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("level"))).select("doc_id", "pos", "level")


def sections(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, section, subsection): the last heading of level 1 and 2 above each element.

    A heading of level 2 ahead of any of level 1 opens nothing and is left out, as is what has no section at all.
    """
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    top = rows.withColumn("section", F.last(F.when(F.col("level") == 1, F.col("pos")), ignorenulls=True).over(order))
    sub = F.last(F.when(F.col("level") == 2, F.col("pos")), ignorenulls=True).over(order)
    return top.withColumn("sub", sub).where("section is not null").select("doc_id", "pos", "section", F.when(F.col("sub") > F.col("section"), F.col("sub")).alias("subsection"))


def section_chunks(rows: DataFrame) -> DataFrame:
    """(doc_id, section, elements, chars, content): the text of each section."""
    placed = rows.join(sections(rows), ["doc_id", "pos"])
    return placed.groupBy("doc_id", "section").agg(
        F.count("*").alias("elements"), F.sum(F.length("content")).alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), " ").alias("content")
    )


def word_windows(rows: DataFrame, longest: int = 600, overlap: int = 120) -> DataFrame:
    """(doc_id, window, content): windows of words, six characters counted for a word, each overlapping the one before."""
    size, step = longest // 6, longest // 6 - overlap // 6
    words = F.filter(F.split(F.regexp_replace("text", r"[\s\p{Z}]+", " "), " "), lambda w: w != "")
    cut = rows.select("doc_id", words.alias("words")).where(F.size("words") > 0)
    starts = cut.select("doc_id", "words", F.posexplode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))).alias("window", "at"))
    return starts.select("doc_id", "window", F.array_join(F.expr(f"slice(words, at + 1, {size})"), " ").alias("content"))


def fixed_chunks(rows: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk, start, content): pieces of at most ``size`` characters that end with a word where they can.

    The next piece starts ``overlap`` before the end of the last, one character on at least, so each depends on the one before: a fold.
    """
    end = f"if(s.e + {size} >= length(text), length(text), greatest(s.e + 1, coalesce(nullif({size} - locate(' ', reverse(substring(text, s.e + 1, {size}))), {size}), {size}) + s.e))"
    fold = f"""aggregate(sequence(1, greatest(1, int(ceil(length(text) / {max(1, size - overlap - size // 2)})) + 1)),
        named_struct('e', 0, 'done', false, 'out', cast(array() as array<struct<start: int, stop: int>>)),
        (s, i) -> if(s.done, s, named_struct(
            'e', greatest(s.e + 1, {end} - {overlap}), 'done', {end} >= length(text),
            'out', concat(s.out, array(named_struct('start', s.e, 'stop', int({end})))))),
        s -> s.out)"""
    cuts = rows.where("length(text) > 0").select("doc_id", "text", F.posexplode(F.expr(fold)).alias("chunk", "cut"))
    return cuts.select("doc_id", "chunk", F.col("cut.start").alias("start"), F.expr("substring(text, cut.start + 1, cut.stop - cut.start)").alias("content"))


def table_text(rows: Column) -> Column:
    """Rows of cells as a pipe table with a rule below the head."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(rows), F.lit(1)))), "\n")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return elements(_docs(spark, d))


QUERIES = {
    "s32_paragraphs": lambda s, d: paragraphs(_docs(s, d)),
    "s33_elements": lambda s, d: _elements(s, d).select("doc_id", "pos", "kind", "level"),
    "s16_table_text": lambda s, d: table(s, d, "nodes").where("table_data is not null and size(table_data) > 0").select("node_id", "ingested_at", table_text(F.col("table_data")).alias("content")),
    "f04_clean_elements": lambda s, d: clean(_elements(s, d)).select("doc_id", "pos", "kind", "content"),
    "f05_header_footer": lambda s, d: _elements(s, d).where(T.is_header_footer(F.col("content"))).select("doc_id", "pos"),
    "f06_page_numbers": lambda s, d: _elements(s, d).where(T.is_page_number(F.col("content"))).select("doc_id", "pos", "content"),
    "f07_chunkable": lambda s, d: _elements(s, d).where(F.col("kind").isin(*CONTENT_KINDS)).groupBy("kind").agg(F.count("*").alias("n")),
    "c05_clean_text": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", T.clean_text(F.col("text")).alias("content")),
    "c06_sentences": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"), F.element_at(T.sentences(F.concat("text", F.lit(".none"))), 1).alias("first")),
    "a03_first_of_equals": lambda s, d: first_of_equals(_elements(s, d)).select("doc_id", "pos", "content"),
    "w01_next": lambda s, d: next_in_document(first_of_equals(clean(_elements(s, d)))),
    "a01_kind_counts": lambda s, d: first_of_equals(clean(_elements(s, d))).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents")),
    "w02_merged_paragraphs": lambda s, d: merge_paragraphs(_elements(s, d)).select("doc_id", "pos", "kind", "merged", "content"),
    "w03_lists": lambda s, d: merge_lists(_elements(s, d)),
    "w04_table_context": lambda s, d: table_context(_elements(s, d)),
    "w05_levels": lambda s, d: dense_levels(_elements(s, d)),
    "w06_sections": lambda s, d: sections(_elements(s, d)),
    "w18_section_chunks": lambda s, d: section_chunks(_elements(s, d)),
    "w09_word_windows": lambda s, d: word_windows(_docs(s, d)),
    "w10_fixed_chunks": lambda s, d: fixed_chunks(_docs(s, d)),
}

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_E = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, pos, {_STRIP.format("line")} AS content FROM l),
e AS (SELECT doc_id, pos, content, CASE WHEN regexp_matches(content, '^#{{1,6}} ') THEN 'heading' WHEN content LIKE '|%' THEN 'table' WHEN regexp_matches(content, '^(?:[-*•]|[0-9]+[.)]) ') THEN 'list_item' ELSE 'paragraph' END AS kind,
      CASE WHEN regexp_matches(content, '^#{{1,6}} ') THEN length(regexp_extract(content, '^(#{{1,6}}) ', 1))::INT END AS level FROM s WHERE content <> '')"""
_HEAD = "((length(content) < 100 AND (" + " OR ".join(f"contains(lower(content), '{w}')" for w in T.HEADER_WORDS) + r")) OR regexp_matches(content, '(?i)^(?:header|footer|page [0-9]+|[0-9]+ of [0-9]+)[^\n]*$'))"
_PAGE = r"regexp_matches(content, '(?i)^\s*(?:page\s*)?[0-9-]+\s*$')"


def _clean_sql(c: str) -> str:
    for old, new in T.ENCODING:
        c = f"replace({c}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    c = rf"regexp_replace({c}, '-\s*\n\s*', '', 'g')"
    for _ in range(2):  # no look-around here: every second of adjacent single letters is met by the second pass
        c = rf"regexp_replace({c}, '([a-z])\s*\n\s*([a-z])', '\1 \2', 'g')"
    c = f"regexp_replace({c}, ' {{2,}}', ' ', 'g')"
    c = rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return _STRIP.format(rf"regexp_replace(replace({c}, chr(9), ' '), '(?m)[ \r\f]+$', '', 'g')")


_C = f""", k AS (SELECT doc_id, pos, kind, level, CASE WHEN kind = 'table' THEN content ELSE {_clean_sql("content")} END AS content FROM e WHERE kind = 'table' OR (NOT {_HEAD} AND NOT {_PAGE})),
c AS (SELECT * FROM k WHERE kind = 'table' OR length(content) >= 20)"""
_D = r", u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(content) ORDER BY pos) AS n FROM c) WHERE n = 1)"
_SEC = """, q AS (SELECT *, last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER w AS sub FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t AS (SELECT doc_id, pos, section, CASE WHEN sub > section THEN sub END AS subsection, content FROM q WHERE section IS NOT NULL)"""
_NEAR = "CASE WHEN kind IN ('paragraph', 'heading') AND (" + " OR ".join(f"contains(lower(content), '{w}')" for w in ("table", "figure", "shows", "linked")) + ") THEN content END"

SQL = {
    "s32_paragraphs": _E + " SELECT doc_id, pos, content FROM s WHERE length(content) > 20",
    "s33_elements": _E + " SELECT doc_id, pos, kind, level FROM e",
    "s16_table_text": "SELECT node_id, ingested_at, array_to_string(list_concat(['| ' || array_to_string(table_data[1], ' | ') || ' |', '| ' || array_to_string(list_transform(table_data[1], lambda x: '---'), ' | ') || ' |'], list_transform(table_data[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |')), chr(10)) AS content FROM nodes WHERE len(table_data) > 0",
    "f04_clean_elements": _E + _C + " SELECT doc_id, pos, kind, content FROM c",
    "f05_header_footer": _E + f" SELECT doc_id, pos FROM e WHERE {_HEAD}",
    "f06_page_numbers": _E + f" SELECT doc_id, pos, content FROM e WHERE {_PAGE}",
    "f07_chunkable": _E + " SELECT kind, count(*) AS n FROM e GROUP BY kind",
    "c05_clean_text": f"SELECT doc_id, {_clean_sql('text')} AS content FROM documents WHERE text IS NOT NULL",
    "c06_sentences": rf"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(p)::INT AS sentences, coalesce(p[1], 'none') AS first FROM s",
    "a03_first_of_equals": _E + " SELECT doc_id, pos, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(content) ORDER BY pos) AS n FROM e) WHERE n = 1",
    "w01_next": _E + _C + _D + " SELECT * FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next_pos FROM u) WHERE next_pos IS NOT NULL",
    "a01_kind_counts": _E + _C + _D + " SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS documents FROM u GROUP BY kind",
    "w03_lists": _E + ", r AS (SELECT *, sum(CASE WHEN kind = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM e) SELECT doc_id, min(pos) AS pos, count(*) AS items, string_agg(content, chr(10) ORDER BY pos) AS content FROM r WHERE kind = 'list_item' GROUP BY doc_id, run",
    "w04_table_context": _E + f", x AS (SELECT doc_id, pos, kind, array_to_string(list_filter(list({_NEAR}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), lambda v: v IS NOT NULL), ' ') AS before, array_to_string(list_filter(list({_NEAR}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), lambda v: v IS NOT NULL), ' ') AS after FROM e) SELECT doc_id, pos, coalesce(before, '') AS before, coalesce(after, '') AS after FROM x WHERE kind = 'table'",
    "w05_levels": _E + " SELECT doc_id, pos, dense_rank() OVER (PARTITION BY doc_id ORDER BY level)::INT AS level FROM e WHERE level IS NOT NULL",
    "w06_sections": _E + _SEC + " SELECT doc_id, pos, section, subsection FROM t",
    "w18_section_chunks": _E + _SEC + " SELECT doc_id, section, count(*) AS elements, sum(length(content))::BIGINT AS chars, string_agg(content, ' ' ORDER BY pos) AS content FROM t GROUP BY doc_id, section",
    "w09_word_windows": r"WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, words, unnest(range(0, len(words), 80)) AS k, unnest(range(len(range(0, len(words), 80))))::INT AS \"window\" FROM w WHERE len(words) > 0) SELECT doc_id, \"window\", array_to_string(words[(k + 1):(k + 100)], ' ') AS content FROM o".replace('\\"', '"'),
}
