"""Queries over a recorded web site: the nodes of each page of a file as its elements, with links from page to page."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import web as W
from quern.operators.graph import nodes_of
from quern.sources.documents import html_elements, html_metadata

KINDS = ("link", "button", "submit", "input", "search", "select", "checkbox", "form", "table", "list", "result", "modal", "toggle", "content")
#: Words that mark an element as navigation, by its text, and addresses that lead nowhere (fixed values).
NAVIGATION_WORDS = ["home", "back", "next", "previous", "menu", "navigation", "about", "contact", "services", "products", "login", "register", "dashboard", "profile", "settings", "help", "support"]
NO_LINKS = ("#", "javascript:void(0)", "javascript:;")
SITE = "https://docs.example.org/"


def elements(s: SparkSession, d: str) -> DataFrame:
    """(page, pos, element_id, kind, text, href, mark, site, number)."""
    n = nodes_of(s, d).where("source_file is not null and page_num is not null").withColumn("num", F.regexp_extract("node_id", "[0-9]+$", 0).cast("bigint"))
    page = lambda no: F.concat(F.lit(SITE), "source_file", F.lit("/"), no.cast("string"))
    onward = (F.col("page_num") % 5 + 1).cast("string")
    kind = F.when(F.col("node_type") == "heading", "heading").otherwise(F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("num") % len(KINDS) + 1).cast("int")))
    way = F.floor(F.col("num") / len(KINDS)) % 6
    tail = F.concat("source_file", F.lit("/"), onward)
    href = (
        F.when(way == 0, F.concat(F.lit(SITE), tail)).when(way == 1, F.concat(F.lit("/"), tail)).when(way == 2, F.concat(F.lit("https://Docs.example.org/"), tail, F.lit("/?from=x#top")))
        .when(way == 3, F.concat(F.lit("https://other.example.com/"), tail)).when(way == 4, page(F.col("page_num") + 100)).otherwise("mailto:someone@example.org")
    )
    rows = n.select(page(F.col("page_num")).alias("page"), F.col("node_id").alias("element_id"), kind.alias("kind"), F.col("content").alias("text"), F.when(kind == "link", href).alias("href"), F.col("source_file").alias("site"), F.col("page_num").alias("number"))
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy("element_id")) - 1)
    return placed.withColumn("mark", F.concat(F.lit("M"), (F.col("pos") % 7 + 1).cast("string")))


def pages(e: DataFrame) -> DataFrame:
    """(url, site, visit, title, chars, tables, links): the title is the first heading."""
    return e.groupBy(F.col("page").alias("url"), "site", F.col("number").alias("visit")).agg(
        F.coalesce(F.min_by(F.when(F.col("kind") == "heading", F.col("text")), F.when(F.col("kind") == "heading", F.col("pos"))), F.lit("")).alias("title"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "link").alias("links"),
    )


def leads_on(href: Column) -> Column:
    """Whether an address names another page: absolute, from the root, or relative with a dot in it."""
    other = href.startswith("http://") | href.startswith("https://") | href.startswith("//") | (href.startswith("/") & (F.length(href) > 1)) | (~href.startswith("#") & href.contains("."))
    return F.coalesce(~href.isin(*NO_LINKS) & (href != "") & other, F.lit(False))


def is_navigation(kind: Column, href: Column, text: Column) -> Column:
    """By kind, by address, by words of the text or a trail of pages in it, in this order; links with any address."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    said = reduce(lambda a, b: a | b, [low.contains(w) for w in [*NAVIGATION_WORDS, ">", "→", "breadcrumb"]])
    return (kind == "menu") | leads_on(href) | said | ((kind == "link") & F.coalesce(href != "", F.lit(False)))


def navigation_edges(e: DataFrame, known: DataFrame) -> DataFrame:
    """(source, target, relation): a link and the page it leads to; within its page, a link and the headings."""
    to = W.link_targets(e, known).select("page", F.col("element_id").alias("source"), "target")
    away = to.where("target != page").select("source", "target", F.lit("navigates").alias("relation"))
    inside = to.where("target = page").join(e.where("kind = 'heading'").select("page", F.col("element_id").alias("heading")), "page").select("source", F.col("heading").alias("target"), F.lit("scrolls").alias("relation"))
    return away.unionByName(inside)


def page_summary(e: DataFrame, known: DataFrame, longest: int = 1000, shown: int = 10, looked_at: int = 20) -> DataFrame:
    """(url, summary): title, text without tags, and the first elements that say something."""
    source = e.groupBy(F.col("page").alias("url")).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("e"))
    html = F.concat(F.lit("<p>"), F.array_join(F.transform("e", lambda x: x["text"]), "</p><p>"), F.lit("</p>"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))
    some = F.slice(F.filter(F.slice("e", 1, looked_at), lambda x: F.trim(x["text"]) != ""), 1, shown)
    listed = F.array_join(F.transform(some, lambda x: F.concat(x["kind"], F.lit(": "), F.substring(x["text"], 1, 100))), ", ")
    text = F.concat(F.lit("Title: "), "title", F.lit("\nText Content: "), F.substring(plain, 1, longest), F.lit("\nInteractive Elements: "), listed)
    return source.join(known, "url").select("url", text.alias("summary"))


def alike_elements(e: DataFrame, least: float = 0.85, batch: int = 100) -> DataFrame:
    """(source, target, likeness): elements of one page whose words are alike, within batches of its order."""
    rows = e.select("page", F.floor(F.col("pos") / batch).alias("batch"), "element_id", T.plain_tokens(F.col("text")).alias("w")).where("size(w) > 0")
    a, b = (rows.select("page", "batch", F.col("element_id").alias(i), F.col("w").alias(f"w_{i}")) for i in ("source", "target"))
    both = a.join(b, ["page", "batch"]).where("source < target").withColumn("likeness", T.jaccard(F.col("w_source"), F.col("w_target")))
    return both.where(F.col("likeness") > least).select("source", "target", "likeness")


def first_interactive(e: DataFrame, most: int = 10) -> DataFrame:
    """(page, element_id, n): the first interactive elements of each page."""
    order = Window.partitionBy("page").orderBy("pos")
    return e.where(W.is_interactive(F.col("kind"))).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("page", "element_id", "n")


TAGS = {"heading": "<h2>{}</h2>", "list": "<ul><li>{}</li><li></li></ul>", "content": "<p>{}</p>", "table": "<table><caption>Record {1}</caption><tr><th>key</th><th>value</th></tr><tr><td>{1}</td><td>{0}</td></tr></table>", "link": '<a href="/to/{1}">{0}</a>', "result": '<img src="/shots/{1}.png" alt="{0}"/>'}


def marked_up(e: DataFrame) -> DataFrame:
    """(doc_id, html): each page written as HTML, for the parsers; texts without marks."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", ""), " +", " "))
    tag = F.lit(None).cast("string")
    for kind, form in TAGS.items():
        parts = [F.lit(x) if k % 2 == 0 else (F.col("plain") if x in ("", "0") else F.col("pos").cast("string")) for k, x in enumerate(re.split(r"\{(\d?)\}", form))]
        tag = F.when(F.col("kind") == kind, F.concat(*parts)).otherwise(tag)
    rows = e.withColumn("plain", plain).where("plain != ''").withColumn("tag", tag).where("tag is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]), "")
    head = F.concat(F.lit("<html><head><title>"), "page", F.lit('</title><meta name="description" content="about '), "page", F.lit('"/><script>var a = 1;</script></head><body>'))
    return rows.groupBy("page").agg(body.alias("body")).select(F.col("page").alias("doc_id"), F.concat(head, "body", F.lit("</body></html>")).alias("html"))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return html_elements(marked_up(elements(s, d)), "doc_id", "html")


def solvability(e: DataFrame) -> DataFrame:
    """(page, visible, interaction): the share of elements with a text, and of those one can act on, twice at most 1; 1 where there is none."""
    acts = F.col("kind").isin(*W.CLICKABLE, *W.INPUTS)
    return e.groupBy("page").agg(F.avg((F.coalesce(F.trim("text"), F.lit("")) != "").cast("double")).alias("visible"), F.when(F.count_if(acts) == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.avg(acts.cast("double")))).alias("interaction"))


def _roles(s: SparkSession, d: str) -> DataFrame:
    e = elements(s, d)
    return W.page_roles(pages(e), e)


def _visits(s: SparkSession, d: str) -> DataFrame:
    p = pages(elements(s, d))
    return W.coherent(p.select(F.col("site").alias("crawl"), "visit", "url", (F.col("chars") > 1500).alias("useful"), (F.col("links") >= 2).alias("navigation"), F.lit(False).alias("essential")), 1, 0.5, 2).select("crawl", "visit")


def _essential(s: SparkSession, d: str) -> DataFrame:
    e = elements(s, d)
    p = pages(e)
    links = W.link_targets(e, p).select(F.col("page").alias("parent"), F.col("target").alias("child"))
    return W.essential_pages(links, p.where("tables > 0").select("url"))


QUERIES = {
    "j09_element_pages": lambda s, d: (lambda e: e.join(pages(e).select(F.col("url").alias("page"), "title"), "page").select("element_id", "page", "title"))(elements(s, d)),
    "j10_marks": lambda s, d: W.by_mark(elements(s, d)),
    "j11_controls": lambda s, d: W.control_edges(elements(s, d)),
    "j12_link_targets": lambda s, d: (lambda e: W.link_targets(e, pages(e)))(elements(s, d)),
    "j13_navigation": lambda s, d: (lambda e: navigation_edges(e, pages(e)))(elements(s, d)),
    "j14_triggers": lambda s, d: W.trigger_edges(elements(s, d)),
    "j15_flows": lambda s, d: W.flow_edges(elements(s, d)),
    "j16_capped_edges": lambda s, d: W.capped_page_edges(elements(s, d)),
    "j18_alike_elements": lambda s, d: alike_elements(elements(s, d), 0.5).withColumn("likeness", F.round("likeness", 6)),
    "f08_links": lambda s, d: elements(s, d).where("kind = 'link'").select("element_id", F.coalesce(U.explorable(F.col("href"), F.col("page")), F.lit(False)).alias("explorable")),
    "f12_navigation": lambda s, d: elements(s, d).select("element_id", is_navigation(F.col("kind"), F.col("href"), F.col("text")).alias("navigation")),
    "f24_interactive": lambda s, d: elements(s, d).select("element_id", W.is_interactive(F.col("kind")).alias("interactive")),
    "f30_first_interactive": lambda s, d: first_interactive(elements(s, d), 3),
    "f31_page_roles": _roles,
    "f36_essential_pages": _essential,
    "f37_clickable": lambda s, d: elements(s, d).select("element_id", (F.col("kind").isin(*W.CLICKABLE) | F.col("href").isNotNull()).alias("clickable"), F.col("kind").isin(*W.INPUTS).alias("input")),
    "t15_first_links": lambda s, d: W.first_links(elements(s, d), 2),
    "t16_page_priority": lambda s, d: W.page_priority(_roles(s, d)),
    "g25_crawl_order": lambda s, d: (lambda e: W.crawl_order(W.first_links(e, 5), pages(e).where("visit = 1").select("url")))(elements(s, d)),
    "a31_signature": lambda s, d: W.signature(elements(s, d)),
    "x06_urls": lambda s, d: elements(s, d).where("href is not null").where(U.host(F.col("href")) == U.host(F.col("page"))).select(U.normalise(F.col("href")).alias("url")).distinct(),
    "p07_page_types": lambda s, d: pages(elements(s, d)).select("url", W.page_type(F.col("title")).alias("type")),
    "p17_page_summary": lambda s, d: (lambda e: page_summary(e, pages(e)))(elements(s, d)),
    "w20_coherent_pages": _visits,
    "s06_html_elements": lambda s, d: _parsed(s, d).select("doc_id", "kind", "idx", "content"),
    "s07_metadata": lambda s, d: html_metadata(marked_up(elements(s, d)), "doc_id", "html").select("doc_id", F.col("metadata")["title"].alias("title"), F.col("metadata")["description"].alias("description")),
    "s08_headings": lambda s, d: _parsed(s, d).where("kind = 'heading'").select("doc_id", "idx", "level", "content"),
    "s09_paragraphs": lambda s, d: _parsed(s, d).where("kind = 'paragraph'").select("doc_id", "idx", "content", F.col("attrs")["word_count"].cast("int").alias("words")),
    "s10_lists": lambda s, d: _parsed(s, d).where("kind = 'list'").select("doc_id", "idx", "content", F.col("attrs")["item_count"].cast("int").alias("items")),
    "s11_tables": lambda s, d: _parsed(s, d).where("kind = 'table'").select("doc_id", "idx", "content", F.col("attrs")["caption"].alias("caption"), F.col("attrs")["rows"].cast("int").alias("n_rows"), F.col("attrs")["cols"].cast("int").alias("n_cols")),
    "s12_links": lambda s, d: _parsed(s, d).where("kind = 'link'").select("doc_id", "idx", "content", F.col("attrs")["href"].alias("href")),
    "s13_images": lambda s, d: _parsed(s, d).where("kind = 'image'").select("doc_id", "idx", "content", F.col("attrs")["src"].alias("src")),
    "s14_page_text": lambda s, d: html_metadata(marked_up(elements(s, d)), "doc_id", "html").select("doc_id", "text"),
    "m18_solvability": lambda s, d: solvability(elements(s, d)).select("page", F.round("visible", 6).alias("visible"), F.round("interaction", 6).alias("interaction")),
    "c25_repaired": lambda s, d: elements(s, d).where("href is not null").select("element_id", U.repair_scheme(F.regexp_replace("href", "^https?:", "")).alias("bare"), U.repair_scheme(F.col("href")).alias("whole")),
}

_NUM = "regexp_extract(node_id, '[0-9]+$')::BIGINT"
_TAIL = "source_file || '/' || (page_num % 5 + 1)"
_HREF = f"CASE (num // {len(KINDS)}) % 6 WHEN 0 THEN '{SITE}' || {_TAIL} WHEN 1 THEN '/' || {_TAIL} WHEN 2 THEN 'https://Docs.example.org/' || {_TAIL} || '/?from=x#top' WHEN 3 THEN 'https://other.example.com/' || {_TAIL} WHEN 4 THEN '{SITE}' || source_file || '/' || (page_num + 100) ELSE 'mailto:someone@example.org' END"
_W = f"""WITH RECURSIVE n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM nodes) WHERE rn = 1 AND deleted_at IS NULL AND source_file IS NOT NULL AND page_num IS NOT NULL),
e0 AS (SELECT *, {_NUM} AS num, CASE WHEN node_type = 'heading' THEN 'heading' ELSE {list(KINDS)!r}[({_NUM} % {len(KINDS)} + 1)::INT] END AS kind FROM n),
el AS (SELECT '{SITE}' || source_file || '/' || page_num AS page, node_id AS element_id, kind, content AS text, CASE WHEN kind = 'link' THEN {_HREF} END AS href, source_file AS site, page_num AS number, (row_number() OVER (PARTITION BY source_file, page_num ORDER BY node_id) - 1)::INT AS pos FROM e0),
pg AS (SELECT page AS url, site, number AS visit, coalesce(arg_min(text, pos) FILTER (WHERE kind = 'heading' AND text IS NOT NULL), '') AS title, sum(length(coalesce(text, ''))) AS chars, count(*) FILTER (WHERE kind = 'table') AS tables, count(*) FILTER (WHERE kind = 'link') AS links FROM el GROUP BY ALL)"""


def _host(c: str) -> str:
    return f"lower(regexp_extract({c}, '^(?i:https?)://([^/?#]*)', 1))"


def _path(c: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_extract({c}, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')"


def _normal(c: str) -> str:
    return f"regexp_replace(lower(regexp_extract({c}, '^(?i:https?)')) || '://' || {_host(c)} || {_path(c)}, '/$', '')"


def _any(c: str, words: list[str] | tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _similar(a: str, b: str) -> str:
    prefix = f"coalesce(list_max(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substring({a}, i::INT, 1) <> substring({b}, i::INT, 1))[1:1]) - 1, least(length({a}), length({b})))"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) ELSE {prefix}::DOUBLE / greatest(length({a}), length({b})) END"


_LT = f""", lk AS (SELECT page, element_id, href, CASE WHEN href LIKE 'http%' THEN {_normal("href")} END AS own, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '/%' THEN 'https://' || {_host("page")} || href ELSE regexp_replace(page, '[^/]*$', '') || href END AS f FROM el WHERE kind = 'link' AND href IS NOT NULL),
l2 AS (SELECT *, {_normal("f")} AS normal, {_path("f")} AS p, {_host("f")} AS h FROM lk), kn AS (SELECT url AS target, {_normal("url")} AS tn, {_path("url")} AS tp, {_host("url")} AS th FROM pg),
h0 AS (SELECT page, element_id, target, 1 AS k FROM l2 JOIN kn ON href = target UNION ALL SELECT page, element_id, target, 2 FROM l2 JOIN kn ON own = tn UNION ALL SELECT page, element_id, target, 3 FROM l2 JOIN kn ON normal = tn UNION ALL SELECT page, element_id, target, 4 FROM l2 JOIN kn ON p = tp),
h1 AS (SELECT * FROM h0 UNION ALL SELECT page, element_id, max_by(target, struct_pack(s := s, t := target)), 5 FROM (SELECT page, element_id, target, {_similar("normal", "tn")} AS s FROM l2 JOIN kn ON h = th AND string_split(p, '/')[2] = string_split(tp, '/')[2] WHERE element_id NOT IN (SELECT element_id FROM h0)) WHERE s > 0.7 GROUP BY ALL),
lt AS (SELECT page, element_id, min(target) AS target, ['exact', 'normalised', 'resolved', 'path', 'similar'][k] AS how FROM (SELECT *, min(k) OVER (PARTITION BY element_id) AS m FROM h1) WHERE k = m GROUP BY ALL)"""
_RO = (
    f""", sn AS (SELECT page, bool_or(kind = 'input') AS inp, bool_or(kind = 'table') AS tab, bool_or(kind = 'card') AS card, bool_or(kind = 'input' AND contains(lower(coalesce(text, '')), 'search')) AS box, bool_or(kind IN ('table', 'list')) AS lst, count(*) FILTER (WHERE kind IN ('input', 'select')) AS fields,
    bool_or(kind = 'heading') AS head, bool_or(kind IN {W.CLICKABLE}) AS click, bool_or(kind = 'menu') AS nav, bool_or(contains(lower(coalesce(text, '')), 'filter')) AS filt FROM el GROUP BY page),
ro AS (SELECT url, """
    + ", ".join(
        f"({' OR '.join(x)}) AS {n}"
        for n, x in {
            "skeleton": ["url LIKE '%/'", "url LIKE '%/index'", "url LIKE '%/home'", _any("lower(title)", W.ROLE_WORDS["skeleton_title"]), _any("lower(url)", W.ROLE_WORDS["skeleton"])],
            "entry": ["inp", "tab", "card", _any("lower(url)", W.ROLE_WORDS["entry"])],
            "listing": [_any("lower(url)", W.ROLE_WORDS["listing"]), "box", "lst"],
            "form": [_any("lower(url)", W.ROLE_WORDS["form"]), "fields >= 2"],
            "detail": [_any("lower(url)", W.ROLE_WORDS["detail"]), "(head AND click)"],
            "filter": [_any("lower(url)", W.ROLE_WORDS["filter"]), "nav", "filt"],
            "auxiliary": [_any("lower(url)", W.ROLE_WORDS["auxiliary"]), _any("lower(title)", W.ROLE_WORDS["auxiliary"])],
        }.items()
    )
    + " FROM pg JOIN sn ON sn.page = pg.url)"
)
_ON = f"regexp_matches(href, '(?i)^https?://') AND NOT {_any('lower(href)', U.SKIPPED)} AND ({_host('href')} = {_host('page')} OR {_host('href')} LIKE '%.' || {_host('page')} OR {_host('page')} LIKE '%.' || {_host('href')})"
_FL = f", fl AS (SELECT page, href FROM (SELECT page, href, row_number() OVER (PARTITION BY page ORDER BY pos) AS k FROM el WHERE kind = 'link' AND {_ON}) WHERE k <= {{0}})"
_R = lambda kind, k, n: f"(SELECT page, element_id AS {n}, pos FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS k FROM el WHERE kind = '{kind}') WHERE k <= {k})"
_PAIR = lambda a, ka, b, kb, name: f"SELECT page, source, target, '{name}' AS relation FROM {_R(a, ka, 'source')} JOIN {_R(b, kb, 'target')} USING (page)"
_INT = f"kind IN {W.INTERACTIVE}"

_PA = r""", pl AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS plain FROM el),
px AS (SELECT page AS doc_id, pos, plain, kind, (row_number() OVER (PARTITION BY page, kind ORDER BY pos) - 1)::INT AS idx FROM pl WHERE plain <> '' AND kind IN ('heading', 'list', 'content', 'table', 'link', 'result'))"""
_TAB = "'Table ' || (idx + 1) || ': Record ' || pos || chr(10) || chr(10) || '| key | value |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || pos || ' | ' || plain || ' |'"

SQL = {
    "s06_html_elements": _W + _PA + f" SELECT doc_id, CASE kind WHEN 'content' THEN 'paragraph' WHEN 'result' THEN 'image' ELSE kind END AS kind, idx, CASE kind WHEN 'list' THEN '• ' || plain WHEN 'table' THEN {_TAB} WHEN 'link' THEN plain || ' (/to/' || pos || ')' ELSE plain END AS content FROM px",
    "s07_metadata": _W + _PA + " SELECT DISTINCT doc_id, doc_id AS title, 'about ' || doc_id AS description FROM px",
    "s08_headings": _W + _PA + " SELECT doc_id, idx, 2 AS level, plain AS content FROM px WHERE kind = 'heading'",
    "s09_paragraphs": _W + _PA + " SELECT doc_id, idx, plain AS content, len(string_split(plain, ' '))::INT AS words FROM px WHERE kind = 'content'",
    "s10_lists": _W + _PA + " SELECT doc_id, idx, '• ' || plain AS content, 2 AS items FROM px WHERE kind = 'list'",
    "s11_tables": _W + _PA + f" SELECT doc_id, idx, {_TAB} AS content, 'Record ' || pos AS caption, 2 AS n_rows, 2 AS n_cols FROM px WHERE kind = 'table'",
    "s12_links": _W + _PA + " SELECT doc_id, idx, plain || ' (/to/' || pos || ')' AS content, '/to/' || pos AS href FROM px WHERE kind = 'link'",
    "s13_images": _W + _PA + " SELECT doc_id, idx, plain AS content, '/shots/' || pos || '.png' AS src FROM px WHERE kind = 'result'",
    "s14_page_text": _W + _PA + " SELECT doc_id, doc_id || string_agg(CASE kind WHEN 'table' THEN 'Record ' || pos || 'keyvalue' || pos || plain WHEN 'result' THEN '' ELSE plain END, '' ORDER BY pos) AS text FROM px GROUP BY doc_id",
    "m18_solvability": _W + f" SELECT page, round(avg((coalesce(trim(text), '') <> '')::INT), 6) AS visible, round(CASE WHEN count(*) FILTER (WHERE kind IN {(*W.CLICKABLE, *W.INPUTS)}) = 0 THEN 1.0 ELSE least(1.0, 2 * avg((kind IN {(*W.CLICKABLE, *W.INPUTS)})::INT)) END, 6) AS interaction FROM el GROUP BY page",
    "j09_element_pages": _W + " SELECT element_id, page, title FROM el JOIN pg ON pg.url = el.page",
    "j10_marks": _W + " SELECT page, 'M' || (pos % 7 + 1) AS mark, arg_min(element_id, pos) AS element_id FROM el GROUP BY ALL",
    "j11_controls": _W + " SELECT a.page, a.element_id AS source, b.element_id AS target, 'controls' AS relation FROM el a JOIN el b ON a.page = b.page WHERE a.kind = 'submit' AND b.kind IN ('input', 'select', 'checkbox', 'form')",
    "j12_link_targets": _W + _LT + " SELECT * FROM lt",
    "j13_navigation": _W + _LT + " SELECT element_id AS source, target, 'navigates' AS relation FROM lt WHERE target <> page UNION ALL SELECT lt.element_id, el.element_id, 'scrolls' FROM lt JOIN el ON el.page = lt.page AND el.kind = 'heading' WHERE lt.target = lt.page",
    "j14_triggers": _W + " " + " UNION ALL ".join(_PAIR("button", 10**6, k, n, f"opens_{k}") for k, n in (("modal", 2), ("form", 3), ("toggle", 2))),
    "j15_flows": _W + " SELECT page, source, target, 'fills' AS relation FROM (SELECT i.page, i.element_id AS source, o.element_id AS target, row_number() OVER (PARTITION BY i.element_id ORDER BY o.pos) AS k FROM el i JOIN el o ON i.page = o.page AND o.pos > i.pos WHERE i.kind IN ('input', 'search') AND o.kind IN ('table', 'list', 'result')) WHERE k <= 2",
    "j16_capped_edges": _W + " " + " UNION ALL ".join([_PAIR("search", 10, "table", 15, "searches"), _PAIR("input", 20, "result", 25, "yields"), _PAIR("button", 10, "content", 20, "acts_on")]),
    "j18_alike_elements": _W + r""", w AS (SELECT page, pos // 100 AS b, element_id, list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\s\p{Z}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM el), q AS (SELECT a.element_id AS source, b.element_id AS target, len(list_intersect(a.w, b.w)) AS c, len(a.w) + len(b.w) AS t FROM w a JOIN w b ON a.page = b.page AND a.b = b.b AND a.element_id < b.element_id WHERE len(a.w) > 0 AND len(b.w) > 0)
        SELECT source, target, round(c / (t - c)::DOUBLE, 6) AS likeness FROM q WHERE c / (t - c)::DOUBLE > 0.5""",
    "f08_links": _W + f" SELECT element_id, coalesce({_ON}, FALSE) AS explorable FROM el WHERE kind = 'link'",
    "f12_navigation": _W + f" SELECT element_id, kind = 'menu' OR coalesce(href NOT IN {NO_LINKS} AND href <> '' AND (href LIKE 'http://%' OR href LIKE 'https://%' OR (href LIKE '/%' AND length(href) > 1) OR (href NOT LIKE '#%' AND contains(href, '.'))), FALSE) OR {_any('lower(trim(coalesce(text, chr(32))))', [*NAVIGATION_WORDS, '>', '→', 'breadcrumb'])} OR (kind = 'link' AND coalesce(href <> '', FALSE)) AS navigation FROM el",
    "f24_interactive": _W + f" SELECT element_id, {_INT} AS interactive FROM el",
    "f30_first_interactive": _W + f" SELECT page, element_id, k AS n FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos)::INT AS k FROM el WHERE {_INT}) WHERE k <= 3",
    "f31_page_roles": _W + _RO + " SELECT * FROM ro",
    "f36_essential_pages": _W + _LT + ", u0 AS (SELECT url FROM pg WHERE tables > 0), u1 AS (SELECT DISTINCT page AS url FROM lt JOIN u0 ON u0.url = lt.target), u2 AS (SELECT DISTINCT page AS url FROM lt JOIN u1 ON u1.url = lt.target) SELECT url FROM u0 UNION SELECT url FROM u1 UNION SELECT url FROM u2",
    "f37_clickable": _W + f" SELECT element_id, kind IN {W.CLICKABLE} OR href IS NOT NULL AS clickable, kind IN {W.INPUTS} AS \"input\" FROM el",
    "t15_first_links": _W + _FL.format(2) + " SELECT * FROM fl",
    "t16_page_priority": _W + _RO + " SELECT url, " + " + ".join(f"{r}::INT * {v}" for r, v in W.ROLE_WORTH.items()) + f" - {W.DEPTH_COST} * len(list_filter(string_split({_path('url')}, '/'), lambda x: x <> ''))::INT AS priority FROM ro",
    "g25_crawl_order": _W + _FL.format(5) + """, c0 AS (SELECT DISTINCT url, 0 AS depth FROM pg WHERE visit = 1), c1 AS (SELECT * FROM c0 UNION ALL SELECT DISTINCT href, 1 FROM fl JOIN c0 ON c0.url = fl.page WHERE depth = 0 AND href NOT IN (SELECT url FROM c0)),
        c2 AS (SELECT * FROM c1 UNION ALL SELECT DISTINCT href, 2 FROM fl JOIN c1 ON c1.url = fl.page WHERE depth = 1 AND href NOT IN (SELECT url FROM c1)), c3 AS (SELECT * FROM c2 UNION ALL SELECT DISTINCT href, 3 FROM fl JOIN c2 ON c2.url = fl.page WHERE depth = 2 AND href NOT IN (SELECT url FROM c2))
        SELECT url, depth, row_number() OVER (ORDER BY depth, url)::INT AS visit FROM c3 ORDER BY depth, url LIMIT 100""",
    "a31_signature": _W + " SELECT page, array_to_string(list_sort(list_distinct(list(kind)))[1:20], ',') || '|' || array_to_string(list_sort(list_distinct(list_filter(list(substring(text, 1, 20)), lambda x: x IS NOT NULL)))[1:20], ',') AS signature FROM el GROUP BY page",
    "x06_urls": _W + f" SELECT DISTINCT {_normal('href')} AS url FROM el WHERE href IS NOT NULL AND {_host('href')} = {_host('page')}",
    "p07_page_types": _W + " SELECT url, CASE " + " ".join("WHEN " + _any("lower(title)", ws) + f" THEN '{n}'" for n, ws in W.PAGE_TYPES) + " ELSE 'content' END AS type FROM pg",
    "p17_page_summary": _W + r""", s AS (SELECT page, list(struct_pack(kind := kind, text := coalesce(text, '')) ORDER BY pos) AS e FROM el GROUP BY page)
        SELECT url, 'Title: ' || title || chr(10) || 'Text Content: ' || substring(trim(regexp_replace(regexp_replace('<p>' || array_to_string(list_transform(e, lambda x: x.text), '</p><p>') || '</p>', '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 1000) || chr(10) || 'Interactive Elements: '
        || array_to_string(list_transform(list_filter(e[1:20], lambda x: trim(x.text) <> '')[1:10], lambda x: x.kind || ': ' || substring(x.text, 1, 100)), ', ') AS summary FROM pg JOIN s ON s.page = pg.url""",
    "w20_coherent_pages": _W + """, v AS (SELECT site AS crawl, visit, chars > 1500 AS useful, links >= 2 AS nav FROM pg), a AS (SELECT *, sum((useful OR nav)::INT) OVER w AS r, row_number() OVER w AS k, sum(useful::INT) OVER w AS u FROM v WINDOW w AS (PARTITION BY crawl ORDER BY visit ROWS UNBOUNDED PRECEDING)),
        b AS (SELECT *, sum((NOT useful AND NOT nav)::INT) OVER (PARTITION BY crawl, r ORDER BY visit ROWS UNBOUNDED PRECEDING) AS empty FROM a) SELECT crawl, visit FROM b WHERE nav OR NOT (empty > 1 OR (k > 2 AND u / k::DOUBLE < 0.5))""",
    "c25_repaired": _W + r""", h AS (SELECT element_id, regexp_replace(href, '^https?:', '') AS b, href FROM el WHERE href IS NOT NULL) SELECT element_id, CASE WHEN b LIKE '//%' THEN 'https:' || b ELSE b END AS bare, href AS whole FROM h""",
}
