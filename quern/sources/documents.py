"""Files and pages to element rows: (doc_id, pos, kind, idx, level, content, attrs)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ELEMENTS = "doc_id string, pos int, kind string, idx int, level int, content string, attrs map<string,string>"
#: The order in which the kinds of a page follow each other, and the words that make a neighbour of a table its caption (fixed values).
KINDS = ("heading", "paragraph", "list", "table", "link", "image")
CAPTION_WORDS = ("table", "data", "results", "summary")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSED_BY = {"p": {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class _Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "_Node | None") -> None:
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent

    def find(self, tags: set[str]) -> Iterator["_Node"]:
        for p in self.parts:
            if isinstance(p, _Node):
                if p.tag in tags:
                    yield p
                yield from p.find(tags)

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        return "".join(p if isinstance(p, str) else "" if p.tag in skip else p.text(skip) for p in self.parts)

    def siblings(self) -> tuple["_Node | None", "_Node | None"]:
        near = [p for p in self.parent.parts if isinstance(p, _Node)] if self.parent else [self]
        k = near.index(self)
        return (near[k - 1] if k else None), (near[k + 1] if k + 1 < len(near) else None)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while tag in _CLOSED_BY.get(self.at.tag, ()) and self.at.parent:
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.parts.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x.parent and x.tag != tag:
            x = x.parent
        if x.parent:
            self.at = x.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def tree_of(page: str) -> _Node:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


def pipe_table(rows: list[list[str]]) -> str:
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]])


def page_elements(page: str) -> list[tuple[str, int, int | None, str, dict[str, str]]]:
    """(kind, index among its kind, level, content, attributes), grouped by kind; an element without content takes its index with it."""
    root = tree_of(page)
    out = []
    for i, h in enumerate(root.find({f"h{k}" for k in range(1, 7)})):
        out.append(("heading", i, int(h.tag[1]), h.text().strip(), {"tag": h.tag, "id": h.attrs.get("id", "")}))
    for i, p in enumerate(root.find({"p"})):
        if text := p.text().strip():
            out.append(("paragraph", i, None, text, {"word_count": str(len(text.split()))}))
    for i, x in enumerate(root.find({"ul", "ol"})):
        items = [li.text().strip() for li in x.find({"li"})]
        if text := "\n".join(f"• {t}" for t in items if t):
            out.append(("list", i, None, text, {"tag": x.tag, "item_count": str(len(items))}))
    for i, t in enumerate(root.find({"table"})):
        rows = [r for r in ([c.text().strip() for c in tr.find({"td", "th"})] for tr in t.find({"tr"})) if r]
        if rows:
            caption = _caption(t)
            text = pipe_table(rows)
            out.append(("table", i, None, f"Table {i + 1}: {caption}\n\n{text}" if caption else text, {"rows": str(len(rows)), "cols": str(len(rows[0])), "caption": caption}))
    for i, a in enumerate(x for x in root.find({"a"}) if "href" in x.attrs):
        if (text := a.text().strip()) and a.attrs["href"]:
            out.append(("link", i, None, f"{text} ({a.attrs['href']})", {"href": a.attrs["href"]}))
    for i, m in enumerate(x for x in root.find({"img"}) if x.attrs.get("src")):
        out.append(("image", i, None, m.attrs.get("alt") or m.attrs.get("title") or m.attrs["src"], {"src": m.attrs["src"]}))
    return out


def _caption(table: _Node) -> str:
    for c in table.find({"caption"}):
        return c.text().strip()
    for near in table.siblings():
        text = near.text().strip() if near else ""
        if text and len(text) < 200 and any(w in text.lower() for w in CAPTION_WORDS):
            return text
    return ""


def page_metadata(page: str) -> dict[str, str]:
    root = tree_of(page)
    out = {"title": t.text().strip() for t in list(root.find({"title"}))[:1]}
    for m in root.find({"meta"}):
        if (name := m.attrs.get("name") or m.attrs.get("property")) and "content" in m.attrs:
            out[name] = m.attrs["content"]
    return out


def page_text(page: str) -> str:
    """All text but that of scripts and styles, as it stands."""
    return tree_of(page).text(frozenset({"script", "style"}))


def html_elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Elements of each page; null pages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, pos, *e) for i, page in zip(b["doc_id"], b["html"]) if page for pos, e in enumerate(page_elements(page))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "kind", "idx", "level", "content", "attrs"]).astype({"level": "Int32"})

    return pages.select(F.col(id_col).cast("string").alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(run, ELEMENTS)


def html_metadata(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "metadata": [page_metadata(p) if p else {} for p in b["html"]], "text": [page_text(p) if p else "" for p in b["html"]]})

    return pages.select(F.col(id_col).cast("string").alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(run, "doc_id string, metadata map<string,string>, text string")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_elements(data: bytes) -> list[tuple[str, int, int | None, str]]:
    """Paragraphs, those in a heading style as headings, then tables without their empty rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda x: "".join(t.text or "" for t in x.iter(f"{_W}t")).strip()
    out: list[tuple[str, int, int | None, str]] = []
    for i, p in enumerate(body.findall(f"{_W}p")):
        style = next((s.get(f"{_W}val", "") for s in p.iter(f"{_W}pStyle")), "")
        if t := text(p):
            if style.lower().replace(" ", "").startswith("heading"):
                level = "".join(c for c in style if c.isdigit())
                out.append(("heading", i, int(level) if level else 1, t))
            else:
                out.append(("paragraph", i, None, t))
    for i, t in enumerate(body.findall(f"{_W}tbl")):
        rows = [[text(c) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        if rows := [r for r in rows if any(r)]:
            out.append(("table", i, None, pipe_table(rows)))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, pos, k, i, level, t, {}) for p, c in zip(b["path"], b["content"]) for pos, (k, i, level, t) in enumerate(docx_elements(c))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "kind", "idx", "level", "content", "attrs"]).astype({"level": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ELEMENTS)


def read_text(spark: SparkSession, path: str, separator: str = "\n\n", least: int = 20) -> DataFrame:
    """Paragraphs of text files; the index counts those too short as well."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    parts = whole.select("doc_id", F.posexplode(F.split("value", separator, -1)).alias("pos", "content")).withColumn("content", F.trim("content")).where(F.length("content") > least)
    return parts.select("doc_id", "pos", F.lit("paragraph").alias("kind"), F.col("pos").alias("idx"), F.lit(None).cast("int").alias("level"), "content", F.create_map().cast("map<string,string>").alias("attrs"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return html_elements(pages, "path", "value")


READERS = {"html": read_html, "htm": read_html, "docx": read_docx, "txt": read_text, "md": read_text}


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, each by the reader of its suffix."""
    found = None
    for suffix, reader in READERS.items():
        try:
            one = reader(spark, f"{folder}/*.{suffix}")
            one.isEmpty()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise FileNotFoundError(f"no readable files in {folder}")
    return found


# ---- words of printed pages


def lines_of(words: DataFrame, apart: float = 5.0) -> DataFrame:
    """(doc_id, page, line, text, box, size): words in reading order; a jump of the top edge begins a line."""
    order = Window.partitionBy("doc_id", "page").orderBy("top", "x0")
    new = F.coalesce(F.abs(F.col("top") - F.lag("top").over(order)) >= apart, F.lit(False))
    numbered = words.withColumn("line", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda w: w["text"]), " ").alias("text"), *boxes(), F.avg("size").alias("size")
    )


def boxes() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]


def paragraphs_of(lines: DataFrame, apart: float = 10.0) -> DataFrame:
    """(doc_id, page, paragraph, text, top, bottom, size): a gap below all lines of a paragraph so far ends it, so this is a fold over a page's lines."""
    kind = "array<struct<text: string, top: double, bottom: double, size: double, n: int>>"
    fold = f"""aggregate(l, cast(array() as {kind}), (done, x) ->
        if(size(done) > 0 and x.top - element_at(done, -1).bottom <= {apart},
           concat(slice(done, 1, size(done) - 1), array(named_struct('text', concat(element_at(done, -1).text, ' ', x.text), 'top', least(element_at(done, -1).top, x.top), 'bottom', greatest(element_at(done, -1).bottom, x.bottom), 'size', element_at(done, -1).size + x.size, 'n', element_at(done, -1).n + 1))),
           concat(done, array(named_struct('text', x.text, 'top', x.top, 'bottom', x.bottom, 'size', x.size, 'n', 1)))))"""
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text", "top", "bottom", "size"))).alias("l"))
    out = pages.select("doc_id", "page", F.posexplode(F.expr(fold)).alias("paragraph", "p"))
    return out.select("doc_id", "page", "paragraph", "p.text", "p.top", "p.bottom", (F.col("p.size") / F.col("p.n")).alias("size"))


def block_kind(text: Column, size: Column) -> Column:
    """Large type, a number or capitals make a heading; a bullet makes a list item."""
    heading = (size > 14) | text.rlike(r"^[0-9]+(?:\.[0-9]+)*\.? [A-Z]") | (text.rlike(r"^[A-Z][A-Z0-9 ,:&-]{3,}$") & (F.length(text) < 100))
    return F.when(heading, "heading").when(text.rlike(r"^\s*(?:[-•*]|[0-9]+[.)]) "), "list_item").otherwise("paragraph")
