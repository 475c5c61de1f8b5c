"""Graphs of recorded web pages: elements, links, what triggers and feeds what, and the order of a crawl.

Pages: url, title, visit (their order). Elements: page, pos, element_id, kind (link, button, submit, input, form, table, modal, content,
...), text, href, mark. Marks start anew on every page, so they are always taken together with the page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import urls as U
from quern.plans.runtime import stored

INTERACTIVE = ("link", "button", "submit", "input", "select", "checkbox", "menu", "search", "tab")
#: Words in a title that tell the type of a page, in order (fixed values).
PAGE_TYPES = [("login", ["login", "signin", "auth"]), ("signup", ["signup", "register", "create account"]), ("product", ["product", "item", "detail"]), ("cart", ["cart", "basket", "checkout"]), ("search", ["search", "results"]), ("info", ["about", "contact", "help"]), ("legal", ["privacy", "terms", "policy"])]
CLICKABLE = ("link", "button", "submit", "menu", "tab")
INPUTS = ("input", "select", "checkbox", "search")
#: Words in an address (or a title) that give a page a role (fixed values).
ROLE_WORDS = {
    "skeleton_title": ["home", "welcome", "main"],
    "skeleton": ["nav", "menu", "sitemap", "breadcrumb"],
    "entry": ["dashboard", "overview", "main", "portal"],
    "listing": ["search", "query", "find", "lookup", "list", "table", "grid", "items", "products"],
    "form": ["form", "input", "submit", "register", "login", "contact"],
    "detail": ["detail", "view", "show", "item", "product", "article"],
    "filter": ["filter", "sort", "order", "page", "pagination"],
    "auxiliary": ["help", "about", "contact", "settings", "profile", "account", "privacy", "terms"],
}
#: What a role is worth in the order of a crawl, and what a step down costs (fixed values).
ROLE_WORTH = {"skeleton": 1000, "entry": 800, "listing": 600, "form": 500, "detail": 300, "filter": 200, "auxiliary": 100}
DEPTH_COST = 50
#: Raw kinds of elements and the kinds they stand for.
KIND_NAMES = {"a": "link", "btn": "button", "textarea": "input", "textbox": "input", "dropdown": "select", "img": "image", "figure": "image", "td": "table", "th": "table", "h1": "heading", "h2": "heading", "p": "content", "div": "content", "span": "content"}


def canonical_kind(c: Column) -> Column:
    low = F.lower(F.trim(c))
    out = low
    for k, v in KIND_NAMES.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def page_type(title: Column) -> Column:
    """The first type one of whose words is in the title."""
    low, out = F.lower(F.coalesce(title, F.lit(""))), F.lit("content")
    for name, words in reversed(PAGE_TYPES):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name).otherwise(out)
    return out


def is_interactive(kind: Column) -> Column:
    return kind.isin(*INTERACTIVE)


def page_roles(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """(url, skeleton, entry, listing, form, detail, filter, auxiliary): roles by address, title and kinds of elements, one pass over the elements."""
    said = F.lower(F.coalesce("text", F.lit("")))
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    kind = lambda *k: F.col("kind").isin(*k)
    seen = elements.groupBy(F.col("page").alias("url")).agg(
        has(kind("input", "table", "card")).alias("tools"), has((F.col("kind") == "input") & said.contains("search")).alias("box"), has(kind("table", "list")).alias("lists"), F.count_if(kind("input", "select")).alias("fields"),
        has(kind("heading")).alias("heads"), has(kind(*CLICKABLE)).alias("clicks"), has(kind("menu")).alias("menus"), has(said.contains("filter")).alias("filters"),
    )
    p = pages.select("url", "title").join(seen, "url", "left").na.fill(False, ["tools", "box", "lists", "heads", "clicks", "menus", "filters"]).na.fill(0, ["fields"])
    url, title = F.lower("url"), F.lower(F.coalesce("title", F.lit("")))
    holds = lambda c, words: reduce(lambda a, b: a | b, [c.contains(w) for w in ROLE_WORDS[words]])
    return p.select(
        "url", (url.endswith("/") | url.endswith("/index") | url.endswith("/home") | holds(title, "skeleton_title") | holds(url, "skeleton")).alias("skeleton"), (F.col("tools") | holds(url, "entry")).alias("entry"),
        (holds(url, "listing") | F.col("box") | F.col("lists")).alias("listing"), (holds(url, "form") | (F.col("fields") >= 2)).alias("form"), (holds(url, "detail") | (F.col("heads") & F.col("clicks"))).alias("detail"),
        (holds(url, "filter") | F.col("menus") | F.col("filters")).alias("filter"), (holds(url, "auxiliary") | holds(title, "auxiliary")).alias("auxiliary"),
    )


def page_priority(roles: DataFrame) -> DataFrame:
    worth = reduce(lambda a, b: a + b, [F.col(r).cast("int") * v for r, v in ROLE_WORTH.items()])
    return roles.select("url", (worth - DEPTH_COST * U.depth(F.col("url"))).alias("priority"))


def first_links(elements: DataFrame, most: int = 5) -> DataFrame:
    """(page, href): the first links of a page that lead on, in its order."""
    ok = elements.where("kind = 'link' and href is not null").where(U.explorable(F.col("href"), F.col("page")))
    return ok.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("pos"))).where(F.col("n") <= most).select("page", "href")


def crawl_order(links: DataFrame, starts: DataFrame, deepest: int = 3, most: int = 100) -> DataFrame:
    """(url, depth, visit): pages by depth, then by address, each once, at most ``most``."""
    edges = links.select(F.col("page").alias("source"), F.col("href").alias("target"), F.lit("").alias("edge_id"), F.lit("link").alias("edge_type"), F.lit(1.0).alias("weight"))
    directed = edges.where("source != target")
    seen = starts.select(F.col("url").alias("node"), F.lit(0).alias("hop")).distinct()
    front = seen
    for h in range(1, deepest + 1):
        front = front.select("node").join(directed.select(F.col("source").alias("node"), "target"), "node").select(F.col("target").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
        seen = stored(seen.unionByName(front))
        front = seen.where(F.col("hop") == h)
    ranked = seen.orderBy("hop", "node").limit(most)
    return ranked.select(F.col("node").alias("url"), F.col("hop").alias("depth"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("hop", "node")).alias("visit"))


def coherent(visits: DataFrame, limit: int = 3, least: float = 0.3, from_page: int = 10) -> DataFrame:
    """Pages kept of a crawl. ``visits``: crawl, visit, url, useful, navigation, essential.

    Navigation and essential pages always; others unless more than ``limit`` pages in a row had nothing, or, past ``from_page`` pages, less than
    a share of all pages so far did. A useful or navigation page ends a row.
    """
    order = Window.partitionBy("crawl").orderBy("visit")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum((F.col("useful") | F.col("navigation")).cast("int")).over(so_far)
    rows = visits.withColumn("row", ends).withColumn("n", F.row_number().over(order)).withColumn("share", F.sum(F.col("useful").cast("int")).over(so_far) / F.col("n"))
    empty = F.sum((~F.col("useful") & ~F.col("navigation")).cast("int")).over(Window.partitionBy("crawl", "row").orderBy("visit").rowsBetween(Window.unboundedPreceding, 0))
    bad = (F.col("empty") > limit) | ((F.col("n") > from_page) & (F.col("share") < least))
    return rows.withColumn("empty", empty).where(F.col("essential") | F.col("navigation") | ~bad).select(*visits.columns)


def essential_pages(links: DataFrame, useful: DataFrame, steps: int = 2) -> DataFrame:
    """The pages that lead to a useful one within so many steps. ``links``: parent, child."""
    level, found = useful.select("url"), useful.select("url")
    for _ in range(steps):
        level = links.join(level.withColumnRenamed("url", "child"), "child").select(F.col("parent").alias("url")).distinct()
        found = found.unionByName(level)
    return found.distinct()


def link_targets(elements: DataFrame, pages: DataFrame, least: float = 0.7) -> DataFrame:
    """(page, element_id, target, how): the page a link leads to: by its address, without query and fragment, resolved against its page, by its path on any host, else the most similar one of the same host."""
    links = elements.where("kind = 'link' and href is not null").select("page", "element_id", "href")
    absolute = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(U.base_url(F.col("page")), "href")).otherwise(F.concat(F.regexp_replace("page", "[^/]*$", ""), "href"))
    links = links.withColumn("own", F.when(F.col("href").startswith("http"), U.normalise(F.col("href")))).withColumn("full", absolute).withColumn("normal", U.normalise(F.col("full"))).withColumn("path", U.path(F.col("full"))).withColumn("host", U.host(F.col("full")))
    known = pages.select(F.col("url").alias("target")).distinct().withColumn("t_normal", U.normalise(F.col("target"))).withColumn("t_path", U.path(F.col("target"))).withColumn("t_host", U.host(F.col("target")))
    found = None
    for how, mine, theirs in (("exact", "href", "target"), ("normalised", "own", "t_normal"), ("resolved", "normal", "t_normal"), ("path", "path", "t_path")):
        hit = links.join(known, F.col(mine) == F.col(theirs)).groupBy("page", "element_id", "href").agg(F.min("target").alias("target")).withColumn("how", F.lit(how))
        found = hit if found is None else found.unionByName(hit)
    rest = links.join(found.select("page", "element_id").distinct(), ["page", "element_id"], "left_anti")
    # only pages of the same host with the same first part of the path are compared
    part = lambda c: F.element_at(F.split(c, "/"), 2)
    near = rest.join(known, (F.col("host") == F.col("t_host")) & (part("path") == part("t_path")))
    alike = near.withColumn("s", U.similarity(F.col("normal"), F.col("t_normal"))).where(F.col("s") > least).groupBy("page", "element_id", "href").agg(F.max_by("target", F.struct("s", "target")).alias("target")).withColumn("how", F.lit("similar"))
    rank = F.array_position(F.array(*[F.lit(h) for h in ("exact", "normalised", "resolved", "path", "similar")]), F.col("how"))
    both = found.unionByName(alike)
    order = Window.partitionBy("page", "element_id").orderBy(rank)
    return both.withColumn("n", F.row_number().over(order)).where("n = 1").select("page", "element_id", "target", "how")


def _pairs(left: DataFrame, right: DataFrame, name: str, most_left: int | None = None, most_right: int | None = None) -> DataFrame:
    """(page, source, target, relation): pairs within a page; the first elements of either side, where bounded, in the order of the page."""
    def first(df: DataFrame, most: int | None, alias: str) -> DataFrame:
        ranked = df if most is None else df.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("pos"))).where(F.col("n") <= most)
        return ranked.select("page", F.col("element_id").alias(alias))

    return first(left, most_left, "source").join(first(right, most_right, "target"), "page").where("source != target").withColumn("relation", F.lit(name))


def control_edges(elements: DataFrame) -> DataFrame:
    """A submit button and the elements of forms on its page."""
    return _pairs(elements.where("kind = 'submit'"), elements.where("kind in ('input', 'select', 'checkbox', 'form')"), "controls")


def trigger_edges(elements: DataFrame) -> DataFrame:
    """A button and the first two modals, three forms and two folding contents of its page."""
    buttons = elements.where("kind = 'button'")
    parts = [_pairs(buttons, elements.where(F.col("kind") == k), f"opens_{k}", None, n) for k, n in (("modal", 2), ("form", 3), ("toggle", 2))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def flow_edges(elements: DataFrame, most: int = 2) -> DataFrame:
    """An input and the first elements below it that show results, at most two."""
    i = elements.where("kind in ('input', 'search')").select("page", F.col("element_id").alias("source"), F.col("pos").alias("from"))
    o = elements.where("kind in ('table', 'list', 'result')").select("page", F.col("element_id").alias("target"), F.col("pos").alias("to"))
    # of the outputs below an input only the next ones matter: each gets its number on the page, each input the number of those above it
    numbered = o.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("to")))
    marks = i.select("page", F.col("from").alias("pos"), "source", F.lit(None).cast("string").alias("target")).unionByName(o.select("page", F.col("to").alias("pos"), F.lit(None).cast("string").alias("source"), "target"))
    above = marks.withColumn("above", F.count("target").over(Window.partitionBy("page").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0))).where("source is not null")
    wanted = above.select("page", "source", F.explode(F.sequence(F.col("above") + 1, F.col("above") + most)).alias("k"))
    return wanted.join(numbered.select("page", F.col("k").cast("bigint").alias("k"), "target"), ["page", "k"]).select("page", "source", "target").withColumn("relation", F.lit("fills"))


def capped_page_edges(elements: DataFrame) -> DataFrame:
    """Search fields with tables, inputs with results, buttons with content: the first so many of each side of a page."""
    of = lambda k: elements.where(F.col("kind") == k)
    parts = [_pairs(of("search"), of("table"), "searches", 10, 15), _pairs(of("input"), of("result"), "yields", 20, 25), _pairs(of("button"), of("content"), "acts_on", 10, 20)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def by_mark(elements: DataFrame) -> DataFrame:
    """(page, mark, element_id): the first element of each mark of a page."""
    return elements.where("mark is not null").groupBy("page", "mark").agg(F.min_by("element_id", "pos").alias("element_id"))


def visited_once(states: DataFrame) -> DataFrame:
    """The first visit of each state: an address together with the signature of what it showed."""
    return states.withColumn("n", F.row_number().over(Window.partitionBy("url", "signature").orderBy("visit"))).where("n = 1").drop("n")


def signature(elements: DataFrame, most: int = 20) -> DataFrame:
    """(page, signature): the first kinds and texts of a page in order of the alphabet, as one string."""
    lists = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, most)
    return elements.groupBy("page").agg(F.concat_ws("|", F.array_join(lists("kind"), ","), F.array_join(lists(F.substring("text", 1, 20)), ",")).alias("signature"))
