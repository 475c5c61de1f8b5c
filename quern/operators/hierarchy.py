"""Parent-child links to full hierarchies.

Nodes are peeled from the bottom. In each round every node without remaining children leaves the table and sends the size of its
subtree to its parent. So that a long chain does not take as many rounds as it has links, a round also takes some nodes with a
single remaining child out of the middle of chains; that child then carries them along and hands them in when it is peeled itself. Both
together need a number of rounds that grows with the logarithm of the number of nodes. What each peeled node was attached to is then
followed back, in the reverse order of peeling, by joins that double the reach each time; this gives the paths and depths. What can
not be peeled are cycles.

Defined results: rows without id are left out; a node that names itself as parent is a cycle; a parent that does not exist makes a root;
of several rows for one id the caller says which holds (``in_force``); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.runtime import Stored, blank, in_force, table

CYCLE = "cycle"


def parents_of(df: DataFrame, node: str, parent: str, children: str) -> DataFrame:
    """(node, parent), one row a node; parent is null for roots.

    The parent is the node's own entry, if not blank; else the node whose list of children names it, the least if several do.
    """
    src = df.select(F.col(f"`{node}`").alias("node"), F.col(f"`{parent}`").alias("own"), F.col(f"`{children}`").alias("children"))
    claims = src.select(F.explode("children").alias("node"), F.col("node").alias("claim")).where("node is not null").groupBy("node").agg(F.min("claim").alias("claim"))
    named = src.join(claims, "node", "left").select("node", F.when(~blank(F.col("own")), F.col("own")).otherwise(F.col("claim")).alias("parent"))
    there = src.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    return named.join(there, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("parent"))


def _round(live: DataFrame, r: int) -> DataFrame:
    """One round: the peeled rows get the number of the round, the others their new parents."""
    kids = live.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    seen = live.join(kids, "node", "left").withColumn("leaf", F.col("kids").isNull())
    total = F.expr("acc + 1 + aggregate(hops, 0L, (s, h) -> s + h.acc + 1)")
    heard = (
        seen.where("parent is not null")
        .groupBy(F.col("parent").alias("node"))
        .agg(F.sum(F.when(F.col("leaf"), total).otherwise(0)).alias("got"), F.sum(F.when(F.col("leaf"), 0).otherwise(1)).alias("rest"))
    )
    told = seen.join(heard, "node", "left")
    peeled = told.where("leaf").select("node", "parent", "acc", "hops", F.lit(r).alias("round"))
    stay = told.where("not leaf").withColumn("acc", F.col("acc") + F.col("got"))
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(r)), F.lit(2))
    taken = F.coalesce((F.col("rest") == 1) & (F.col("parent") != F.col("node")) & (coin("node") == 1) & (coin("parent") == 0), F.lit(False))
    out = stay.where(taken).select(F.col("node").alias("parent"), F.col("parent").alias("up"), F.concat("hops", F.array(F.struct("node", "acc"))).alias("more"))
    moved = stay.where(~taken).join(out, "parent", "left")
    kept = moved.select("node", F.coalesce("up", "parent").alias("parent"), "acc", F.when(F.col("up").isNotNull(), F.concat("more", "hops")).otherwise(F.col("hops")).alias("hops"), F.lit(None).cast("int").alias("round"))
    return peeled.unionByName(kept)


def hierarchy(parents: DataFrame, paths: bool = True, loops: bool = False) -> DataFrame:
    """(node, root, depth, descendants[, path]) from (node, parent).

    ``path`` runs from the root to the node. On cycles and below them root is ``cycle``, depth -1, path and, on the cycle, descendants null.

    With ``loops`` these get a path too: from the node itself upwards until a node would come again, in the order from there to the node; and
    descendants on a cycle are all nodes on and below it but the node.
    """
    kind = parents.schema["node"].dataType.simpleString()
    start = parents.select("node", "parent", F.lit(0).cast("bigint").alias("acc"), F.expr(f"cast(array() as array<struct<node: {kind}, acc: bigint>>)").alias("hops"))
    state, rounds, r = Stored(start), [], 0
    live = state.df
    while True:
        r += 1
        state = Stored(_round(live, r))
        rounds.append(state.df.where("round is not null").drop("round"))
        live = state.df.where("round is null").drop("round")
        if live.where("parent is null or parent != node").isEmpty():
            break
    done = rounds[0]
    for x in rounds[1:]:
        done = done.unionByName(x)
    rows = done.withColumn("loop", F.lit(False)).unionByName(live.withColumn("loop", F.lit(True)))
    # each row stands for its node and the nodes taken out above it: all hang on the same parent, by a longer and longer way
    chain = F.expr("concat(hops, array(struct(node, acc)))")
    below = F.expr("aggregate(slice(chain, i, size(chain)), 0L, (s, h) -> s + h.acc + 1) - 1")
    way = F.expr("transform(slice(chain, 1, i), h -> h.node)") if paths else F.col("i").cast("bigint")
    size = F.when(~F.col("loop"), below)
    if loops:
        # a cycle has become one row, whose chain is the whole cycle: going up from its first node leads to its last
        turned = F.expr("transform(concat(slice(chain, i + 1, size(chain)), slice(chain, 1, i)), h -> h.node)")
        way = F.when(F.col("loop"), turned).otherwise(way) if paths else way
        size = F.when(F.col("loop"), F.expr("aggregate(chain, 0L, (s, h) -> s + h.acc + 1) - 1")).otherwise(below)
    nodes = (
        rows.withColumn("chain", chain)
        .withColumn("i", F.explode(F.expr("sequence(1, size(chain))")))
        .select(F.expr("element_at(chain, i).node").alias("node"), F.when(~F.col("loop"), F.col("parent")).alias("up"), way.alias("way"), size.alias("below"), "loop", F.expr("chain[0].node").alias("top"))
    )
    state = Stored(nodes)
    for _ in range(max(1, r.bit_length())):
        up = state.df.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("way").alias("way2"), F.col("loop").alias("loop2"), F.col("top").alias("top2"))
        longer = F.when(F.col("way2").isNull(), F.col("way")).otherwise(F.concat("way2", "way") if paths else F.col("way2") + F.col("way"))
        before, state = state, Stored(state.df.join(up, "up", "left").select("node", F.col("up2").alias("up"), longer.alias("way"), "below", F.coalesce("loop2", "loop").alias("loop"), F.coalesce("top2", "top").alias("top")))
        before.drop()
    ok = ~F.col("loop")
    depth = F.when(ok, (F.size("way") if paths else F.col("way")) - 1).otherwise(-1).cast("int")
    out = state.df.select("node", F.when(ok, F.col("top")).otherwise(CYCLE).alias("root"), depth.alias("depth"), F.col("below").alias("descendants"), *([(F.col("way") if loops else F.when(ok, F.col("way"))).alias("path")] if paths else []))
    return out


def _chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunk_nodes").select("node_id", "parent_chunk_id", "child_chunk_ids", "ingested_at")
    return parents_of(in_force(rows, "node_id", "ingested_at"), "node_id", "parent_chunk_id", "child_chunk_ids")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(_chunk_parents(spark, sf_dir), paths=False).select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and number of descendants of every node; root ``cycle`` and depth -1 mark those that reach no root."""
    found = hierarchy(_chunk_parents(spark, sf_dir), loops=True)
    return found.select(F.col("node").alias("node_id"), F.array_join("path", "/").alias("path"), "depth", F.col("root").alias("root_id"), "descendants")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each node and each node below it, also on and below cycles, where the distance is that of the first way up.

    A list a node would not fit into one row for the root of a large tree.
    """
    found = hierarchy(_chunk_parents(spark, sf_dir), loops=True)
    each = found.select(F.posexplode("path").alias("i", "node_id"), F.col("node").alias("descendant"), (F.size("path") - 1).alias("last")).where("node_id != descendant")
    return each.select("node_id", "descendant", (F.col("last") - F.col("i")).alias("distance"))
