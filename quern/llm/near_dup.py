"""Groups of texts whose word sets are alike.

An exact set-similarity join that skips by the relations between sets.

*Relations.* Equal sets are one class. Sets with the same sketch (three minima) that differ from the least of them in a tenth at most follow it,
their leader. 1 - likeness is a metric, so what holds for two leaders bounds what holds for their followers: most answers of a follower
are derived from its leader's answers and the two distances, all those inside a group are, and only what the bounds leave open is compared in full.

*Index lists.* The words of each set stand in one order, rare ones first. Sets that are alike share one of their first words, and if that
is a frequent one, at least two of their first words, and so on. So the lists are kept for rare words and for pairs of frequent words; a
pair whose list would be long, as a sample shows, gives way to its triples, and these to fours. Each list is sorted by size of set and position of the word, and cut into
blocks. A block tells how many words a set can at best share with its sets, and is skipped as a whole when that is too few. What is left is compared
by 128 parity bits, in which two sets differ at most as often as in their words. A follower stands in the lists its leader is not in, only.
Lists that stay long are dealt out.

Defined results: texts without words (null, empty, blank, punctuation) are like nothing; repeated rows with one id are one row; rows
without id are left out; texts may be as long as they like; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.words import overlap, word_set
from quern.plans.runtime import stored, table

LEAST = 0.7
#: Words in at least this share of the sets, or in more than LONG sets, are frequent. At most so many are kept as such (16 bytes each), the most
#: frequent ones; any choice gives the same pairs.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST = 0.02, 16, 65_536
#: A list with more sets than this is long. Which are is estimated from one set in SAMPLED; at most KEYS_MOST keys are told to all tasks (8 bytes each).
LONG, SAMPLED, KEYS_MOST = 4096, 16, 2**18
#: Most words of a key.
DEEPEST = 4
#: Sets up to this size get lists for combinations of frequent words, longer ones (and those they can be like) for each frequent word and class of sizes.
PAIRS_UP_TO = 400
BLOCK = 64
EPS = 1e-9


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parity_bits(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits a set: each word flips one."""
    h = _mix(words)
    bit = np.uint64(1) << (h & np.uint64(63))
    high = (h >> np.uint64(6)) & np.uint64(1) == 1
    low, up = (np.bitwise_xor.reduceat(np.where(m, bit, np.uint64(0)), offsets) for m in (~high, high))
    return low.view(np.int64), up.view(np.int64)


def entries(words: np.ndarray, sizes: np.ndarray, space: np.ndarray, frequent: np.ndarray, rank: np.ndarray, long: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of sets given back to back: list key, number of the set, position.

    ``space`` parts the sets of different tables; ``frequent`` are the frequent words, sorted, with their ``rank`` by frequency; ``long`` the
    keys, sorted, that are to be made longer by another word.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    often, at = _found(words.view(np.uint64), frequent.view(np.uint64))
    order = np.lexsort((words, np.where(often, rank[at] + 1 if len(frequent) else 0, 0), row))
    words, often = words[order].view(np.uint64), often[order]
    n = sizes[row]
    pos = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = n - np.ceil(least * n - EPS).astype(np.int64) + 1
    tag = _mix(space[row].astype(np.uint64) + np.uint64(77))
    longs = n > least * PAIRS_UP_TO
    # rare words, and for long sets every frequent one too: in the list of their class of sizes and in that of the next smaller class
    one = np.flatnonzero((pos < first) & ~often)
    each = np.flatnonzero((pos < first) & often & longs)
    step = np.floor(np.log(np.maximum(n[each], 1)) / -np.log(least) + EPS).astype(np.uint64) if least < 1 else n[each].astype(np.uint64)
    keys, who, where = [_mix(words[one] ^ tag[one])], [row[one]], [pos[one]]
    for k in (0, 1):
        keys.append(_mix(_mix(words[each] ^ tag[each] ^ np.uint64(5)) + step - np.uint64(k)))
        who.append(row[each])
        where.append(pos[each])
    able = often & (n <= PAIRS_UP_TO)
    # combinations of d words stand within the first + d - 1 words; those that are too frequent are carried on to d + 1
    last, key = np.flatnonzero(able & (pos < first + 1)), None
    key = _mix(words[last] ^ tag[last])
    for d in range(2, DEEPEST + 1):
        new_last, new_key = [], []
        step = 1
        while True:
            to = last + step
            k = np.flatnonzero(to < len(words))
            k = k[(row[to[k]] == row[last[k]]) & (pos[to[k]] < first[to[k]] + d - 1)]
            if not len(k):
                break
            new_last.append(to[k])
            new_key.append(_mix(key[k] + words[to[k]]))
            step += 1
        if not new_last:
            break
        last, key = np.concatenate(new_last), np.concatenate(new_key)
        more = _found(key, long)[0] if d < DEEPEST else np.zeros(len(key), bool)
        keys.append(key[~more])
        who.append(row[last[~more]])
        where.append(pos[last[~more]] - (d - 1))
        last, key = last[more], key[more]
    return np.concatenate(keys), np.concatenate(who), np.concatenate(where)


def _found(x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``x`` are in a sorted array, and where."""
    if not len(among):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x, at


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hash of three minima of each set."""
    for batch in batches:
        words, sizes = _lists(batch.column("words"))
        offsets, key = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint64)
        for seed in (11, 12, 13):
            key = _mix(key + np.minimum.reduceat(_mix(words.view(np.uint64) ^ _mix(np.array([seed], np.uint64))), offsets)) if len(sizes) else key
        yield pa.RecordBatch.from_arrays([batch.column("space"), batch.column("id"), pa.array(key.view(np.int64))], names=["space", "id", "sketch"])


def _index(frequent: np.ndarray, rank: np.ndarray, long: np.ndarray, least: float):
    """Entries of the sets (space, id, group, slack, words, lead); ``lead``: the words of a follower's leader, whose lists it is not put into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words, sizes = _lists(part.column("words"))
                low, up = parity_bits(words.view(np.uint64), np.cumsum(sizes) - sizes)
                space = part.column("space").to_numpy(zero_copy_only=False)
                keys, who, where = entries(words, sizes, space, frequent, rank, long, least)
                led, lead_sizes = _lists(part.column("lead"))
                follows = np.flatnonzero(lead_sizes)
                if len(follows):
                    theirs, whose, _ = entries(led, lead_sizes[follows], space[follows], frequent, rank, long, least)
                    tell = lambda k, w: _mix(k + _mix(w.astype(np.uint64)))
                    own = ~np.isin(tell(keys, who), tell(theirs, follows[whose]))
                    keys, who, where = keys[own], who[own], where[own]
                slack = part.column("slack").to_numpy(zero_copy_only=False).astype(np.int64)
                cols = [keys.view(np.int64), part.column("group").to_numpy()[who], (space[who].astype(np.int64) << 48) | (sizes[who] << 24) | where, slack[who], low[who], up[who]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "id", "at", "slack", "b0", "b1"])

    return run


class AlikeSets:
    """Rows with alike word sets, per ``space``.

    ``members``: space, id, class (the least id with that set); ``pairs``: space, a, b (classes, a < b).
    """

    def __init__(self, rows: DataFrame, least: float = LEAST) -> None:
        """``rows``: space int, id bigint, text string."""
        if not 0.5 <= least <= 1:
            raise ValueError("the likeness must be between 0.5 and 1")
        self.least = least
        sets = rows.where("id is not null").select("space", "id", "text", word_set(F.col("text")).alias("words")).where(F.size("words") > 0)
        keyed = sets.select("space", "id", "text", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))
        classes = keyed.groupBy("space", "h1", "h2").agg(F.min(F.struct("id", "text")).alias("rep"), F.count("*").alias("size"))
        kept = stored(classes.select("space", "h1", "h2", F.col("rep.id").alias("id"), F.col("rep.text").alias("text"), "size"))
        crowded = kept.where("size > 1").select("space", "h1", "h2", F.col("id").alias("class"))
        copies = keyed.select("space", "id", "h1", "h2").join(crowded, ["space", "h1", "h2"]).select("space", "id", "class").distinct()
        #: rows of classes with more than one row; every other row is its own class
        self.copies = copies
        self.reps = kept.select("space", "id", word_set(F.col("text")).alias("words"))
        self.count = kept.count()
        #: space, id, leader, far (1 - likeness) of the followers
        self.followers = stored(self._followers())
        #: space, group, id, far of the classes in groups of more than one; leaders too
        leaders = self.followers.select("space", F.col("leader").alias("group")).distinct()
        self.grouped = self.followers.select("space", F.col("leader").alias("group"), "id", "far").unionByName(leaders.select("space", "group", F.col("group").alias("id"), F.lit(0.0).alias("far")))
        self.across = stored(self._across())

    def _followers(self) -> DataFrame:
        sketched = self.reps.mapInArrow(_sketch, "space int, id bigint, sketch bigint")
        lead = sketched.groupBy("space", "sketch").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
        led = stored(sketched.join(lead, ["space", "sketch"]).where("id != leader").select("space", "id", "leader"))
        words = lambda c, w: self.reps.select("space", F.col("id").alias(c), F.col("words").alias(w))
        both = led.join(words("id", "words"), ["space", "id"]).join(words("leader", "lead"), ["space", "leader"])
        common = overlap(F.col("words"), F.col("lead"))
        either = F.size("words") + F.size("lead") - common
        told = both.select("space", "id", "leader", "words", "lead", (either - common).alias("differ"), (1 - common / either).alias("far"))
        return told.where(F.col("far") <= (1 - self.least) / 3 + EPS)

    def _met(self) -> DataFrame:
        """Pairs of groups (by their leaders) that no filter tells apart."""
        least = self.least
        bound = max(FREQUENT_LEAST, min(FREQUENT_SHARE * self.count, LONG))
        often = self.reps.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= bound).orderBy(F.desc("count"), "word").limit(FREQUENT_MOST).toArrow()
        word = often.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        frequent, rank = word[order], (len(word) - 1 - np.arange(len(word)))[order]
        slack = self.followers.groupBy("space", F.col("leader").alias("id")).agg(F.max("differ").alias("slack"))
        led = self.followers.select("space", "id", F.col("leader").alias("group"), "lead")
        ready = (
            self.reps.join(led, ["space", "id"], "left")
            .join(slack, ["space", "id"], "left")
            .select("space", "id", F.coalesce("group", "id").alias("group"), F.coalesce("slack", F.lit(0)).cast("int").alias("slack"), "words", F.coalesce("lead", F.array().cast("array<bigint>")).alias("lead"))
        )
        schema = "key bigint, id bigint, at bigint, slack bigint, b0 bigint, b1 bigint"
        some = ready.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(SAMPLED)) == 0)
        long = np.zeros(0, np.uint64)
        # keys grow until no sampled list is long; what is still long at the end is dealt out
        for _ in range(DEEPEST - 1):
            counted = some.mapInArrow(_index(frequent, rank, long, least), schema).groupBy("key").agg((F.count("*") * SAMPLED).alias("n")).where(F.col("n") > LONG)
            counted = stored(counted.orderBy(F.desc("n"), "key").limit(KEYS_MOST))
            found = np.sort(counted.select("key").toArrow().column("key").to_numpy().view(np.uint64))
            if not len(np.setdiff1d(found, long)):
                break
            long = np.union1d(long, found)[:KEYS_MOST]
        # one number holds table, size and position, in this order: the rows are many
        lists = ready.mapInArrow(_index(frequent, rank, long, least), schema)
        place = ["key"]
        if counted.isEmpty():
            lists = probes = lists.repartition("key")
        else:
            place = ["key", "part"]
            dealt = lists.join(counted.select("key", F.ceil(F.col("n") / LONG).cast("int").alias("parts")), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            lists = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
            probes = dealt.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
        space, n, pos = (lambda c: F.shiftright(c, 48)), (lambda c: F.shiftright(c, 24).bitwiseAND(F.lit(0xFFFFFF))), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFF)))
        number = F.row_number().over(Window.partitionBy(*place).orderBy("at", "id"))
        blocks = (
            lists.withColumn("block", F.floor((number - 1) / BLOCK))
            .groupBy(*place, "block")
            .agg(F.collect_list(F.struct("id", "at", "slack", "b0", "b1")).alias("sets"), F.min(n("at") - F.col("slack")).alias("n_from"), F.max(n("at") + F.col("slack")).alias("n_to"), F.max(n("at") - pos("at") + F.col("slack")).alias("left"))
        )
        need = lambda n, m: F.ceil(F.lit(least / (1 + least)) * (n + m) - EPS)
        probe = probes.select(*place, F.col("id").alias("pid"), n("at").alias("pn"), pos("at").alias("ppos"), space("at").alias("pspace"), F.col("slack").alias("ps"), F.col("b0").alias("p0"), F.col("b1").alias("p1"))
        # sizes of the sets that an entry stands for differ from its own by its slack at most, and so does what they share
        p_from, p_to, p_left = F.col("pn") - F.col("ps"), F.col("pn") + F.col("ps"), F.col("pn") - F.col("ppos") + F.col("ps")
        useful = (F.col("n_from") <= p_to) & (F.col("n_to") >= F.lit(least) * p_from - EPS) & (F.col("left") + F.col("ps") >= need(F.col("n_from"), p_from))
        each = probe.join(blocks, place).where(useful).select("pid", "pn", "ppos", "ps", "p0", "p1", "pspace", F.inline("sets")).withColumns({"n": n("at"), "pos": pos("at"), "space": space("at").cast("int")})
        one_way = (F.col("n") < F.col("pn")) | ((F.col("n") == F.col("pn")) & (F.col("id") < F.col("pid")))
        both = F.col("slack") + F.col("ps")
        fits = (F.col("n") + F.col("slack") >= F.lit(least) * p_from - EPS) & (F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("ppos")) + both >= need(F.col("n") - F.col("slack"), p_from))
        apart = F.bit_count(F.col("b0").bitwiseXOR(F.col("p0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("p1")))
        close = F.when(both == 0, apart <= F.col("n") + F.col("pn") - 2 * need(F.col("n"), F.col("pn"))).otherwise(apart <= F.lit((1 - least) / (1 + least)) * (F.col("n") + F.col("pn") + both) + both + EPS)
        met = each.where((F.col("space") == F.col("pspace")) & one_way & (F.col("id") != F.col("pid")) & fits & close)
        return met.select("space", F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct()

    def _across(self) -> DataFrame:
        """(space, a, b): pairs of classes of different groups."""
        least, far = self.least, 1 - self.least
        met = stored(self._met())
        radius = self.followers.groupBy("space", F.col("leader").alias("id")).agg(F.max("far").alias("radius"))
        some = met.select("space", F.explode(F.array("a", "b")).alias("id")).distinct()
        words = stored(self.reps.join(some, ["space", "id"], "left_semi").join(radius, ["space", "id"], "left").withColumn("radius", F.coalesce("radius", F.lit(0.0))))
        of = lambda df, c: df.select("space", F.col("id").alias(c), F.col("words").alias(f"w_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in df.columns if x == "radius"])
        common = overlap(F.col("w_a"), F.col("w_b"))
        either = F.size("w_a") + F.size("w_b")
        alike = lambda c: c >= F.lit(least) * (either - c) - EPS
        told = met.join(of(words, "a"), ["space", "a"]).join(of(words, "b"), ["space", "b"]).withColumn("common", common).withColumn("dist", 1 - F.col("common") / (either - F.col("common")))
        told = stored(told.where(F.col("dist") <= far + F.col("radius_a") + F.col("radius_b") + EPS).select("space", "a", "b", "dist", alike(F.col("common")).alias("alike"), (F.col("radius_a") + F.col("radius_b")).alias("radius")))
        single = told.where("radius = 0 and alike").select("space", "a", "b")
        member = lambda c: self.grouped.select("space", F.col("group").alias(c), F.col("id").alias(f"m_{c}"), F.col("far").alias(f"far_{c}"))
        open_ = told.where("radius > 0").join(member("a"), ["space", "a"], "left").join(member("b"), ["space", "b"], "left")
        open_ = open_.select("space", F.coalesce("m_a", "a").alias("a"), F.coalesce("m_b", "b").alias("b"), "dist", (F.coalesce("far_a", F.lit(0.0)) + F.coalesce("far_b", F.lit(0.0))).alias("off"))
        # what the distances decide by themselves, and what they leave open
        open_ = stored(open_.where(F.col("dist") - F.col("off") <= far + EPS))
        sure = open_.where(F.col("dist") + F.col("off") <= far - EPS).select("space", "a", "b")
        asked = open_.where(F.col("dist") + F.col("off") > far - EPS).select("space", "a", "b")
        full = of(self.reps, "a"), of(self.reps, "b")
        checked = asked.join(full[0], ["space", "a"]).join(full[1], ["space", "b"]).where(alike(common)).select("space", "a", "b")
        out = single.unionByName(sure).unionByName(checked)
        return out.select("space", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    @property
    def pairs(self) -> DataFrame:
        """(space, a, b): all pairs of alike classes; those inside a group are alike by their distances to the leader."""
        one = lambda c: self.grouped.select("space", "group", F.col("id").alias(c))
        inside = one("a").join(one("b"), ["space", "group"]).where("a < b").select("space", "a", "b")
        return self.across.unionByName(inside)

    def links(self) -> DataFrame:
        """(space, class, links): to how many classes each class is linked; groups are counted, not spelled out."""
        sizes = self.grouped.groupBy("space", "group").agg((F.count("*") - 1).alias("links"))
        inside = self.grouped.join(sizes, ["space", "group"]).select("space", F.col("id").alias("class"), "links")
        outside = self.across.select("space", F.explode(F.array("a", "b")).alias("class")).groupBy("space", "class").agg(F.count("*").alias("links"))
        return inside.unionByName(outside).groupBy("space", "class").agg(F.sum("links").alias("links"))

    def row_pairs(self) -> DataFrame:
        """(space, row_a, row_b): every pair of alike rows, the classes spelled out."""
        one = self.copies.select("space", F.col("class"), F.col("id"))

        def spelled(df: DataFrame, c: str) -> DataFrame:
            more = one.select("space", F.col("class").alias(c), F.col("id").alias(f"row_{c}"))
            return df.join(more, ["space", c], "left").withColumn(f"row_{c}", F.coalesce(f"row_{c}", c))

        across = spelled(spelled(self.pairs, "a"), "b").select("space", F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b"))
        within = one.select("space", "class", F.col("id").alias("row_a")).join(one.select("space", "class", F.col("id").alias("row_b")), ["space", "class"]).where("row_a < row_b").select("space", "row_a", "row_b")
        return across.unionByName(within)


TABLES = ("training_samples", "text_task_templates")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "training_samples").select(F.lit(0).alias("space"), F.col("row_id").alias("id"), F.col("prompt").alias("text"))
    return samples.unionByName(table(spark, sf_dir, "text_task_templates").select(F.lit(1).alias("space"), F.col("row_id").alias("id"), F.col("prompt_template").alias("text")))


def _name(c):
    return F.element_at(F.array(*[F.lit(t) for t in TABLES]), c + 1)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AlikeSets(_prompts(spark, sf_dir)).row_pairs().select(_name(F.col("space")).alias("table_name"), "row_a", "row_b")


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row that is like another: its class of equal word sets and the number of classes its class is linked to."""
    found = AlikeSets(_prompts(spark, sf_dir))
    ends = found.links()
    copies = found.copies
    single = ends.join(copies.select("space", "class").distinct(), ["space", "class"], "left_anti").select("space", F.col("class").alias("id"), "class")
    rows = copies.unionByName(single).join(ends, ["space", "class"], "left")
    return rows.select(_name(F.col("space")).alias("table_name"), F.col("id").alias("row_id"), F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
