"""Closure, components and chains over edges; loops with a checkpoint each round and counts only on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonegraph.session import checkpointed


def closure(edges: DataFrame, *, child: str, parent: str, reflexive: bool = True, most_rounds: int = 60) -> DataFrame:
    """(node, ancestor): all that is reachable along the edges, and each node itself if ``reflexive``.

    Paths double each round, so chains of length n take log n rounds; circles
    do no harm. Rows with a null end are left out.
    """
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    reach, size = checkpointed(e), -1
    for _ in range(most_rounds):
        step = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"))
        reach = checkpointed(reach.union(step).distinct())
        now = reach.count()
        if now == size:
            break
        size = now
    else:
        raise RuntimeError("the closure did not settle")
    if reflexive:
        reach = reach.union(e.select(F.explode(F.array("node", "ancestor")).alias("node")).select("node", F.col("node").alias("ancestor"))).distinct()
    return reach


def components(edges: DataFrame, *, a: str, b: str, most_rounds: int = 80) -> DataFrame:
    """(node, component): the smallest node linked to each one, by turns of large-star and small-star linking, which never gather a hub's neighbours in one row."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    alone = e.where("u = v").select(F.col("u").alias("node")).distinct()
    e = checkpointed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        mark = e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("the components did not settle")
    linked = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
    return linked.union(alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))


def chase(aliases: DataFrame, *, name: str, target: str) -> DataFrame:
    """(name, canonical): the end of each chain of aliases, however long.

    A chain that leaves the list ends at the name it leads to; one that runs
    into a circle ends at the circle's smallest member. A null or empty target
    ends a chain, a null name is left out, and of several targets of a name the
    greatest counts. Jumps double each round, so ``n`` aliases settle in about
    ``log2(n)`` rounds; RuntimeError if they haven't after 64.
    """
    listed = aliases.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.max(F.nullif(F.col(target), F.lit(""))).alias("next"))
    # to: the place after ``reach`` steps, or the end (done); low: the smallest name on the way there
    at = checkpointed(listed.select("name", F.coalesce("next", "name").alias("to"), F.least("name", F.coalesce("next", "name")).alias("low"), F.col("next").isNull().alias("done")))
    before, reach = -1, 1
    for _ in range(64):
        jump = at.select(F.col("name").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        open_ = at.where("not done").join(jump, "to", "left")
        moved = open_.select("name", F.coalesce("to2", "to").alias("to"), F.coalesce(F.least("low", "low2"), "low").alias("low"), F.coalesce("done2", F.lit(True)).alias("done"))
        at, reach = checkpointed(at.where("done").unionByName(moved)), 2 * reach
        left = at.where("not done").count()
        if not left or (left == before and reach >= left):  # nothing but circles and what runs into them
            break
        before = left
    else:
        raise RuntimeError("the aliases did not settle")
    if left:
        ends = at.where("not done").select(F.col("name").alias("to"), F.col("low").alias("end"))
        at = at.join(ends, "to", "left").withColumn("to", F.when(F.col("done"), F.col("to")).otherwise(F.col("end")))
    return at.select("name", F.col("to").alias("canonical"))


def hierarchy_pairs(df: DataFrame, *, key: str, chain: str) -> DataFrame:
    """Neighbours in each narrow-to-broad chain of labels: key, narrow, broad, both as keys that carry their whole ancestry."""
    suffixes = F.transform(F.sequence(F.lit(1), F.size(chain)), lambda i: F.array_join(F.reverse(F.slice(F.col(chain), i, F.size(chain))), " > "))
    pairs = F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("narrow"), F.slice("s", F.lit(2), F.size("s") - 1).alias("broad"))
    return df.where(F.size(chain) > 1).select(key, suffixes.alias("s")).select(key, F.inline(pairs))


def bridges(mentions: DataFrame, *, name: str, place: str) -> DataFrame:
    """(name, place, first): places that share a name, tied to the smallest of them.

    Every two places of a name are linked by way of its first, so a name met
    everywhere gives a row for each place and not one for each pair. These are
    hypotheses, to be kept apart from components of asserted links.
    """
    once = mentions.where((F.length(name) > 0) & F.col(place).isNotNull()).select(F.col(name).alias("name"), F.col(place).alias("place")).distinct()
    first = once.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("_n")).where("_n > 1")
    return once.join(first, "name").where("place <> first").select("name", "place", "first")
