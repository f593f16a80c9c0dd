"""Pairwise links consolidated into groups by low-diameter decomposition.

Every vertex draws a geometric head start (the whole part of an exponential).
Clusters grow at one link a step; a vertex joins the cluster that reaches it
first, so clusters have a diameter of at most twice ``steps``. Clusters are
contracted to super-vertices and the links between them handled in the same
way, until none is left; then the assignments are composed, the smallest map
first. A link is never lost: a round that keeps clusters apart only leaves
their links to the next.

All state is in DataFrames cut by checkpoint; nothing but counts reaches the
driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonegraph.session import checkpointed

ID_BITS = 58
MASK = (1 << ID_BITS) - 1


def _scrambled(v: Column) -> Column:
    """Ids under 2**58 (as of up to 2**25 partitions) mixed one to one, so that ties between clusters don't follow the order of rows."""
    for left, right in ((17, 31), (23, 29)):
        v = v.bitwiseXOR(F.shiftleft(v, left)).bitwiseAND(F.lit(MASK))
        v = v.bitwiseXOR(F.shiftrightunsigned(v, right))
    return v


def _head_start(v: Column, round_no: int, steps: int, beta: float) -> Column:
    """The arrival of a vertex at itself: its head start, at most ``steps``, above its id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(round_no), v), 11).cast("double") + 1) / float(1 << 53)
    start = F.least(F.floor(-F.ln(u) / beta), F.lit(steps))
    return F.shiftleft(start.cast("bigint"), ID_BITS).bitwiseOR(v)


def with_parts(links: DataFrame, hub: int) -> DataFrame:
    """``links`` (a, b), if there are hubs with ``na`` and ``nb``: into how many parts the links of their ends are split, one for every ``hub`` links.

    Only vertices with more than ``hub`` links are told apart, which are under
    ``2 * links / hub``.
    """
    if links.count() <= hub:
        return links
    ends = links.select(F.col("a").alias("v")).unionAll(links.select("b"))
    hubs = checkpointed(ends.groupBy("v").count().where(F.col("count") > hub).select("v", F.ceil(F.col("count") / hub).cast("int").alias("n")))
    if hubs.isEmpty():
        return links
    for end in ("a", "b"):
        links = links.join(hubs.select(F.col("v").alias(end), F.col("n").alias(f"n{end}")), end, "left").withColumn(f"n{end}", F.coalesce(f"n{end}", F.lit(1)))
    return checkpointed(links.select("a", "b", "na", "nb"))


def _part(other: str, n: str) -> Column:
    """Which part of a vertex' links the one to ``other`` is in."""
    return F.pmod(F.xxhash64(other), F.col(n).cast("bigint")).cast("int")


def _ways(links: DataFrame) -> DataFrame:
    """(src, dst) both ways, and from each vertex to itself, as it also keeps what it has; with hubs also the part of the way out, and of ways to oneself the number of parts ``n``."""
    if "na" not in links.columns:
        both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(links.select("b", "a"))
        return both.unionAll(both.select("src", F.col("src").alias("dst")).distinct())
    out = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), _part("b", "na").alias("part"), F.lit(0).alias("n"))
    back = links.select(F.col("b").alias("src"), F.col("a").alias("dst"), _part("a", "nb").alias("part"), F.lit(0).alias("n"))
    own = links.select(F.col("a").alias("v"), F.col("na").alias("n")).unionAll(links.select("b", "nb")).distinct()
    return out.unionAll(back).unionAll(own.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("part"), "n"))


def decompose(links: DataFrame, round_no: int, steps: int = 8, beta: float = 0.35) -> DataFrame:
    """(v, c), with hubs also n: the cluster of each vertex of ``links`` (a, b: bigint ids under 2**58; see ``with_parts``).

    A hub is joined part by part: each way out of it is in one of its ``n``
    parts, and what it has to tell is handed to each of them.
    """
    ways = checkpointed(_ways(links))
    one, parts = F.lit(1 << ID_BITS), "part" in ways.columns

    def told(value: Column) -> Column:  # a step later at the neighbour; without head start left nothing is passed on
        return F.when(F.col("src") == F.col("dst"), value).when(value >= one, value - one)

    def heard(rows: DataFrame, value: Column) -> DataFrame:
        return rows.groupBy(F.col("dst").alias("v")).agg(F.max(told(value)).alias("val"), *([F.max("n").alias("n")] if parts else []))

    state = heard(ways, _head_start(F.col("src"), round_no, steps, beta))
    for _ in range(steps - 1):
        if parts:
            state = checkpointed(state)
            tells = state.select(F.col("v").alias("src"), "val", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
            state = heard(ways.join(tells, ["src", "part"]), F.col("val"))
        else:
            state = heard(ways.join(state, F.col("src") == F.col("v")), F.col("val"))
    return state.select("v", *(["n"] if parts else []), F.col("val").bitwiseAND(F.lit(MASK)).alias("c"))


def contract(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b): the links between different clusters, each pair once; those of a hub are joined part by part."""
    ends, on = links.select("a", "b"), {"a": ["a"], "b": ["b"]}
    told = {end: clusters.select(F.col("v").alias(end), F.col("c").alias(f"c{end}")) for end in on}
    if "na" in links.columns:
        each = checkpointed(clusters.select("v", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "c"))
        ends, on = links.select("a", "b", _part("b", "na").alias("pa"), _part("a", "nb").alias("pb")), {"a": ["a", "pa"], "b": ["b", "pb"]}
        told = {end: each.select(F.col("v").alias(end), F.col("part").alias(f"p{end}"), F.col("c").alias(f"c{end}")) for end in on}
    for end in on:
        ends = ends.join(told[end], on[end])
    return ends.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def component_ids(links: DataFrame, *, steps: int = 8, beta: float = 0.35, hub: int = 100_000, most_rounds: int = 60) -> DataFrame:
    """(v, c): for each vertex of ``links`` (a, b) an id that all vertices linked with it share."""
    maps = []
    for n in range(most_rounds):
        links = with_parts(links, hub)
        clusters = checkpointed(decompose(links, n, steps, beta))
        maps.append(clusters.select("v", "c"))
        links = checkpointed(contract(links, clusters))
        if links.isEmpty():
            break
    else:
        raise RuntimeError(f"links are left after {most_rounds} rounds")
    whole = maps.pop()
    while maps:
        above = whole.select(F.col("v").alias("c"), F.col("c").alias("top"))
        whole = checkpointed(maps.pop().join(above, "c", "left").select("v", F.coalesce("top", "c").alias("c")))
    return whole


def group_members(pairs: DataFrame, *, a: str, b: str, steps: int = 8, beta: float = 0.35, hub: int = 100_000) -> DataFrame:
    """(group_id, member): each member of ``pairs`` once, with the smallest member linked to it, directly or not.

    A row with two members links them; a row with one (the other null) only
    names it; a row with none is ignored, as are repeated rows and links of a
    member to itself. A member without links is its own group. Strings compare
    by code point. An empty table gives no rows; extra columns are ignored.
    Members with more than ``hub`` links are joined in parts. The groups are
    found when the function is called.
    """
    named = checkpointed(pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct())  # names are made once
    links = named.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    linked = checkpointed(ends.select("member", _scrambled(F.monotonically_increasing_id()).alias("v")))  # ids hold only once they are written
    members = named.select(F.explode(F.array("a", "b")).alias("member")).where("member is not null").distinct()
    if linked.isEmpty():
        return members.select(F.col("member").alias("group_id"), "member")
    numbered = links.join(linked.select(F.col("member").alias("a"), F.col("v").alias("va")), "a").join(linked.select(F.col("member").alias("b"), F.col("v").alias("vb")), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    top = component_ids(checkpointed(numbered), steps=steps, beta=beta, hub=hub)
    placed = checkpointed(linked.join(top, "v").select("member", "c"))
    least = placed.groupBy("c").agg(F.min("member").alias("group_id"))
    grouped = placed.join(least, "c").select("member", "group_id")
    return members.join(grouped, "member", "left").select(F.coalesce("group_id", "member").alias("group_id"), "member")


def letters(c: Column) -> Column:
    """The letters A-Z of a text in upper case, of a to z too; null if there are none."""
    return F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), F.lit(""))


def families(persons: DataFrame) -> DataFrame:
    """(group_id, member) of the persons named; an anonymous end (``yes``) is known on its stone only."""

    def member(name: str, anonymous: str) -> Column:
        plain = letters(F.col(name))
        return F.when(plain.isNotNull() & F.coalesce(F.lower(F.trim(anonymous)) == "yes", F.lit(False)), F.concat(F.coalesce("stone", F.lit("")), F.lit("/"), plain)).otherwise(plain)

    ends = persons.select(member("from_name", "from_anonymous").alias("a"), member("to_name", "to_anonymous").alias("b"))
    return group_members(ends, a="a", b="b")
