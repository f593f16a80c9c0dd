"""Summaries, roll-ups and report rows over records, each a partial aggregation or a window over a summary's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonegraph.functions import text
from stonegraph.session import checkpointed, shuffle_partitions


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """A summary's rows numbered from 1 in a total order. For summaries only: all rows meet in one task; see ``numbered_globally`` for tables."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def numbered_globally(df: DataFrame, *, order: list[str], name: str = "no") -> DataFrame:
    """All rows numbered from 0 in the total order of ``order``, nulls first.

    The rows are parted by ranges and numbered within each part; the parts'
    sizes, a number for each partition, are all that reaches the driver. Rows
    alike in ``order`` are numbered in any order among themselves.
    """
    parts = checkpointed(df.repartitionByRange(shuffle_partitions(df.sparkSession), *(F.asc_nulls_first(c) for c in order)).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    begin = df.sparkSession.createDataFrame(offsets, "_part int, _begin bigint")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*(F.asc_nulls_first(c) for c in order)))
    return parts.withColumn("_at", at).join(F.broadcast(begin), "_part").withColumn(name, F.col("_begin") + F.col("_at") - 1).drop("_part", "_at", "_begin")


def dissent_summary(compared: DataFrame, *, key: str, editor: str, ratio: str, at_stake: Column) -> DataFrame:
    """One row: stones, comparisons, editors, and stones with formula words at stake."""
    return compared.agg(F.countDistinct(key).alias("stones"), F.count("*").alias("comparisons"), F.countDistinct(editor).alias("editors"), F.countDistinct(F.when(at_stake, F.col(key))).alias("at_stake"))


def dissent_histogram(compared: DataFrame, *, key: str, editor: str, ratio: str) -> DataFrame:
    """(dimension, value, band, n): stones by the band of their least similarity, and comparisons by editor and band."""
    stones = compared.groupBy(key).agg(text.band(F.min(ratio)).alias("band")).groupBy("band").agg(F.count("*").alias("n")).select(F.lit("stone").alias("dimension"), F.lit("").alias("value"), "band", "n")
    editors = compared.groupBy(F.col(editor).alias("value"), text.band(F.col(ratio)).alias("band")).agg(F.count("*").alias("n")).select(F.lit("editor").alias("dimension"), "value", "band", "n")
    return stones.unionByName(editors)


def component_rollup(edges: DataFrame, members: DataFrame, *, a: str, b: str, place: str) -> DataFrame:
    """(component, nodes, edges, places, rank) of linked groups: ``members`` has node and component, ``edges`` the ends ``a`` and ``b`` and where each edge is; ranked by places, then nodes, then name."""
    at = edges.join(members.withColumnRenamed("node", a), a)
    drawn = at.groupBy("component").agg(F.count("*").alias("edges"), F.countDistinct(place).alias("places"))
    held = members.groupBy("component").agg(F.count("*").alias("nodes"))
    return ranked(held.join(drawn, "component"), F.desc("places"), F.desc("nodes"), F.asc("component"))


def located_summary(holders: DataFrame) -> DataFrame:
    """One row: holders located, in all, and aliases (which count for neither)."""
    alias = F.length(F.coalesce("alias_of", F.lit(""))) > 0
    there = (F.length(F.coalesce("lat", F.lit(""))) > 0) & (F.length(F.coalesce("lon", F.lit(""))) > 0)
    return holders.agg(F.count_if(~alias & there).alias("located"), F.count_if(~alias).alias("total"), F.count_if(alias).alias("aliases"))


def manifest_counts(files: DataFrame, *, by: str, path: str, edition: Column) -> DataFrame:
    """(by, files, editions): the different files of each snapshot and how many of them are editions."""
    return files.groupBy(by).agg(F.countDistinct(path).alias("files"), F.countDistinct(F.when(edition, F.col(path))).alias("editions"))


def cross_border(records: DataFrame, homes: DataFrame, *, holder: str, country: str) -> DataFrame:
    """Records with ``home``, their holder's country, and ``abroad``: whether that is another one; without a home it isn't."""
    joined = records.join(homes.withColumnRenamed(country, "home"), holder, "left")
    return joined.withColumn("abroad", F.coalesce(F.col("home") != F.col(country), F.lit(False)))


def broken_links(pages: DataFrame, *, key: str, state: str, page: str) -> DataFrame:
    """(state, n, example) of the links that can't be resolved; the example is that of the smallest key."""
    bad = pages.where(~F.col(state).isin("ok", "none"))
    return bad.groupBy(state).agg(F.count("*").alias("n"), F.min_by(page, key).alias("example"))


def worklist_rows(places: DataFrame, gaps: dict[str, Column], *, key: str, county: list[str], place: list[str]) -> DataFrame:
    """Records with gaps, in the order (series, county, id): series and its label, the gaps' names, and the first county and place that are given.

    Numbered with ``numbered_globally``, so the list may be as long as the table.
    """
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in gaps.items())), lambda x: x.isNotNull())
    series = text.series(F.col(key))
    label = F.when(series == "", "numbered").when(series == "L", "lost").when(series == "X", "doubtful").otherwise("other")

    def given(names: list[str]) -> Column:
        return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names), F.lit(""))

    rows = places.select(F.col(key).alias("id"), series.alias("series"), label.alias("series_label"), F.array_join(found, "; ").alias("gaps"), given(county).alias("county"), given(place).alias("place")).where("gaps <> ''")
    return numbered_globally(rows, order=["series", "county", "id"], name="row_no")


def tag_tally(tags: DataFrame, *, status: str) -> DataFrame:
    """(status, tags, uses) of classified tags."""
    return tags.groupBy(status).agg(F.count("*").alias("tags"), F.sum("total").alias("uses"))


def graph_summary(graph: DataFrame, classes: dict[str, str]) -> DataFrame:
    """(figure, n): different nodes of each class, and triples. ``classes``: the class of each figure."""
    typed = graph.where((F.col("kind") == "uri") & F.col("p").endswith("#type"))
    counts = typed.agg(*(F.countDistinct(F.when(F.col("o") == c, F.col("s"))).alias(n) for n, c in classes.items()))
    whole = graph.agg(F.count("*").alias("triples"))
    rows = counts.select(F.explode(F.create_map(*(x for n in classes for x in (F.lit(n), F.col(n))))).alias("figure", "n"))
    return rows.unionByName(whole.select(F.lit("triples").alias("figure"), F.col("triples").alias("n")))


def violation_counts(found: DataFrame, *, by: list[str], node: str) -> DataFrame:
    """(by, n, example): violations of each rule with the smallest node, most first (``rank``)."""
    return ranked(found.groupBy(*by).agg(F.count("*").alias("n"), F.min(node).alias("example")), F.desc("n"), *map(F.asc, by))


def hits_by_word(hits: DataFrame, *, word: str, mode: str, stone: str, reading: str) -> DataFrame:
    """(key, stones): each word's stones with the readings it is met in, as a map of arrays, keyed ``word|mode``."""
    each = hits.groupBy(F.concat_ws("|", word, mode).alias("key"), F.col(stone).alias("stone")).agg(F.array_sort(F.collect_set(reading)).alias("readings"))
    return each.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stone", "readings")))).alias("stones"))


def markdown_cells(c: Column, most: int = 44) -> Column:
    """A value for a cell of a Markdown table: bars escaped, cut to ``most`` characters."""
    return F.replace(F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c), F.lit("|"), F.lit("\\|"))
