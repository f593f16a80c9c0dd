"""Faceted views, density maps and gap reports over records."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonegraph.functions import geo
from stonegraph.session import checkpointed


def faceted(df: DataFrame, *, among: dict[str, list] | None = None, flags: list[Column] | None = None, term: str = "", search: list[str] | None = None) -> DataFrame:
    """Rows whose columns are among the chosen values, for which all flags hold, and whose searched columns hold the term in any case."""
    conds = [F.col(c).isin(v) for c, v in (among or {}).items() if v] + list(flags or [])
    if term:
        conds.append(F.contains(F.lower(F.concat_ws(" ", *(search or []))), F.lit(term.lower())))
    return df.where(reduce(lambda x, y: x & y, conds)) if conds else df


def facet_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass: grouping sets."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns)))
    return df.select(pairs.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def hexbin(points: DataFrame, *, lat: str, lon: str, size: float, scale: str = "log") -> DataFrame:
    """(q, r, n, step): points counted in hexagonal cells, and the colour step of each count; latitudes are stretched by the mean latitude of the points given."""
    p = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    mean = p.agg(F.avg(F.col(lat).cast("decimal(20,9)")).cast("double")).first()[0]
    stretch = 1 / math.cos(math.radians(mean or 0.0))
    cells = p.select(geo.hex_cell(F.col(lon), F.col(lat), F.lit(stretch), size).alias("c")).groupBy("c.q", "c.r").agg(F.count("*").alias("n"))
    cells = checkpointed(cells)
    most = cells.agg(F.max("n")).first()[0] or 1
    return cells.select("q", "r", "n", geo.hex_band(F.col("n"), F.lit(most), scale).alias("step"))


def legend(cells: DataFrame) -> DataFrame:
    """(step, cells, least, most) of the steps that occur."""
    return cells.groupBy("step").agg(F.count("*").alias("cells"), F.min("n").alias("least"), F.max("n").alias("most"))


def gap_counts(df: DataFrame, gaps: dict[str, Column]) -> DataFrame:
    """One row with the number of rows in each gap."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in gaps.items()))


def points_geojson(df: DataFrame, *, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """(feature): a GeoJSON point per located row, without its empty properties."""
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in properties)), lambda x: F.coalesce(x["v"], F.lit("")) != "")
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.map_from_entries(pairs).alias("properties"))).alias("feature"))


def slim(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """(record): each row as compact JSON for a page: columns under short names, empty values left out."""
    fields = [F.when(F.length(F.col(c).cast("string")) > 0, F.col(c)).alias(short) for c, short in names.items()]
    return df.select(F.to_json(F.struct(*fields)).alias("record"))


def centroids(points: DataFrame, *, key: str, lat: str, lon: str) -> DataFrame:
    """(key, lat, lon, n): the mean of each key's points, summed as decimals so that the order of rows changes nothing."""
    there = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return there.groupBy(key).agg(*(F.avg(F.col(c).cast("decimal(20,9)")).cast("double").alias(name) for c, name in ((lat, "lat"), (lon, "lon"))), F.count("*").alias("n"))
