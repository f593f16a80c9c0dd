"""Writers: CSV with fixed fields, N-Triples, GeoJSON lines, manifests and Markdown tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonegraph.functions.text import PLACE_LEVELS
from stonegraph.operators import triples, views
from stonegraph.session import bounded_rows


# The fields of each report, in order.
FIELDS = {
    "places": ["file", "ogham_id", "stone_key", "title", "ciic", "cisp", "cisp_url", "tm", "smr", "repository", *(f"pn_{level}" for level in PLACE_LEVELS), "pn_vernacular", "geo_source", "geo_note", "geo_qid", "geo_settled", "gazetteer_uris", "geo_raw", "geo_cert", "geo_hedge", "geo_status", "lat", "lon", "grid_raw", "origplace_text"],
    "words": ["ogham_id", "ciic", "title", "reading_id", "editor", "script", "is_current_edition", "word", "mode", "variant", "token", "translation", "wikidata", "reference", "reading_text"],
    "readings": ["ogham_id", "ciic", "title", "script", "editor", "similarity", "band", "formula_gained", "formula_lost", "only_in_current_edition", "only_in_this_reading", "current_edition_text", "this_reading_text"],
    "persons": ["stone", "from_name", "relation_lemma", "relation_surface", "relation_gloss", "to_name", "object_is_kin_group", "uncertain", "from_anonymous", "to_anonymous"],
    "setting": ["ogham_id", "ciic", "title", "county", "country", "custody", "category", "key", "method", "repository", "observed"],
    "keepers": ["ogham_id", "ciic", "title", "findspot_county", "findspot_country", "findspot_lat", "findspot_lon", "keeper", "keeper_qid", "keeper_lat", "keeper_lon", "keeper_source", "distance_km"],
    "worklist": ["id", "series", "series_label", "series_note", "gaps", "ciic", "cisp", "cisp_url", "cisp_url_state", "title", "place", "county", "keeper", "geo_raw", "gazetteer", "status"],
}


def report(df: DataFrame, name: str) -> DataFrame:
    """A report's fields in their order: others are dropped, missing ones null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in FIELDS[name]))


def write_csv(df: DataFrame, path: str, fields: list[str], *, order: list[str] | None = None, one_file: bool = False) -> None:
    """The given fields with a header: arrays joined by blanks, booleans as yes and no, null as nothing."""
    kinds = dict(df.dtypes)

    def plain(c: str):
        if kinds[c].startswith("array"):
            return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
        return F.when(F.col(c), "yes").otherwise("no").alias(c) if kinds[c] == "boolean" else F.col(c).cast("string").alias(c)

    out = df.orderBy(*order) if order else df
    out = out.select(*map(plain, fields))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", escape='"')


def write_n_triples(graph: DataFrame, path: str) -> None:
    triples.n_triples(graph).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, *, lat: str, lon: str, properties: list[str]) -> None:
    """One feature a line."""
    views.points_geojson(df, lat=lat, lon=lon, properties=properties).write.mode("overwrite").text(path)


def manifest_text(header: dict[str, str], files: DataFrame, *, most: int = 1_000_000) -> str:
    """A manifest document: header, counts, and the sorted map of paths to content ids (path, sha)."""
    rows = sorted((r["path"], r["sha"]) for r in bounded_rows(files, most, "the manifest"))
    return "".join([*(f'{k}: "{v}"\n' for k, v in header.items()), f"file_count: {len(rows)}\n", "files:\n", *(f'  "{p}": {s}\n' for p, s in rows)])


def markdown_table(df: DataFrame, *, most: int = 10_000) -> str:
    """A small table in Markdown, bars escaped."""
    rows = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in bounded_rows(df, most, "the table")]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows]) + "\n"


def write_turtle(graph: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """Blocks of Turtle by subject, in as many files as there are partitions; each file begins with the prefixes."""
    head = triples.turtle_head(prefixes)
    blocks = triples.turtle(graph, prefixes).select("block")

    def with_head(batches):
        first = True
        for b in batches:
            if first and b.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    blocks.mapInArrow(with_head, "value string").write.mode("overwrite").text(path)


def suggestions_text(found: DataFrame, *, key: str, most: int = 10_000) -> str:
    """Identifiers found by search, as a document for review; it is never the one kept by hand."""
    rows = sorted(bounded_rows(found.select(key, "qid", "source"), most, "the suggestions"))
    return "".join(["# found by search, to be checked by hand\n", "keepers:\n", *(f'  "{k}":\n    qid: {q}\n    source: {s}\n' for k, q, s in rows)])


TEMPLATE = "# identifiers set by hand\nkeepers:\nfindspots:\n"


def markdown_report(title: str, sections: list[tuple[str, DataFrame]], *, most: int = 10_000) -> str:
    """A document of small tables, one below each heading."""
    return "\n".join([f"# {title}\n", *(f"## {head}\n\n{markdown_table(df, most=most)}" for head, df in sections)])


def change_lines(changes: DataFrame, *, by: str, key: str, change: str, names: int = 12) -> DataFrame:
    """(by, change, n, shown, more) for a run's report: of each kind of change the number, the first names in order, and how many more there are. The names are kept in bounded lists from the start."""
    bounded = F.slice(F.array_sort(F.collect_list(key)), 1, names)
    parts = changes.select("*", F.pmod(F.xxhash64(key), F.lit(64)).alias("_p")).groupBy(by, change, "_p").agg(F.count("*").alias("n"), bounded.alias("k"))
    whole = parts.groupBy(by, change).agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("k"))), 1, names).alias("k"))
    return whole.select(by, change, "n", F.array_join("k", ", ").alias("shown"), F.greatest(F.col("n") - names, F.lit(0)).alias("more"))
