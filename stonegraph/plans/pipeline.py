"""The run over a corpus: each edition is parsed once, the layers are derived from the records and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stonegraph import sinks
from stonegraph.functions import geo, text
from stonegraph.operators import graph, resolve, rules, triples, views
from stonegraph.session import checkpointed
from stonegraph.sources import editions


def layers(corpus: DataFrame, *, key: str, content: str, spellings: dict[str, list[str]], vocabulary: DataFrame | None = None, hosts: list[str] | None = None, holders: DataFrame | None = None, ontology: DataFrame | None = None) -> dict[str, DataFrame]:
    """The layers of a corpus of XML editions: places, readings, dissent, settings, persons, relations, components, keepers, gaps, tags and the graph.

    The graph holds stones, places, gazetteer matches, persons, readings,
    located keepers and words. ``spellings`` has the formula words by spelling;
    with ``vocabulary`` (word, mode, variant) the words found in each reading
    come out as well. ``holders`` (repository, alias_of, qid, lat, lon, source,
    status) locates keepers; with ``ontology`` (s, p, o, kind) the graph is
    validated: ``violations`` of domains and ranges and ``unknown_terms``.
    Records whose id isn't an edition's are left out of places and what comes
    from them, and of the stones of the graph.
    """
    records = checkpointed(editions.read_records(corpus, key=key, content=content))
    own = F.when(F.col("stone_key") == "x", F.col("record")).otherwise(F.col("stone_key"))
    located = editions.places(records, hosts=hosts).withColumn("stone_key", own)
    stones = located.groupBy("record").agg(F.min("stone_key").alias("stone"))
    places = located.where(F.col("edition_id").rlike("^[A-Z]-[A-Z]{3}-[A-Z0-9]+$"))
    readings = editions.readings(records)
    first = Window.partitionBy("record", "script").orderBy("reading_no")
    current = readings.where("current").withColumn("n", F.row_number().over(first)).where("n = 1").select("record", "script", F.col("text").alias("current_text"))
    pairs = readings.where("not current").select("record", "script", "editor", F.col("text").alias("other_text")).join(current, ["record", "script"])
    compared = resolve.compare_readings(pairs, current="current_text", other="other_text", formula=spellings)
    relations = editions.relations(records).withColumn("r", rules.relation_parts(F.col("lemma"))).select("record", "phrase", "pos", "from_id", "to_id", "lemma", "surface", "uncertain", "r.gloss", "r.kinds", "r.is_kin")
    numbered = triples.numbered(relations.join(stones, "record"), order=["record", "phrase", "pos"]).withColumn("is_parent", F.array_contains("kinds", "parent"))
    gap = F.col("geo_status").isin("missing", "textual_only")
    keepers = held(places, holders)
    links = keepers.where("why is null").select(F.col("stone_key").alias("stone"), "keeper", "qid", F.col("keeper_lat").alias("lat"), F.col("keeper_lon").alias("lon"), "source", "status")
    graphs = [
        triples.stone_graph(stone_rows(records)), triples.place_graph(places), triples.gazetteer_graph(places, hosts), triples.person_graph(numbered), triples.reading_graph(readings.join(stones, "record").select("stone", "reading_id", F.col("editor").alias("label"), "text")), triples.keeper_graph(links), triples.keeper_places(links),
    ]
    out = {
        "places": places,
        "readings": readings,
        "comparisons": compared,
        "dissent": resolve.dissent(compared, key="record", editor="editor"),
        "settings": places.select("edition_id", rules.classify_setting(F.col("repository"), F.col("observed")).alias("v")).select("edition_id", "v.*"),
        "persons": editions.slots(records),
        "relations": relations,
        "components": graph.components(relations, a="from_id", b="to_id"),
        "keepers": keepers,
        "gaps": places.where(gap | (F.col("geo_status") == "qualified")).select("edition_id", F.when(gap, "findspot").otherwise("findspot hedged").alias("gap"), "geo_raw", "page", "repository"),
        "tags": records.select("record", F.explode("tags").alias("t")).groupBy(F.col("t.tag").alias("tag")).agg(F.sum("t.n").alias("total"), F.count("*").alias("files")).withColumn("status", rules.classify_tag(F.col("tag"))),
    }
    if vocabulary is not None:
        tokens = readings.select("record", "reading_no", F.explode(F.split("normalised", " ")).alias("token")).where("token <> ''")
        out["words"] = resolve.match_words(tokens, vocabulary, token="token").distinct()
        matches = out["words"].join(readings.select("record", "reading_no", "reading_id", "editor", "script", "text"), ["record", "reading_no"]).join(stones, "record")
        graphs.append(triples.word_graph(matches, vocabulary))
    out["graph"] = checkpointed(triples.merge(*graphs))
    if ontology is not None:
        out |= validated(out["graph"], ontology)
    return out


def stone_rows(records: DataFrame) -> DataFrame:
    """What ``triples.stone_graph`` takes, of each record that is an edition."""
    filename, number = F.try_element_at("ids", F.lit("filename")), F.try_element_at("ids", F.lit("CIIC"))
    key, at = text.stone_key(filename, number), geo.parse_coordinate(F.col("geo_raw"))
    place = F.when(F.size("places") > 0, F.get("places", F.lit(0))["raw"]).otherwise(F.regexp_replace(F.split("place_text", r"\d")[0], "^[ ,]+|[ ,]+$", ""))
    shown = F.filter("readings", lambda r: r["current"])
    r = records.withColumn("edition_id", F.coalesce(filename, "record")).where(F.col("edition_id").rlike("^[A-Z]-[A-Z]{3}-[A-Z0-9]+$"))
    label = F.concat(F.coalesce(F.nullif("title", F.lit("")), F.lit("Ogham stone")), F.lit(" ("), F.coalesce(F.concat(F.lit("CIIC "), F.nullif(number, F.lit(""))), F.col("edition_id")), F.lit(")"))
    return r.select(F.when(key == "x", F.col("record")).otherwise(key).alias("stone"), label.alias("label"), "ids", "object_type", "material", F.get(shown, F.lit(0))["text"].alias("inscription"), place.alias("place"), at["lat"].alias("lat"), at["lon"].alias("lon"), F.col("name_texts").alias("names"))


def held(places: DataFrame, holders: DataFrame | None) -> DataFrame:
    """Each stone's keeper, aliases followed, its place and distance from the findspot; ``why`` tells what keeps it off the graph: no findspot, or a holder that isn't located."""
    named = places.where(F.length(F.trim("repository")) > 0).select("edition_id", "stone_key", F.trim("repository").alias("name"), "lat", "lon")
    if holders is None:
        holders = places.sparkSession.createDataFrame([], "repository string, alias_of string, qid string, lat string, lon string, source string, status string")
    columns = ["qid", "lat", "lon", "source", "status"]
    listed = holders.groupBy(F.col("repository").alias("canonical")).agg(F.min(F.struct(F.expr("try_cast(lat as double) is null").alias("n"), *columns)).alias("h"))
    ends = graph.chase(holders, name="repository", target="alias_of")
    known = ends.join(listed, "canonical").select("name", "canonical", "h.qid", F.expr("try_cast(h.lat as double)").alias("keeper_lat"), F.expr("try_cast(h.lon as double)").alias("keeper_lon"), "h.source", "h.status")
    there = F.col("keeper_lat").isNotNull() & F.col("keeper_lon").isNotNull()
    why = F.when(F.col("lat").isNull(), "no findspot coordinate").when(~there, "holder not located")
    return named.join(known, "name", "left").select("edition_id", "stone_key", F.coalesce("canonical", "name").alias("keeper"), "qid", "lat", "lon", "keeper_lat", "keeper_lon", "source", "status", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("keeper_lat"), F.col("keeper_lon")).alias("distance_km"), why.alias("why"))


WATCHED = [triples.CRM, triples.CRMTEX, triples.DOMAIN, triples.PROV, triples.GEO]  #: namespaces whose terms must exist


def validated(data: DataFrame, ontology: DataFrame) -> dict[str, DataFrame]:
    """``violations`` of the ontology's domains and ranges, and ``unknown_terms``: those of watched namespaces that it says nothing of."""
    supers = graph.closure(ontology.where(F.col("p") == triples.RDFS + "subClassOf"), child="s", parent="o")
    ends = [triples.violations(data, triples.constraints(ontology, triples.RDFS + position), supers, end=end, position=position) for end, position in (("s", "domain"), ("o", "range"))]
    return {"violations": ends[0].union(ends[1]), "unknown_terms": triples.unknown_terms(data, ontology.select(F.col("s").alias("term")), watched=WATCHED)}


def write(found: dict[str, DataFrame], folder: str) -> None:
    """Writes the layers below ``folder``: the graph as N-Triples, places also as GeoJSON, everything else as Parquet."""
    for name, df in found.items():
        if name == "graph":
            sinks.write_n_triples(df, f"{folder}/graph.nt")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    places = found["places"]
    sinks.write_geojson(places, f"{folder}/places.geojsonl", lat="lat", lon="lon", properties=["edition_id", "title", "geo_status", "repository"])


def summary(found: dict[str, DataFrame]) -> dict[str, int]:
    """How many rows each layer has, and the open gaps."""
    counts = {name: df.count() for name, df in found.items()}
    gaps = views.gap_counts(found["places"], {"missing": F.col("geo_status") == "missing", "hedged": F.col("geo_status") == "qualified"}).first()
    return counts | gaps.asDict()
