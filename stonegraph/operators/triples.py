"""Records as triples, weighted statements, and checks of triples against class hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonegraph.functions import text
from stonegraph.operators.graph import closure
from stonegraph.operators.reports import numbered_globally
from stonegraph.session import checkpointed, shared_folder

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
CRM = "http://www.cidoc-crm.org/cidoc-crm/"
CRMTEX = "http://www.cidoc-crm.org/extensions/crmtex/"
PROV = "http://www.w3.org/ns/prov#"
GEO = "http://www.opengis.net/ont/geosparql#"
WKT = "http://www.opengis.net/ont/geosparql#wktLiteral"
DATA = "http://data.example.org/"  #: default space of minted nodes
DOMAIN = "http://onto.example.org/"  #: default space of the domain's own terms

TRIPLE = "struct<s:string,p:string,o:string,kind:string,dtype:string,lang:string>"


def node(prefix: str, *keys: Column, base: str = DATA) -> Column:
    """A minted node: the base, a prefix and the slugs of its keys."""
    return F.concat(F.lit(base + prefix), F.concat_ws("_", *(text.slug(k) for k in keys)))


def uri(s: Column, p: str, o: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("uri").alias("kind"), F.lit("").alias("dtype"), F.lit("").alias("lang"))


def literal(s: Column, p: str, o: Column, dtype: str = "", lang: str = "") -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("lit").alias("kind"), F.lit(dtype).alias("dtype"), F.lit(lang).alias("lang"))


def a(s: Column, cls: str) -> Column:
    return uri(s, RDF + "type", F.lit(cls))


def statement(st: Column, s: Column, p: str, o: Column, weight: Column, status: Column, domain: str = DOMAIN) -> list[Column]:
    """A weighted statement about a triple: type, subject, predicate, object, weight (two decimals) and status."""
    return [a(st, RDF + "Statement"), uri(st, RDF + "subject", s), uri(st, RDF + "predicate", F.lit(p)), uri(st, RDF + "object", o), literal(st, domain + "weight", F.format_string("%.2f", weight), XSD + "decimal"), literal(st, domain + "matchStatus", status)]


def emit(df: DataFrame, *triples: Column | tuple[Column, Column]) -> DataFrame:
    """The triples of each row, once each; a pair (condition, triple) is emitted where the condition holds. Triples with a null part are left out."""
    made = [F.when(t[0], t[1]) if isinstance(t, tuple) else t for t in triples]
    rows = df.select(F.explode(F.array(*made)).alias("t")).where("t is not null").select("t.*")
    return rows.where("s is not null and o is not null").distinct()


def emit_at(df: DataFrame, *triples: Column | tuple[Column, Column]) -> DataFrame:
    """As ``emit``, where the node in the column ``at`` is the subject or the object of each triple: the rows are parted by it and not the triples, of which equal ones then meet in the same task anyhow."""
    made = [F.when(t[0], t[1]) if isinstance(t, tuple) else t for t in triples]
    rows = df.repartition("at").select("at", F.explode(F.array(*made)).alias("t")).where("t is not null").select("at", "t.*")
    return rows.where("s is not null and o is not null").distinct().drop("at")


def merge(*graphs: DataFrame) -> DataFrame:
    """The union of graphs as sets of triples."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.distinct()


def n_triples(graph: DataFrame) -> DataFrame:
    """Each triple as a line of N-Triples; a text sink can write them in parallel."""
    esc = F.col("o")
    for x, y in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(x), F.lit(y))
    tail = F.when(F.col("lang") != "", F.concat(F.lit("@"), F.col("lang"))).when(F.col("dtype") != "", F.concat(F.lit("^^<"), F.col("dtype"), F.lit(">"))).otherwise("")
    obj = F.when(F.col("kind") == "uri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(F.concat(F.lit('"'), esc, F.lit('"'), tail))
    return graph.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), obj, F.lit(" .")).alias("line"))


def place_graph(places: DataFrame) -> DataFrame:
    """Stones, findspots and the chains of named places (key of a place: its whole ancestry, broadest first). The places are checkpointed when this is called, as three parts of the graph are made of them."""
    places = checkpointed(places)
    stone, spot = node("stone_", F.col("stone_key")), node("findspot_", F.col("stone_key"))
    has = (F.size("hierarchy") > 0) | F.col("lat").isNotNull()
    labels = F.transform("hierarchy", lambda h: h["label"])
    base = places.withColumn("labels", labels)
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.size("labels"), F.lit(1))), lambda i: F.concat(F.lit(DATA + "place_"), F.array_join(F.transform(F.reverse(F.slice("labels", i, F.size("labels"))), text.slug), "_")))
    base = base.withColumn("keys", F.when(F.size("labels") > 0, keys).otherwise(F.array().cast("array<string>")))
    own = emit(
        base, a(stone, CRM + "E22_Human-Made_Object"), literal(stone, RDFS + "label", F.concat(F.coalesce(F.nullif("title", F.lit("")), "edition_id"), F.lit(" ("), F.col("edition_id"), F.lit(")"))), literal(stone, CRM + "P1_is_identified_by", F.col("edition_id")),
        (has, a(spot, CRM + "E53_Place")), (has, uri(stone, CRM + "P53_has_former_or_current_location", spot)), (F.size("keys") > 0, uri(spot, CRM + "P89_falls_within", F.get("keys", F.lit(0)))), (F.col("lat").isNotNull(), literal(spot, "http://www.opengis.net/ont/geosparql#asWKT", F.concat(F.lit("POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")), WKT)),
        (has, literal(spot, DOMAIN + "geoStatus", F.col("geo_status"))), (has & (F.col("hedge") != "") & F.col("lat").isNotNull(), literal(spot, CRM + "P3_has_note", F.col("hedge"))),
    )
    each = base.select("record", F.posexplode(F.arrays_zip("keys", "hierarchy")).alias("i", "x"), "keys").select(F.col("x.keys").alias("key"), F.col("x.hierarchy").alias("h"), F.get("keys", F.col("i") + 1).alias("broader"))
    first = each.groupBy("key").agg(F.min(F.struct(F.col("h.label").alias("label"), F.col("h.level").alias("level"))).alias("h"))
    k, kind = F.col("key"), node("placetype_", F.col("h.level"))
    named = emit(first, a(k, CRM + "E53_Place"), literal(k, RDFS + "label", F.col("h.label"), lang="en"), uri(k, CRM + "P2_has_type", kind), a(kind, CRM + "E55_Type"))
    within = emit(each, (F.col("broader").isNotNull(), uri(k, CRM + "P89_falls_within", F.col("broader"))))
    return merge(own, named, within)


def keeper_graph(links: DataFrame) -> DataFrame:
    """Holders of stones with their places and their weighted matches: ``links`` has stone, keeper, qid, lat, lon, source, status."""
    stone, keeper, place = node("stone_", F.col("stone")), node("keeper_", F.col("keeper")), node("place_keeper_", F.col("keeper"))
    target = F.concat(F.lit("http://www.wikidata.org/entity/"), F.col("qid"))
    st = node("match_keeper_", F.col("keeper"))
    pinned = F.length("qid") > 0
    weight = F.when(F.col("status") == "verified", 1.0).otherwise(0.7)
    return emit(
        links, a(keeper, CRM + "E74_Group"), literal(keeper, RDFS + "label", F.col("keeper")), a(place, CRM + "E53_Place"), uri(keeper, CRM + "P74_has_current_or_former_residence", place), literal(place, DOMAIN + "geocodedFrom", F.col("source")),
        uri(stone, CRM + "P50_has_current_keeper", keeper), uri(stone, CRM + "P55_has_current_location", place), (pinned, uri(keeper, SKOS + "closeMatch", target)), *((pinned, t) for t in statement(st, keeper, SKOS + "closeMatch", target, weight, F.col("status"))),
    )


def keeper_places(links: DataFrame) -> DataFrame:
    """Labels and points of the keepers' places: ``links`` has keeper, lat, lon."""
    place = node("place_keeper_", F.col("keeper"))
    return emit(links, literal(place, RDFS + "label", F.concat("keeper", F.lit(" (present location)"))), literal(place, GEO + "asWKT", F.concat(F.lit("POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")), WKT))


def stone_graph(stones: DataFrame) -> DataFrame:
    """Stones with identifiers, type, material, inscribed surface, inscription, place and names: ``stones`` has stone, label, ids, object_type, material, inscription, place, lat, lon, names."""
    stone, kind, material = node("stone_", F.col("stone")), node("type_", F.col("object_type")), node("material_", F.col("material"))
    surface, text_node, place = node("surface_", F.col("stone")), node("inscription_", F.col("stone")), node("place_", F.col("stone"))
    typed, made, told, pinned = F.length("object_type") > 0, F.length("material") > 0, F.length("place") > 0, F.col("lat").isNotNull()
    own = emit(
        stones, a(stone, CRM + "E22_Human-Made_Object"), a(stone, DOMAIN + "OghamStone"), literal(stone, RDFS + "label", F.col("label")), (typed, a(kind, CRM + "E55_Type")), (typed, literal(kind, RDFS + "label", F.col("object_type"))), (typed, uri(stone, CRM + "P2_has_type", kind)),
        (made, a(material, CRM + "E57_Material")), (made, literal(material, RDFS + "label", F.col("material"))), (made, uri(stone, CRM + "P45_consists_of", material)), a(surface, CRM + "E25_Human-Made_Feature"), literal(surface, RDFS + "label", F.lit("inscribed surface")), uri(stone, CRM + "P56_bears_feature", surface),
        a(text_node, CRMTEX + "TX1_Written_Text"), a(text_node, DOMAIN + "Inscription"), (F.length("inscription") > 0, literal(text_node, RDFS + "label", F.col("inscription"))), uri(stone, DOMAIN + "carries", text_node),
        (told | pinned, a(place, CRM + "E53_Place")), (told, literal(place, RDFS + "label", F.col("place"))), (told | pinned, uri(stone, CRM + "P53_has_former_or_current_location", place)), (pinned, literal(place, GEO + "asWKT", F.concat(F.lit("POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")), WKT)),
    )
    idn, person = node("id_", F.col("stone"), F.col("system")), node("person_", F.col("stone"), F.col("name"))
    ids = emit(stones.select("stone", F.explode("ids").alias("system", "value")), a(idn, CRM + "E42_Identifier"), literal(idn, RDFS + "label", F.col("value")), literal(idn, CRM + "P2_has_type", F.col("system")), uri(stone, CRM + "P1_is_identified_by", idn))
    names = emit(stones.select("stone", F.explode("names").alias("name")), a(person, CRM + "E21_Person"), a(person, DOMAIN + "Person"), literal(person, RDFS + "label", F.col("name")), uri(stone, DOMAIN + "shows", person))
    return merge(own, ids, names)


def gazetteer_graph(places: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """Weighted matches of named places (key: the whole ancestry, as in ``place_graph``) with the gazetteer links of ``hosts``, or with all links."""
    labels = F.transform("hierarchy", lambda h: h["label"])
    each = places.withColumn("labels", labels).select("labels", F.posexplode("hierarchy").alias("i", "h")).select(F.concat(F.lit("place_"), F.array_join(F.transform(F.reverse(F.slice("labels", F.col("i") + 1, F.size("labels"))), text.slug), "_")).alias("key"), F.explode("h.links").alias("link"))
    if hosts:
        each = each.where(F.exists(F.array(*map(F.lit, hosts)), lambda h: F.contains(F.col("link"), h)))
    place, target = F.concat(F.lit(DATA), F.col("key")), F.col("link")
    st = F.concat(F.lit(DATA + "match_"), F.col("key"), F.lit("_"), text.slug(F.regexp_extract("link", "[^/]*$", 0)))
    return emit(each, uri(place, SKOS + "closeMatch", target), *statement(st, place, SKOS + "closeMatch", target, F.lit(1.0), F.lit("source-asserted")), literal(st, DOMAIN + "matchConfidence", F.lit("1.00"), XSD + "decimal"), literal(st, DOMAIN + "matchTypeCheck", F.lit("curated")))


def word_graph(matches: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The vocabulary and its words' occurrences in readings: ``matches`` has stone, reading_id, editor, script, text, token, word, mode, variant, ``vocabulary`` word, mode, variant. Readings without a match aren't emitted.

    The matches are written under the shared checkpoint folder when this is
    called, as four parts of the graph are made of them. No two parts have a
    triple in common: the subjects of each begin with prefixes of their own, but
    for ``carries`` and ``shows`` of stones.
    """
    folder = shared_folder(matches.sparkSession, "words")
    slugs = {"s": "stone", "r": "reading_id", "w": "word", "m": "mode"}
    matches.select(*(text.slug(F.col(c)).alias(n) for n, c in slugs.items()), "editor", "script", "text", "token", "mode", "variant").write.parquet(folder)
    found = matches.sparkSession.read.parquet(folder)

    def made(prefix: str, *parts: str) -> Column:
        return F.concat(F.lit(DATA + prefix), F.concat_ws("_", *parts))

    at, mode, none = F.col("at"), F.col("mode"), F.lit(None).cast("string")
    cls = F.when(mode == "formula", DOMAIN + "FormulaWord").when(mode == "element", DOMAIN + "NomenclatureWord").otherwise(DOMAIN + "Word")
    occurrences = found.select(made("word_occ_", "s", "r", "w", "m").alias("at"), made("stone_", "s").alias("stone"), made("word_", "w", "m").alias("entry"), "token", "mode", "variant", none.alias("word"), F.lit(True).alias("occurs"))
    entries = vocabulary.select(node("word_", F.col("word"), F.col("mode")).alias("at"), none.alias("stone"), none.alias("entry"), none.alias("token"), "mode", "variant", "word", F.lit(False).alias("occurs"))
    occurs, listed = F.col("occurs"), ~F.col("occurs")
    words = emit_at(
        occurrences.unionByName(entries), uri(at, RDF + "type", cls), (occurs, literal(at, RDFS + "label", F.col("token"))), (occurs, uri(at, CRM + "P2_has_type", F.col("entry"))), (occurs, literal(at, DOMAIN + "matchedVariant", F.col("variant"))), (occurs, literal(at, DOMAIN + "matchMode", mode)), (occurs, uri(F.col("stone"), DOMAIN + "shows", at)),
        (listed, a(at, CRM + "E55_Type")), (listed, literal(at, RDFS + "label", F.col("word"))), (listed, literal(at, DOMAIN + "wordClass", mode)), (listed, literal(at, SKOS + "altLabel", F.col("variant"))),
    )
    inscription, agent = made("inscription_", "s"), made("agent_", "r")
    readings = emit_at(
        found.select(made("reading_", "s", "r").alias("at"), inscription.alias("inscription"), agent.alias("agent"), "text", "script").distinct(), a(at, DOMAIN + "Reading"), literal(at, RDFS + "label", F.col("text")), (F.length("script") > 0, literal(at, DOMAIN + "script", F.col("script"))), uri(F.col("inscription"), DOMAIN + "identifiedAs", at), uri(at, PROV + "wasAttributedTo", F.col("agent")),
    )
    stones = emit(found.select("s").distinct(), uri(made("stone_", "s"), DOMAIN + "carries", inscription))
    agents = emit(found.select("r", "editor").distinct(), a(agent, PROV + "Agent"), literal(agent, RDFS + "label", F.col("editor")))
    return words.unionByName(readings).unionByName(stones).unionByName(agents)


def person_graph(persons: DataFrame) -> DataFrame:
    """Named ends and their relations: ``persons`` has stone, from_id, to_id, lemma, gloss, is_kin, is_parent, uncertain, edge_no."""
    src, dst = node("person_", F.col("from_id")), F.when(F.col("is_kin"), node("tribe_", F.col("to_id"))).otherwise(node("person_", F.col("to_id")))
    st, stone = node("relation_", F.col("edge_no").cast("string")), node("stone_", F.col("stone"))
    plain = ~F.col("is_kin")
    weight = F.when(F.col("uncertain"), 0.9).otherwise(1.0)
    return emit(
        persons, a(src, CRM + "E21_Person"), (plain, a(dst, CRM + "E21_Person")), (F.col("is_kin"), a(dst, DOMAIN + "Tribe")), uri(stone, DOMAIN + "shows", src), (plain, uri(stone, DOMAIN + "shows", dst)), (plain & F.col("is_parent"), uri(src, CRM + "P152_has_parent", dst)), (plain, uri(src, DOMAIN + "relatedTo", dst)),
        *statement(st, src, DOMAIN + "relatedTo", dst, weight, F.lit("asserted")), literal(st, DOMAIN + "relationLemma", F.col("lemma")), literal(st, RDFS + "label", F.col("gloss")),
    )


def reading_graph(readings: DataFrame) -> DataFrame:
    """Readings of the inscriptions that stones carry: ``readings`` has stone, reading_id, label, text."""
    stone, text_node, reading = node("stone_", F.col("stone")), node("inscription_", F.col("stone")), node("reading_", F.col("stone"), F.col("reading_id"))
    return emit(readings, a(stone, CRM + "E22_Human-Made_Object"), uri(stone, DOMAIN + "carries", text_node), uri(text_node, DOMAIN + "identifiedAs", reading), a(reading, DOMAIN + "Reading"), literal(reading, RDFS + "label", F.col("label")), literal(reading, CRM + "P190_has_symbolic_content", F.col("text")))


def union_members(graph: DataFrame, *, predicate: str = OWL + "unionOf") -> DataFrame:
    """(s, member): the members of each list that ``predicate`` leads to, in any order."""
    heads = graph.where(F.col("p") == predicate).select("s", F.col("o").alias("cell"))
    rest = graph.where(F.col("p") == RDF + "rest").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    cells = heads.union(heads.join(closure(rest, child="child", parent="parent", reflexive=False), F.col("cell") == F.col("node")).select("s", F.col("ancestor").alias("cell")))
    return cells.join(graph.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("member")), "cell").select("s", "member").distinct()


def constraints(reference: DataFrame, predicate: str, unions: DataFrame | None = None) -> DataFrame:
    """(property, allowed): the classes a property's domain or range allows; a union allows each of its members, another unnamed class nothing in particular. ``unions`` may give ``union_members`` of the reference, where it is needed more than once."""
    told = reference.where(F.col("p") == predicate).select(F.col("s").alias("property"), F.col("o").alias("cls"))
    unions = union_members(reference) if unions is None else unions
    plain = told.where(~F.col("cls").startswith("_:")).select("property", F.col("cls").alias("allowed"))
    return plain.union(told.join(unions, F.col("cls") == F.col("s")).select("property", F.col("member").alias("allowed"))).distinct()


def violations(data: DataFrame, allowed: DataFrame, supers: DataFrame, *, end: str, position: str) -> DataFrame:
    """(property, node, position): nodes in a constrained position none of whose types is, or is under, an allowed class. Nodes without a type, and literals, break nothing."""
    types = data.where(F.col("p") == RDF + "type").select(F.col("s").alias("node"), F.col("o").alias("type")).distinct()
    used = data if end == "s" else data.where("kind = 'uri'")
    used = used.select(F.col("p").alias("property"), F.col(end).alias("node")).distinct().join(allowed.select("property").distinct(), "property", "left_semi")
    typed = used.join(types.select("node").distinct(), "node", "left_semi")
    under = types.join(supers.select(F.col("node").alias("type"), "ancestor"), "type", "left").select("node", F.coalesce("ancestor", "type").alias("cls")).union(types)
    fine = typed.join(allowed, "property").join(under, (typed["node"] == under["node"]) & (F.col("allowed") == F.col("cls"))).select("property", typed["node"])
    return typed.join(fine.distinct(), ["property", "node"], "left_anti").select("property", "node", F.lit(position).alias("position"))


def unknown_terms(data: DataFrame, known: DataFrame, *, watched: list[str], local: str = DOMAIN) -> DataFrame:
    """(term, position, uses, new_local): properties and classes in watched namespaces that no reference triple is about."""
    props = data.select(F.col("p").alias("term"), F.lit("property").alias("position"))
    classes = data.where((F.col("p") == RDF + "type") & (F.col("kind") == "uri")).select(F.col("o").alias("term"), F.lit("class").alias("position"))
    seen = props.union(classes).where(F.exists(F.array(*map(F.lit, watched)), lambda ns: F.startswith("term", ns)))
    counted = seen.groupBy("term", "position").agg(F.count("*").alias("uses"))
    return counted.join(known.select("term").distinct(), "term", "left_anti").withColumn("new_local", F.startswith("term", F.lit(local)))


def without_ancestor(classes: DataFrame, supers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Classes none of whose ancestors, themselves included, is wanted: ``classes`` has node, ``wanted`` ancestor."""
    return classes.join(supers.join(wanted, "ancestor", "left_semi").select("node").distinct(), "node", "left_anti")


def renamespace(graph: DataFrame, old: str, new: str, locals_: dict[str, str] | None = None) -> DataFrame:
    """Terms of one namespace moved to another, some under another local name."""
    def moved(c: str) -> Column:
        local = F.substr(F.col(c), F.lit(len(old) + 1))
        for x, y in (locals_ or {}).items():
            local = F.when(local == x, F.lit(y)).otherwise(local)
        return F.when(F.startswith(F.col(c), F.lit(old)), F.concat(F.lit(new), local)).otherwise(F.col(c))

    return graph.withColumns({c: moved(c) for c in ("s", "p")}).withColumn("o", F.when(F.col("kind") == "uri", moved("o")).otherwise(F.col("o"))).distinct()


def patch(graph: DataFrame, *, remove: DataFrame, add: DataFrame) -> DataFrame:
    """A graph without some triples and with others that it lacks."""
    return merge(graph.join(remove, ["s", "p", "o"], "left_anti"), add)


def numbered(df: DataFrame, *, order: list[str]) -> DataFrame:
    """Rows numbered from 0 through all stones, in the order of stone and ``order``."""
    return numbered_globally(df, order=["stone", *order], name="edge_no")


def provenance_graph(snapshots: DataFrame, *, graph: str, agent: str) -> DataFrame:
    """Where a graph comes from: ``snapshots`` has commit, source, date and subject."""
    g, made, who = F.lit(DATA + graph), node("snapshot_", F.col("commit")), F.lit(DATA + "agent_" + agent)
    return emit(
        snapshots, a(g, PROV + "Entity"), a(made, PROV + "Entity"), uri(g, PROV + "wasDerivedFrom", made), literal(made, RDFS + "label", F.col("commit")), (F.length("source") > 0, literal(made, PROV + "atLocation", F.col("source"))),
        (F.col("date").isNotNull(), literal(made, PROV + "generatedAtTime", F.col("date"), XSD + "dateTime")), (F.length("subject") > 0, literal(made, RDFS + "comment", F.col("subject"))), a(who, PROV + "Agent"), uri(g, PROV + "wasAttributedTo", who),
    )


def class_graph(mapping: DataFrame, top: str = CRM + "E1_CRM_Entity") -> DataFrame:
    """The classes of a mapping as a chain: ``mapping`` has app, domain and crm, each below the next, ``top`` above all; rows with a null part give no chain (see ``mapping_gaps``)."""
    m = mapping.where("app is not null and domain is not null and crm is not null")
    links = [(F.col("app"), F.col("domain")), (F.col("domain"), F.col("crm")), (F.col("crm"), F.lit(top)), (F.lit(top), F.lit(OWL + "Thing"))]
    made = [t for child, parent in links for t in ((child != parent, uri(child, RDFS + "subClassOf", parent)), a(child, OWL + "Class"))]
    return emit(m, *made, literal(F.col("app"), RDFS + "label", F.regexp_extract("app", "[^/#]*$", 0)))


def mapping_gaps(mapping: DataFrame) -> DataFrame:
    """(app, gap): rows of a mapping that lack a part, and classes that are their own parent."""
    gaps = F.filter(F.array(*(F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"no {c}")) for c in ("domain", "crm")), F.when((F.col("app") == F.col("domain")) | (F.col("domain") == F.col("crm")), F.lit("its own parent"))), lambda x: x.isNotNull())
    return mapping.select("app", F.explode(gaps).alias("gap"))


def subclass_claims(claims: DataFrame, supers: DataFrame) -> DataFrame:
    """(child, parent, same_name): claims of a class tree that ``supers`` (node, ancestor) doesn't entail, and whether both have one local name."""
    entailed = supers.select(F.col("node").alias("child"), F.col("ancestor").alias("parent")).distinct()
    local = [F.regexp_extract(c, "[^/#]*$", 0) for c in ("child", "parent")]
    return claims.select("child", "parent").distinct().join(entailed, ["child", "parent"], "left_anti").withColumn("same_name", local[0] == local[1])


def later_wins(reference: DataFrame, *, order: str) -> DataFrame:
    """Of several domains or ranges of one property the one declared last (by ``order``); all other triples as they are."""
    told = F.col("p").isin(RDFS + "domain", RDFS + "range")
    last = reference.where(told).groupBy("s", "p").agg(F.max(F.struct(order, "o", "kind")).alias("v")).select("s", "p", "v.o", "v.kind")
    return reference.where(~told).select("s", "p", "o", "kind").unionByName(last)


def check(data: DataFrame, reference: DataFrame, tree: DataFrame, *, watched: list[str], local: str = DOMAIN) -> DataFrame:
    """(kind, term, position, n, example): all checks of a graph as one report: terms that no reference triple is about, and nodes whose types break a domain or range, with the smallest such node."""
    supers, unions = closure(tree, child="child", parent="parent"), checkpointed(union_members(reference))
    known = reference.select(F.col("s").alias("term")).union(tree.select("child"))
    terms = unknown_terms(data, known, watched=watched, local=local).select(F.when(F.col("new_local"), "new local term").otherwise("unknown term").alias("kind"), "term", "position", F.col("uses").alias("n"), F.lit("").alias("example"))
    broken = [violations(data, constraints(reference, RDFS + position, unions), supers, end=end, position=position) for end, position in (("s", "domain"), ("o", "range"))]
    counted = broken[0].unionByName(broken[1]).groupBy("property", "position").agg(F.count("*").alias("n"), F.min("node").alias("example"))
    return terms.unionByName(counted.select(F.lit("violation").alias("kind"), F.col("property").alias("term"), "position", "n", "example"))


def turtle(graph: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(subject, block): each subject's triples as a block of Turtle, by predicate; the prefixes' lines are ``turtle_head``."""
    def short(c: Column) -> Column:
        done = text.curie(c, prefixes)
        plain = done.rlike(r"^[a-z]+:[A-Za-z_][A-Za-z0-9_\-]*$")
        return F.when(plain & (done != c), done).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    esc = F.col("o")
    for x, y in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(x), F.lit(y))
    tail = F.when(F.col("lang") != "", F.concat(F.lit("@"), F.col("lang"))).when(F.col("dtype") != "", F.concat(F.lit("^^"), short(F.col("dtype")))).otherwise("")
    obj = F.when(F.col("kind") == "uri", short(F.col("o"))).otherwise(F.concat(F.lit('"'), esc, F.lit('"'), tail))
    rows = graph.select("s", short(F.col("s")).alias("subject"), F.when(F.col("p") == RDF + "type", "a").otherwise(short(F.col("p"))).alias("p"), obj.alias("o"))
    each = rows.groupBy("s", "subject", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("o"))
    blocks = each.groupBy("s", "subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "o"))), lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ;\n    ").alias("body"))
    return blocks.select(F.col("s").alias("subject"), F.concat("subject", F.lit(" "), "body", F.lit(" .")).alias("block"))


def turtle_head(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in prefixes.items())
