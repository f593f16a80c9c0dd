"""Queries over editions and graphs made from the test tables, so that SQL can tell what must come out of the XML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonegraph.functions import text
from stonegraph.operators import nested, reports, resolve, rules, triples
from stonegraph.plans.layers import LETTERS, _letters
from stonegraph.plans.queries import NORM, SLUG, STAR, UPS, VOCABULARY, _ontology, _star, _ups
from stonegraph.session import table
from stonegraph.sinks import report
from stonegraph.sources import editions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
D, O, CRM, RDF, RDFS, SKOS, PROV, XSD = triples.DATA, triples.DOMAIN, triples.CRM, triples.RDF, triples.RDFS, triples.SKOS, triples.PROV, triples.XSD


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HEAD = '<TEI xmlns="http://tei.example.org/ns/1.0"><teiHeader><title>%s</title><idno type="filename">%s</idno></teiHeader><text>%s</text></TEI>'

# ---- persons and their relations

PHRASES = f"""p AS (SELECT DISTINCT stone, {LETTERS.format('from_name')} AS a, {LETTERS.format('to_name')} AS b, relation_lemma AS lemma FROM persons WHERE stone IS NOT NULL AND relation_lemma <> ''),
 ph AS (SELECT *, row_number() OVER (PARTITION BY stone ORDER BY a, b, lemma) - 1 AS phrase FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """Editions whose transliteration names the persons of each statement, with the relation's words between them."""
    p = table(spark, d, "persons").where("stone is not null and relation_lemma <> ''").select("stone", _letters("from_name").alias("a"), _letters("to_name").alias("b"), F.col("relation_lemma").alias("lemma")).where("a is not null and b is not null").distinct()
    words = F.array_join(F.transform(F.split("lemma", r"\+"), lambda x: F.concat(F.lit('<w type="formula" lemma="'), x, F.lit('">W</w> '))), "")
    phrase = F.concat(F.lit('<persName><name nymRef="'), "a", F.lit('">'), "a", F.lit("</name> "), words, F.lit('<name nymRef="'), "b", F.lit('">'), "b", F.lit("</name></persName>"))
    rows = p.select("stone", F.struct("a", "b", "lemma", phrase.alias("xml")).alias("x")).groupBy("stone").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.concat(F.lit('<div type="edition" subtype="transliteration"><ab>'), F.array_join(F.transform("x", lambda x: x["xml"]), " "), F.lit("</ab></div>"))
    return rows.select("stone", F.format_string(HEAD, "stone", "stone", body).alias("content"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return editions.relations(editions.read_records(_phrases(spark, d), key="stone", content="content")).withColumn("r", rules.relation_parts(F.col("lemma")))


GLOSS = "CASE lemma WHEN 'maqqas' THEN 'son of' WHEN 'maqqas+muccoviias' THEN 'son of and of the kin of' WHEN 'avias' THEN 'grandson or descendant of' WHEN 'muccoviias' THEN 'of the kin of' WHEN 'inigena' THEN 'daughter of' END"


@query(f"WITH {PHRASES} SELECT stone AS record, CAST(phrase AS INTEGER) AS phrase, 1 AS pos, 'name/' || a AS from_id, 'name/' || b AS to_id, lemma, CASE WHEN contains(lemma, '+') THEN 'W W' ELSE 'W' END AS surface, false AS uncertain, {GLOSS} AS gloss, contains(lemma, 'mucc') AS is_kin FROM ph")
def edition_relations(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).select("record", "phrase", "pos", "from_id", "to_id", "lemma", "surface", "uncertain", "r.gloss", "r.is_kin")


PERSONS = f"""{PHRASES}, g AS (SELECT *, row_number() OVER (ORDER BY stone, phrase) - 1 AS no, '{D}person_name_' || a AS src, CASE WHEN contains(lemma, 'mucc') THEN '{D}tribe_name_' ELSE '{D}person_name_' END || b AS dst, '{D}stone_' || {SLUG.format('stone')} AS st, contains(lemma, 'mucc') AS kin, {GLOSS} AS gloss FROM ph),
 r AS (SELECT *, '{D}relation_' || no AS rel FROM g)"""


@query(f"""WITH {PERSONS} SELECT src AS s, '{RDF}type' AS p, '{CRM}E21_Person' AS o FROM r UNION SELECT dst, '{RDF}type', CASE WHEN kin THEN '{O}Tribe' ELSE '{CRM}E21_Person' END FROM r UNION SELECT st, '{O}shows', src FROM r UNION SELECT st, '{O}shows', dst FROM r WHERE NOT kin
UNION SELECT src, '{CRM}P152_has_parent', dst FROM r WHERE NOT kin AND lemma IN ('maqqas', 'inigena') UNION SELECT src, '{O}relatedTo', dst FROM r WHERE NOT kin UNION SELECT rel, '{RDF}type', '{RDF}Statement' FROM r UNION SELECT rel, '{RDF}subject', src FROM r UNION SELECT rel, '{RDF}predicate', '{O}relatedTo' FROM r
UNION SELECT rel, '{RDF}object', dst FROM r UNION SELECT rel, '{O}weight', '1.00' FROM r UNION SELECT rel, '{O}matchStatus', 'asserted' FROM r UNION SELECT rel, '{O}relationLemma', lemma FROM r UNION SELECT rel, '{RDFS}label', gloss FROM r""")
def person_triples(spark: SparkSession, d: str) -> DataFrame:
    rows = triples.numbered(_relations(spark, d).withColumnRenamed("record", "stone"), order=["phrase", "pos"])
    return triples.person_graph(rows.select("stone", "from_id", "to_id", "lemma", "r.gloss", "r.is_kin", F.array_contains("r.kinds", "parent").alias("is_parent"), "uncertain", "edge_no")).select("s", "p", "o")


@query(f"""WITH {PHRASES}, n AS (SELECT count(*) AS phrases, count(DISTINCT stone) AS files, sum(CASE WHEN contains(lemma, '+') THEN 2 ELSE 1 END) AS words FROM ph)
SELECT tag, total::BIGINT AS total, files, status FROM n, LATERAL (VALUES ('TEI', files), ('teiHeader', files), ('title', files), ('idno', files), ('text', files), ('div', files), ('ab', files), ('persName', phrases), ('name', 2 * phrases), ('w', words)) t(tag, total) JOIN (VALUES {', '.join(f"('{t}', '{s}')" for s, tags in (('mapped', rules.MAPPED), ('candidate', rules.CANDIDATE), ('doubt', rules.DOUBT), ('structural', rules.STRUCTURAL)) for t in tags if t in ('TEI', 'teiHeader', 'title', 'idno', 'text', 'div', 'ab', 'persName', 'name', 'w'))}) k(tag, status) USING (tag)""")
def made_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = editions.read_records(_phrases(spark, d), key="stone", content="content").select("record", F.explode("tags").alias("t"))
    return tags.groupBy(F.col("t.tag").alias("tag")).agg(F.sum("t.n").alias("total"), F.count("*").alias("files")).withColumn("status", rules.classify_tag(F.col("tag")))


@query(ORACLES["made_tags"].replace("SELECT tag, total::BIGINT AS total, files, status FROM n", "SELECT status, count(*) AS tags, sum(total)::BIGINT AS uses FROM n") + " GROUP BY status")
def tag_tally(spark: SparkSession, d: str) -> DataFrame:
    return reports.tag_tally(made_tags(spark, d), status="status")


# ---- readings

CODES = ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in text.EDITOR_PREFIXES.items())
APPS = f"""r AS (SELECT DISTINCT ogham_id AS stone, upper(left(regexp_extract(editor, '([A-Za-z]+)', 1), 3)) AS code, regexp_extract(editor, '([0-9]{{4}})', 1) AS year, {LETTERS.format('this_reading_text')} AS t FROM readings WHERE ogham_id IS NOT NULL AND editor IS NOT NULL),
 q AS (SELECT *, row_number() OVER (PARTITION BY stone ORDER BY code, year, t) - 1 AS no FROM r WHERE t IS NOT NULL AND code <> '' AND year <> '')"""


def _apps(spark: SparkSession, d: str) -> DataFrame:
    """Editions with an apparatus of each stone's readings."""
    r = table(spark, d, "readings").where("ogham_id is not null and editor is not null")
    r = r.select(F.col("ogham_id").alias("stone"), F.upper(F.left(F.regexp_extract("editor", "([A-Za-z]+)", 1), F.lit(3))).alias("code"), F.regexp_extract("editor", "([0-9]{4})", 1).alias("year"), _letters("this_reading_text").alias("t")).where("t is not null and code <> '' and year <> ''").distinct()
    rows = r.groupBy("stone").agg(F.array_sort(F.collect_list(F.struct("code", "year", "t"))).alias("x"))
    xml = F.array_join(F.transform("x", lambda x: F.concat(F.lit('<app><rdg source="#'), x["code"], x["year"], F.lit('">'), x["t"], F.lit("</rdg></app>"))), "")
    return rows.select("stone", F.format_string(HEAD, "stone", "stone", xml).alias("content"))


@query(f"WITH {APPS} SELECT stone AS record, CAST(no AS INTEGER) AS reading_no, false AS current, code || year AS reading_id, coalesce(map {{{CODES}}}[code], upper(left(code, 1)) || lower(code[2:])) || ' ' || year AS editor, 'ogham' AS script, t AS text, trim(regexp_replace(t, '(?i)vacat\\b', ' ')) AS normalised FROM q")
def made_readings(spark: SparkSession, d: str) -> DataFrame:
    return editions.readings(editions.read_records(_apps(spark, d), key="stone", content="content"))


def _made_table(tag: str):
    def rows(spark: SparkSession, d: str) -> DataFrame:
        made = _apps(spark, d).withColumn("at", F.lit(None).cast("timestamp")) if tag == "rdg" else _phrases(spark, d).withColumn("at", F.lit(None).cast("timestamp")) if tag == "persName" else _spots(spark, d).withColumn("at", F.lit(None).cast("timestamp"))
        return nested.nested_tables(made, key="stone", content="content", at="at")[tag]

    return rows


# ---- places

SPOTS = """k AS (SELECT DISTINCT ogham_id AS stone, regexp_replace(findspot_county, '[^A-Za-z ]', '', 'g') AS county, findspot_country AS country FROM keepers WHERE ogham_id <> '' AND findspot_county <> '' AND findspot_country <> ''),
 s AS (SELECT stone, min((county, country)) AS v FROM k WHERE length(trim(county)) > 0 GROUP BY stone), l AS (SELECT stone, trim(v[1]) AS county, v[2] AS country FROM s)"""


def _spots(spark: SparkSession, d: str) -> DataFrame:
    """Editions with the county and country of each stone."""
    k = table(spark, d, "keepers").where("ogham_id <> '' and findspot_county <> '' and findspot_country <> ''").select(F.col("ogham_id").alias("stone"), F.regexp_replace("findspot_county", "[^A-Za-z ]", "").alias("county"), F.col("findspot_country").alias("country")).where("length(trim(county)) > 0")
    s = k.groupBy("stone").agg(F.min(F.struct("county", "country")).alias("v")).select("stone", F.trim("v.county").alias("county"), "v.country")
    place = F.concat(F.lit('<history><origin><origPlace corresp="#'), "stone", F.lit('"><placeName type="county">'), "county", F.lit('</placeName> <placeName type="country">'), "country", F.lit("</placeName><geo>1.5, 2.5</geo></origPlace></origin></history>"))
    return s.select("stone", F.format_string(HEAD, "stone", "stone", place).alias("content"))


for _tag, _sql in {
    "origPlace": f"WITH {SPOTS} SELECT stone AS record, 1 AS element_no, '' AS parent_element, 0 AS parent_no, county || ' ' || country || '1.5, 2.5' AS text, '#' || stone AS corresp FROM l",
    "placeName": f"WITH {SPOTS} SELECT stone AS record, 1 AS element_no, 'origPlace' AS parent_element, 1 AS parent_no, county AS text, 'county' AS type FROM l UNION ALL SELECT stone, 2, 'origPlace', 1, country, 'country' FROM l",
    "rdg": f"WITH {APPS} SELECT stone AS record, CAST(no + 1 AS INTEGER) AS element_no, 'app' AS parent_element, CAST(no + 1 AS INTEGER) AS parent_no, t AS text, '#' || code || year AS source, CAST(NULL AS VARCHAR) AS resp FROM q",
    "persName": f"WITH {PHRASES} SELECT stone AS record, CAST(phrase + 1 AS INTEGER) AS element_no, '' AS parent_element, 0 AS parent_no, a || CASE WHEN contains(lemma, '+') THEN ' W W ' ELSE ' W ' END || b AS text, CAST(NULL AS VARCHAR) AS lang FROM ph",
}.items():
    QUERIES[f"made_table_{_tag}"], ORACLES[f"made_table_{_tag}"] = _made_table(_tag), _sql

STONE = f"'{D}stone_' || {SLUG.format('stone')}"
PLACES = f"""{SPOTS}, x AS (SELECT {STONE} AS st, '{D}findspot_' || {SLUG.format('stone')} AS sp, stone, county, country, '{D}place_' || {SLUG.format('country')} || '_' || {SLUG.format('county')} AS k1, '{D}place_' || {SLUG.format('country')} AS k2 FROM l),
 kl AS (SELECT k1 AS k, county AS label, 'county' AS level FROM x UNION SELECT k2, country, 'country' FROM x), kf AS (SELECT k, min((label, level)) AS h FROM kl GROUP BY k)"""


@query(f"""WITH {PLACES} SELECT st AS s, '{RDF}type' AS p, '{CRM}E22_Human-Made_Object' AS o FROM x UNION SELECT st, '{RDFS}label', stone || ' (' || stone || ')' FROM x UNION SELECT st, '{CRM}P1_is_identified_by', stone FROM x UNION SELECT sp, '{RDF}type', '{CRM}E53_Place' FROM x UNION SELECT st, '{CRM}P53_has_former_or_current_location', sp FROM x
UNION SELECT sp, '{CRM}P89_falls_within', k1 FROM x UNION SELECT sp, 'http://www.opengis.net/ont/geosparql#asWKT', 'POINT(2.5 1.5)' FROM x UNION SELECT sp, '{O}geoStatus', 'asserted' FROM x UNION SELECT k, '{RDF}type', '{CRM}E53_Place' FROM kf UNION SELECT k, '{RDFS}label', h[1] FROM kf
UNION SELECT k, '{CRM}P2_has_type', '{D}placetype_' || h[2] FROM kf UNION SELECT '{D}placetype_' || h[2], '{RDF}type', '{CRM}E55_Type' FROM kf UNION SELECT k1, '{CRM}P89_falls_within', k2 FROM x""")
def made_place_triples(spark: SparkSession, d: str) -> DataFrame:
    return triples.place_graph(editions.places(editions.read_records(_spots(spark, d), key="stone", content="content"))).select("s", "p", "o")


@query(f"WITH {SPOTS} SELECT stone, county AS place, 1.5 AS lat, 2.5 AS lon, 0 AS ids, 0 AS names FROM l")
def made_stones(spark: SparkSession, d: str) -> DataFrame:
    x = editions.stones(editions.read_records(_spots(spark, d), key="stone", content="content"))
    return x.select("stone", "place", "lat", "lon", F.size("ids").alias("ids"), F.size("names").alias("names"))


@query(f"WITH {SPOTS} SELECT stone AS ogham_id, stone AS title, county AS pn_county, country AS pn_country, '1.5, 2.5' AS geo_raw, 'asserted' AS geo_status, 1.5 AS lat, 2.5 AS lon FROM l")
def place_rows(spark: SparkSession, d: str) -> DataFrame:
    """The places' report: its fixed fields, of which the ones that are filled here."""
    rows = report(editions.place_rows(editions.read_records(_spots(spark, d), key="stone", content="content")), "places")
    return rows.select("ogham_id", "title", "pn_county", "pn_country", "geo_raw", "geo_status", "lat", "lon")


LINK = "'https://gazetteer.example.org/entity/' || replace(county, ' ', '_')"


@query(f"""WITH {PLACES}, g AS (SELECT DISTINCT k1, {LINK} AS t, '{D}match_' || substr(k1, {len(D) + 1}) || '_' || regexp_replace(replace(county, ' ', '_'), '[^A-Za-z0-9]+', '_', 'g') AS m FROM x)
SELECT k1 AS s, '{SKOS}closeMatch' AS p, t AS o FROM g UNION SELECT m, '{RDF}type', '{RDF}Statement' FROM g UNION SELECT m, '{RDF}subject', k1 FROM g UNION SELECT m, '{RDF}predicate', '{SKOS}closeMatch' FROM g UNION SELECT m, '{RDF}object', t FROM g UNION SELECT m, '{O}weight', '1.00' FROM g UNION SELECT m, '{O}matchStatus', 'source-asserted' FROM g UNION SELECT m, '{O}matchConfidence', '1.00' FROM g UNION SELECT m, '{O}matchTypeCheck', 'curated' FROM g""")
def gazetteer_triples(spark: SparkSession, d: str) -> DataFrame:
    """Counties with a link to a gazetteer each, as weighted statements."""
    p = editions.places(editions.read_records(_spots(spark, d), key="stone", content="content"))
    linked = F.transform("hierarchy", lambda h: h.withField("links", F.when(h["level"] == "county", F.array(F.concat(F.lit("https://gazetteer.example.org/entity/"), F.replace(h["label"], F.lit(" "), F.lit("_"))))).otherwise(F.array().cast("array<string>"))))
    return triples.gazetteer_graph(p.withColumn("hierarchy", linked), ["gazetteer.example.org"]).select("s", "p", "o")


# ---- stones, words, ontology


@query(f"""WITH k AS (SELECT ogham_id AS stone, max(title) AS title, max(ciic) AS ciic, max(keeper) AS keeper FROM keepers WHERE ogham_id <> '' AND title IS NOT NULL GROUP BY ogham_id), x AS (SELECT *, {STONE} AS st, '{D}surface_' || {SLUG.format('stone')} AS su, '{D}inscription_' || {SLUG.format('stone')} AS ins, '{D}id_' || {SLUG.format('stone')} || '_CIIC' AS i, '{D}place_' || {SLUG.format('stone')} AS pl FROM k)
SELECT st AS s, '{RDF}type' AS p, '{CRM}E22_Human-Made_Object' AS o FROM x UNION SELECT st, '{RDF}type', '{O}OghamStone' FROM x UNION SELECT st, '{RDFS}label', title FROM x UNION SELECT su, '{RDF}type', '{CRM}E25_Human-Made_Feature' FROM x UNION SELECT su, '{RDFS}label', 'inscribed surface' FROM x UNION SELECT st, '{CRM}P56_bears_feature', su FROM x
UNION SELECT ins, '{RDF}type', '{triples.CRMTEX}TX1_Written_Text' FROM x UNION SELECT ins, '{RDF}type', '{O}Inscription' FROM x UNION SELECT st, '{O}carries', ins FROM x UNION SELECT pl, '{RDF}type', '{CRM}E53_Place' FROM x WHERE length(keeper) > 0 UNION SELECT pl, '{RDFS}label', keeper FROM x WHERE length(keeper) > 0 UNION SELECT st, '{CRM}P53_has_former_or_current_location', pl FROM x WHERE length(keeper) > 0
UNION SELECT i, '{RDF}type', '{CRM}E42_Identifier' FROM x WHERE ciic IS NOT NULL UNION SELECT i, '{RDFS}label', ciic FROM x WHERE ciic IS NOT NULL UNION SELECT i, '{CRM}P2_has_type', 'CIIC' FROM x WHERE ciic IS NOT NULL UNION SELECT st, '{CRM}P1_is_identified_by', i FROM x WHERE ciic IS NOT NULL""")
def stone_triples(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keepers").where("ogham_id <> '' and title is not null").groupBy(F.col("ogham_id").alias("stone")).agg(F.max("title").alias("label"), F.max("ciic").alias("ciic"), F.max("keeper").alias("place"))
    none = F.lit(None).cast("string")
    ids = F.map_filter(F.create_map(F.lit("CIIC"), F.col("ciic")), lambda _, v: v.isNotNull())
    return triples.stone_graph(k.select("stone", "label", ids.alias("ids"), none.alias("object_type"), none.alias("material"), none.alias("inscription"), "place", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array().cast("array<string>").alias("names"))).select("s", "p", "o")


VALUES = ", ".join(str(v) for v in VOCABULARY)
WORDS = f"""v(word, mode, variant) AS (VALUES {VALUES}), r AS (SELECT DISTINCT ogham_id AS stone, editor, {NORM.format('this_reading_text')} AS t FROM readings WHERE this_reading_text IS NOT NULL AND ogham_id IS NOT NULL AND editor IS NOT NULL), k AS (SELECT *, unnest(string_split(t, ' ')) AS token FROM r),
 m AS (SELECT *, {STONE} AS st, '{D}inscription_' || {SLUG.format('stone')} AS ins, '{D}reading_' || {SLUG.format('stone')} || '_' || {SLUG.format('editor')} AS rd, '{D}agent_' || {SLUG.format('editor')} AS ag, '{D}word_' || word || '_' || mode AS w, '{D}word_occ_' || {SLUG.format('stone')} || '_' || {SLUG.format('editor')} || '_' || word || '_' || mode AS oc, CASE WHEN mode = 'formula' THEN '{O}FormulaWord' ELSE '{O}NomenclatureWord' END AS cls FROM k JOIN v ON token <> '' AND CASE WHEN mode = 'element' THEN contains(token, variant) ELSE token = variant END),
 e AS (SELECT *, '{D}word_' || word || '_' || mode AS w, CASE WHEN mode = 'formula' THEN '{O}FormulaWord' ELSE '{O}NomenclatureWord' END AS cls FROM v)"""


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vocabulary = spark.createDataFrame(VOCABULARY, "word string, mode string, variant string")
    r = table(spark, d, "readings").where("this_reading_text is not null and ogham_id is not null and editor is not null").select(F.col("ogham_id").alias("stone"), "editor", text.normalise_reading(F.col("this_reading_text")).alias("text")).distinct()
    tokens = r.select("*", F.col("editor").alias("reading_id"), F.lit("ogham").alias("script"), F.explode(text.words(F.col("text"))).alias("token"))
    return resolve.match_words(tokens, vocabulary, token="token"), vocabulary


@query(f"""WITH {WORDS} SELECT w AS s, '{RDF}type' AS p, '{CRM}E55_Type' AS o FROM e UNION SELECT w, '{RDF}type', cls FROM e UNION SELECT w, '{RDFS}label', word FROM e UNION SELECT w, '{O}wordClass', mode FROM e UNION SELECT w, '{SKOS}altLabel', variant FROM e
UNION SELECT rd, '{RDF}type', '{O}Reading' FROM m UNION SELECT rd, '{RDFS}label', t FROM m UNION SELECT rd, '{O}script', 'ogham' FROM m UNION SELECT ins, '{O}identifiedAs', rd FROM m UNION SELECT st, '{O}carries', ins FROM m UNION SELECT ag, '{RDF}type', '{PROV}Agent' FROM m UNION SELECT ag, '{RDFS}label', editor FROM m UNION SELECT rd, '{PROV}wasAttributedTo', ag FROM m
UNION SELECT oc, '{RDF}type', cls FROM m UNION SELECT oc, '{RDFS}label', token FROM m UNION SELECT oc, '{CRM}P2_has_type', w FROM m UNION SELECT oc, '{O}matchedVariant', variant FROM m UNION SELECT oc, '{O}matchMode', mode FROM m UNION SELECT st, '{O}shows', oc FROM m""")
def word_triples(spark: SparkSession, d: str) -> DataFrame:
    return triples.word_graph(*_hits(spark, d)).select("s", "p", "o")


@query(f"WITH {WORDS} SELECT DISTINCT stone, editor, word, mode, variant, token FROM m")
def word_rows(spark: SparkSession, d: str) -> DataFrame:
    """The words' report: one row for each edition, reading and match."""
    return _hits(spark, d)[0].select("stone", "editor", "word", "mode", "variant", "token").distinct()


@query(f"WITH {WORDS} SELECT stone, bool_or(editor LIKE '%19%') AS modern, count(DISTINCT editor) AS readings FROM m WHERE word = 'MAQI' AND mode = 'formula' GROUP BY stone")
def view_words(spark: SparkSession, d: str) -> DataFrame:
    """Stones with one word, and whether an edition of one century has it."""
    m = _hits(spark, d)[0].where((F.col("word") == "MAQI") & (F.col("mode") == "formula"))
    return m.groupBy("stone").agg(F.bool_or(F.contains("editor", F.lit("19"))).alias("modern"), F.countDistinct("editor").alias("readings"))


@query(f"""WITH s AS (SELECT DISTINCT lower(commit) AS c, source, commit_date AS dt, commit_subject AS sub, '{D}snapshot_' || lower(commit) AS m FROM manifest_snapshots)
SELECT '{D}corpus' AS s, '{RDF}type' AS p, '{PROV}Entity' AS o UNION SELECT m, '{RDF}type', '{PROV}Entity' FROM s UNION SELECT '{D}corpus', '{PROV}wasDerivedFrom', m FROM s UNION SELECT m, '{RDFS}label', c FROM s UNION SELECT m, '{PROV}atLocation', source FROM s WHERE length(source) > 0 UNION SELECT m, '{PROV}generatedAtTime', dt FROM s WHERE dt IS NOT NULL
UNION SELECT m, '{RDFS}comment', sub FROM s WHERE length(sub) > 0 UNION SELECT '{D}agent_builder', '{RDF}type', '{PROV}Agent' UNION SELECT '{D}corpus', '{PROV}wasAttributedTo', '{D}agent_builder'""")
def provenance_triples(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "manifest_snapshots").select(F.lower("commit").alias("commit"), "source", F.col("commit_date").alias("date"), F.col("commit_subject").alias("subject"))
    return triples.provenance_graph(s, graph="corpus", agent="builder").select("s", "p", "o")


MAPS = f"m AS (SELECT DISTINCT '{O}' || kind AS app, '{O}' || source AS domain, '{CRM}' || status AS crm FROM (SELECT 'a_' || note AS kind, source, status FROM keeper_coordinates))"


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keeper_coordinates")
    return k.select(F.concat(F.lit(O + "a_"), "note").alias("app"), F.concat(F.lit(O), "source").alias("domain"), F.concat(F.lit(CRM), "status").alias("crm")).distinct()


@query(f"""WITH {MAPS}, f AS (SELECT * FROM m WHERE app IS NOT NULL AND domain IS NOT NULL AND crm IS NOT NULL) SELECT app AS s, '{RDFS}subClassOf' AS p, domain AS o FROM f UNION SELECT domain, '{RDFS}subClassOf', crm FROM f UNION SELECT crm, '{RDFS}subClassOf', '{CRM}E1_CRM_Entity' FROM f UNION SELECT '{CRM}E1_CRM_Entity', '{RDFS}subClassOf', '{triples.OWL}Thing' FROM f
UNION SELECT app, '{RDF}type', '{triples.OWL}Class' FROM f UNION SELECT domain, '{RDF}type', '{triples.OWL}Class' FROM f UNION SELECT crm, '{RDF}type', '{triples.OWL}Class' FROM f UNION SELECT '{CRM}E1_CRM_Entity', '{RDF}type', '{triples.OWL}Class' FROM f UNION SELECT app, '{RDFS}label', regexp_extract(app, '[^/#]*$') FROM f""")
def class_triples(spark: SparkSession, d: str) -> DataFrame:
    return triples.class_graph(_mapping(spark, d)).select("s", "p", "o")


@query(f"WITH {MAPS} SELECT app, 'no domain' AS gap FROM m WHERE domain IS NULL UNION ALL SELECT app, 'no crm' FROM m WHERE crm IS NULL UNION ALL SELECT app, 'its own parent' FROM m WHERE app = domain OR domain = crm")
def mapping_gaps(spark: SparkSession, d: str) -> DataFrame:
    return triples.mapping_gaps(_mapping(spark, d))


@query(f"WITH RECURSIVE {UPS}, reach AS (SELECT child AS node, parent AS ancestor FROM up UNION SELECT r.node, up.parent FROM reach r JOIN up ON r.ancestor = up.child), c AS (SELECT DISTINCT 'S' || s_suppkey AS child, r_name AS parent FROM supplier, region) SELECT child, parent, child = parent AS same_name FROM c WHERE NOT EXISTS (SELECT 1 FROM reach WHERE node = child AND ancestor = parent)")
def subclass_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that each supplier is in each region, but for those that hold."""
    from stonegraph.operators.graph import closure

    regions = [r["r_name"] for r in table(spark, d, "region").collect()]
    claims = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("child"), F.explode(F.array(*map(F.lit, regions))).alias("parent"))
    return triples.subclass_claims(claims, closure(_ups(spark, d), child="child", parent="parent"))


@query(f"""WITH {STAR}, v AS (SELECT '{D}region_' || {SLUG.format('r_name')} AS node FROM region JOIN nation ON r_regionkey = n_regionkey)
SELECT 'new local term' AS kind, '{O}Region' AS term, 'class' AS position, count(*) AS n, '' AS example FROM star WHERE o = '{O}Region' UNION ALL SELECT 'new local term', p, 'property', count(*), '' FROM star WHERE p = '{O}size' GROUP BY p UNION ALL SELECT 'violation', '{CRM}P89_falls_within', 'range', count(DISTINCT node), min(node) FROM v""")
def graph_check(spark: SparkSession, d: str) -> DataFrame:
    tree, reference = _ontology(spark)
    return triples.check(_star(spark, d), reference, tree, watched=[CRM, O])


@query(f"""WITH {STAR}, x AS (SELECT replace(s, '{O}', 'http://new.example.org/') AS s, replace(p, '{O}', 'http://new.example.org/') AS p, CASE WHEN kind = 'uri' THEN replace(replace(o, '{O}Region', '{O}Area'), '{O}', 'http://new.example.org/') ELSE o END AS o FROM star)
SELECT DISTINCT * FROM x WHERE p <> '{CRM}P89_falls_within' UNION SELECT '{D}a', '{RDFS}label', 'added'""")
def patched_graph(spark: SparkSession, d: str) -> DataFrame:
    """A graph in another namespace, with one class renamed, one property taken out and a triple added."""
    g = triples.renamespace(_star(spark, d), O, "http://new.example.org/", {"Region": "Area"})
    add = spark.createDataFrame([(D + "a", RDFS + "label", "added", "lit", "", "")], "s string, p string, o string, kind string, dtype string, lang string")
    return triples.patch(g, remove=g.where(F.col("p") == CRM + "P89_falls_within").select("s", "p", "o"), add=add).select("s", "p", "o")


@query(f"WITH {STAR}, n AS (SELECT count(DISTINCT s) FILTER (p = '{RDF}type' AND o = '{CRM}E53_Place') AS places, count(DISTINCT s) FILTER (p = '{RDF}type' AND o = '{O}Region') AS regions, count(*) AS triples FROM star) SELECT unnest(['places', 'regions', 'triples']) AS figure, unnest([places, regions, triples]) AS n FROM n")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    from stonegraph.operators.reports import graph_summary as summary

    return summary(_star(spark, d), {"places": CRM + "E53_Place", "regions": O + "Region"})


@query("SELECT stone, bad FROM (SELECT DISTINCT ogham_id AS stone, length(ogham_id) % 2 = 0 AS bad FROM keepers WHERE ogham_id <> '')")
def mended_editions(spark: SparkSession, d: str) -> DataFrame:
    """Editions with an element left open, a stray end, a loose sign or a cut end are read all the same; ``bad`` tells which had to be mended."""
    good = "<TEI><title>t</title><idno type='filename'>%s</idno></TEI>"
    broken = "<TEI><title>a & b<idno type='filename'>%s</idno></hi><note>x < y</note><p>cut"
    k = table(spark, d, "keepers").where("ogham_id <> ''").select(F.col("ogham_id").alias("stone")).distinct()
    made = k.select("stone", F.when(F.length("stone") % 2 == 0, F.format_string(broken, "stone")).otherwise(F.format_string(good, "stone")).alias("content"))
    return editions.read_records(made, key="stone", content="content").select(F.try_element_at("ids", F.lit("filename")).alias("stone"), F.col("recovered").alias("bad"))
