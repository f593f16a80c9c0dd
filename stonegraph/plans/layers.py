"""Queries of the layers of a corpus: dissent, persons, holders, worklist, reconciliation, with DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonegraph.functions import text
from stonegraph import sinks
from stonegraph.operators import graph, reports, resolve, rules, views
from stonegraph.operators.snapshot import plain_path
from stonegraph.plans.dealt import CHANGED, p1_found
from stonegraph.plans.queries import DISTANCES, EDGES, SETTING, _distances, _settings
from stonegraph.session import table
from stonegraph.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LETTERS = "nullif(upper(regexp_replace({0}, '[^A-Za-z]', '', 'g')), '')"


def _letters(c: str):
    return F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), F.lit(""))


# ---- dissent


@query(f"WITH {DISTANCES} SELECT count(DISTINCT ogham_id) AS stones, count(*) AS comparisons, count(DISTINCT editor) AS editors, count(DISTINCT ogham_id) FILTER (contains(a, 'MAQI') <> contains(b, 'MAQI')) AS at_stake FROM bands")
def dissent_summary(spark: SparkSession, d: str) -> DataFrame:
    stake = F.contains("a", F.lit("MAQI")) != F.contains("b", F.lit("MAQI"))
    return reports.dissent_summary(_distances(spark, d), key="ogham_id", editor="editor", ratio="closeness", at_stake=stake)


@query(f"""WITH {DISTANCES}, least AS (SELECT ogham_id, min(closeness) AS c FROM bands GROUP BY ogham_id)
SELECT 'stone' AS dimension, '' AS value, CASE WHEN c >= 1 THEN 'identical' WHEN c >= 0.8 THEN 'close' WHEN c >= 0.5 THEN 'diverging' ELSE 'far apart' END AS band, count(*) AS n FROM least GROUP BY 3
UNION ALL SELECT 'editor', editor, band, count(*) FROM bands GROUP BY editor, band""")
def dissent_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.dissent_histogram(_distances(spark, d), key="ogham_id", editor="editor", ratio="closeness")


@query("SELECT ogham_id, count(*) AS n FROM readings WHERE band IN ('diverging', 'far apart') AND length(concat(formula_gained, formula_lost)) > 0 AND editor IS NOT NULL GROUP BY ogham_id")
def view_readings(spark: SparkSession, d: str) -> DataFrame:
    stake = F.length(F.concat(F.coalesce("formula_gained", F.lit("")), F.coalesce("formula_lost", F.lit("")))) > 0
    rows = views.faceted(table(spark, d, "readings"), among={"band": ["diverging", "far apart"]}, flags=[stake, F.col("editor").isNotNull()])
    return rows.groupBy("ogham_id").agg(F.count("*").alias("n"))


@query("""
WITH cur AS (SELECT ogham_id, script, min(current_edition_text) AS current_text FROM readings WHERE current_edition_text <> '' AND ogham_id IS NOT NULL AND script IS NOT NULL GROUP BY ogham_id, script)
SELECT DISTINCT r.ogham_id, r.script, r.editor, r.this_reading_text AS text, cur.current_text FROM readings r JOIN cur USING (ogham_id, script) WHERE r.this_reading_text <> ''
""")
def paired_readings(spark: SparkSession, d: str) -> DataFrame:
    """Current and other readings of one long table, paired within stone and script."""
    r = table(spark, d, "readings")
    current = r.where("current_edition_text <> ''").select("ogham_id", "script", F.lit("current").alias("editor"), F.col("current_edition_text").alias("text"), F.lit(True).alias("current"))
    other = r.where("this_reading_text <> ''").select("ogham_id", "script", "editor", F.col("this_reading_text").alias("text"), F.lit(False).alias("current"))
    return resolve.pair_readings(current.unionByName(other), stone="ogham_id", script="script", current="current", order="text").select("ogham_id", "script", "editor", "text", "current_text").distinct()


@query("SELECT ogham_id, editor, printf('%.3f', similarity) AS similarity, coalesce(band, '') AS band, coalesce(formula_gained, '') AS formula_gained, coalesce(formula_lost, '') AS formula_lost FROM readings WHERE similarity IS NOT NULL GROUP BY ALL")
def readings_rows(spark: SparkSession, d: str) -> DataFrame:
    """The readings' report: numbers with three decimals, nothing null."""
    r = table(spark, d, "readings").where("similarity is not null")
    return r.select("ogham_id", "editor", F.format_string("%.3f", "similarity").alias("similarity"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("band", "formula_gained", "formula_lost"))).distinct()


# ---- persons

ENDS = f"e AS (SELECT DISTINCT stone, {LETTERS.format('from_name')} AS a, {LETTERS.format('to_name')} AS b FROM persons WHERE stone IS NOT NULL)"


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons").where("stone is not null").select("stone", _letters("from_name").alias("a"), _letters("to_name").alias("b")).distinct()


@query(f"""WITH {ENDS}, m AS (SELECT stone, a AS name FROM e WHERE a IS NOT NULL UNION SELECT stone, b FROM e WHERE b IS NOT NULL), f AS (SELECT name, min(stone) AS first FROM m GROUP BY name HAVING count(*) > 1)
SELECT name, stone AS place, first FROM m JOIN f USING (name) WHERE stone <> first""")
def name_bridges(spark: SparkSession, d: str) -> DataFrame:
    e = _ends(spark, d)
    return graph.bridges(e.select("stone", F.col("a").alias("name")).union(e.select("stone", "b")), name="name", place="stone")


@query(f"""WITH RECURSIVE {ENDS}, g AS (SELECT * FROM e WHERE a IS NOT NULL AND b IS NOT NULL), w AS (SELECT a, b FROM g UNION SELECT b, a FROM g), reach AS (SELECT a AS node, a AS other FROM w UNION SELECT r.node, w.b FROM reach r JOIN w ON r.other = w.a),
 c AS (SELECT node, min(other) AS component FROM reach GROUP BY node), n AS (SELECT component, count(*) AS nodes FROM c GROUP BY component), k AS (SELECT component, count(*) AS edges, count(DISTINCT stone) AS places FROM g JOIN c ON g.a = c.node GROUP BY component)
SELECT component, nodes, edges, places, row_number() OVER (ORDER BY places DESC, nodes DESC, component) AS rank FROM n JOIN k USING (component)""")
def family_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Families of the persons' statements: nodes, edges, stones and rank."""
    e = _ends(spark, d).where("a is not null and b is not null")
    return reports.component_rollup(e, graph.components(e, a="a", b="b"), a="a", b="b", place="stone")


@query(f"WITH {ENDS} SELECT stone, a, b, row_number() OVER (ORDER BY stone, a NULLS FIRST, b NULLS FIRST) - 1 AS no FROM e")
def numbered_edges(spark: SparkSession, d: str) -> DataFrame:
    return reports.numbered_globally(_ends(spark, d), order=["stone", "a", "b"])


@query(f"""WITH p AS (SELECT DISTINCT stone, from_name, to_name, {LETTERS.format('from_name')} AS a, {LETTERS.format('to_name')} AS b FROM persons WHERE stone IS NOT NULL), s AS (SELECT a AS slot, from_name AS surface, stone FROM p WHERE a IS NOT NULL UNION SELECT b, to_name, stone FROM p WHERE b IS NOT NULL),
 l AS (SELECT slot, arg_max(surface, stone || '/' || surface) AS surface FROM s GROUP BY slot)
SELECT DISTINCT p.stone, p.a, p.b, x.surface AS a_surface, y.surface AS b_surface FROM p LEFT JOIN l x ON x.slot = p.a LEFT JOIN l y ON y.slot = p.b""")
def edge_slots(spark: SparkSession, d: str) -> DataFrame:
    """Statements with the surface that each end was last met with."""
    p = table(spark, d, "persons").where("stone is not null").select("stone", "from_name", "to_name", _letters("from_name").alias("a"), _letters("to_name").alias("b"))
    s = p.select("a", "from_name", "stone").union(p.select("b", "to_name", "stone")).toDF("slot", "surface", "stone").where("slot is not null").withColumn("ord", F.concat_ws("/", "stone", "surface"))
    return resolve.edge_slots(p.select("stone", "a", "b").distinct(), s, a="a", b="b").distinct()


@query("SELECT stone, count(*) AS n FROM persons WHERE list_contains(string_split(relation_lemma, '+'), 'maqqas') AND uncertain = 'no' GROUP BY stone")
def view_persons(spark: SparkSession, d: str) -> DataFrame:
    """Stones with a certain relation of one lemma, compound ones included."""
    has = F.exists(F.split("relation_lemma", r"\+"), lambda x: x == "maqqas")
    return views.faceted(table(spark, d, "persons"), among={"uncertain": ["no"]}, flags=[has]).groupBy("stone").agg(F.count("*").alias("n"))


# ---- holders


@query("SELECT count(*) FILTER (coalesce(alias_of, '') = '' AND lat <> '' AND lon <> '') AS located, count(*) FILTER (coalesce(alias_of, '') = '') AS total, count(*) FILTER (alias_of <> '') AS aliases FROM keeper_coordinates")
def located_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.located_summary(table(spark, d, "keeper_coordinates"))


HOME = """c AS (SELECT keeper_qid, findspot_country, count(*) AS n FROM keepers WHERE findspot_country IS NOT NULL AND keeper_qid <> '' GROUP BY ALL),
 home AS (SELECT keeper_qid, findspot_country AS home FROM c QUALIFY row_number() OVER (PARTITION BY keeper_qid ORDER BY n DESC, findspot_country) = 1)"""


def _abroad(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keepers").where("keeper_qid <> ''").select("ogham_id", "keeper_qid", "findspot_country").distinct()
    homes = rules.modal(table(spark, d, "keepers").where("keeper_qid <> ''"), key=["keeper_qid"], value="findspot_country")
    return reports.cross_border(k, homes, holder="keeper_qid", country="findspot_country")


@query(f"WITH {HOME} SELECT DISTINCT ogham_id, keeper_qid, findspot_country, home, coalesce(home <> findspot_country, false) AS abroad FROM keepers LEFT JOIN home USING (keeper_qid) WHERE keeper_qid <> ''")
def cross_border(spark: SparkSession, d: str) -> DataFrame:
    return _abroad(spark, d)


@query(f"WITH {HOME}, k AS (SELECT DISTINCT ogham_id, keeper_qid, findspot_country, coalesce(home <> findspot_country, false) AS abroad FROM keepers LEFT JOIN home USING (keeper_qid) WHERE keeper_qid <> '') SELECT findspot_country, count(DISTINCT keeper_qid) AS holders, count(*) AS stones, count(*) FILTER (abroad) AS abroad FROM k WHERE findspot_country IN ('Ireland', 'Wales') GROUP BY findspot_country")
def view_keepers(spark: SparkSession, d: str) -> DataFrame:
    """Holders of the stones found in some countries: how many, and how many stones went abroad."""
    shown = views.faceted(_abroad(spark, d), among={"findspot_country": ["Ireland", "Wales"]})
    return shown.groupBy("findspot_country").agg(F.countDistinct("keeper_qid").alias("holders"), F.count("*").alias("stones"), F.count_if("abroad").alias("abroad"))


@query("SELECT DISTINCT keeper AS repository FROM keepers WHERE length(trim(keeper)) > 0 AND keeper NOT IN (SELECT repository FROM keeper_coordinates WHERE lat <> '' AND lon <> '' AND repository IS NOT NULL)")
def pending_keepers(spark: SparkSession, d: str) -> DataFrame:
    located = table(spark, d, "keeper_coordinates").where("lat <> '' and lon <> ''")
    return resolve.pending(table(spark, d, "keepers").select(F.col("keeper").alias("repository")), located, name="repository")


@query("SELECT repository, qid, source FROM keeper_coordinates k WHERE source IN ('wikidata', 'osm') AND coalesce(alias_of, '') = '' AND qid <> '' AND NOT EXISTS (SELECT 1 FROM keeper_coordinates h WHERE h.status = 'verified' AND h.repository = k.repository)")
def keeper_suggestions(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keeper_coordinates")
    return resolve.suggestions(k, k.where("status = 'verified'"), key="repository", sources=["wikidata", "osm"]).select("repository", "qid", "source")


@query("SELECT repository, CASE WHEN status = 'verified' THEN lat END AS lat, CASE WHEN status = 'verified' THEN lon END AS lon, status IS DISTINCT FROM 'verified' AS reset FROM keeper_coordinates")
def reset_unverified(spark: SparkSession, d: str) -> DataFrame:
    return resolve.reset_unverified(table(spark, d, "keeper_coordinates"), ["lat", "lon"]).select("repository", "lat", "lon", "reset")


@query("SELECT repository FROM keeper_coordinates k WHERE repository IS NOT NULL AND NOT EXISTS (SELECT 1 FROM keepers p WHERE p.keeper = k.repository)")
def unused_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the list kept by hand that no record uses."""
    k = table(spark, d, "keeper_coordinates").where("repository is not null")
    return k.join(table(spark, d, "keepers").select(F.col("keeper").alias("repository")).distinct(), "repository", "left_anti").select("repository")


@query("""
WITH pts AS (SELECT keeper_qid AS id, min((keeper_lat, keeper_lon)) AS p FROM keepers WHERE keeper_qid <> '' AND keeper_lat IS NOT NULL AND keeper_lon IS NOT NULL GROUP BY 1),
 f AS (SELECT keeper AS name, keeper_qid AS qid, keeper_lat AS lat, keeper_lon AS lon, findspot_country = 'Ireland' AS in_country, year(recorded) AS rank FROM keepers WHERE length(keeper) > 0),
 best AS (SELECT name, qid, lat, lon FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY lat IS NULL, NOT coalesce(in_country, false), rank, qid NULLS FIRST, lat, lon) = 1),
 h AS (SELECT k.repository AS name, k.qid, TRY_CAST(k.lat AS DOUBLE) AS lat, TRY_CAST(k.lon AS DOUBLE) AS lon, a.p[1] AS qlat, a.p[2] AS qlon, b.name IS NOT NULL AS hit, b.qid AS bqid, b.lat AS blat, b.lon AS blon,
        CASE WHEN coalesce(alias_of, '') <> '' THEN 'alias' WHEN k.source = 'manual' THEN 'manual' WHEN coalesce(k.qid, '') = '' AND coalesce(k.osm_id, '') = '' AND k.lat IS NOT NULL THEN 'located' WHEN a.id IS NOT NULL THEN 'qid' WHEN coalesce(k.qid, '') <> '' OR coalesce(k.osm_id, '') <> '' THEN 'pinned, not found' WHEN b.name IS NOT NULL THEN 'search' ELSE 'nothing' END AS decided_by
       FROM keeper_coordinates k LEFT JOIN pts a ON a.id = k.qid LEFT JOIN best b ON b.name = k.repository)
SELECT name, CASE WHEN decided_by = 'search' THEN bqid ELSE qid END AS qid, CASE WHEN decided_by IN ('alias', 'manual', 'located') THEN lat WHEN decided_by = 'qid' THEN qlat WHEN decided_by = 'search' THEN blat END AS lat, CASE WHEN decided_by IN ('alias', 'manual', 'located') THEN lon WHEN decided_by = 'qid' THEN qlon WHEN decided_by = 'search' THEN blon END AS lon, decided_by FROM h
""")
def holder_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The listed institutions located anew, from the points recorded with stones."""
    k = table(spark, d, "keeper_coordinates")
    h = k.select(F.col("repository").alias("name"), "alias_of", "qid", "osm_id", "source", F.expr("try_cast(lat as double)").alias("lat"), F.expr("try_cast(lon as double)").alias("lon"))
    p = table(spark, d, "keepers")
    by_id = p.where("keeper_qid <> ''").select(F.col("keeper_qid").alias("id"), F.col("keeper_lat").alias("lat"), F.col("keeper_lon").alias("lon"))
    found = p.where("length(keeper) > 0").select(F.col("keeper").alias("name"), F.col("keeper_qid").alias("qid"), F.year("recorded").alias("rank"), (F.col("findspot_country") == "Ireland").alias("in_country"), F.col("keeper_lat").alias("lat"), F.col("keeper_lon").alias("lon"))
    return resolve.locate_holders(h, by_id, found)


@query("""
WITH k AS (SELECT repository AS key, * FROM keeper_coordinates)
SELECT key, 'no key' AS complaint FROM k WHERE length(trim(coalesce(key, ''))) = 0 UNION ALL SELECT key, 'bad qid' FROM k WHERE qid <> '' AND NOT regexp_matches(qid, '^Q[0-9]+$') UNION ALL SELECT key, 'bad osm id' FROM k WHERE osm_id <> '' AND NOT regexp_matches(osm_id, '^[NWR][0-9]+$')
UNION ALL SELECT key, 'lat and lon must be given together' FROM k WHERE (coalesce(lat, '') = '') <> (coalesce(lon, '') = '') UNION ALL SELECT key, 'not a number' FROM k WHERE (lat <> '' AND TRY_CAST(lat AS DOUBLE) IS NULL) OR (lon <> '' AND TRY_CAST(lon AS DOUBLE) IS NULL)
UNION ALL SELECT key, 'not on earth' FROM k WHERE abs(TRY_CAST(lat AS DOUBLE)) > 90 OR abs(TRY_CAST(lon AS DOUBLE)) > 180 UNION ALL SELECT key, 'alias of itself' FROM k WHERE key = alias_of
UNION ALL SELECT DISTINCT key, 'unknown key' FROM k WHERE length(trim(key)) > 0 AND key NOT IN (SELECT keeper FROM keepers WHERE keeper IS NOT NULL) UNION ALL SELECT key, 'ignored beside an alias' FROM k WHERE alias_of <> '' AND (qid <> '' OR note <> '')
""")
def identifier_complaints(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keeper_coordinates").withColumnRenamed("repository", "key")
    return resolve.identifier_complaints(k, table(spark, d, "keepers").select(F.col("keeper").alias("key")), ignored=["qid", "note"])


@query("SELECT repository, unnest(['alias_of', 'osm_id']) AS field FROM keeper_coordinates WHERE repository IS NOT NULL")
def unknown_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the list that a reader of ids and points doesn't know."""
    k = table(spark, d, "keeper_coordinates").where("repository is not null")
    fields = F.create_map(*(x for c in ("qid", "lat", "lon", "alias_of", "osm_id") for x in (F.lit(c), F.col(c))))
    return resolve.unknown_fields(k.select("repository", fields.alias("fields")), key="repository", fields="fields", known=["qid", "lat", "lon"])


# ---- reconciliation

KINDS = {"material": ["rock", "stone", "slate", "limestone"], "objectType": ["stone", "cross", "bead", "comb"]}


@query("""
WITH c AS (SELECT kind, label, CASE WHEN type_match = 'ok' THEN [CASE WHEN kind = 'editor' THEN 'Q5' ELSE 'Q7' END] WHEN type_match = 'mismatch' THEN ['Q4167410'] END AS classes, CASE WHEN type_match IS NULL THEN NULL ELSE [wd_label] END AS labels FROM wikidata_links)
SELECT kind, label, CASE WHEN coalesce(len(classes), 0) = 0 AND coalesce(len(labels), 0) = 0 THEN NULL WHEN kind = 'editor' THEN coalesce(list_contains(classes, 'Q5'), false) WHEN kind = 'material' THEN coalesce(regexp_matches(lower(labels[1]), 'rock|stone|slate|limestone'), false) WHEN kind = 'objectType' THEN coalesce(regexp_matches(lower(labels[1]), 'stone|cross|bead|comb'), false) ELSE false END AS fits FROM c
""")
def type_fits(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wikidata_links")
    classes = F.when(F.col("type_match") == "ok", F.array(F.when(F.col("kind") == "editor", "Q5").otherwise("Q7"))).when(F.col("type_match") == "mismatch", F.array(F.lit("Q4167410")))
    labels = F.when(F.col("type_match").isNotNull(), F.array("wd_label"))
    return w.select("kind", "label", resolve.type_fits(F.col("kind"), classes, labels, KINDS).alias("fits"))


TERMS = """t AS (SELECT DISTINCT kind, label FROM label_entries WHERE kind IS NOT NULL AND label IS NOT NULL), al AS (SELECT 'repository' AS kind, repository AS label, max(qid) AS aq FROM keeper_coordinates WHERE status = 'verified' AND qid <> '' GROUP BY repository),
 ca AS (SELECT kind, label, max((status = 'verified', qid, confidence)) AS c FROM wikidata_links GROUP BY kind, label),
 x AS (SELECT t.kind, t.label, w.wd_label AS hit, w.qid, row_number() OVER (PARTITION BY t.kind, t.label ORDER BY w.wd_label, w.qid) AS rank, w.type_match = 'ok' AS fits FROM t JOIN wikidata_links w ON t.kind = w.kind AND lower(left(t.label, 4)) = left(w.wd_label, 4) WHERE w.qid <> ''),
 y AS (SELECT *, coalesce(fits, false) AND rank <= 5 AS ok, max(CAST(fits IS NOT NULL AS INT)) OVER (PARTITION BY kind, label) AS known, CASE WHEN lower(trim(label)) = lower(trim(hit)) THEN 0.9 WHEN contains(lower(trim(hit)), lower(trim(label))) OR contains(lower(trim(label)), lower(trim(hit))) THEN 0.7 ELSE 0.5 END AS base FROM x),
 b AS (SELECT kind, label, hit, CAST(CASE WHEN known = 0 THEN base WHEN ok THEN least(1.0, base + 0.05) ELSE base * 0.5 END AS DOUBLE) AS cc, CASE WHEN known = 0 THEN 'unknown' WHEN ok THEN 'ok' ELSE 'mismatch' END AS tm FROM y QUALIFY row_number() OVER (PARTITION BY kind, label ORDER BY ok DESC, rank) = 1),
 q AS (SELECT kind, label, hit, min(qid) AS cq FROM x GROUP BY kind, label, hit),
 r AS (SELECT t.kind, t.label, aq, c, cq, cc, tm, CASE WHEN aq IS NOT NULL THEN 'curated' WHEN c[1] AND length(c[2]) > 0 THEN 'verified' WHEN cq IS NOT NULL THEN 'candidate' WHEN length(c[2]) > 0 THEN 'cache' ELSE '' END AS decided_by FROM t LEFT JOIN al USING (kind, label) LEFT JOIN ca USING (kind, label) LEFT JOIN b USING (kind, label) LEFT JOIN q USING (kind, label, hit))"""


@query(f"WITH {TERMS} SELECT kind, label, CASE decided_by WHEN 'curated' THEN aq WHEN 'verified' THEN c[2] WHEN 'candidate' THEN cq WHEN 'cache' THEN c[2] END AS qid, round(coalesce(CASE decided_by WHEN 'curated' THEN 1.0 WHEN 'verified' THEN c[3] WHEN 'candidate' THEN cc WHEN 'cache' THEN c[3] END, 0)::DOUBLE, 1) AS confidence, CASE WHEN decided_by IN ('curated', 'verified') THEN 'verified' WHEN decided_by <> '' THEN 'auto' END AS status, CASE decided_by WHEN 'curated' THEN 'curated' WHEN 'verified' THEN 'ok' WHEN 'candidate' THEN tm WHEN 'cache' THEN 'unknown' END AS type_match, decided_by FROM r")
def reconcile_terms(spark: SparkSession, d: str) -> DataFrame:
    """Labels as typed: each different one against the list set by hand, the verified links, and candidates that begin alike."""
    from pyspark.sql import Window

    links, terms = table(spark, d, "wikidata_links"), table(spark, d, "label_entries").select("kind", "label")
    allowed = table(spark, d, "keeper_coordinates").where("status = 'verified'").select(F.lit("repository").alias("kind"), F.col("repository").alias("label"), "qid")
    hits = links.where("qid <> ''").select("kind", F.col("wd_label").alias("hit"), "qid", (F.col("type_match") == "ok").alias("fits"), F.left("wd_label", F.lit(4)).alias("begin"))
    once = terms.where("kind is not null and label is not null").distinct().withColumn("begin", F.lower(F.left("label", F.lit(4))))
    found = once.join(hits, ["kind", "begin"]).withColumn("rank", F.row_number().over(Window.partitionBy("kind", "label").orderBy("hit", "qid"))).drop("begin")
    r = resolve.reconcile(terms, allowed=allowed, cache=links.select("kind", "label", "qid", "confidence", "status"), candidates=found, key=["kind", "label"], label="label")
    return r.withColumn("confidence", F.round("confidence", 1))


@query(f"""WITH n AS (SELECT DISTINCT from_name FROM persons WHERE from_name IS NOT NULL), l AS (SELECT {LETTERS.format('to_name')} AS label, min(to_name) AS uri FROM persons WHERE {LETTERS.format('to_name')} IS NOT NULL GROUP BY 1),
 f AS (SELECT from_name, 0 AS form, from_name AS label FROM n UNION ALL SELECT from_name, 1, upper(from_name) FROM n UNION ALL SELECT from_name, 2, {LETTERS.format('from_name')} FROM n)
SELECT from_name, l.uri, CAST(form + 1 AS INTEGER) AS form FROM f JOIN l USING (label) QUALIFY row_number() OVER (PARTITION BY from_name ORDER BY form, l.uri) = 1""")
def names_published(spark: SparkSession, d: str) -> DataFrame:
    """Names looked up as they stand, in capitals, and as letters only: the first form that is a label counts."""
    p = table(spark, d, "persons")
    labels = p.select(_letters("to_name").alias("label"), F.col("to_name").alias("uri")).where("label is not null")
    return resolve.first_of_forms(p.where("from_name is not null"), labels, [F.col("from_name"), F.upper("from_name"), _letters("from_name")], name="from_name")


# ---- worklist and settings

def _spots(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keepers").where("ogham_id <> ''").distinct()
    last = k.groupBy("ogham_id").agg(F.max(F.struct("recorded", F.coalesce("findspot_lat", F.lit(-999.0)).alias("lat"), F.coalesce("findspot_county", F.lit("")).alias("county"), F.coalesce("findspot_country", F.lit("")).alias("country"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("keeper", F.lit("")).alias("keeper"))).alias("v"))
    return last.select("ogham_id", "v.*")


LAST = "p AS (SELECT ogham_id, max((recorded, coalesce(findspot_lat, -999.0), coalesce(findspot_county, ''), coalesce(findspot_country, ''), coalesce(title, ''), coalesce(keeper, ''))) AS v FROM keepers WHERE ogham_id <> '' GROUP BY ogham_id), l AS (SELECT ogham_id, v[2] AS lat, v[3] AS county, v[4] AS country, v[5] AS title, v[6] AS keeper FROM p)"


@query(f"""WITH {LAST}, g AS (SELECT ogham_id AS id, regexp_extract(ogham_id, '^[A-Z]-[A-Z]{{3}}-([A-Z]?)', 1) AS series, array_to_string(list_filter([CASE WHEN lat = -999 THEN 'no findspot' END, CASE WHEN keeper = '' THEN 'no holder' END], lambda x: x IS NOT NULL), '; ') AS gaps, coalesce(nullif(county, ''), country) AS county, coalesce(nullif(title, ''), nullif(county, ''), '') AS place FROM l)
SELECT id, series, CASE series WHEN '' THEN 'numbered' WHEN 'L' THEN 'lost' WHEN 'X' THEN 'doubtful' ELSE 'other' END AS series_label, gaps, county, place, row_number() OVER (ORDER BY series, county, id) - 1 AS row_no FROM g WHERE gaps <> ''""")
def worklist_rows(spark: SparkSession, d: str) -> DataFrame:
    gaps = {"no findspot": F.col("lat") == -999, "no holder": F.col("keeper") == ""}
    return reports.worklist_rows(_spots(spark, d), gaps, key="ogham_id", county=["county", "country"], place=["title", "county"])


@query(f"""WITH {LAST}, s AS (SELECT DISTINCT ogham_id FROM keepers WHERE ciic = '-' AND ogham_id <> ''), g AS (SELECT l.ogham_id, lat = -999 AS gap, s.ogham_id IS NOT NULL AS settled FROM l LEFT JOIN s USING (ogham_id)) SELECT gap, settled, count(*) AS n FROM g GROUP BY gap, settled""")
def settled_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps, and those of stones outside the numbered catalogue, of which no more is to be found."""
    settled = table(spark, d, "keepers").where("ciic = '-'").select("ogham_id")
    return resolve.settle(_spots(spark, d), settled, key="ogham_id").groupBy((F.col("lat") == -999).alias("gap"), "settled").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT DISTINCT ogham_id, CASE WHEN ciic = '-' THEN '/.html' WHEN ciic <> '' THEN lower(substr(ogham_id, 3, 3)) || '_' || ciic || '.html' ELSE coalesce(keeper_source, '') END AS page FROM keepers WHERE ogham_id <> ''),
 s AS (SELECT ogham_id, page, CASE WHEN page = '' THEN 'none' WHEN regexp_matches(page, '[a-z0-9]+_\\d+\\.html$') THEN 'ok' WHEN regexp_matches(page, '/\\.html/*$') THEN 'empty' ELSE 'identifier form' END AS state FROM g)
SELECT state, count(*) AS n, arg_min(page, ogham_id || page) AS example FROM s WHERE state NOT IN ('ok', 'none') GROUP BY state""".replace("\\\\", "\\"))
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    page = F.when(F.col("ciic") == "-", "/.html").when(F.col("ciic") != "", F.concat(F.lower(F.substring("ogham_id", 3, 3)), F.lit("_"), F.col("ciic"), F.lit(".html"))).otherwise(F.coalesce("keeper_source", F.lit("")))
    g = table(spark, d, "keepers").where("ogham_id <> ''").select("ogham_id", page.alias("page")).distinct()
    pages = g.select(F.concat("ogham_id", "page").alias("key"), "page", text.stone_page_state(F.col("page")).alias("state"))
    return reports.broken_links(pages, key="key", state="state", page="page")


@query("""WITH v AS (SELECT doc_id, lang, source, coalesce(source, '') AS evidence FROM documents), o AS (SELECT doc_id, max((CAST(abusive AS VARCHAR), reader)) AS m FROM review_labels GROUP BY doc_id)
SELECT v.doc_id, CASE WHEN m IS NOT NULL THEN m[1] ELSE lang END AS lang, CASE WHEN m IS NOT NULL AND length(m[2]) > 0 THEN m[2] ELSE evidence END AS evidence, CASE WHEN m IS NOT NULL THEN 'set by hand' ELSE 'rule' END AS method FROM v LEFT JOIN o USING (doc_id)""")
def override_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A column of documents overlaid by what readers set, with the reader as evidence."""
    v = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("source", F.lit("")).alias("evidence"))
    o = table(spark, d, "review_labels").select("doc_id", F.col("abusive").cast("string").alias("lang"), "reader")
    return resolve.override_verdicts(v, o, key="doc_id", columns=["lang"], note="reader")


@query("SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM (SELECT coalesce(source, '') AS source FROM documents WHERE lang = 'ga') GROUP BY source")
def facet_order(spark: SparkSession, d: str) -> DataFrame:
    """A facet's values in the order they are offered: commonest first, then by name."""
    c = views.facet_counts(views.faceted(table(spark, d, "documents"), among={"lang": ["ga"]}), ["source"])
    return reports.ranked(c.select(F.col("value").alias("source"), "n"), F.desc("n"), F.asc("source"))


@query(r"""WITH f AS (SELECT lower(trim(commit)) AS commit, array_to_string(list_filter(string_split(replace(regexp_replace(path, '^\s+|\s+$', '', 'g'), '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS path FROM manifest_files WHERE path IS NOT NULL)
SELECT commit, count(DISTINCT path) AS files, count(DISTINCT path) FILTER (regexp_matches(path, '/[A-Z]-[A-Z]{3}-[A-Z0-9]+\.xml$')) AS editions FROM f WHERE path <> '' AND length(commit) = 40 GROUP BY commit""")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files and editions of each snapshot, of rows that give its id in full."""
    f = table(spark, d, "manifest_files").select(F.lower(F.trim("commit")).alias("commit"), plain_path(F.col("path")).alias("path")).where("path is not null and length(commit) = 40")
    return reports.manifest_counts(f, by="commit", path="path", edition=F.col("path").rlike(r"/[A-Z]-[A-Z]{3}-[A-Z0-9]+\.xml$"))


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS other FROM w UNION SELECT r.node, b FROM reach r JOIN w ON r.other = w.a), c AS (SELECT node, min(other) AS component FROM reach GROUP BY node), n AS (SELECT component, count(*) AS nodes FROM c GROUP BY component)
SELECT component, nodes, row_number() OVER (ORDER BY nodes DESC, component) AS rank FROM n""")
def components_ranked(spark: SparkSession, d: str) -> DataFrame:
    from stonegraph.plans.queries import component_sizes

    return reports.ranked(component_sizes(spark, d), F.desc("nodes"), F.asc("component"))


@query("""WITH t AS (SELECT ogham_id, upper(regexp_extract(this_reading_text, '([A-Za-z]+)', 1)) AS word, editor FROM readings WHERE this_reading_text IS NOT NULL AND ogham_id IS NOT NULL AND editor IS NOT NULL),
 e AS (SELECT word || '|first' AS key, ogham_id, list_sort(list_distinct(list(editor))) AS r FROM t WHERE word <> '' GROUP BY 1, 2)
SELECT key, count(*) AS stones, sum(len(r))::BIGINT AS readings, min(ogham_id) AS first FROM e GROUP BY key""")
def hits_by_word(spark: SparkSession, d: str) -> DataFrame:
    """Stones and readings of each first word, kept as a map of arrays."""
    t = table(spark, d, "readings").where("this_reading_text is not null and ogham_id is not null and editor is not null").select("ogham_id", F.upper(F.regexp_extract("this_reading_text", "([A-Za-z]+)", 1)).alias("word"), "editor", F.lit("first").alias("mode")).where("word <> ''")
    h = reports.hits_by_word(t, word="word", mode="mode", stone="ogham_id", reading="editor")
    return h.select("key", F.size("stones").cast("bigint").alias("stones"), F.aggregate(F.map_values("stones"), F.lit(0).cast("bigint"), lambda acc, x: acc + F.size(x)).alias("readings"), F.array_min(F.map_keys("stones")).alias("first"))


@query("SELECT repository, CASE WHEN length(repository) > 20 THEN replace(repository[:19] || '…', '|', '\\|') ELSE replace(repository, '|', '\\|') END AS cell FROM keeper_coordinates")
def markdown_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keeper_coordinates").select("repository", reports.markdown_cells(F.col("repository"), 20).alias("cell"))


@query("SELECT json_merge_patch('{}', json_object('id', nullif(ogham_id, ''), 't', nullif(title, ''), 'c', nullif(findspot_county, '')))::VARCHAR AS record FROM keepers WHERE ogham_id <> '' OR title <> '' OR findspot_county <> ''")
def slim_records(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keepers").where("ogham_id <> '' OR title <> '' OR findspot_county <> ''")
    return views.slim(k, {"ogham_id": "id", "title": "t", "findspot_county": "c"})


@query("SELECT keeper_qid, round(CAST(avg(CAST(keeper_lat AS DECIMAL(20, 9))) AS DOUBLE), 9) AS lat, round(CAST(avg(CAST(keeper_lon AS DECIMAL(20, 9))) AS DOUBLE), 9) AS lon, count(*) AS n FROM keepers WHERE keeper_qid <> '' AND keeper_lat IS NOT NULL AND keeper_lon IS NOT NULL GROUP BY keeper_qid")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    c = views.centroids(table(spark, d, "keepers").where("keeper_qid <> ''"), key="keeper_qid", lat="keeper_lat", lon="keeper_lon")
    return c.select("keeper_qid", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "n")


@query("SELECT kind, label, arg_max(qid, confidence_order) AS qid, arg_max(confidence, confidence_order) AS confidence FROM (SELECT kind, label, qid, coalesce(confidence, 0.0) AS confidence, coalesce(wd_label, '') AS confidence_order FROM wikidata_links WHERE length(kind) > 0 AND length(label) > 0) GROUP BY kind, label")
def links_cache(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wikidata_links").select("kind", "label", F.coalesce("qid", F.lit("")).alias("qid"), "confidence", F.coalesce("wd_label", F.lit("")).alias("line"))
    return tables.links_cache(w, key=["kind", "label"], order="line").select("kind", "label", F.nullif("qid", F.lit("")).alias("qid"), "confidence")


@query(CHANGED + "SELECT commit, change, count(*) AS n, array_to_string(list_sort(list(path))[1:12], ', ') AS shown, greatest(count(*) - 12, 0) AS more FROM changes GROUP BY commit, change")
def change_lines(spark: SparkSession, d: str) -> DataFrame:
    """The report on a corpus that changed: of each kind the number and the first twelve paths."""
    return sinks.change_lines(p1_found(spark, d), by="commit", key="path", change="change")


@query(f"WITH {SETTING} SELECT key, count(*) AS n FROM k WHERE custody IN ('indoors', 'landscape') GROUP BY key")
def view_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings under two kinds of custody: the counts follow the filter."""
    shown = views.faceted(_settings(spark, d), among={"custody": ["indoors", "landscape"]})
    return shown.groupBy("key").agg(F.count("*").alias("n"))


@query(f"WITH {LAST} SELECT DISTINCT r.ogham_id, r.editor, l.lat FROM readings r JOIN l USING (ogham_id) WHERE lat > -999 AND r.editor IS NOT NULL")
def located_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings on the map: those of stones without a point are left out."""
    r = table(spark, d, "readings").where("editor is not null").select("ogham_id", "editor").distinct()
    return r.join(_spots(spark, d).where("lat > -999").select("ogham_id", "lat"), "ogham_id")


@query("""WITH a AS (SELECT DISTINCT editor, regexp_extract(editor, '([A-Za-z]+)', 1) AS n, regexp_extract(editor, '([0-9]{4})', 1) AS y FROM readings WHERE editor IS NOT NULL), s AS (SELECT editor, CASE WHEN y <> '' THEN upper(left(n, 3)) || y ELSE n END AS id FROM a)
SELECT editor, CASE WHEN id = '' THEN 'OGHAM edition' WHEN regexp_matches(id, '^[A-Za-z]+[0-9]{4}') THEN coalesce(map {'RHY': 'Rhys', 'MAC': 'Macalister', 'DIA': 'Diack', 'JAC': 'Jackson', 'FOR': 'Forsyth'}[left(id, 3)], upper(left(id, 1)) || lower(regexp_extract(id, '^.([A-Za-z]*)', 1))) || ' ' || regexp_extract(id, '([0-9]{4})', 1) ELSE id END AS label FROM s""")
def edition_labels(spark: SparkSession, d: str) -> DataFrame:
    """Editors as the stone's graph names them: ids of another form stand as they are."""
    name, year = F.regexp_extract("editor", "([A-Za-z]+)", 1), F.regexp_extract("editor", "([0-9]{4})", 1)
    rows = table(spark, d, "readings").where("editor is not null").select("editor", F.when(year != "", F.concat(F.upper(F.left(name, F.lit(3))), year)).otherwise(name).alias("id")).distinct()
    return rows.select("editor", text.edition_label(F.col("id")).alias("label"))


@query("SELECT DISTINCT ogham_id, printf('%.6f', findspot_lat) AS lat, printf('%.6f', findspot_lon) AS lon FROM keepers WHERE findspot_lat IS NOT NULL AND findspot_lon IS NOT NULL")
def formatted_points(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keepers").where("findspot_lat is not null and findspot_lon is not null")
    return k.select("ogham_id", *(F.format_string("%.6f", f"findspot_{c}").alias(c) for c in ("lat", "lon"))).distinct()


@query("SELECT lower(commit) AS commit, left(commit_date, 10) AS day, strftime(max(fetched) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS fetched FROM manifest_snapshots GROUP BY 1, 2")
def snapshot_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days and instants as reports write them."""
    s = table(spark, d, "manifest_snapshots").groupBy(F.lower("commit").alias("commit"), F.left("commit_date", F.lit(10)).alias("day")).agg(F.max("fetched").alias("fetched"))
    return s.withColumn("fetched", text.utc_stamp(F.col("fetched")))


@query("SELECT CASE WHEN coalesce(alias_of, '') <> '' THEN 'alias' WHEN coalesce(qid, '') <> '' THEN 'qid' WHEN coalesce(osm_id, '') <> '' THEN 'osm' WHEN lat <> '' THEN 'point' ELSE 'empty' END AS kind, count(*) AS n FROM keeper_coordinates GROUP BY 1")
def identifier_summary(spark: SparkSession, d: str) -> DataFrame:
    return resolve.identifier_kinds(table(spark, d, "keeper_coordinates")).groupBy("kind").agg(F.count("*").alias("n"))
