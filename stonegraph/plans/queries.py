"""Queries over the test tables, one or more for each operator, with DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonegraph.functions import geo, text
from stonegraph.operators import graph, resolve, rules, triples, views
from stonegraph.operators.nested import latest
from stonegraph.operators.spatial import located
from stonegraph.session import checkpointed, shared_folder, table
from stonegraph.sources import editions
from stonegraph.streaming.snapshots import catch_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


VALID = "findspot_lat BETWEEN -90 AND 90 AND findspot_lon BETWEEN -180 AND 180 AND NOT (findspot_lat = 0 AND findspot_lon = 0)"
SLUG = "coalesce(nullif(regexp_replace(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'x')"
NORM = r"""upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(coalesce({0}, '')), '(?i);?\s*\bRoman\b\s*:.*$', ' ', 'g'),
 '\([^)]*[a-z0-9][^)]*\)', ' ', 'g'), '\([^)]*[a-z0-9][^)]*$', ' ', 'g'), '(?i)vacat\b|vac\.', ' ', 'g'), '[\[\](){{}}⸢⸣〚〛/\\]', '', 'g'), '[^A-Za-z]+', ' ', 'g')))"""
ALIASES = """hop AS (SELECT repository AS name, nullif(max(alias_of), '') AS next FROM keeper_coordinates WHERE repository IS NOT NULL GROUP BY repository),
 chain(name, reached) AS (SELECT name, next FROM hop WHERE next IS NOT NULL UNION SELECT c.name, h.next FROM chain c JOIN hop h ON c.reached = h.name WHERE h.next IS NOT NULL),
 circles AS (SELECT name, reached FROM chain WHERE reached IN (SELECT name FROM chain WHERE name = reached)),
 ends AS (SELECT h.name, coalesce((SELECT min(reached) FROM circles WHERE circles.name = h.name), (SELECT min(reached) FROM chain WHERE chain.name = h.name AND reached NOT IN (SELECT name FROM hop WHERE next IS NOT NULL)), h.name) AS canonical FROM hop h)"""


# ---- text


@query(f"SELECT DISTINCT keeper, {SLUG.format('keeper')} AS slug FROM keepers")
def slug_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keepers").select("keeper", text.slug(F.col("keeper")).alias("slug")).distinct()


@query(r"""
WITH a AS (SELECT DISTINCT label, regexp_replace(regexp_replace(label, 'https?://[^\s)\]]+', '', 'g'), '\(\s*[‘’''"]?\s*\)', '', 'g') AS t FROM label_entries WHERE label IS NOT NULL),
 b AS (SELECT label, t, length(t) - length(replace(t, '(', '')) AS o, length(t) - length(replace(t, ')', '')) AS c FROM a),
 e AS (SELECT label, CASE WHEN o > c THEN regexp_replace(t, '(?s)\([^(]*$', '') WHEN c > o THEN regexp_replace(t, '(?s)\).*$', '') ELSE t END AS t FROM b)
SELECT label, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s+\)', ')', 'g'), '\(\s+', '(', 'g'), '\s+', ' ', 'g'), '^[ ,;‘’''"]+|[ ,;‘’''"]+$', '', 'g') AS clean FROM e
""")
def clean_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_entries").where("label is not null").select("label", text.clean_label(F.col("label")).alias("clean")).distinct()


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
 b AS (SELECT doc_id, t, regexp_replace(t, '(?i)\b(Co|St|Mt)\.(\s)', '\1' || chr(1) || '\2', 'g') AS h FROM a)
SELECT doc_id, length(replace(regexp_extract(h, '(?is)^(.*?)(?:\.\s|;\s|\sbut\s|\sprobably\s|\spossibly\s)', 1), chr(1), '.')) AS cut,
       regexp_matches(h, '(?i)\.\s|;\s|\sbut\s|\sprobably\s|\spossibly\s') AS has_prose FROM b
""")
def split_prose(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    parts = F.split("t", text.PROSE, 2)
    return docs.select("doc_id", F.when(F.size(parts) > 1, F.length(parts[0])).otherwise(0).cast("bigint").alias("cut"), (F.size(parts) > 1).alias("has_prose"))


@query(f"SELECT DISTINCT ogham_id, this_reading_text, {NORM.format('this_reading_text')} AS normalised FROM readings")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "readings").select("ogham_id", "this_reading_text", text.normalise_reading(F.col("this_reading_text")).alias("normalised")).distinct()


@query(r"""
WITH a AS (SELECT repository, regexp_extract(repository, '^(.*?)(\s*[|,].*)?$', 1) AS lead FROM keeper_coordinates WHERE repository IS NOT NULL),
 b AS (SELECT repository, list_filter(list_transform([repository, regexp_replace(repository, '\s*\([^)]*\)', '', 'g'), lead, regexp_replace(lead, '\s*\([^)]*\)', '', 'g')], lambda x: trim(x, ' ,|')), lambda x: length(x) > 3) AS v FROM a)
SELECT repository, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), ' | ') AS variants FROM b
""")
def name_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keeper_coordinates").where("repository is not null").select("repository", F.array_join(text.name_variants(F.col("repository")), " | ").alias("variants"))


@query(r"""
WITH a AS (SELECT DISTINCT editor, regexp_extract(editor, '([0-9]{4})', 1) AS year, upper(left(regexp_extract(editor, '([A-Za-z]+)', 1), 3)) AS code FROM readings WHERE editor IS NOT NULL)
SELECT editor, CASE WHEN year <> '' THEN coalesce(map {'RHY': 'Rhys', 'MAC': 'Macalister', 'BRA': 'Brash', 'CLA': 'Clarke', 'WES': 'West', 'FOR': 'Forsyth', 'JAC': 'Jackson', 'FUL': 'Fulford'}[code], upper(left(code, 1)) || lower(code[2:])) || ' ' || year ELSE '' END AS label,
       coalesce(regexp_extract(editor, '([A-Z][\w’''-]+)\s*\((\d{4})', 1) || ' ' || nullif(regexp_extract(editor, '([A-Z][\w’''-]+)\s*\((\d{4})', 2), ''), '') AS attributed FROM a
""")
def editor_labels(spark: SparkSession, d: str) -> DataFrame:
    year, code = F.regexp_extract("editor", "([0-9]{4})", 1), F.upper(F.left(F.regexp_extract("editor", "([A-Za-z]+)", 1), F.lit(3)))
    rows = table(spark, d, "readings").where("editor is not null").select("editor", F.concat(code, year).alias("source")).distinct()
    return rows.select("editor", text.editor_label(F.col("source")).alias("label"), text.attribution(F.col("editor")).alias("attributed"))


@query(r"""
WITH a AS (SELECT DISTINCT from_name, replace(trim(regexp_replace(from_name, '^#+', '')), '-', '_') AS nym FROM persons WHERE from_name IS NOT NULL)
SELECT from_name, nym, nym IN ('', '...', '…') OR regexp_matches(nym, '^\?*$') AS anonymous FROM a
""")
def nyms(spark: SparkSession, d: str) -> DataFrame:
    nym = text.normalise_nym(F.col("from_name"))
    return table(spark, d, "persons").where("from_name is not null").select("from_name", nym.alias("nym"), text.is_anonymous(nym).alias("anonymous")).distinct()


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS blob FROM documents WHERE text IS NOT NULL")
def blob_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.blob_id(F.col("text")).alias("blob"))


@query(r"""
WITH a AS (SELECT DISTINCT ogham_id, upper(substr(ogham_id, 3, 3)) || '/' || regexp_extract(ogham_id, '([0-9]+)', 1) AS number, CASE WHEN ciic = '-' THEN 'https://stones.example.org/.html' WHEN ciic <> '' THEN 'https://stones.example.org/' || lower(substr(ogham_id, 3, 3)) || '_' || ciic || '.html' ELSE '' END AS given FROM keepers)
SELECT ogham_id, CASE WHEN regexp_matches(given, '[a-z0-9]+_\d+\.html$') THEN given WHEN contains(number, '/') THEN 'https://stones.example.org/' || replace(lower(number), '/', '_') || '.html' ELSE '' END AS page,
       CASE WHEN given = '' THEN 'none' WHEN regexp_matches(given, '[a-z0-9]+_\d+\.html$') THEN 'ok' WHEN regexp_matches(given, '/\.html/*$') THEN 'empty' ELSE 'identifier form' END AS state, regexp_extract(ogham_id, '^[A-Z]-[A-Z]{3}-([A-Z]?)', 1) AS series FROM a
""")
def stone_pages(spark: SparkSession, d: str) -> DataFrame:
    base = "https://stones.example.org/"
    area = F.substring("ogham_id", 3, 3)
    number = F.concat(F.upper(area), F.lit("/"), F.regexp_extract("ogham_id", "([0-9]+)", 1))
    given = F.when(F.col("ciic") == "-", base + ".html").when(F.col("ciic") != "", F.concat(F.lit(base), F.lower(area), F.lit("_"), F.col("ciic"), F.lit(".html"))).otherwise("")
    rows = table(spark, d, "keepers").select("ogham_id", number.alias("number"), given.alias("given")).distinct()
    return rows.select("ogham_id", text.stone_page_link(base, F.col("number"), F.col("given")).alias("page"), text.stone_page_state(F.col("given")).alias("state"), text.series(F.col("ogham_id")).alias("series"))


# ---- coordinates


GEO = r"""raw AS (SELECT ogham_id, path, fetched, trim(regexp_extract(content, '<(?:tei:)?geo[^>]*>([^<]*)<', 1)) AS geo_raw, regexp_extract(content, '<(?:tei:)?geo[^>]*cert=["'']([^"'']*)', 1) AS cert FROM editions WHERE content IS NOT NULL),
 cut AS (SELECT *, TRY_CAST(nullif(regexp_extract(geo_raw, '(-?\d+(?:\.\d+)?)\s*[,;]\s*(-?\d+(?:\.\d+)?)\s*(.*)$', 1), '') AS DOUBLE) AS la, TRY_CAST(nullif(regexp_extract(geo_raw, '(-?\d+(?:\.\d+)?)\s*[,;]\s*(-?\d+(?:\.\d+)?)\s*(.*)$', 2), '') AS DOUBLE) AS lo, trim(regexp_extract(geo_raw, '(-?\d+(?:\.\d+)?)\s*[,;]\s*(-?\d+(?:\.\d+)?)\s*(.*)$', 3), ' ()') AS rest FROM raw),
 parsed AS (SELECT *, coalesce(la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180, false) AS ok FROM cut),
 status AS (SELECT DISTINCT ogham_id, fetched, geo_raw, CASE WHEN ok THEN la END AS lat, CASE WHEN ok THEN lo END AS lon, CASE WHEN ok THEN rest ELSE geo_raw END AS hedge, CASE WHEN NOT ok AND geo_raw = '' THEN 'missing' WHEN NOT ok THEN 'textual_only' WHEN cert <> '' OR rest <> '' THEN 'qualified' ELSE 'asserted' END AS geo_status FROM parsed)"""


def _coordinates(spark: SparkSession, d: str) -> DataFrame:
    raw = F.trim(F.regexp_extract("content", r"<(?:tei:)?geo[^>]*>([^<]*)<", 1))
    cert = F.regexp_extract("content", r"<(?:tei:)?geo[^>]*cert=[\"']([^\"']*)", 1)
    rows = table(spark, d, "editions").where("content is not null").select("ogham_id", "fetched", raw.alias("geo_raw"), cert.alias("cert")).withColumn("g", geo.parse_coordinate(F.col("geo_raw")))
    return rows.select("ogham_id", "fetched", "geo_raw", "g.lat", "g.lon", "g.hedge", geo.coordinate_status(F.col("geo_raw"), F.col("cert"), F.col("g")).alias("geo_status")).distinct()


@query(f"WITH {GEO} SELECT ogham_id, geo_raw, lat, lon, hedge, geo_status FROM status GROUP BY ALL")
def parse_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return _coordinates(spark, d).drop("fetched").distinct()


@query(f"WITH {GEO} SELECT geo_status, count(*) AS n FROM status GROUP BY geo_status")
def geo_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return _coordinates(spark, d).groupBy("geo_status").agg(F.count("*").alias("n"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    """Keepers' rows with their institution's canonical name and location."""
    k = table(spark, d, "keeper_coordinates")
    names = graph.chase(k, name="repository", target="alias_of")
    places = k.where("lat <> '' and lon <> ''").select(F.col("repository").alias("canonical"), F.col("lat").cast("double").alias("klat"), F.col("lon").cast("double").alias("klon"), "qid", "source", "status")
    return table(spark, d, "keepers").join(names.withColumnRenamed("name", "keeper"), "keeper").join(places, "canonical")


HELD = f"""WITH RECURSIVE {ALIASES},
 held AS (SELECT p.*, e.canonical, CAST(k.lat AS DOUBLE) AS klat, CAST(k.lon AS DOUBLE) AS klon, k.qid, k.source, k.status FROM keepers p JOIN ends e ON p.keeper = e.name JOIN keeper_coordinates k ON k.repository = e.canonical WHERE k.lat <> '' AND k.lon <> '')"""
KM = "12742.0 * asin(least(1.0, sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


@query(f"{HELD} SELECT DISTINCT ogham_id, canonical, round({KM.format('findspot_lat', 'findspot_lon', 'klat', 'klon')}, 1) AS km FROM held WHERE {VALID}")
def haversine_links(spark: SparkSession, d: str) -> DataFrame:
    km = geo.haversine_km(F.col("findspot_lat"), F.col("findspot_lon"), F.col("klat"), F.col("klon"))
    return _held(spark, d).where(VALID).select("ogham_id", "canonical", text.round_even(km, 1).alias("km")).distinct()


@query(f"""{HELD} SELECT DISTINCT ogham_id, canonical FROM held WHERE {VALID} AND regexp_matches(lower(canonical), '{geo.IN_SITU}') AND {KM.format('findspot_lat', 'findspot_lon', 'klat', 'klon')} > 25""")
def doubtful_geocodes(spark: SparkSession, d: str) -> DataFrame:
    km = geo.haversine_km(F.col("findspot_lat"), F.col("findspot_lon"), F.col("klat"), F.col("klon"))
    return _held(spark, d).where(VALID).where(geo.looks_in_situ(F.col("canonical")) & (km > 25.0)).select("ogham_id", "canonical").distinct()


BOXES = " ".join(f"WHEN findspot_country = '{c}' THEN findspot_lat BETWEEN {s} AND {n} AND findspot_lon BETWEEN {w} AND {e}" for c, (s, n, w, e) in geo.COUNTRY_BOXES.items())


@query(f"SELECT ogham_id, findspot_country, CASE {BOXES} ELSE true END AS inside FROM keepers WHERE {VALID} GROUP BY ALL")
def country_boxes(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keepers").where(VALID)
    return k.select("ogham_id", "findspot_country", geo.in_country(F.col("findspot_lat"), F.col("findspot_lon"), F.col("findspot_country")).alias("inside"), "findspot_lat", "findspot_lon").drop("findspot_lat", "findspot_lon").distinct()


@query(f"""WITH RECURSIVE {ALIASES}, named AS (SELECT DISTINCT p.ogham_id, p.keeper, p.findspot_lat IS NULL AS no_spot, coalesce(k.lat <> '' AND k.lon <> '', false) AS there FROM keepers p LEFT JOIN ends e ON trim(p.keeper) = e.name LEFT JOIN keeper_coordinates k ON k.repository = e.canonical WHERE length(trim(p.keeper)) > 0)
SELECT ogham_id, keeper, CASE WHEN no_spot THEN 'no findspot coordinate' ELSE 'holder not located' END AS why FROM named WHERE no_spot OR NOT there""")
def undrawable_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "keeper_coordinates")
    names = graph.chase(k, name="repository", target="alias_of")
    there = k.select(F.col("repository").alias("canonical"), F.coalesce((F.col("lat") != "") & (F.col("lon") != ""), F.lit(False)).alias("located"))
    holders = names.join(there, "canonical").select("name", "located")
    return resolve.undrawable(table(spark, d, "keepers").select("ogham_id", "keeper", "findspot_lat"), holders, holder="keeper", lat="findspot_lat").select("ogham_id", "keeper", "why").distinct()


@query(f"SELECT CAST(floor(p_partkey / 5) AS BIGINT) AS east_km, count(*) AS n FROM part GROUP BY 1")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """References made from part keys, back to their squares."""
    ref = F.concat(F.lit("V "), F.lpad((F.floor(F.col("p_partkey") / 5) % 1000).cast("string"), 3, "0"), F.lit(" 915"))
    g = table(spark, d, "part").select(geo.grid_reference(ref).alias("g"), F.floor(F.col("p_partkey") / 5000).alias("k"))
    return g.groupBy(((F.col("g.east") - 50) / 100 + F.col("k") * 1000).cast("bigint").alias("east_km")).agg(F.count("*").alias("n"))


@query()
def grid_to_wgs84(spark: SparkSession, d: str) -> DataFrame:
    """Irish Grid and ITM points made from part keys; the control points are in the tests."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("V "), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(" 915")).alias("ref"))
    p = p.withColumn("g", geo.irish_grid_to_wgs84(F.col("ref"))).withColumn("i", geo.itm_to_wgs84(F.lit(440000.0) + F.col("p_partkey"), F.lit(599247.0)))
    return p.select("p_partkey", F.round("g.lat", 6).alias("lat"), F.round("g.lon", 6).alias("lon"), F.round("i.lat", 6).alias("itm_lat"), F.round("i.lon", 6).alias("itm_lon"))


SIZE = 0.25
HEXES = f"""p AS (SELECT findspot_lon AS x, findspot_lat AS la FROM keepers WHERE {VALID}), m AS (SELECT 1 / cos(radians(CAST(avg(CAST(la AS DECIMAL(20, 9))) AS DOUBLE))) AS ky FROM p),
 a AS (SELECT x * (2.0::DOUBLE / 3) / {SIZE} AS q, x * (-1.0::DOUBLE / 3) / {SIZE} + la * ky * (sqrt(3) / 3) / {SIZE} AS r FROM p, m), b AS (SELECT q, r, -q - r AS s, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM a),
 c AS (SELECT rq, rr, rs, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM b),
 h AS (SELECT CAST(CASE WHEN dq > ds AND dq > dr THEN -rs - rr ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dq > ds AND dq > dr THEN rr WHEN ds > dr THEN rr ELSE -rq - rs END AS BIGINT) AS r FROM c),
 cells AS (SELECT q, r, count(*) AS n FROM h GROUP BY ALL), most AS (SELECT max(n) AS most FROM cells), steps AS (SELECT q, r, n, CAST(CASE WHEN most <= 1 THEN 0 ELSE least(floor(ln(n) / ln(most) * 5), 4) END AS INTEGER) AS step FROM cells, most)"""


@query(f"WITH {HEXES} SELECT * FROM steps")
def hexbin(spark: SparkSession, d: str) -> DataFrame:
    return views.hexbin(table(spark, d, "keepers").where(VALID), lat="findspot_lat", lon="findspot_lon", size=SIZE)


@query(f"WITH {HEXES} SELECT step, count(*) AS cells, min(n) AS least, max(n) AS most FROM steps GROUP BY step")
def hex_legend(spark: SparkSession, d: str) -> DataFrame:
    return views.legend(views.hexbin(table(spark, d, "keepers").where(VALID), lat="findspot_lat", lon="findspot_lon", size=SIZE))


@query(f"""SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || findspot_lon || ',' || findspot_lat || ']}},"properties":' || json_merge_patch('{{}}', json_object('ogham_id', nullif(ogham_id, ''), 'title', nullif(title, ''), 'findspot_county', nullif(findspot_county, ''), 'keeper', nullif(keeper, ''))) || '}}' AS feature FROM keepers WHERE {VALID}""")
def points_geojson(spark: SparkSession, d: str) -> DataFrame:
    return views.points_geojson(table(spark, d, "keepers").where(VALID), lat="findspot_lat", lon="findspot_lon", properties=["ogham_id", "title", "findspot_county", "keeper"])


# ---- joins, merges, lookups


@query(f"""
WITH last_rows AS (SELECT ogham_id, findspot_lat AS lat, findspot_lon AS lon FROM keepers QUALIFY row_number() OVER (PARTITION BY ogham_id ORDER BY recorded DESC, findspot_lat DESC NULLS LAST, findspot_lon DESC NULLS LAST) = 1),
 given AS (SELECT ogham_id, findspot_lat AS lat, findspot_lon AS lon FROM keepers WHERE findspot_lat IS NOT NULL AND findspot_lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ogham_id ORDER BY recorded, findspot_lat, findspot_lon) = 1)
SELECT l.ogham_id, CASE WHEN l.lat IS NULL AND g.lat IS NOT NULL THEN g.lat ELSE l.lat END AS lat, CASE WHEN l.lat IS NULL AND g.lat IS NOT NULL THEN g.lon ELSE l.lon END AS lon, l.lat IS NULL AND g.lat IS NOT NULL AS supplied FROM last_rows l LEFT JOIN given g USING (ogham_id)
""")
def override_fill(spark: SparkSession, d: str) -> DataFrame:
    """Missing findspots filled from each stone's first complete record."""
    return resolve.fill_missing(*_spots(spark, d), key="ogham_id", columns=["lat", "lon"])


def _spots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = table(spark, d, "keepers").select("ogham_id", "recorded", F.col("findspot_lat").alias("lat"), F.col("findspot_lon").alias("lon"))
    last = k.groupBy("ogham_id").agg(F.max(F.struct("recorded", "lat", "lon")).alias("v")).select("ogham_id", "v.lat", "v.lon")
    first = rules.first_per_key(k.where("lat is not null and lon is not null"), key=["ogham_id"], order=[F.col("recorded"), F.col("lat"), F.col("lon")], columns=["lat", "lon"])
    return last, first


@query("""
WITH last_rows AS (SELECT ogham_id, findspot_lat AS lat FROM keepers QUALIFY row_number() OVER (PARTITION BY ogham_id ORDER BY recorded DESC, findspot_lat DESC NULLS LAST, findspot_lon DESC NULLS LAST) = 1)
SELECT DISTINCT l.ogham_id FROM last_rows l JOIN keepers k USING (ogham_id) WHERE l.lat IS NOT NULL AND k.findspot_lat IS NOT NULL AND k.findspot_lon IS NOT NULL
""")
def override_refused(spark: SparkSession, d: str) -> DataFrame:
    last, first = _spots(spark, d)
    return resolve.refused(last, first, key="ogham_id", column="lat").select("ogham_id")


@query("""
WITH c AS (SELECT keeper_qid, findspot_country, count(*) AS n FROM keepers WHERE findspot_country IS NOT NULL GROUP BY ALL)
SELECT keeper_qid, findspot_country FROM c QUALIFY row_number() OVER (PARTITION BY keeper_qid ORDER BY n DESC, findspot_country) = 1
""")
def modal_value(spark: SparkSession, d: str) -> DataFrame:
    return rules.modal(table(spark, d, "keepers"), key=["keeper_qid"], value="findspot_country")


@query(f"WITH RECURSIVE {ALIASES} SELECT name, canonical FROM ends")
def alias_canonical(spark: SparkSession, d: str) -> DataFrame:
    return graph.chase(table(spark, d, "keeper_coordinates"), name="repository", target="alias_of")


@query("""
WITH c AS (SELECT s_name, [s_name, n_name, r_name] AS chain FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_name, chain[3] || ' > ' || chain[2] || ' > ' || chain[1] AS narrow, chain[3] || ' > ' || chain[2] AS broad FROM c UNION ALL SELECT s_name, chain[3] || ' > ' || chain[2], chain[3] FROM c
""")
def hierarchy_chain(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.hierarchy_pairs(s.select("s_name", F.array("s_name", "n_name", "r_name").alias("chain")), key="s_name", chain="chain")


VOCABULARY = [("MAQI", "formula", "MAQI"), ("MAQI", "formula", "MAQQI"), ("MUCOI", "formula", "MUCOI"), ("AVI", "formula", "AVI"), ("ANM", "formula", "ANM"), ("KOI", "formula", "KOI"), ("QEGI", "element", "QEGI"), ("CUNA", "element", "CUN"), ("DUBI", "element", "DUB"), ("FILI", "element", "FI")]
FORMULA = sorted({w for w, mode, _ in VOCABULARY if mode == "formula"})
SPELLINGS = {w: [w] for w in FORMULA}
VALUES = ", ".join(str(v) for v in VOCABULARY)


@query(f"""
WITH v(word, mode, variant) AS (VALUES {VALUES}), t AS (SELECT ogham_id, unnest(string_split({NORM.format('this_reading_text')}, ' ')) AS token FROM readings WHERE this_reading_text IS NOT NULL)
SELECT word, mode, variant, count(*) AS hits, count(DISTINCT ogham_id) AS stones FROM t JOIN v ON token <> '' AND CASE WHEN mode = 'element' THEN contains(token, variant) ELSE token = variant END GROUP BY ALL
""")
def vocabulary_matches(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = spark.createDataFrame(VOCABULARY, "word string, mode string, variant string")
    r = table(spark, d, "readings").where("this_reading_text is not null")
    tokens = r.select("ogham_id", F.explode(text.words(text.normalise_reading(F.col("this_reading_text")))).alias("token"))
    return resolve.match_words(tokens, vocabulary, token="token").groupBy("word", "mode", "variant").agg(F.count("*").alias("hits"), F.countDistinct("ogham_id").alias("stones"))


BOTH = "current_edition_text IS NOT NULL AND this_reading_text IS NOT NULL"


def _compared(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "readings").where(BOTH).select("ogham_id", "editor", "current_edition_text", "this_reading_text").distinct()
    return resolve.compare_readings(r, current="current_edition_text", other="this_reading_text", formula=SPELLINGS)


@query(f"""
WITH r AS (SELECT DISTINCT ogham_id, editor, {NORM.format('current_edition_text')} AS current_norm, {NORM.format('this_reading_text')} AS other_norm FROM readings WHERE {BOTH}),
 t AS (SELECT *, list_filter(string_split(current_norm, ' '), lambda x: x <> '') AS a, list_filter(string_split(other_norm, ' '), lambda x: x <> '') AS b FROM r), f AS (SELECT {FORMULA} AS known)
SELECT ogham_id, editor, current_norm, other_norm, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS only_current, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ' ') AS only_other,
       array_to_string(list_sort(list_distinct(list_filter(b, lambda x: list_contains(known, x) AND NOT list_contains(a, x)))), ' ') AS gained, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: list_contains(known, x) AND NOT list_contains(b, x)))), ' ') AS lost FROM t, f
""")
def reading_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = _compared(spark, d)
    return c.select("ogham_id", "editor", "current_norm", "other_norm", *(F.array_join(x, " ").alias(x) for x in ("only_current", "only_other", "gained", "lost"))).distinct()


@query()
def reading_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("ogham_id", "editor", "current_edition_text", "this_reading_text", "ratio", "ratio_band")


@query()
def stone_dissent(spark: SparkSession, d: str) -> DataFrame:
    return resolve.dissent(_compared(spark, d), key="ogham_id", editor="editor").withColumn("editors", F.array_join("editors", "; "))


DISTANCES = f"""n AS (SELECT DISTINCT ogham_id, editor, {NORM.format('current_edition_text')} AS a, {NORM.format('this_reading_text')} AS b FROM readings WHERE {BOTH} AND ogham_id IS NOT NULL),
 r AS (SELECT ogham_id, editor, a, b, CASE WHEN a = '' AND b = '' THEN 1.0::DOUBLE ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END AS closeness FROM n),
 bands AS (SELECT *, CASE WHEN closeness >= 1 THEN 'identical' WHEN closeness >= 0.8 THEN 'close' WHEN closeness >= 0.5 THEN 'diverging' ELSE 'far apart' END AS band FROM r)"""


def _distances(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "readings").where(BOTH).where("ogham_id is not null").select("ogham_id", "editor", text.normalise_reading(F.col("current_edition_text")).alias("a"), text.normalise_reading(F.col("this_reading_text")).alias("b")).distinct()
    closeness = F.when((F.col("a") == "") & (F.col("b") == ""), 1.0).otherwise(1 - F.levenshtein("a", "b").cast("double") / F.greatest(F.length("a"), F.length("b")))
    return n.withColumn("closeness", closeness).withColumn("band", text.band(F.col("closeness")))


@query(f"WITH {DISTANCES} SELECT ogham_id, count(*) AS comparisons, round(min(closeness), 6) AS least, CASE WHEN min(closeness) >= 1 THEN 'identical' WHEN min(closeness) >= 0.8 THEN 'close' WHEN min(closeness) >= 0.5 THEN 'diverging' ELSE 'far apart' END AS least_band, array_to_string(list_sort(list_distinct(list(editor))), '; ') AS editors FROM bands GROUP BY ogham_id")
def stone_distances(spark: SparkSession, d: str) -> DataFrame:
    """The roll-up of comparisons by edit distance, which SQL has as well."""
    g = _distances(spark, d).groupBy("ogham_id").agg(F.count("*").alias("comparisons"), F.round(F.min("closeness"), 6).alias("least"), text.band(F.min("closeness")).alias("least_band"), F.array_sort(F.collect_set("editor")).alias("e"))
    return g.select("ogham_id", "comparisons", "least", "least_band", F.array_join("e", "; ").alias("editors"))


@query(f"WITH {DISTANCES} SELECT band, count(*) AS comparisons, count(DISTINCT ogham_id) AS stones, count(DISTINCT editor) AS editors FROM bands GROUP BY band")
def dissent_bands(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d).groupBy("band").agg(F.count("*").alias("comparisons"), F.countDistinct("ogham_id").alias("stones"), F.countDistinct("editor").alias("editors"))


@query("""
WITH w AS (SELECT l.kind, l.label, c.wd_label AS hit, c.confidence, row_number() OVER (PARTITION BY l.kind, l.label ORDER BY c.wd_label) AS rank, c.type_match = 'ok' AS fits
           FROM wikidata_links l JOIN wikidata_links c ON l.kind = c.kind AND left(lower(l.label), 1) = left(c.wd_label, 1) WHERE c.wd_label IS NOT NULL),
 b AS (SELECT *, coalesce(fits, false) AND rank <= 5 AS ok, max(CAST(fits IS NOT NULL AS INT)) OVER (PARTITION BY kind, label) AS known, CASE WHEN lower(label) = lower(hit) THEN 0.9 WHEN contains(lower(hit), lower(label)) OR contains(lower(label), lower(hit)) THEN 0.7 ELSE 0.5 END AS base FROM w)
SELECT kind, label, hit, rank, CAST(CASE WHEN known = 0 THEN base WHEN ok THEN round_even(least(1.0, base + 0.05), 2) ELSE round_even(base * 0.5, 2) END AS DOUBLE) AS confidence, CASE WHEN known = 0 THEN 'unknown' WHEN ok THEN 'ok' ELSE 'mismatch' END AS type_match
FROM b QUALIFY row_number() OVER (PARTITION BY kind, label ORDER BY ok DESC, rank) = 1
""")
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each linked label against the list's own labels of the same kind and initial."""
    links = table(spark, d, "wikidata_links")
    hits = links.where("wd_label is not null").select("kind", F.col("wd_label").alias("hit"), (F.col("type_match") == "ok").alias("fits"), F.left("wd_label", F.lit(1)).alias("initial"))
    c = links.select("kind", "label", F.left(F.lower("label"), F.lit(1)).alias("initial")).join(hits, ["kind", "initial"])
    from pyspark.sql import Window

    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "label").orderBy("hit")).cast("bigint"))
    return resolve.rank_candidates(c, key=["kind", "label"], label="label", hit="hit", rank="rank", fits="fits")


@query("""
WITH g AS (SELECT keeper AS repository, max(keeper_qid) AS qid, CAST(NULL AS VARCHAR) AS note FROM keepers GROUP BY keeper)
SELECT coalesce(k.repository, g.repository) AS repository, coalesce(g.qid, k.qid) AS qid, coalesce(g.note, k.note) AS note, coalesce(g.qid, k.qid) IS DISTINCT FROM k.qid OR coalesce(g.note, k.note) IS DISTINCT FROM k.note AS changed FROM keeper_coordinates k FULL JOIN g ON k.repository = g.repository
""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "keepers").groupBy(F.col("keeper").alias("repository")).agg(F.max("keeper_qid").alias("qid")).withColumn("note", F.lit(None).cast("string"))
    return resolve.upsert(table(spark, d, "keeper_coordinates"), given, key="repository", columns=["qid", "note"])


@query("""
WITH k AS (SELECT DISTINCT keeper FROM keepers WHERE keeper IS NOT NULL), a AS (SELECT repository AS keeper, max(qid) AS qid FROM keeper_coordinates WHERE status = 'verified' AND qid IS NOT NULL GROUP BY 1), b AS (SELECT repository AS keeper, max(qid) AS qid FROM keeper_coordinates WHERE qid IS NOT NULL GROUP BY 1), c AS (SELECT keeper, max(keeper_qid) AS qid FROM keepers WHERE keeper_qid IS NOT NULL GROUP BY 1)
SELECT keeper, coalesce(a.qid, b.qid, c.qid) AS qid, CASE WHEN a.qid IS NOT NULL THEN 'verified' WHEN b.qid IS NOT NULL THEN 'listed' WHEN c.qid IS NOT NULL THEN 'recorded' ELSE '' END AS decided_by FROM k LEFT JOIN a USING (keeper) LEFT JOIN b USING (keeper) LEFT JOIN c USING (keeper)
""")
def identifier_precedence(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "keeper_coordinates"), table(spark, d, "keepers")
    listed = c.where("qid is not null").groupBy(F.col("repository").alias("keeper"))
    verified = c.where("qid is not null and status = 'verified'").groupBy(F.col("repository").alias("keeper")).agg(F.max("qid").alias("qid"))
    recorded = k.where("keeper_qid is not null").groupBy("keeper").agg(F.max("keeper_qid").alias("qid"))
    return resolve.by_precedence(k.where("keeper is not null").select("keeper").distinct(), on=["keeper"], sources=[("verified", verified), ("listed", listed.agg(F.max("qid").alias("qid"))), ("recorded", recorded)], value="qid")


LINTS = {
    "lat and lon must be given together": "(findspot_lat IS NULL) <> (findspot_lon IS NULL)",
    "not a coordinate on earth": "findspot_lat NOT BETWEEN -90 AND 90 OR findspot_lon NOT BETWEEN -180 AND 180",
    "placeholder coordinate": "findspot_lat = 0 AND findspot_lon = 0",
    "no institution id": "keeper_qid IS NULL",
    "no county": "findspot_county IS NULL",
}


@query(" UNION ALL ".join(f"SELECT ogham_id, '{name}' AS complaint FROM keepers WHERE {cond}" for name, cond in LINTS.items()))
def lint_rows(spark: SparkSession, d: str) -> DataFrame:
    return resolve.lint(table(spark, d, "keepers"), key="ogham_id", complaints={n: F.expr(c) for n, c in LINTS.items()})


# ---- sequences, groups, graphs


@query("""
WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM a)
SELECT user_id, CAST(run_no AS BIGINT) AS run_no, min(event_type) AS event_type, count(*) AS length, min(ts) AS first, max(ts) AS last FROM b GROUP BY user_id, run_no
""")
def island_runs(spark: SparkSession, d: str) -> DataFrame:
    return rules.runs(table(spark, d, "events"), by=["user_id"], order=["ts", "event_id"], value="event_type")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events
""")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return rules.nearest(table(spark, d, "events"), by=["user_id"], order=["ts", "event_id"], value="event_id", of=F.col("event_type") == "purchase").select("event_id", "before", "after")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return rules.first_per_key(table(spark, d, "orders"), key=["o_custkey"], order=[F.col("o_orderdate"), F.col("o_orderkey")], columns=["o_orderkey", "o_orderstatus"])


@query("SELECT name, count(DISTINCT stone) AS places FROM (SELECT stone, upper(trim(from_name)) AS name FROM persons UNION ALL SELECT stone, upper(trim(to_name)) FROM persons) WHERE name <> '' GROUP BY name HAVING count(DISTINCT stone) > 1")
def shared_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "persons")
    ends = p.select("stone", F.upper(F.trim("from_name")).alias("name")).union(p.select("stone", F.upper(F.trim("to_name"))))
    return resolve.shared(ends, name="name", place="stone")


@query("SELECT stone, upper(from_name) AS name, min(from_name) AS spelling, count(*) AS mentions FROM persons WHERE from_name IS NOT NULL GROUP BY 1, 2")
def names_once(spark: SparkSession, d: str) -> DataFrame:
    """Names of a stone, each once whatever its case."""
    p = table(spark, d, "persons").where("from_name is not null")
    return p.groupBy("stone", F.upper("from_name").alias("name")).agg(F.min("from_name").alias("spelling"), F.count("*").alias("mentions"))


EDGES = "e AS (SELECT s_suppkey AS a, 1000000 + s_nationkey AS b FROM supplier UNION ALL SELECT 2000000 + p_partkey, 3000000 + p_size FROM part)"


@query(f"""
WITH RECURSIVE {EDGES}, ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, b FROM reach r JOIN ways ON r.other = ways.a), c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT component, count(*) AS nodes FROM c GROUP BY component
""")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    e = s.select(F.col("s_suppkey").alias("a"), (F.lit(1000000) + F.col("s_nationkey")).cast("bigint").alias("b")).union(p.select(F.lit(2000000) + F.col("p_partkey"), (F.lit(3000000) + F.col("p_size")).cast("bigint")))
    return graph.components(e, a="a", b="b").groupBy("component").agg(F.count("*").alias("nodes"))


UPS = "up AS (SELECT 'S' || s_suppkey AS child, n_name AS parent FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'World' FROM region)"


def _ups(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    a = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("child"), F.col("n_name").alias("parent"))
    return a.union(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")).union(r.select("r_name", F.lit("World"))).distinct()


@query(f"WITH RECURSIVE {UPS}, reach AS (SELECT child AS node, child AS ancestor FROM up UNION SELECT parent, parent FROM up UNION SELECT r.node, up.parent FROM reach r JOIN up ON r.ancestor = up.child) SELECT * FROM reach")
def closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_ups(spark, d), child="child", parent="parent")


# ---- rules


CASES = " ".join(f"WHEN {'regexp_matches(low, ' + chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) + ')' if p else 'length(repository) > 0'} THEN '{k}|{c}'" for k, c, p in rules.SETTINGS)
SETTING = f"""s AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS low, CASE WHEN starts_with(source, 'catalogue') THEN source END AS repository FROM documents),
 v AS (SELECT doc_id, CASE {CASES} WHEN regexp_matches(low, '{rules.INSTITUTION}') THEN 'institution_unrecorded|institution' ELSE 'undescribed|undescribed' END AS v FROM s), k AS (SELECT doc_id, split_part(v, '|', 1) AS key, split_part(v, '|', 2) AS custody FROM v)"""


def _settings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(F.startswith("source", F.lit("catalogue")), F.col("source")).alias("repository"))
    return docs.select("doc_id", rules.classify_setting(F.col("repository"), F.col("text")).alias("v")).select("doc_id", "v.key", "v.custody")


@query(f"WITH {SETTING} SELECT * FROM k")
def rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _settings(spark, d)


@query(f"WITH {SETTING} SELECT key, custody, count(*) AS n FROM k GROUP BY GROUPING SETS ((key), (custody))")
def setting_counts(spark: SparkSession, d: str) -> DataFrame:
    return _settings(spark, d).groupingSets([["key"], ["custody"]], "key", "custody").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT relation_lemma, relation_gloss AS gloss, object_is_kin_group = 'yes' AS is_kin FROM persons WHERE relation_lemma IS NOT NULL")
def relation_glosses(spark: SparkSession, d: str) -> DataFrame:
    """The table's own glosses are what it is held against."""
    lemmas = table(spark, d, "persons").where("relation_lemma is not null").select("relation_lemma").distinct()
    return lemmas.select("relation_lemma", rules.relation_parts(F.col("relation_lemma")).alias("r")).select("relation_lemma", "r.gloss", "r.is_kin")


# ---- editions


def _records(spark: SparkSession, d: str) -> DataFrame:
    return editions.read_records(latest(table(spark, d, "editions"), key="ogham_id", content="content", at="fetched"), key="record", content="content")


@query()
def edition_places(spark: SparkSession, d: str) -> DataFrame:
    p = editions.places(_records(spark, d))
    return p.select("record", "stone_key", "title", F.array_join(F.transform("hierarchy", lambda h: h["label"]), " < ").alias("chain"), "lat", "lon", "geo_status", "repository")


@query()
def edition_readings(spark: SparkSession, d: str) -> DataFrame:
    return editions.readings(_records(spark, d))


@query()
def tag_inventory(spark: SparkSession, d: str) -> DataFrame:
    tags = _records(spark, d).select("record", F.explode("tags").alias("t"))
    return tags.groupBy(F.col("t.tag").alias("tag")).agg(F.sum("t.n").alias("total"), F.count("*").alias("files")).withColumn("status", rules.classify_tag(F.col("tag")))


@query("SELECT 'S-SUP-' || s_suppkey AS stone_key, s_name AS title, n_name || ' < ' || r_name AS chain, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(-(s_suppkey % 180) AS DOUBLE) AS lon, CASE WHEN s_suppkey % 2 = 0 THEN 'qualified' ELSE 'asserted' END AS geo_status FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def xml_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as XML editions and read back."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    form = (
        '<TEI xmlns="http://tei.example.org/ns/1.0"><teiHeader><title>%s</title><idno type="filename">S-SUP-%d</idno><history><origin><origPlace><placeName type="country">%s</placeName>, '
        '<placeName type="county">%s <distinct xml:lang="ga">x</distinct></placeName><geo>%d, -%d%s</geo></origPlace></origin></history></teiHeader></TEI>'
    )
    content = F.format_string(form, "s_name", "s_suppkey", "r_name", "n_name", F.col("s_suppkey") % 90, F.col("s_suppkey") % 180, F.when(F.col("s_suppkey") % 2 == 0, " (approximate)").otherwise(""))
    p = editions.places(editions.read_records(s.select("s_name", content.alias("content")), key="s_name", content="content"))
    return p.select("stone_key", "title", F.array_join(F.transform("hierarchy", lambda h: h["label"]), " < ").alias("chain"), "lat", "lon", "geo_status")


# ---- triples


D, O, CRM, RDFS, RDF = triples.DATA, triples.DOMAIN, triples.CRM, triples.RDFS, triples.RDF


def _star(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    sn, nn, rn = triples.node("supplier_", F.col("s_name")), triples.node("nation_", F.col("n_name")), triples.node("region_", F.col("r_name"))
    a = triples.emit(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")), triples.a(sn, CRM + "E74_Group"), triples.literal(sn, RDFS + "label", F.col("s_name")), triples.uri(sn, CRM + "P74_has_current_or_former_residence", nn), triples.a(nn, CRM + "E53_Place"))
    b = triples.emit(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), triples.a(nn, CRM + "E53_Place"), triples.uri(nn, CRM + "P89_falls_within", rn), triples.a(rn, O + "Region"), triples.literal(rn, O + "size", F.col("r_regionkey"), triples.XSD + "integer"))
    return triples.merge(a, b)


STAR = f"""sn AS (SELECT '{D}supplier_' || {SLUG.format('s_name')} AS s, s_name, '{D}nation_' || {SLUG.format('n_name')} AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 nr AS (SELECT '{D}nation_' || {SLUG.format('n_name')} AS n, '{D}region_' || {SLUG.format('r_name')} AS r, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
 star AS (SELECT s, '{RDF}type' AS p, '{CRM}E74_Group' AS o, 'uri' AS kind, '' AS dtype, '' AS lang FROM sn UNION SELECT s, '{RDFS}label', s_name, 'lit', '', '' FROM sn UNION SELECT s, '{CRM}P74_has_current_or_former_residence', n, 'uri', '', '' FROM sn UNION SELECT n, '{RDF}type', '{CRM}E53_Place', 'uri', '', '' FROM sn
  UNION SELECT n, '{RDF}type', '{CRM}E53_Place', 'uri', '', '' FROM nr UNION SELECT n, '{CRM}P89_falls_within', r, 'uri', '', '' FROM nr UNION SELECT r, '{RDF}type', '{O}Region', 'uri', '', '' FROM nr UNION SELECT r, '{O}size', CAST(r_regionkey AS VARCHAR), 'lit', '{triples.XSD}integer', '' FROM nr)"""


@query(f"WITH {STAR} SELECT * FROM star")
def triples_star(spark: SparkSession, d: str) -> DataFrame:
    return _star(spark, d)


@query(f"""WITH {STAR} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN kind = 'uri' THEN '<' || o || '>' ELSE '"' || o || '"' || CASE WHEN dtype <> '' THEN '^^<' || dtype || '>' ELSE '' END END || ' .' AS line FROM star""")
def n_triples(spark: SparkSession, d: str) -> DataFrame:
    return triples.n_triples(_star(spark, d))


@query(f"""
WITH r AS (SELECT doc_id, avg(abusive) AS w, count(*) AS n FROM review_labels GROUP BY doc_id), st AS (SELECT '{D}review_' || doc_id AS st, '{D}document_' || doc_id AS s, * FROM r)
SELECT st AS s, '{RDF}type' AS p, '{RDF}Statement' AS o FROM st UNION SELECT st, '{RDF}subject', s FROM st UNION SELECT st, '{RDF}predicate', '{O}reviewedAs' FROM st UNION SELECT st, '{RDF}object', '{O}abusive' FROM st UNION SELECT st, '{O}weight', printf('%.2f', w) FROM st UNION SELECT st, '{O}matchStatus', CASE WHEN n > 1 THEN 'verified' ELSE 'auto' END FROM st
""")
def statements_weighted(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "review_labels").groupBy("doc_id").agg(F.avg("abusive").alias("w"), F.count("*").alias("n"))
    st, s = triples.node("review_", F.col("doc_id").cast("string")), triples.node("document_", F.col("doc_id").cast("string"))
    return triples.emit(r, *triples.statement(st, s, O + "reviewedAs", F.lit(O + "abusive"), F.col("w"), F.when(F.col("n") > 1, "verified").otherwise("auto"))).select("s", "p", "o")


@query(f"""{HELD}, l AS (SELECT DISTINCT {SLUG.format('ogham_id')} AS stone, {SLUG.format('canonical')} AS keeper, canonical, qid, source, status FROM held)
SELECT '{CRM}P50_has_current_keeper' AS p, count(DISTINCT (stone, keeper)) AS n FROM l UNION ALL SELECT '{CRM}P55_has_current_location', count(DISTINCT (stone, keeper)) FROM l UNION ALL SELECT '{CRM}P74_has_current_or_former_residence', count(DISTINCT keeper) FROM l
UNION ALL SELECT '{RDFS}label', count(DISTINCT (keeper, canonical)) FROM l UNION ALL SELECT '{O}geocodedFrom', count(DISTINCT (keeper, source)) FROM l WHERE source IS NOT NULL UNION ALL SELECT '{triples.SKOS}closeMatch', count(DISTINCT (keeper, qid)) FROM l WHERE length(qid) > 0
UNION ALL SELECT '{RDF}type', 2 * count(DISTINCT keeper) + count(DISTINCT keeper) FILTER (length(qid) > 0) FROM l UNION ALL SELECT '{RDF}subject', count(DISTINCT keeper) FROM l WHERE length(qid) > 0 UNION ALL SELECT '{RDF}predicate', count(DISTINCT keeper) FROM l WHERE length(qid) > 0
UNION ALL SELECT '{RDF}object', count(DISTINCT (keeper, qid)) FROM l WHERE length(qid) > 0 UNION ALL SELECT '{O}weight', count(DISTINCT (keeper, status = 'verified')) FROM l WHERE length(qid) > 0 UNION ALL SELECT '{O}matchStatus', count(DISTINCT (keeper, status)) FROM l WHERE length(qid) > 0 AND status IS NOT NULL
""")
def keeper_triples(spark: SparkSession, d: str) -> DataFrame:
    h = _held(spark, d).select(F.col("ogham_id").alias("stone"), F.col("canonical").alias("keeper"), "qid", "source", "status", F.col("klat").alias("lat"), F.col("klon").alias("lon")).distinct()
    return triples.keeper_graph(h).groupBy("p").agg(F.count("*").alias("n"))


@query()
def place_triples(spark: SparkSession, d: str) -> DataFrame:
    return triples.place_graph(editions.places(_records(spark, d)))


def _ontology(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A small class tree, and the terms and constraints of some properties."""
    classes = [("E74_Group", "E39_Actor"), ("E39_Actor", "E77_Persistent_Item"), ("E77_Persistent_Item", "E1_Entity"), ("E53_Place", "E1_Entity")]
    tree = spark.createDataFrame([(CRM + c, CRM + p) for c, p in classes], "child string, parent string")
    told = [("P74_has_current_or_former_residence", RDFS + "domain", CRM + "E39_Actor"), ("P74_has_current_or_former_residence", RDFS + "range", CRM + "E53_Place"), ("P89_falls_within", RDFS + "domain", CRM + "E53_Place"), ("P89_falls_within", RDFS + "range", "_:u")]
    rows = [(CRM + s, p, o, "uri") for s, p, o in told] + [("_:u", triples.OWL + "unionOf", "_:l1", "uri"), ("_:l1", RDF + "first", CRM + "E53_Place", "uri"), ("_:l1", RDF + "rest", "_:l2", "uri"), ("_:l2", RDF + "first", CRM + "E39_Actor", "uri"), ("_:l2", RDF + "rest", RDF + "nil", "uri")]
    return tree, spark.createDataFrame(rows, "s string, p string, o string, kind string")


@query(f"SELECT DISTINCT '{CRM}P89_falls_within' AS property, '{D}region_' || {SLUG.format('r_name')} AS node, 'range' AS position FROM region JOIN nation ON r_regionkey = n_regionkey")
def domain_range_violations(spark: SparkSession, d: str) -> DataFrame:
    tree, reference = _ontology(spark)
    supers, unions = graph.closure(tree, child="child", parent="parent"), checkpointed(triples.union_members(reference))
    data = _star(spark, d)
    return triples.violations(data, triples.constraints(reference, RDFS + "domain", unions), supers, end="s", position="domain").union(triples.violations(data, triples.constraints(reference, RDFS + "range", unions), supers, end="o", position="range"))


@query(f"WITH {STAR} SELECT '{O}Region' AS term, 'class' AS position, count(*) AS uses, true AS new_local FROM star WHERE o = '{O}Region' UNION ALL SELECT p, 'property', count(*), true FROM star WHERE p = '{O}size' GROUP BY p")
def unknown_terms(spark: SparkSession, d: str) -> DataFrame:
    tree, reference = _ontology(spark)
    known = reference.select(F.col("s").alias("term")).union(tree.select("child"))
    return triples.unknown_terms(_star(spark, d), known, watched=[CRM, O])


@query(f"WITH {UPS} SELECT DISTINCT child AS node FROM up WHERE child IN (SELECT child FROM up WHERE parent IN (SELECT n_name FROM nation WHERE n_regionkey <> 0)) OR child IN (SELECT n_name FROM nation WHERE n_regionkey <> 0) OR child IN (SELECT r_name FROM region WHERE r_regionkey <> 0)")
def without_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the tree of places that aren't in, or under, the first region."""
    ups = _ups(spark, d)
    wanted = table(spark, d, "region").where("r_regionkey = 0").select(F.col("r_name").alias("ancestor"))
    return triples.without_ancestor(ups.select(F.col("child").alias("node")).distinct(), graph.closure(ups, child="child", parent="parent"), wanted)


@query(f"WITH r AS (SELECT DISTINCT {SLUG.format('ogham_id')} AS stone, {SLUG.format('ogham_id')} || '_' || {SLUG.format('editor')} AS reading FROM readings WHERE editor IS NOT NULL AND ogham_id IS NOT NULL) SELECT '{D}stone_' || stone AS stone, count(DISTINCT reading) AS n FROM r GROUP BY stone HAVING count(DISTINCT reading) > 1")
def competing_readings(spark: SparkSession, d: str) -> DataFrame:
    """Stones whose inscription is read in several ways: two steps through the triples, counted."""
    r = table(spark, d, "readings").where("editor is not null and ogham_id is not null").select(F.col("ogham_id").alias("stone"), F.col("editor").alias("reading_id"), F.col("editor").alias("label"), F.col("this_reading_text").alias("text"))
    g = triples.reading_graph(r)
    carries, read = g.where(F.col("p") == O + "carries").select(F.col("s").alias("stone"), F.col("o").alias("inscription")), g.where(F.col("p") == O + "identifiedAs").select(F.col("s").alias("inscription"), F.col("o").alias("reading"))
    return carries.join(read, "inscription").groupBy("stone").agg(F.countDistinct("reading").alias("n")).where("n > 1")


# ---- views and reports


@query("SELECT 'lang' AS facet, coalesce(lang, '') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, ''), count(*) FROM documents GROUP BY 2")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.facet_counts(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND ogham_id IS NOT NULL AND contains(lower(concat_ws(' ', text, source, ogham_id)), 'quarry')")
def faceted_filter(spark: SparkSession, d: str) -> DataFrame:
    return views.faceted(table(spark, d, "documents"), among={"lang": ["en", "de"]}, flags=[F.col("ogham_id").isNotNull()], term="Quarry", search=["text", "source", "ogham_id"]).select("doc_id")


@query(f"""
WITH {GEO}, w AS (SELECT ogham_id, geo_status, regexp_extract(ogham_id, '^[A-Z]-[A-Z]{{3}}-([A-Z]?)', 1) AS series FROM status)
SELECT count(*) FILTER (geo_status IN ('missing', 'textual_only') AND series = '') AS numbered_without_findspot, count(*) FILTER (geo_status = 'qualified') AS hedged, count(*) FILTER (geo_status IN ('missing', 'textual_only') AND series = 'L') AS lost_without_findspot, count(*) FILTER (geo_status IN ('missing', 'textual_only') AND series = 'X') AS doubtful_without_findspot FROM w
""")
def worklist_gaps(spark: SparkSession, d: str) -> DataFrame:
    s = text.series(F.col("ogham_id"))
    gap = F.col("geo_status").isin("missing", "textual_only")
    return views.gap_counts(_coordinates(spark, d), {"numbered_without_findspot": gap & (s == ""), "hedged": F.col("geo_status") == "qualified", "lost_without_findspot": gap & (s == "L"), "doubtful_without_findspot": gap & (s == "X")})


@query("""
SELECT 'stones' AS figure, count(DISTINCT ogham_id) AS n FROM keepers UNION ALL SELECT 'institutions', count(DISTINCT keeper_qid) FROM keepers UNION ALL SELECT 'readings', count(*) FROM readings UNION ALL SELECT 'editors', count(DISTINCT editor) FROM readings UNION ALL SELECT 'persons', count(DISTINCT upper(from_name)) FROM persons UNION ALL SELECT 'documents', count(*) FROM documents
""")
def landing_figures(spark: SparkSession, d: str) -> DataFrame:
    def one(t: str, name: str, agg) -> DataFrame:
        return table(spark, d, t).agg(agg.alias("n")).select(F.lit(name).alias("figure"), "n")

    parts = [("keepers", "stones", F.countDistinct("ogham_id")), ("keepers", "institutions", F.countDistinct("keeper_qid")), ("readings", "readings", F.count("*")), ("readings", "editors", F.countDistinct("editor")), ("persons", "persons", F.countDistinct(F.upper("from_name"))), ("documents", "documents", F.count("*"))]
    out = one(*parts[0])
    for p in parts[1:]:
        out = out.union(one(*p))
    return out


@query("SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE AS total FROM events GROUP BY event_type")
def stream_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Events through the file stream that stops when it has caught up, then summed."""
    base = shared_folder(spark, "stream")
    rows = catch_up(spark, d, sink=f"{base}/sink", checkpoint=f"{base}/checkpoint", transform=lambda s: s.select("event_type", "value"), pattern="events.parquet")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
