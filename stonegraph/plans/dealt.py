"""Queries of the general operators for training data (p1, p2, p3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stonegraph.operators.nested import nested_elements, nested_tables
from stonegraph.operators.snapshot import change_counts, manifest_changes
from stonegraph.operators.spatial import findspots, near_classes, neighbourhood
from stonegraph.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_changes(table(spark, sf_dir, "manifest_files"), table(spark, sf_dir, "manifest_snapshots"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each commit added, removed and changed."""
    return change_counts(p1_found(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood(table(spark, sf_dir, "keepers"), table(spark, sf_dir, "areas"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stones found at one spot as classes, and the classes at most 0.1 km apart."""
    return near_classes(findspots(table(spark, sf_dir, "keepers")), 0.1)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_elements(table(spark, sf_dir, "editions"))


def _nested(tag: str) -> Callable[[SparkSession, str], DataFrame]:
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested_tables(table(spark, sf_dir, "editions"), key="ogham_id", content="content", at="fetched")[tag]

    return rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p3_orig_places": _nested("origPlace"),
    "p3_place_names": _nested("placeName"),
    "p3_readings": _nested("rdg"),
    "p3_persons": _nested("persName"),
}

CHANGED = r"""
WITH heads AS (SELECT lower(trim(commit)) AS full_id, max(CAST(commit_date AS TIMESTAMPTZ)) AS t FROM manifest_snapshots GROUP BY 1),
     numbered AS (SELECT full_id, row_number() OVER (ORDER BY t, full_id) AS n FROM heads),
     plain AS (SELECT lower(trim(commit)) AS given, fetched,
                      array_to_string(list_filter(string_split(replace(regexp_replace(path, '^\s+|\s+$', '', 'g'), '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS path,
                      nullif(regexp_extract(lower(sha), '[0-9a-f]{40}'), '') AS sha
               FROM manifest_files WHERE path IS NOT NULL),
     placed AS (SELECT n, path, sha, fetched FROM plain JOIN numbered ON starts_with(full_id, given) WHERE path <> ''),
     kept AS (SELECT n, path, sha FROM placed QUALIFY row_number() OVER (PARTITION BY n, path ORDER BY fetched DESC, sha DESC NULLS LAST) = 1),
     pairs AS (SELECT coalesce(b.n, a.n + 1) AS n, coalesce(b.path, a.path) AS path, a.path AS old, b.path AS new, a.sha AS x, b.sha AS y FROM kept a FULL JOIN kept b ON a.path = b.path AND b.n = a.n + 1),
 changes AS (SELECT full_id AS commit, path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM pairs JOIN numbered USING (n) WHERE n > 1 AND (old IS NULL OR new IS NULL OR x IS DISTINCT FROM y))
"""

ORACLES: dict[str, str] = {
    "p1_found": CHANGED + "SELECT * FROM changes",
    "p1_counts": CHANGED + "SELECT commit, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed FROM changes GROUP BY commit",
    "p2_found": r"""
WITH last_rows AS (SELECT ogham_id, findspot_lat AS lat, findspot_lon AS lon FROM keepers WHERE ogham_id <> '' QUALIFY row_number() OVER (PARTITION BY ogham_id ORDER BY recorded DESC, findspot_lat DESC, findspot_lon DESC) = 1),
     stones AS (SELECT * FROM last_rows WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
     places AS (SELECT DISTINCT keeper_qid AS id, keeper_lat AS lat, keeper_lon AS lon FROM keepers WHERE keeper_qid <> '' AND keeper_lat BETWEEN -90 AND 90 AND keeper_lon BETWEEN -180 AND 180 AND NOT (keeper_lat = 0 AND keeper_lon = 0)),
     near_stones AS (SELECT a.ogham_id AS a, b.ogham_id AS b FROM stones a JOIN stones b ON a.ogham_id < b.ogham_id AND abs(a.lat - b.lat) < 0.001
                     WHERE 12742 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 0.1),
     near_keepers AS (SELECT DISTINCT a.ogham_id AS a, b.id AS b FROM stones a JOIN places b ON abs(a.lat - b.lat) < 0.03
                      WHERE 12742 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 3),
     edges AS (SELECT area_id, unnest(outline) AS p, unnest(list_concat(outline[2:], outline[:1])) AS q FROM areas),
     in_areas AS (SELECT ogham_id AS a, area_id AS b FROM stones JOIN edges ON (p.lat > stones.lat) <> (q.lat > stones.lat) AND stones.lon < (q.lon - p.lon) * (stones.lat - p.lat) / (q.lat - p.lat) + p.lon GROUP BY 1, 2 HAVING count(*) % 2 = 1),
     every AS (SELECT 'findspot' AS kind, * FROM near_stones UNION ALL SELECT 'keeper', * FROM near_keepers UNION ALL SELECT 'area', * FROM in_areas)
SELECT kind, least(a, b) AS id_a, greatest(a, b) AS id_b FROM every
""",
    "p2_classes": r"""
WITH last_rows AS (SELECT ogham_id, findspot_lat AS lat, findspot_lon AS lon FROM keepers WHERE ogham_id <> '' QUALIFY row_number() OVER (PARTITION BY ogham_id ORDER BY recorded DESC, findspot_lat DESC, findspot_lon DESC) = 1),
     stones AS (SELECT *, min(ogham_id) OVER (PARTITION BY lat, lon) AS class FROM last_rows WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
     spots AS (SELECT * FROM stones WHERE ogham_id = class)
SELECT 'member' AS kind, ogham_id AS a, class AS b FROM stones UNION ALL
SELECT 'near', a.class, b.class FROM spots a JOIN spots b ON a.class < b.class AND abs(a.lat - b.lat) < 0.001
WHERE 12742 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 0.1
""",
}
