"""Queries of the llm operators, by name, and DuckDB's SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonegraph.llm.abuse import abusive_documents, group_gaps, source_rates
from stonegraph.llm.canonical import Writing, allowed_sql, map_values, meant_labels, reference_spellings, unmatched, words_duckdb
from stonegraph.llm.components import families
from stonegraph.llm.consensus import fit, reading_consensus, reading_votes
from stonegraph.llm.encode import encode_texts
from stonegraph.llm.packing import fill_containers
from stonegraph.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families(table(spark, sf_dir, "persons"))


# Notes and shortenings of catalogue entries, a parameter of the label mapping.
CATALOGUE = Writing(
    notes=(
        r";.*$",
        r"\((on loan|on display|\?)\)|\[[^\]]*\]",
        r"[, ]+(inv\.? ?no\.?|acc\.? ?no\.?|store|vol\.?|no\.?|nr\.?|p\.?|pp\.?|room|case) ?[0-9].*$",
        r"[, ]+et al\b.*$",
        r"[, (]+(1[5-9]|20)[0-9][0-9][a-z]?\)?$",
        r"^[ '\"]*(prob\.?|probably|poss\.?|possibly|perhaps|ed\.|eds\.|after|cf\.?) ",
    ),
    short=(
        (r"\bnatl\b|\bnat\b", "national"),
        (r"\bmus\b", "museum"),
        (r"\br inst\b", "royal institution"),
        (r"\binst\b", "institution"),
        (r"\bunivs?\b", "university"),
        (r"\buniversity coll\b", "university college"),
        (r"\bcoll\b", "collection"),
        (r"\bch\b", "church"),
        (r"\bherit\b", "heritage"),
        (r"\bctr\b", "centre"),
        (r"\bco\b", "county"),
        (r"\blib\b", "library"),
        (r"\bsoc\b", "society"),
        (r"\bhist\b", "history"),
        (r"\bdist\b", "district"),
        (r"\bsaint\b", "st"),
        (r"\b(at|the|and|of)\b", " "),
    ),
    qualified=True,
)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meant_labels(table(spark, sf_dir, "label_entries"), table(spark, sf_dir, "keeper_coordinates"), table(spark, sf_dir, "wikidata_links"), CATALOGUE)


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that mean no value of their kind's list, by anti-join."""
    entries = table(spark, sf_dir, "label_entries")
    mapped = map_values(entries, reference_spellings(table(spark, sf_dir, "keeper_coordinates"), table(spark, sf_dir, "wikidata_links")), writing=CATALOGUE)
    return unmatched(entries, mapped).select("entry_id", "kind", "label").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_consensus(table(spark, sf_dir, "readings")).select("ogham_id", "consensus")


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the annotators of each stone agree; every stone with a text, be it by one annotator only."""
    return reading_consensus(table(spark, sf_dir, "readings"), least=1).select("ogham_id", F.col("voters").cast("bigint").alias("voters"), F.round("agreement", 6).alias("agreement"))


def p6_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotator's number of labels, reliability and community."""
    return fit(reading_votes(table(spark, sf_dir, "readings"))).annotators


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids by chunks of 256 characters: every longer text is cut and stitched."""
    return encode_texts(table(spark, sf_dir, "documents"), chunk=256, overlap=64)


CAPACITY = 2048  #: tokens of byte_bpe_50k


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their containers; sizes are tokens of byte_bpe_50k."""
    sizes = encode_texts(table(spark, sf_dir, "documents"), lengths_only=True)
    return fill_containers(sizes, item="doc_id", size="tokens", capacity=CAPACITY).withColumnRenamed("item", "doc_id").withColumnRenamed("size", "tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abusive_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of abusive documents of each source."""
    return source_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p9_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far scores change when terms for groups are swapped, by term."""
    return group_gaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p6_found": p6_found, "p6_agreement": p6_agreement, "p6_reliability": p6_reliability, "p7_ids": p7_ids, "p7_chunked": p7_chunked, "p8_containers": p8_containers, "p9_found": p9_found, "p9_rates": p9_rates, "p9_gaps": p9_gaps}

MAPPED = rf"""
WITH RECURSIVE hop AS (SELECT repository AS name, max(CASE WHEN alias_of IN (SELECT repository FROM keeper_coordinates) THEN alias_of END) AS next FROM keeper_coordinates WHERE length(trim(repository)) > 0 GROUP BY repository),
     chain(name, reached) AS (SELECT name, next FROM hop WHERE next IS NOT NULL UNION SELECT c.name, h.next FROM chain c JOIN hop h ON c.reached = h.name WHERE h.next IS NOT NULL),
     circles AS (SELECT name, min(reached) AS least FROM chain WHERE reached IN (SELECT name FROM chain WHERE name = reached) GROUP BY name),
     lasts AS (SELECT name, min(reached) AS reached FROM chain WHERE reached NOT IN (SELECT name FROM hop WHERE next IS NOT NULL) GROUP BY name),
     ends AS (SELECT h.name, coalesce(c.least, l.reached, h.name) AS canonical FROM hop h LEFT JOIN circles c ON c.name = h.name LEFT JOIN lasts l ON l.name = h.name),
     listed AS (SELECT 'repository' AS kind, e.canonical, k.repository AS label, CASE WHEN k.repository = e.canonical THEN 0 ELSE 1 END AS own FROM keeper_coordinates k JOIN ends e ON k.repository = e.name
       UNION ALL SELECT 'repository', e.canonical, k.wd_label, CASE WHEN k.wd_label = e.canonical THEN 0 ELSE 2 END FROM keeper_coordinates k JOIN ends e ON k.repository = e.name WHERE k.wd_label IS NOT NULL
       UNION ALL SELECT kind, label, label, 0 FROM wikidata_links WHERE label IS NOT NULL UNION ALL SELECT kind, label, wd_label, 2 FROM wikidata_links WHERE label IS NOT NULL AND wd_label IS NOT NULL),
     words AS (SELECT kind, canonical, own, string_split({words_duckdb("label", CATALOGUE)}, ' ') AS w FROM listed WHERE length({words_duckdb("label", CATALOGUE)}) > 0),
     turned AS (SELECT kind, canonical, own, r, array_to_string(list_concat(w[r + 1:], w[:r]), '') AS form FROM (SELECT *, unnest(range(0, len(w))) AS r FROM words)),
     forms AS (SELECT kind, form, length(form) AS n, min_by(canonical, (own, r, canonical)) AS canonical, min(own * 1000 + r) AS rank FROM turned GROUP BY kind, form),
     typed AS (SELECT entry_id, kind, replace(norm, ' ', '') AS form, replace(regexp_replace(norm, '(^| )[^ ]+$', ''), ' ', '') AS head FROM (SELECT DISTINCT entry_id, kind, {words_duckdb("label", CATALOGUE)} AS norm FROM label_entries WHERE label IS NOT NULL AND regexp_matches(label, '[^\s' || chr(160) || ']'))),
     tried AS (SELECT v.kind, v.form, s.canonical, s.rank, levenshtein(v.form, s.form) AS edits, {allowed_sql("s.n")} AS k FROM (SELECT kind, form FROM typed WHERE form <> '' UNION SELECT kind, head FROM typed WHERE head <> '') v JOIN forms s ON v.kind = s.kind AND abs(length(v.form) - s.n) <= 3),
     found AS (SELECT kind, form, min_by(canonical, (edits, rank, canonical)) AS canonical FROM tried WHERE edits <= k GROUP BY kind, form),
     mapped AS (SELECT DISTINCT t.entry_id, coalesce(f.canonical, g.canonical, '') AS canonical FROM typed t LEFT JOIN found f ON t.kind = f.kind AND t.form = f.form LEFT JOIN found g ON t.kind = g.kind AND t.head = g.form)
"""

ORACLES: dict[str, str] = {
    "p4_found": r"""
WITH RECURSIVE plain AS (
       SELECT stone, nullif(upper(regexp_replace(from_name, '[^A-Za-z]', '', 'g')), '') AS a, nullif(upper(regexp_replace(to_name, '[^A-Za-z]', '', 'g')), '') AS b, from_anonymous, to_anonymous FROM persons),
     ends AS (SELECT CASE WHEN lower(trim(from_anonymous)) = 'yes' THEN coalesce(stone, '') || '/' || a ELSE a END AS a, CASE WHEN lower(trim(to_anonymous)) = 'yes' THEN coalesce(stone, '') || '/' || b ELSE b END AS b FROM plain),
     members AS (SELECT a AS member FROM ends WHERE a IS NOT NULL UNION SELECT b FROM ends WHERE b IS NOT NULL),
     links AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
     reach AS (SELECT member, member AS other FROM members UNION SELECT reach.member, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT min(other) AS group_id, member FROM reach GROUP BY member
""",
    "p5_found": MAPPED + "SELECT * FROM mapped",
    "p5_unmatched": MAPPED + r"SELECT DISTINCT entry_id, kind, label FROM label_entries WHERE regexp_matches(label, '[^\s' || chr(160) || ']') AND entry_id NOT IN (SELECT entry_id FROM mapped WHERE canonical <> '')",
}
