"""Typed values mapped to a canonical list by a partition-based pigeonhole join, in SQL.

Each spelling of the list is cut into ``k + 1`` segments; a typed value within
``k`` edits of it holds one of them unchanged, near its place. So values and
spellings are joined by equality on (length, segment number, segment), the
pairs found are measured by ``levenshtein`` with its bound, and what is left
without a partner is reported by an anti-join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from stonegraph.operators.graph import chase
from stonegraph.session import checkpointed

# How letters and digits are written for one another.
ACCENTS = ("áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
DIGITS = ("015", "ols")  # digits read for letters


class Writing(NamedTuple):
    """How values of a field are commonly decorated and shortened.

    Patterns of notes that are taken off, and of shortenings with what they
    stand for, both over small letters without accents, in the order they
    apply. With ``qualified`` a value that means nothing as a whole may end with
    one word that qualifies it.
    """

    notes: tuple[str, ...] = ()
    short: tuple[tuple[str, str], ...] = ()
    qualified: bool = False


PLAIN = Writing()

MOST = 3  #: edits allowed at most


def words_duckdb(c: str, writing: Writing = PLAIN) -> str:
    """``words_sql`` in DuckDB's dialect, for comparison."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    blanks, quotes = "'[\\s ]+'", "'" * 8
    x = f"trim(replace(translate(regexp_replace(lower({c}), {blanks}, ' ', 'g'), '{ACCENTS[0]}’‘´`', '{ACCENTS[1]}{quotes}'), '&amp;', '&'))"
    for note in writing.notes:
        x = f"regexp_replace({x}, {quoted(note)}, '', 'g')"
    x = f"regexp_replace(replace(replace(translate({x}, '{DIGITS[0]}', '{DIGITS[1]}'), '{chr(39) * 2}', ''), '-', ''), '[^a-z]+', ' ', 'g')"
    for short, full in writing.short:
        x = f"regexp_replace({x}, {quoted(short)}, '{full}', 'g')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


def words_sql(c: str, writing: Writing = PLAIN) -> str:
    """SQL for the plain words of a value: lower case a-z and single blanks, without notes, shortenings written out."""
    x = rf"regexp_replace(lower({c}), '(?U)[\\s]+', ' ')"
    x = f"translate({x}, '{ACCENTS[0]}’‘´`', '{ACCENTS[1]}''''''''')"
    x = f"trim(replace({x}, '&amp;', '&'))"
    for note in writing.notes:
        note = note.replace("\\", "\\\\").replace("'", "\\'")
        x = f"regexp_replace({x}, '{note}', '')"
    x = f"translate({x}, '{DIGITS[0]}', '{DIGITS[1]}')"
    x = rf"regexp_replace(replace(replace({x}, '\'', ''), '-', ''), '[^a-z]+', ' ')"
    for short, full in writing.short:
        x = f"regexp_replace({x}, '{short.replace(chr(92), chr(92) * 2)}', '{full}')"
    return f"trim(regexp_replace({x}, ' +', ' '))"


def allowed_sql(n: str) -> str:
    """SQL for the edits allowed on a spelling of ``n`` letters."""
    return f"CASE WHEN {n} < 4 THEN 0 WHEN {n} < 5 THEN 1 WHEN {n} < 10 THEN 2 ELSE {MOST} END"


# The steps, one statement each.

# A list's spellings as words.
WORDS = """
SELECT kind, canonical, own, split({norm}, ' ') AS w FROM {spellings} WHERE length({norm}) > 0
"""

# With their rotations by words, so that "Priory, X" and "X Museum of" are met too.
FORMS = """
SELECT kind, form, length(form) AS n, min_by(canonical, struct(own, r, canonical)) AS canonical, min(own * 1000 + r) AS rank
FROM (SELECT kind, canonical, own, r, concat_ws('', slice(w, r + 1, size(w)), slice(w, 1, r)) AS form FROM {words} LATERAL VIEW explode(sequence(0, size(w) - 1)) x AS r)
GROUP BY kind, form
"""

# Entries as letters only, as a whole and without their last word.
TYPED = """
SELECT entry_id, kind, replace(norm, ' ', '') AS form, IF({qualified}, replace(regexp_replace(norm, '(^| )[^ ]+$', ''), ' ', ''), '') AS head
FROM (SELECT entry_id, kind, {norm} AS norm FROM {entries} WHERE label IS NOT NULL AND label RLIKE '(?U)[^\\\\s]')
"""

# Values, each once.
VALUES = """
SELECT kind, form, length(form) AS n FROM (SELECT kind, form FROM {typed} UNION SELECT kind, head FROM {typed}) WHERE form <> ''
"""

# Lengths of the list's spellings that values may have, with the edits those allow.
LENGTHS = """
SELECT v.kind, form, v.n, m, {k} AS k FROM (SELECT * FROM {values} LATERAL VIEW explode(sequence(greatest(1, n - {most}), n + {most})) x AS m) v LEFT SEMI JOIN (SELECT DISTINCT kind, n FROM {forms}) l ON l.kind = v.kind AND l.n = v.m
"""

# The k + 1 segments of a text of m letters, the last ones a letter longer if need be.
CUTS = """
SELECT *, i * (m div (k + 1)) + greatest(0, i - (k + 1 - m % (k + 1))) AS start, m div (k + 1) + IF(i >= k + 1 - m % (k + 1), 1, 0) AS size FROM {texts} LATERAL VIEW explode(sequence(0, k)) x AS i
"""

SEGMENTS = """
SELECT kind, form, canonical, rank, m, k, i, substring(form, start + 1, size) AS segment FROM {cuts}
"""

# Where a value may hold a segment: shifted by no more than the edits before and after it can explain.
SHIFTS = """
SELECT *, greatest(-i, n - m - (k - i)) AS low, least(i, n - m + (k - i)) AS high FROM {cuts} WHERE abs(n - m) <= k
"""

PROBES = """
SELECT DISTINCT kind, form, m, i, substring(form, start + shift + 1, size) AS segment FROM {shifts} LATERAL VIEW explode(sequence(low, high)) x AS shift
WHERE low <= high AND start + shift >= 0 AND start + shift + size <= n
"""

# Segments that many spellings or many values hold, with the numbers of ways their two sides are split in.
HEAT = """
SELECT kind, m, i, segment, CAST(ceil(max(spellings) / {many_spellings}) AS int) AS ways, CAST(ceil(max(probes) / {many_probes}) AS int) AS shares FROM (
  SELECT kind, m, i, segment, count(*) AS spellings, 1 AS probes FROM {segments} GROUP BY kind, m, i, segment HAVING count(*) > {many_spellings} UNION ALL
  SELECT kind, m, i, segment, 1 AS spellings, count(*) AS probes FROM {probes} GROUP BY kind, m, i, segment HAVING count(*) > {many_probes})
GROUP BY kind, m, i, segment
"""

# A hot segment's spellings and probes, each part of the ones with each part of the others.
SPLIT_SEGMENTS = """
SELECT s.*, pmod(xxhash64(s.form), coalesce(h.ways, 1)) AS way, share FROM {segments} s LEFT JOIN {heat} h ON s.kind = h.kind AND s.m = h.m AND s.i = h.i AND s.segment = h.segment LATERAL VIEW explode(sequence(0, coalesce(h.shares, 1) - 1)) x AS share
"""

SPLIT_PROBES = """
SELECT p.*, way, pmod(xxhash64(p.form), coalesce(h.shares, 1)) AS share FROM {probes} p LEFT JOIN {heat} h ON p.kind = h.kind AND p.m = h.m AND p.i = h.i AND p.segment = h.segment LATERAL VIEW explode(sequence(0, coalesce(h.ways, 1) - 1)) x AS way
"""

MET = """
SELECT DISTINCT p.kind, p.form, s.form AS spelling, s.canonical, s.rank, s.k FROM {probes} p JOIN {segments} s ON p.kind = s.kind AND p.m = s.m AND p.i = s.i AND p.segment = s.segment AND p.way = s.way AND p.share = s.share
"""

MATCHES = """
SELECT kind, form, min_by(canonical, struct(edits, rank, canonical)) AS canonical, min(edits) AS edits FROM (SELECT *, levenshtein(form, spelling, k) AS edits FROM {met}) WHERE edits >= 0 GROUP BY kind, form
"""

EXACT = """
SELECT v.kind, v.form, s.canonical, 0 AS edits FROM {values} v JOIN {forms} s ON v.kind = s.kind AND v.form = s.form
"""

REST = """
SELECT v.* FROM {values} v LEFT ANTI JOIN {exact} e ON e.kind = v.kind AND e.form = v.form
"""

MATCHED = """
SELECT t.entry_id, m.canonical, m.edits FROM {typed} t JOIN {found} m ON t.kind = m.kind AND t.form = m.form
"""

# What no spelling is near enough to.
UNMATCHED = """
SELECT t.* FROM {typed} t LEFT ANTI JOIN {found} m ON t.kind = m.kind AND t.form = m.form
"""

NOTHING = """
SELECT entry_id, '' AS canonical, CAST(NULL AS int) AS edits FROM {rest}
"""


def map_values(entries: DataFrame, spellings: DataFrame, *, writing: Writing = PLAIN, many_spellings: int = 256, many_probes: int = 20_000) -> DataFrame:
    """(entry_id, canonical, edits): the canonical value each entry means, '' and null edits if it means none.

    ``entries`` has entry_id, kind and label; ``spellings`` kind, canonical,
    label and own (0 for the canonical's own label, more for others). A value
    is compared, after notes and shortenings are dealt with as ``writing`` says,
    letter by letter; up to three edits are allowed, fewer on short spellings.
    Of several spellings the nearest counts, then the canonical's own, then the
    smallest. Entries with a null or blank label are left out; a null kind fits
    none; exact copies give one row each time they occur. Extra columns are
    ignored. A segment that more than ``many_spellings`` spellings or
    ``many_probes`` values hold is split, so that no task gets more of either.
    Entries and what was found are checkpointed when the function is called.
    """
    sql = entries.sparkSession.sql
    norm = words_sql("label", writing)
    typed = checkpointed(sql(TYPED.replace("{norm}", norm).replace("{qualified}", str(writing.qualified).lower()), entries=entries.select("entry_id", "kind", "label")))
    words = sql(WORDS.replace("{norm}", norm), spellings=spellings)
    forms = checkpointed(sql(FORMS, words=words))
    values = checkpointed(sql(VALUES, typed=typed))
    exact = sql(EXACT, values=values, forms=forms)
    rest = sql(REST, values=values, exact=exact)
    texts = forms.selectExpr("*", "n AS m", f"{allowed_sql('n')} AS k")
    segments = sql(SEGMENTS, cuts=sql(CUTS, texts=texts))
    lengths = sql(LENGTHS.replace("{k}", allowed_sql("m")).replace("{most}", str(MOST)), values=rest, forms=forms)
    probes = checkpointed(sql(PROBES, shifts=sql(SHIFTS, cuts=sql(CUTS, texts=lengths))))
    heat = checkpointed(sql(HEAT.replace("{many_spellings}", str(many_spellings)).replace("{many_probes}", str(many_probes)), segments=segments, probes=probes))
    if not heat.isEmpty():
        segments, probes = sql(SPLIT_SEGMENTS, segments=segments, heat=heat), sql(SPLIT_PROBES, probes=probes, heat=heat)
    else:
        segments, probes = segments.selectExpr("*", "0 AS way", "0 AS share"), probes.selectExpr("*", "0 AS way", "0 AS share")
    near = sql(MATCHES, met=sql(MET, probes=probes, segments=segments))
    found = checkpointed(exact.unionByName(near))
    matched, rest = sql(MATCHED, typed=typed, found=found), sql(UNMATCHED, typed=typed, found=found)
    if writing.qualified:
        rest = rest.selectExpr("entry_id", "kind", "head AS form")
        matched, rest = matched.unionByName(sql(MATCHED, typed=rest, found=found)), sql(UNMATCHED, typed=rest, found=found)
    return matched.unionByName(sql(NOTHING, rest=rest))


def unmatched(entries: DataFrame, mapped: DataFrame) -> DataFrame:
    """The entries that mean no canonical value, with their labels. Every row of an entry that means one somewhere is left out; null ids are reported."""
    sql = entries.sparkSession.sql
    return sql("SELECT e.* FROM {entries} e LEFT ANTI JOIN (SELECT entry_id FROM {mapped} WHERE canonical <> '') m ON e.entry_id = m.entry_id WHERE e.label RLIKE '(?U)[^\\\\s]'", entries=entries, mapped=mapped)


def reference_spellings(keepers: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, canonical, label, own) of the institutions, through their aliases, and of the linked labels.

    A chain of aliases is followed to its end however long it is; one that runs
    in a circle ends at the circle's smallest member, and an alias that isn't
    listed counts for none.
    """
    sql = keepers.sparkSession.sql
    listed = sql("SELECT k.repository, t.repository AS alias_of FROM {keepers} k LEFT JOIN (SELECT DISTINCT repository FROM {keepers} WHERE length(trim(repository)) > 0) t ON k.alias_of = t.repository WHERE length(trim(k.repository)) > 0", keepers=keepers)
    ends = chase(listed, name="repository", target="alias_of")
    return sql(
        """
        SELECT 'repository' AS kind, e.canonical, x.label, IF(x.label = e.canonical, 0, x.own) AS own FROM {keepers} k JOIN {ends} e ON k.repository = e.name
          LATERAL VIEW inline(array(struct(k.repository AS label, 1 AS own), struct(k.wd_label AS label, 2 AS own))) x WHERE x.label IS NOT NULL
        UNION ALL
        SELECT l.kind, l.label, x.label, x.own FROM {links} l LATERAL VIEW inline(array(struct(l.label AS label, 0 AS own), struct(l.wd_label AS label, 2 AS own))) x WHERE l.label IS NOT NULL AND x.label IS NOT NULL
        """,
        keepers=keepers, ends=ends, links=links,
    )


def meant_labels(entries: DataFrame, keepers: DataFrame, links: DataFrame, writing: Writing = PLAIN) -> DataFrame:
    """(entry_id, canonical), without repeated rows."""
    return map_values(entries, reference_spellings(keepers, links), writing=writing).select("entry_id", "canonical").distinct()
