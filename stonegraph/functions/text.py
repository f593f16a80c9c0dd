"""Text functions as Spark expressions; only ``similarity_ratio`` needs Python."""

from __future__ import annotations

import difflib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
PLACE_LEVELS = ["building", "graveyard", "ecclesiastical_site", "site", "lake", "townland", "civil_parish", "parish", "town", "city", "sheading", "county", "region", "island", "historical", "country"]
EDITOR_PREFIXES = {"RHY": "Rhys", "MAC": "Macalister", "DIA": "Diack", "JAC": "Jackson", "FOR": "Forsyth", "OKA": "O’Kelly", "BRA": "Brash", "MCM": "McManus", "PAD": "Padel", "WES": "West", "BRO": "Broderick", "SHE": "Shee", "CLA": "Clarke", "FUL": "Fulford", "JOH": "Johnson"}
EDITION_ID = r"[A-Z]-[A-Z]{3}-[A-Z0-9]+"


def _accents() -> tuple[str, str]:
    """Each character of the basic plane that is one base character with marks, and that base: built from Unicode's own decompositions."""
    marked, bare = [], []
    for code in range(0xC0, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(parts) == 1 and parts[0] != chr(code):
            marked.append(chr(code))
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _accents()


def strip_marks(c: Column) -> Column:
    """Letters without their combining marks."""
    plain = F.regexp_replace(F.translate(c, _MARKED, _BARE), r"\p{Mn}+", "")
    return F.when(c.rlike(r"[^\x00-\x7f]"), plain).otherwise(c)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null is ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def slug(c: Column) -> Column:
    """Runs of other than ASCII letters and digits as ``_``; ``x`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("x"))


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def clean_label(c: Column) -> Column:
    """A label without URLs, empty or unbalanced brackets and stray punctuation at its ends."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"https?://[^\s)\]]+", "")
    t = F.regexp_replace(t, r"\(\s*[‘’'\"]?\s*\)", "")
    opened, closed = _count(t, "("), _count(t, ")")
    t = F.when(opened > closed, F.regexp_replace(t, r"(?s)\([^(]*$", "")).when(closed > opened, F.regexp_replace(t, r"(?s)\).*$", "")).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"\s+\)", ")"), r"\(\s+", "(")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ ,;‘’'\"]+|[ ,;‘’'\"]+$", "")


PROSE = r"(?i)(?<!\bCo)(?<!\bSt)(?<!\bMt)\.\s|;\s|\sbut\s|\sprobably\s|\spossibly\s"


def split_prose(c: Column) -> Column:
    """struct(short, full): a label before the prose that follows it; full is '' where there is none."""
    parts = F.split(c, PROSE, 2)
    short = clean_label(parts[0])
    cut = (F.size(parts) > 1) & (short != "")
    return F.struct(F.when(cut, short).otherwise(c).alias("short"), F.when(cut, c).otherwise("").alias("full"))


def normalise_reading(c: Column) -> Column:
    """A transliteration as plain capitals and blanks: marks, trailing Roman-script part, asides and vacats dropped, brackets removed but not their letters."""
    t = strip_marks(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, r"(?i);?\s*\bRoman\b\s*:.*$", " ")
    t = F.regexp_replace(t, r"\([^)]*[a-z0-9][^)]*\)", " ")
    t = F.regexp_replace(t, r"\([^)]*[a-z0-9][^)]*$", " ")
    t = F.regexp_replace(t, r"(?i)vacat\b|vac\.", " ")
    t = F.regexp_replace(t, r"[\[\](){}⸢⸣〚〛/\\]", "")
    return F.upper(F.trim(F.regexp_replace(t, "[^A-Za-z]+", " ")))


def plain_letters(c: Column) -> Column:
    """Letters in capitals and single blanks; all else is dropped and parts no words."""
    return F.upper(collapse(F.regexp_replace(strip_marks(F.coalesce(c, F.lit(""))), r"[^A-Za-z\s]", "")))


def split_script(c: Column) -> Column:
    """struct(script, text): a leading ``Ogham:``, ``Roman:`` or ``Latin:`` taken off."""
    head = F.regexp_extract(c, r"(?i)^\s*(Ogham|Roman|Latin)\s*:\s*", 1)
    rest = F.regexp_replace(c, r"(?i)^\s*(Ogham|Roman|Latin)\s*:\s*", "")
    return F.struct(F.when(head != "", F.lower(head)).otherwise("ogham").alias("script"), F.when(head != "", F.trim(rest)).otherwise(c).alias("text"))


def editor_label(c: Column, prefixes: dict[str, str] = EDITOR_PREFIXES) -> Column:
    """``MAC1945`` as ``Macalister 1945``; '' for other forms."""
    name, year = F.regexp_extract(c, r"^([A-Za-z]+)(\d{4})", 1), F.regexp_extract(c, r"^([A-Za-z]+)(\d{4})", 2)
    known = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    return F.when(name != "", F.concat(F.coalesce(F.try_element_at(known, F.upper(name)), F.initcap(name)), F.lit(" "), year)).otherwise("")


# The editors that a stone's own graph knows by name.
EDITION_PREFIXES = {k: EDITOR_PREFIXES[k] for k in ("RHY", "MAC", "DIA", "JAC", "FOR")}


def edition_label(c: Column) -> Column:
    """As ``editor_label`` with fewer names; other forms stand as they are, nothing is ``OGHAM edition``."""
    label = editor_label(c, EDITION_PREFIXES)
    return F.when(label != "", label).otherwise(F.coalesce(F.nullif(c, F.lit("")), F.lit("OGHAM edition")))


def utc_stamp(c: Column) -> Column:
    """An instant as ``2024-01-31T12:00:00Z``, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def attribution(c: Column) -> Column:
    """The surname and year of the first ``Some Name (1945`` in a note; '' without one."""
    pattern = r"([A-Z][\w’'\-]+(?:\s+[A-Z][\w’'\-]+)*?)\s*\((\d{4})"
    name, year = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    surname = F.regexp_extract(F.regexp_replace(name, r"(’s|'s)$", ""), r"(\S+)$", 1)
    return F.when(year != "", F.trim(F.concat_ws(" ", surname, year))).otherwise("")


def surname(source: Column, prefixes: dict[str, str] = EDITOR_PREFIXES) -> Column:
    """The editor behind a source id such as ``MAC1945``; null for others."""
    known = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    return F.try_element_at(known, F.upper(F.regexp_extract(source, r"^([A-Za-z]+)\d{4}", 1)))


def normalise_nym(c: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(c, "^#+", "")), F.lit("-"), F.lit("_"))


def is_anonymous(nym: Column) -> Column:
    return nym.isin("", "...", "…") | nym.rlike(r"^\?*$")


def series(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Z]-[A-Z]{3}-([A-Z]?)", 1)


def stone_key(filename: Column, catalogue: Column) -> Column:
    """The edition's id if it is well formed, else the catalogue number, else whatever there is, else ``x``."""
    name = F.trim(F.coalesce(filename, F.lit("")))
    number = F.trim(F.coalesce(catalogue, F.lit("")))
    return F.when(name.rlike(f"^{EDITION_ID}$"), name).otherwise(F.coalesce(F.nullif(number, F.lit("")), F.nullif(name, F.lit("")), F.lit("x")))


def is_edition(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{EDITION_ID}$"), F.lit(False))


def name_variants(c: Column) -> Column:
    """A name in full, without its parentheses, before its first comma or bar, and both; over three letters, each once whatever its case."""

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"\s*\([^)]*\)", "")

    lead = F.split(c, r"\s*[|,]", 2)[0]
    tidy = [F.regexp_replace(x, r"^[ ,|]+|[ ,|]+$", "") for x in (c, bare(c), lead, bare(lead))]
    kept = F.filter(F.array(*tidy), lambda x: F.length(x) > 3)
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def curie(uri: Column, prefixes: dict[str, str]) -> Column:
    """A URI with the first namespace that fits as a prefix."""
    return reduce(lambda rest, kv: F.when(uri.startswith(kv[1]), F.concat(F.lit(kv[0] + ":"), F.substr(uri, F.lit(len(kv[1]) + 1)))).otherwise(rest), reversed(list(prefixes.items())), uri)


def expand_curie(c: Column, prefixes: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    base = F.try_element_at(known, F.substring_index(c, ":", 1))
    return F.when(base.isNotNull(), F.concat(base, F.regexp_extract(c, r"^[^:]*:(.*)$", 1))).otherwise(c)


def haystack(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *cols))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def only_in(a: Column, b: Column) -> Column:
    """The elements of ``a`` that ``b`` lacks, in order and with repeats."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def words(c: Column) -> Column:
    """The words of a normalised text; none for ''."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def highlight(text: Column, word: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """The first occurrence of a word in a text marked up."""
    at = F.position(word, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(before), word, F.lit(after), F.substr(text, at + F.length(word)))).otherwise(text)


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all, by longest matching blocks (with the usual rule on popular characters in long texts); 1 for two empty texts. The order of the two matters."""
    seen: dict = {}

    def ratio(x: str, y: str) -> float:
        if (x, y) not in seen:
            seen[x, y] = difflib.SequenceMatcher(None, x, y).ratio() if x or y else 1.0
        return seen[x, y]

    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)])


def round_even(c: Column, digits: int) -> Column:
    """Rounded by the number's exact binary value, ties to even, as Python does: 2.675 is a little less than it looks and gives 2.67. Spark's own functions go by the shortest decimal and give 2.68."""

    @F.pandas_udf(T.DoubleType())
    def rounded(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else round(v, digits) for v in values], dtype="float64")

    return rounded(c)


def band(ratio: Column) -> Column:
    return F.when(ratio >= 1.0, "identical").when(ratio >= 0.8, "close").when(ratio >= 0.5, "diverging").otherwise("far apart")


def label_confidence(label: Column, hit: Column) -> Column:
    a, b = F.lower(F.trim(label)), F.lower(F.trim(F.coalesce(hit, F.lit(""))))
    return F.when(a == b, 0.90).when(F.contains(b, a) | F.contains(a, b), 0.70).otherwise(0.50)


def blob_id(content: Column) -> Column:
    """The id version control gives to a text's UTF-8 bytes."""
    data = F.encode(content, "UTF-8")
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), data))


def stone_page_link(base: str, number: Column, given: Column) -> Column:
    """A stone's page: the given address if it has the resolvable form, else one made from its number; '' without either."""
    ok = F.coalesce(given.rlike(r"[a-z0-9]+_\d+\.html$"), F.lit(False))
    made = F.concat(F.lit(base), F.replace(F.lower(number), F.lit("/"), F.lit("_")), F.lit(".html"))
    return F.when(ok, given).when(F.contains(number, F.lit("/")), made).otherwise("")


def stone_page_state(given: Column) -> Column:
    return F.when(F.coalesce(given, F.lit("")) == "", "none").when(given.rlike(r"[a-z0-9]+_\d+\.html$"), "ok").when(given.rlike(r"/\.html/*$"), "empty").otherwise("identifier form")
