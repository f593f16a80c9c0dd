"""Ordered rules, lookups and run-length operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What each lemma asserts (gloss, kind).
RELATIONS = {
    "maqqas": ("son of", "parent"), "filius": ("son of (Latin)", "parent"), "avias": ("grandson or descendant of", "descent"), "muccoviias": ("of the kin of", "kin"), "celi": ("client or follower of", "social"), "celias": ("client or follower of", "social"),
    "cēlias": ("client or follower of", "social"), "koi": ("here (lies)", "marker"), "anmen": ("name of", "marker"), "anm": ("name of", "marker"), "netta": ("nephew or sister's son of", "descent"), "inigena": ("daughter of", "parent"),
}

# How a stone stands today, in order (key, custody, pattern); an empty pattern is decided by the repository.
SETTINGS = [
    ("lost", "lost", r"(no longer (?:visible|extant|to be seen|survives)|now missing|gone missing|cannot be located|currently unlocated|is (?:now )?lost|^lost$|was lost|subsequently lost|destroyed|broken up|whereabouts (?:are |is )?(?:now )?not known|whereabouts (?:are |is )?(?:now )?unknown|nothing is now known|present location .{0,20}not known|whereabouts .{0,14}not .{0,6}known|no visible surface)"),
    ("institution", "institution", ""),
    ("conservation", "institution", r"(for conservation|in conservation|conservator|conservation (?:workshop|studio|laborator)|being conserved|undergoing conservation)"),
    ("church", "indoors", r"((?:in|inside|within|at)[^.]{0,40}\b(?:church|chapel|cathedral|capel|kirk|priory|abbey)\b|nave|chancel|transept|church porch|house of crosses)"),
    ("visitor", "indoors", r"(visitor'?s? centre|exhibition centre|heritage centre|interpretive centre|geopark|victory hall|on display at)"),
    ("structure", "landscape", r"(built into|incorporated into|re-?used in|set in(?:to)? |embedded in|still in place above|attached to|souterrain|lintel|in the wall|wall of|gable|bridge|stile|gate ?post|barrow|cashel|ringfort|\brath\b|holy well|promontory fort|outbuilding|farmyard|farmhouse)"),
    ("enclosure", "landscape", r"(modern enclosure|small enclosure|own enclosure|nearby .{0,12}enclosure|modern collection|enclosure surrounding|glass case|under cover)"),
    ("churchyard", "landscape", r"(churchyard|graveyard|cemetery|burial ground|killeen|kileen|lych-?gate|ecclesiastical (?:site|enclosure))"),
    ("in_situ", "landscape", r"(in situ|on site|at or close to find|still at the find|(?:at|on) (?:the )?find ?s(?:ite|pot)|near find ?s(?:ite|pot)|pres\.? loc|position in which it was discovered|where it was found|in a field|in the field|in pasture|field fence|field boundary|in a hedge|standing stone|still stands|now stands|remains standing|on a rock|outcrop|dunes|on the hill|hillside|strand)"),
    ("grounds", "landscape", r"(private possession|re-?erected|roadside|beside a .{0,12}road|by the road|grass island|village green|garden|grounds of|demesne|estate|house\b|hall\b|castle|school|college|coláiste|scoil|ollscoil|forecourt|lawn|moved to|removed to|taken to|brought .{0,20}to|new premises)"),
]
INSTITUTION = r"\b(museum|college|coláiste|library|institution|university|academy)\b"

# What a tag is to the mapping.
MAPPED = "support idno objectType material layout div rdg origPlace origDate name geo country distinct persName ab".split()
CANDIDATE = "dimensions height width depth dim condition title provenance origin history bibl listBibl citedRange lb w term repository keywords rs date language textLang editor resp respStmt orgName graphic facsimile media note q g c space del add handShift creation surname roleName glyph charDecl".split()
DOUBT = "unclear supplied gap certainty app listApp lem choice corr sic orig reg damage surplus abbr expan ex".split()
STRUCTURAL = "TEI teiHeader fileDesc titleStmt publicationStmt sourceDesc encodingDesc profileDesc revisionDesc textClass langUsage msDesc msIdentifier msContents msItem physDesc objectDesc supportDesc layoutDesc handDesc handNote body text p desc funder licence availability authority change listChange include altIdentifier calendar calendarDesc ptr hi emph list item num xml".split()


def first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule whose condition holds."""
    return reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), otherwise)


def classify_setting(repository: Column, observed: Column) -> Column:
    """struct(key, custody, matched): the first setting that fits. ``matched`` is the wording, cut to 38 characters, or the repository."""
    held = F.coalesce(F.length(repository) > 0, F.lit(False))

    def verdict(key: str, custody: str, matched: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit(custody).alias("custody"), F.coalesce(matched, F.lit("")).alias("matched"))

    def of(low: Column) -> Column:
        rules = [(low.rlike(p), verdict(k, c, F.substring(F.regexp_substr(low, F.lit(p)), 1, 38))) if p else (held, verdict(k, c, repository)) for k, c, p in SETTINGS]
        rules.append((low.rlike(INSTITUTION), verdict("institution_unrecorded", "institution", F.lit(""))))
        return first_match(rules, verdict("undescribed", "undescribed", F.lit("")))

    # bound in a lambda, the text is put in small letters once and not in every branch
    return F.get(F.transform(F.array(F.lower(F.trim(F.coalesce(observed, F.lit(""))))), of), F.lit(0))


def classify_tag(tag: Column) -> Column:
    kinds = (("mapped", MAPPED), ("candidate", CANDIDATE), ("doubt", DOUBT), ("structural", STRUCTURAL))
    return first_match([(tag.isin(tags), F.lit(kind)) for kind, tags in kinds], F.lit("review"))


def relation_parts(lemma: Column, table: dict = RELATIONS) -> Column:
    """struct(gloss, kinds, is_kin) of a compound lemma ``a+b``; an unknown part stands for itself and is of kind ``other``."""
    gloss = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[0])))
    kind = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[1])))
    parts = F.split(lemma, r"\+")
    kinds = F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.coalesce(F.try_element_at(kind, p), F.lit("other")))))
    return F.struct(F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(gloss, p), p)), " and ").alias("gloss"), kinds.alias("kinds"), F.array_contains(kinds, "kin").alias("is_kin"))


def runs(df: DataFrame, *, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adjacent rows of equal value as one: by, run_no, value, length, and the first and last of the first order column."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    marked = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).withColumn("run_no", F.sum("_new").over(w))
    return marked.groupBy(*by, "run_no").agg(F.first(value).alias(value), F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def nearest(df: DataFrame, *, by: list[str], order: list[str], value: str, of: Column) -> DataFrame:
    """Adds before and after: ``value`` of the nearest rows on either side for which ``of`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    v = F.when(of, F.col(value))
    return df.withColumn("_v", v).withColumn("before", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first("_v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).drop("_v")


def first_per_key(df: DataFrame, *, key: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key, the least by ``order``; pre-aggregated, so a hot key is no window of its own."""
    best = F.min_by(F.struct(*columns), F.struct(*(c.alias(f"o{n}") for n, c in enumerate(order))))
    return df.groupBy(*key).agg(best.alias("_b")).select(*key, *(F.col("_b")[c].alias(c) for c in columns))


def modal(df: DataFrame, *, key: list[str], value: str) -> DataFrame:
    """The commonest value of each key, of ties the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))
