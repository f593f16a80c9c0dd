"""Records completed, merged and linked: overrides, upserts, candidate ranking, lints, comparison of readings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonegraph.functions import text
from stonegraph.session import BitTable


def fill_missing(records: DataFrame, overrides: DataFrame, *, key: str, columns: list[str]) -> DataFrame:
    """Records with missing ``columns`` (the first one null) filled from overrides that have all; ``supplied`` tells which. An override for a record that has its own is refused (see ``refused``)."""
    whole = reduce(lambda a, c: a & F.col(c).isNotNull(), columns[1:], F.col(columns[0]).isNotNull())
    o = overrides.where(whole).select(key, *(F.col(c).alias(f"_{c}") for c in columns)).dropDuplicates([key])
    use = F.col(columns[0]).isNull() & F.col(f"_{columns[0]}").isNotNull()
    joined = records.join(o, key, "left").withColumn("supplied", use)
    return joined.withColumns({c: F.when(F.col("supplied"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop(*(f"_{c}" for c in columns))


def refused(records: DataFrame, overrides: DataFrame, *, key: str, column: str) -> DataFrame:
    return overrides.where(F.col(column).isNotNull()).join(records.where(F.col(column).isNotNull()).select(key), key, "left_semi")


def upsert(cache: DataFrame, given: DataFrame, *, key: str, columns: list[str]) -> DataFrame:
    """The cache with hand-set values laid over it; new keys are added and ``changed`` tells which rows differ."""
    g = given.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    both = cache.select(key, *columns).join(g, key, "full")
    new = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
    changed = reduce(lambda a, c: a | ~new[c].eqNullSafe(F.col(c)), columns, F.lit(False))
    return both.select(key, *(new[c].alias(c) for c in columns), changed.alias("changed"))


def rank_candidates(candidates: DataFrame, *, key: list[str], label: str, hit: str, rank: str, fits: str, look_at: int = 5) -> DataFrame:
    """One candidate for each key: the first of the top ``look_at`` that fits (confidence raised by 0.05, at most 1), else the very first (halved). ``fits`` may be null for unknown: then the first as it is."""
    w = Window.partitionBy(*key).orderBy(rank, hit)
    c = candidates.withColumn("_n", F.row_number().over(w)).withColumn("_known", F.max(F.col(fits).isNotNull()).over(Window.partitionBy(*key)))
    c = c.withColumn("_ok", F.coalesce(F.col(fits), F.lit(False)) & (F.col("_n") <= look_at))
    best = c.withColumn("_b", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_ok"), "_n"))).where("_b = 1")
    base = text.label_confidence(F.col(label), F.col(hit))
    verdict = F.when(~F.col("_known"), "unknown").when(F.col("_ok"), "ok").otherwise("mismatch")
    conf = F.when(~F.col("_known"), base).when(F.col("_ok"), F.least(F.lit(1.0), F.bround(base + 0.05, 2))).otherwise(F.bround(base * 0.5, 2))
    return best.select(*key, hit, rank, conf.alias("confidence"), verdict.alias("type_match"))


def by_precedence(keys: DataFrame, *, on: list[str], sources: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """Each key with the value of the first source that has one, and that source's name ('' without)."""
    out = keys
    for n, (_, df) in enumerate(sources):
        out = out.join(df.select(*on, F.col(value).alias(f"_v{n}")).dropDuplicates(on), on, "left")
    picked = F.coalesce(*(F.col(f"_v{n}") for n in range(len(sources))))
    name = reduce(lambda rest, n: F.when(F.col(f"_v{n}").isNotNull(), sources[n][0]).otherwise(rest), reversed(range(len(sources))), F.lit(""))
    return out.select(*on, picked.alias(value), name.alias("decided_by"))


def lint(df: DataFrame, *, key: str, complaints: dict[str, Column]) -> DataFrame:
    """(key, complaint): one row for each complaint whose condition holds, in one pass over the table."""
    found = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in complaints.items())), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(found).alias("complaint"))


def compare_readings(pairs: DataFrame, *, current: str, other: str, formula: dict[str, list[str]], normalise: Callable[[Column], Column] = text.normalise_reading) -> DataFrame:
    """Adds to pairs of texts: both normalised, what is only in either, formula words gained and lost, similarity (3 digits, half even) and its band.

    ``formula`` has, for each spelling, the formula words it stands for.
    """
    known = F.create_map(*(x for k, v in formula.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if formula else F.create_map().cast("map<string,array<string>>")
    d = pairs.withColumn("current_norm", normalise(F.col(current))).withColumn("other_norm", normalise(F.col(other)))
    d = d.withColumn("_a", text.words(F.col("current_norm"))).withColumn("_b", text.words(F.col("other_norm"))).withColumn("_r", text.similarity_ratio(F.col("current_norm"), F.col("other_norm")))

    def meant(tokens: str) -> Column:
        return F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>"))))

    d = d.withColumn("_fa", meant("_a")).withColumn("_fb", meant("_b"))
    return d.select(
        *pairs.columns, "current_norm", "other_norm", text.only_in(F.col("_a"), F.col("_b")).alias("only_current"), text.only_in(F.col("_b"), F.col("_a")).alias("only_other"),
        F.array_sort(F.array_except("_fb", "_fa")).alias("gained"), F.array_sort(F.array_except("_fa", "_fb")).alias("lost"), text.round_even(F.col("_r"), 3).alias("ratio"), text.band(F.col("_r")).alias("ratio_band"),
    )


def dissent(compared: DataFrame, *, key: str, editor: str) -> DataFrame:
    """Per stone: comparisons, least similarity and its band, editors in order, whether formula words are at stake."""
    stake = (F.size("gained") > 0) | (F.size("lost") > 0)
    return compared.groupBy(key).agg(F.count("*").alias("comparisons"), F.min("ratio").alias("least"), F.array_sort(F.collect_set(editor)).alias("editors"), F.bool_or(stake).alias("at_stake")).withColumn("least_band", text.band(F.col("least")))


MOST_WORDS, MOST_WORD_BYTES = 100_000, 16 << 20  #: rows of a vocabulary, and their bytes, up to which it is broadcast
FEW_WORDS = 100  #: rows up to which looking for each in a token costs less than making the token's substrings


def match_words(tokens: DataFrame, vocabulary: DataFrame, *, token: str, longest_piece: int = 0) -> DataFrame:
    """Tokens with the vocabulary's variants: equal ones, and for mode ``element`` also those that hold a variant.

    The vocabulary is measured by a job when this is called. Up to
    ``FEW_WORDS`` are looked for in each token one by one. With more of them
    both are one equality join: each token is looked up with its substrings of
    the lengths that element variants have, so no pair of rows is compared that
    doesn't share text. ``longest_piece`` bounds the length of element variants;
    0 takes all.

    Catalyst knows the size neither of the vocabulary nor of the substrings. Up
    to ``MOST_WORDS`` the vocabulary is broadcast and the tokens stay where they
    are; beyond that substrings that a bit table doesn't know are dropped before
    both sides are shuffled. The substrings are never broadcast.
    """
    length = F.length("variant")
    element = (F.col("mode") == "element") & (length > 0) & (length <= (longest_piece or 2**31 - 1))
    v = vocabulary.where(element | (F.col("mode") != "element"))
    rows, size, most, lengths = v.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*v.columns)))), F.max(F.when(element, length)), F.slice(F.collect_set(F.when(element, length)), 1, 65)).first()
    small = rows <= MOST_WORDS and (size or 0) <= MOST_WORD_BYTES
    if small and rows <= FEW_WORDS:
        return tokens.join(F.broadcast(v), ((F.col("mode") == "element") & F.contains(F.col(token), F.col("variant"))) | (F.col(token) == F.col("variant")))
    n, pieces = F.length(token), F.array(token)
    if most:
        ks = F.array(*map(F.lit, sorted(lengths))) if len(lengths) <= 64 else F.sequence(F.lit(1), F.lit(most))
        inner = F.transform(F.filter(ks, lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substring(F.col(token), at, k)))
        pieces = F.array_distinct(F.concat(pieces, F.flatten(inner)))
    parts = tokens.where(F.col(token).isNotNull()).select("*", F.explode(pieces).alias("_piece"))
    held = (F.col("_piece") == F.col("variant")) & ((F.col("mode") == "element") | (F.col("_piece") == F.col(token)))
    if small:
        return parts.join(F.broadcast(v), held).drop("_piece")
    known = BitTable(v.select(F.xxhash64("variant").alias("_key")), "_key", rows)
    sifted = known.held(parts.withColumn("_key", F.xxhash64("_piece")), "_key").drop("_key")
    return sifted.hint("merge").join(v, held).drop("_piece")


def shared(df: DataFrame, *, name: str, place: str) -> DataFrame:
    """Names found at more than one place: name, places (how many)."""
    return df.where(F.length(name) > 0).groupBy(name).agg(F.countDistinct(place).alias("places")).where("places > 1")


def undrawable(records: DataFrame, holders: DataFrame, *, holder: str, lat: str) -> DataFrame:
    """Records with a holder that can't be drawn, with the reason; ``holders`` has name and located."""
    named = records.where(F.length(F.trim(holder)) > 0)
    why = F.when(F.col(lat).isNull(), "no findspot coordinate").when(~F.coalesce("located", F.lit(False)), "holder not located")
    return named.join(holders, F.trim(holder) == F.col("name"), "left").withColumn("why", why).where("why is not null").drop("name", "located")


def settle(records: DataFrame, settled: DataFrame, *, key: str) -> DataFrame:
    """Records with ``settled``: whether somebody has found that nothing more can be known."""
    marks = settled.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("settled")).distinct()
    return records.join(marks, key, "left").withColumn("settled", F.coalesce("settled", F.lit(False)))


def override_verdicts(verdicts: DataFrame, overrides: DataFrame, *, key: str, columns: list[str], note: str) -> DataFrame:
    """Verdicts replaced by those set by hand: ``columns`` and ``evidence`` (its note, or else the rule's evidence), and ``method`` tells which. ``overrides`` has one row a key; of several the greatest counts."""
    by_hand = overrides.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns, note)).alias("_o"))
    d = verdicts.join(by_hand, key, "left")
    use = F.col("_o").isNotNull()
    d = d.withColumns({c: F.when(use, F.col("_o")[c]).otherwise(F.col(c)) for c in columns})
    d = d.withColumn("evidence", F.when(use & (F.length(F.col("_o")[note]) > 0), F.col("_o")[note]).otherwise(F.col("evidence")))
    return d.withColumn("method", F.when(use, "set by hand").otherwise("rule")).drop("_o")


def type_fits(kind: Column, classes: Column, labels: Column, wanted: dict[str, list[str]], human: str = "Q5") -> Column:
    """Whether a candidate is of the kind looked for: an editor is a human, others have one of the kind's words in the label of a type; null if no type is known."""
    known = (F.size(F.coalesce(classes, F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0)
    words = reduce(lambda rest, kv: F.when(kind == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(rest), wanted.items(), F.array().cast("array<string>"))
    fits = F.when(kind == "editor", F.array_contains(classes, human)).otherwise(F.exists(labels, lambda x: F.exists(words, lambda w: F.contains(F.lower(x), w))))
    return F.when(known, F.coalesce(fits, F.lit(False)))


def reconcile(terms: DataFrame, *, allowed: DataFrame, cache: DataFrame, candidates: DataFrame, key: list[str], label: str) -> DataFrame:
    """(key, qid, confidence, status, type_match, decided_by) of each different term.

    The first of: the list curated by hand (confidence 1), a verified entry of
    the cache, the best candidate (see ``rank_candidates``), any entry of the
    cache, nothing. ``allowed`` has qid, ``cache`` qid, confidence and status,
    ``candidates`` qid, rank, hit and fits.
    """
    once = terms.select(*key).where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in key))).distinct()
    best = rank_candidates(candidates.withColumn("_label", F.col(label)), key=key, label="_label", hit="hit", rank="rank", fits="fits").select(*key, F.col("hit"), F.col("confidence").alias("_cc"), "type_match")
    best = best.join(candidates.groupBy(*key, "hit").agg(F.min("qid").alias("_cq")), [*key, "hit"])
    held = cache.groupBy(*key).agg(F.max(F.struct((F.col("status") == "verified").alias("v"), "qid", "confidence")).alias("c"))
    curated = allowed.where(F.length("qid") > 0).groupBy(*key).agg(F.max("qid").alias("_aq"))
    d = once.join(curated, key, "left").join(held, key, "left").join(best, key, "left")
    source = F.when(F.col("_aq").isNotNull(), "curated").when(F.col("c.v") & (F.length("c.qid") > 0), "verified").when(F.col("_cq").isNotNull(), "candidate").when(F.length("c.qid") > 0, "cache").otherwise("")
    d = d.withColumn("decided_by", source)

    def of(*values: Column) -> Column:
        return reduce(lambda rest, kv: F.when(F.col("decided_by") == kv[0], kv[1]).otherwise(rest), zip(("curated", "verified", "candidate", "cache"), values), F.lit(None))

    return d.select(
        *key, of(F.col("_aq"), F.col("c.qid"), F.col("_cq"), F.col("c.qid")).alias("qid"), F.coalesce(of(F.lit(1.0), F.col("c.confidence"), F.col("_cc"), F.col("c.confidence")), F.lit(0.0)).alias("confidence"),
        of(F.lit("verified"), F.lit("verified"), F.lit("auto"), F.lit("auto")).alias("status"), of(F.lit("curated"), F.lit("ok"), F.col("type_match"), F.lit("unknown")).alias("type_match"), "decided_by",
    )


def locate_holders(holders: DataFrame, by_id: DataFrame, found: DataFrame) -> DataFrame:
    """(name, qid, lat, lon, decided_by): where each holder is.

    ``holders`` has name, alias_of, qid, osm_id, source, lat and lon; ``by_id``
    the points of ids (id, lat, lon); ``found`` what a search by name gave
    (name, qid, rank, in_country, lat, lon). Aliases, holders set by hand and
    those located without an id are left as they are. One with an id gets that
    id's point (the qid's before the other's), and if that fails it stays
    unset: it is never searched. The others get the first hit in the country
    with a point, then any with one, then one without.
    """
    points = by_id.where("lat is not null and lon is not null").groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("at"))
    hit = found.groupBy("name").agg(F.min_by(F.struct("qid", "lat", "lon"), F.struct(F.col("lat").isNull(), ~F.coalesce("in_country", F.lit(False)), "rank", "qid")).alias("hit"))
    pinned = (F.length(F.coalesce("qid", F.lit(""))) > 0) | (F.length(F.coalesce("osm_id", F.lit(""))) > 0)
    h = holders.join(points.select(F.col("id").alias("qid"), F.col("at").alias("at_qid")), "qid", "left").join(points.select(F.col("id").alias("osm_id"), F.col("at").alias("at_osm")), "osm_id", "left").join(hit, "name", "left")
    why = (
        F.when(F.length(F.coalesce("alias_of", F.lit(""))) > 0, "alias").when(F.coalesce(F.col("source") == "manual", F.lit(False)), "manual").when(~pinned & F.col("lat").isNotNull(), "located")
        .when(F.col("at_qid").isNotNull(), "qid").when(F.col("at_osm").isNotNull(), "osm").when(pinned, "pinned, not found").when(F.col("hit").isNotNull(), "search").otherwise("nothing")
    )
    h = h.withColumn("decided_by", why)

    def point(c: str) -> Column:
        return F.when(F.col("decided_by").isin("alias", "manual", "located"), F.col(c)).when(F.col("decided_by") == "qid", F.col("at_qid")[c]).when(F.col("decided_by") == "osm", F.col("at_osm")[c]).when(F.col("decided_by") == "search", F.col("hit")[c])

    qid = F.when(F.col("decided_by") == "search", F.col("hit.qid")).otherwise(F.col("qid"))
    return h.select("name", qid.alias("qid"), point("lat").alias("lat"), point("lon").alias("lon"), "decided_by")


def reset_unverified(cache: DataFrame, columns: list[str], *, status: str = "status") -> DataFrame:
    """The cache with ``columns`` of all but verified rows emptied, to be found anew; ``reset`` tells which."""
    again = F.coalesce(F.col(status) != "verified", F.lit(True))
    return cache.withColumn("reset", again).withColumns({c: F.when(~again, F.col(c)) for c in columns})


def pending(names: DataFrame, located: DataFrame, *, name: str) -> DataFrame:
    """Names that are nowhere located."""
    return names.where(F.length(F.trim(name)) > 0).select(name).distinct().join(located.select(name).distinct(), name, "left_anti")


def suggestions(cache: DataFrame, by_hand: DataFrame, *, key: str, sources: list[str]) -> DataFrame:
    """Entries found by search, with an id and without an alias, that the list kept by hand lacks."""
    found = cache.where(F.col("source").isin(sources) & (F.length(F.coalesce("alias_of", F.lit(""))) == 0) & (F.length(F.coalesce("qid", F.lit(""))) > 0))
    return found.join(by_hand.select(key).distinct(), key, "left_anti")


#: Complaints about identifiers set by hand, as conditions over key, qid, osm_id, lat and lon (strings).
IDENTIFIER_COMPLAINTS = {
    "no key": "length(trim(coalesce(key, ''))) = 0",
    "bad qid": "qid <> '' AND NOT regexp_like(qid, '^Q[0-9]+$')",
    "bad osm id": "osm_id <> '' AND NOT regexp_like(osm_id, '^[NWR][0-9]+$')",
    "lat and lon must be given together": "(coalesce(lat, '') = '') <> (coalesce(lon, '') = '')",
    "not a number": "(lat <> '' AND try_cast(lat AS double) IS NULL) OR (lon <> '' AND try_cast(lon AS double) IS NULL)",
    "not on earth": "abs(try_cast(lat AS double)) > 90 OR abs(try_cast(lon AS double)) > 180",
    "alias of itself": "key = alias_of",
}


def identifier_complaints(entries: DataFrame, keys: DataFrame, *, ignored: list[str]) -> DataFrame:
    """(key, complaint) for each entry of identifiers set by hand: malformed values, keys that ``keys`` (key) lacks, and ``ignored`` columns that are filled in beside an alias."""
    own = lint(entries, key="key", complaints={n: F.expr(c) for n, c in IDENTIFIER_COMPLAINTS.items()})
    unknown = entries.where("length(trim(key)) > 0").select("key").distinct().join(keys.select("key").distinct(), "key", "left_anti").select("key", F.lit("unknown key").alias("complaint"))
    filled = reduce(lambda x, y: x | y, (F.length(F.coalesce(c, F.lit(""))) > 0 for c in ignored))
    beside = entries.where((F.length("alias_of") > 0) & filled).select("key", F.lit("ignored beside an alias").alias("complaint"))
    return own.unionByName(unknown).unionByName(beside)


def unknown_fields(entries: DataFrame, *, key: str, fields: str, known: list[str]) -> DataFrame:
    """(key, field): names in a map of fields that aren't known."""
    return entries.select(F.col(key), F.explode(F.array_except(F.map_keys(fields), F.array(*map(F.lit, known)))).alias("field"))


def first_of_forms(names: DataFrame, labels: DataFrame, forms: list[Column], *, name: str) -> DataFrame:
    """(name, uri, form): the uri of the first of several forms of a name that is a published label, and the form's number from 1; of several uris of a label the smallest counts. Names without one are left out."""
    published = labels.groupBy("label").agg(F.min("uri").alias("uri"))
    tried = names.select(name).distinct().select(name, F.posexplode(F.array(*forms)).alias("form", "label"))
    hits = tried.join(published, "label").groupBy(name).agg(F.min(F.struct("form", "uri")).alias("b"))
    return hits.select(name, "b.uri", (F.col("b.form") + 1).alias("form"))


def pair_readings(readings: DataFrame, *, stone: str, script: str, current: str, order: str) -> DataFrame:
    """Each competing reading with the current one of its stone and script: ``current_text`` beside ``text``. Of several current ones the first by ``order`` counts; the side joined is one row a stone and script."""
    fixed = readings.where(F.col(current)).groupBy(stone, script).agg(F.min_by("text", order).alias("current_text"))
    return readings.where(~F.col(current)).join(fixed, [stone, script])


def edge_slots(edges: DataFrame, slots: DataFrame, *, a: str, b: str) -> DataFrame:
    """Edges with the surfaces of both their ends: of a slot seen several times the last one (by ``ord``) counts. ``slots`` has slot, surface and ord."""
    last = slots.groupBy("slot").agg(F.max_by("surface", "ord").alias("surface"))
    out = edges
    for end in (a, b):
        out = out.join(last.select(F.col("slot").alias(end), F.col("surface").alias(f"{end}_surface")), end, "left")
    return out


def identifier_kinds(entries: DataFrame) -> DataFrame:
    """Entries with ``kind``: what locates each: an alias, an id, a point, or nothing."""
    def given(c: str) -> Column:
        return F.length(F.coalesce(c, F.lit(""))) > 0

    return entries.withColumn("kind", F.when(given("alias_of"), "alias").when(given("qid"), "qid").when(given("osm_id"), "osm").when(given("lat"), "point").otherwise("empty"))
