"""XML editions as records: one parse per edition, everything else in Spark expressions.

Elements are known by their local names, whatever their namespace.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stonegraph.functions import geo, text

_READING = pa.struct([("source", pa.string()), ("note", pa.string()), ("text", pa.string()), ("current", pa.bool_())])
_PLACE = pa.struct([("type", pa.string()), ("raw", pa.string()), ("vernacular", pa.list_(pa.struct([("lang", pa.string()), ("form", pa.string())]))), ("links", pa.list_(pa.string()))])
_PART = pa.struct([("phrase", pa.int32()), ("pos", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("surface", pa.string())])
_TAG = pa.struct([("tag", pa.string()), ("n", pa.int32())])
SCHEMA = pa.schema([
    ("record", pa.string()), ("recovered", pa.bool_()), ("ids", pa.map_(pa.string(), pa.string())), ("title", pa.string()), ("page", pa.string()), ("repository", pa.string()), ("material", pa.string()), ("object_type", pa.string()),
    ("has_place", pa.bool_()), ("place_text", pa.string()), ("places", pa.list_(_PLACE)), ("geo_raw", pa.string()), ("geo_cert", pa.string()), ("notes", pa.list_(pa.string())), ("links", pa.list_(pa.string())), ("observed", pa.string()),
    ("last_ids", pa.map_(pa.string(), pa.string())), ("any_geo", pa.string()), ("first_place", pa.string()), ("responsible", pa.string()), ("readings", pa.list_(_READING)), ("parts", pa.list_(_PART)), ("names", pa.list_(pa.string())), ("name_texts", pa.list_(pa.string())), ("tags", pa.list_(_TAG)),
])
DDL = (
    "record string, recovered boolean, ids map<string,string>, title string, page string, repository string, material string, object_type string, has_place boolean, place_text string, "
    "places array<struct<type:string,raw:string,vernacular:array<struct<lang:string,form:string>>,links:array<string>>>, geo_raw string, geo_cert string, notes array<string>, links array<string>, observed string, "
    "last_ids map<string,string>, any_geo string, first_place string, responsible string, readings array<struct<source:string,note:string,text:string,current:boolean>>, parts array<struct<phrase:int,pos:int,kind:string,ref:string,surface:string>>, names array<string>, name_texts array<string>, tags array<struct<tag:string,n:int>>"
)
LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def _name(el) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def _all(el, name: str) -> list:
    return [] if el is None else [x for x in el.iter() if x is not el and _name(x) == name]


def _kids(el, name: str) -> list:
    return [] if el is None else [x for x in el if _name(x) == name]


def _first(el, *path: str):
    """The first element at the end of a path of names: the first one anywhere below, the others as children."""
    for x in _all(el, path[0]):
        for step in path[1:]:
            x = next(iter(_kids(x, step)), None)
        if x is not None:
            return x
    return None


def _text(el, without: str = "") -> str:
    """All text below, blanks collapsed; ``without`` leaves out elements of that name but keeps what follows them."""

    def parts(x):
        yield x.text or ""
        for kid in x:
            if _name(kid) and _name(kid) != without:
                yield from parts(kid)
            yield kid.tail or ""

    return "" if el is None else " ".join("".join(parts(el)).split())


def parse(content: str | None, strict: bool = False) -> tuple[ET.Element, bool] | None:
    """The root, and whether it had to be repaired; None beyond that (see ``_repaired``)."""
    if not content:
        return None
    try:
        return ET.fromstring(content), False
    except (ET.ParseError, ValueError):
        if strict:
            return None
    mended = re.sub(r"&(?!(?:#\d+|#x[0-9a-fA-F]+|\w+);)", "&amp;", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", content))
    for _ in range(MOST_REPAIRS):
        try:
            return ET.fromstring(mended), True
        except ET.ParseError as error:
            better = _repaired(mended, error)
            if better is None or better == mended:
                return None
            mended = better
        except ValueError:
            return None
    return None


MOST_REPAIRS = 200  #: faults mended in one text; one with more can't be read


def _open_tags(text: str) -> list[str]:
    """The elements that are open at the end of a text."""
    opened: list[str] = []
    for m in re.finditer(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|<(/?)([^\s<>/]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", text, re.S):
        if m[2] and m[1]:
            if m[2] in opened:
                del opened[len(opened) - 1 - opened[::-1].index(m[2]) :]
        elif m[2] and not m[4]:
            opened.append(m[2])
    return opened


def _repaired(content: str, error: ET.ParseError) -> str | None:
    """The text with the fault that a parser stopped at undone: what is left open is closed, a stray end taken out, an entity nobody declared or a loose ``<`` written out, what follows the root cut off."""
    lines = content.split("\n")
    row, col = error.position
    at = sum(len(x) + 1 for x in lines[: row - 1]) + len(lines[row - 1].encode()[:col].decode(errors="ignore")) if row <= len(lines) else len(content)
    said = str(error)
    if "mismatched tag" in said:
        start = content.rfind("<", 0, at + 1)
        end = content.find(">", start) + 1
        name = content[start + 2 : end - 1].strip()
        opened = _open_tags(content[:start])
        if name not in opened:
            return content[:start] + content[end:]
        closing = opened[len(opened) - opened[::-1].index(name) :]
        return content[:start] + "".join(f"</{x}>" for x in reversed(closing)) + content[start:]
    if "no element found" in said or "unclosed token" in said:
        whole = content[: content.rfind("<")] if "unclosed token" in said and "<" in content else content
        opened = _open_tags(whole)
        return whole + "".join(f"</{x}>" for x in reversed(opened)) if opened else None
    if "undefined entity" in said:
        start = content.rfind("&", 0, at + 1)
        return content[:start] + "&amp;" + content[start + 1 :] if start >= 0 else None
    if "junk after document element" in said:
        return content[:at]
    if "not well-formed" in said or "duplicate attribute" in said or "unbound prefix" in said:
        start = content.rfind("<", 0, at + 1)
        return content[:start] + "&lt;" + content[start + 1 :] if start > 0 else None
    return None


def record(content: str | None, strict: bool = False) -> dict | None:
    """The record of one edition (see ``SCHEMA``), unprocessed text as it stands."""
    found = parse(content, strict)
    if not found:
        return None
    root, recovered = found
    ids: dict[str, str] = {}
    numbered = [x for x in _all(root, "idno") if x.get("type")]
    for x in numbered:
        if (x.text or "").strip():
            ids.setdefault(x.get("type"), x.text.strip())
    place = _first(root, "history", "origin", "origPlace")
    place = place if place is not None else _first(root, "origPlace")
    geo_el = _first(place, "geo")
    places = []
    for pn in _all(place, "placeName"):
        forms = [{"lang": d.get(LANG) or "ga", "form": _text(d)} for d in _all(pn, "distinct") if _text(d)]
        places.append({"type": pn.get("type", "untyped"), "raw": _text(pn, "distinct" if forms else ""), "vernacular": forms, "links": [r.get("target") for r in _all(pn, "ref") if r.get("target")]})
    editions = [d for d in _all(root, "div") if d.get("type") == "edition"]
    script = next((d for d in editions if d.get("subtype") == "transliteration"), None)
    shown = script if script is not None else next(iter(editions), None)
    readings, parts = [], []
    if shown is not None:
        blocks = _all(shown, "ab")
        readings.append({"source": (shown.get("resp") or "").lstrip("#"), "note": "", "text": _text(blocks[-1] if blocks else shown), "current": True})
    done = set()
    for app in _all(root, "app"):
        note = _text(next(iter(_kids(app, "note")), None))
        for r in _kids(app, "rdg"):
            done.add(r)
            readings.append({"source": (r.get("source") or r.get("resp") or "").lstrip("#"), "note": note, "text": _text(r), "current": False})
    readings += [{"source": (r.get("source") or r.get("resp") or "").lstrip("#"), "note": "", "text": _text(r), "current": False} for r in _all(root, "rdg") if r not in done]
    for n, phrase in enumerate(_all(script, "persName")):
        pos = 0
        for el in phrase.iter():
            if _name(el) == "name" and el.get("nymRef") is not None:
                parts.append({"phrase": n, "pos": pos, "kind": "name", "ref": el.get("nymRef"), "surface": _text(el)})
                pos += 1
            elif _name(el) == "w" and el.get("type") == "formula" and (el.get("lemma") or "").strip("#").strip():
                parts.append({"phrase": n, "pos": pos, "kind": "rel", "ref": el.get("lemma").strip("#").strip(), "surface": _text(el)})
                pos += 1
    shown_names: dict[str, str] = {}
    for x in _all(root, "name"):
        if x.get("nymRef") is not None and re.fullmatch("[A-Za-z ]+", _text(x)):
            shown_names.setdefault(_text(x).upper(), _text(x))
    page = next((x for x in numbered if x.get("type") == "CISP"), None)
    return {
        "recovered": recovered, "ids": list(ids.items()), "title": _text(_first(root, "title")), "page": "" if page is None else page.get("corresp", ""), "repository": _text(_first(root, "msIdentifier", "repository")),
        "material": _text(_first(root, "material")), "object_type": _text(_first(root, "objectType")), "has_place": place is not None, "place_text": _text(place), "places": places,
        "geo_raw": _text(geo_el), "geo_cert": "" if geo_el is None else geo_el.get("cert", ""), "notes": [_text(x) for x in _all(place, "note")], "links": [r.get("target") for r in _all(place, "ref") if r.get("target")],
        "observed": " ".join(_text(p) for p in _all(root, "provenance") if p.get("type") == "observed" and _text(p)), "last_ids": list({x.get("type"): (x.text or "").strip() for x in numbered}.items()), "any_geo": _text(_first(root, "geo")), "first_place": _text(_first(root, "placeName")),
        "responsible": "" if shown is None else (shown.get("resp") or "").lstrip("#"),
        "readings": [r for r in readings if r["text"]], "parts": parts, "names": [x.get("nymRef") for x in _all(root, "name") if x.get("nymRef")], "name_texts": list(shown_names.values()), "tags": [{"tag": t, "n": k} for t, k in sorted(Counter(_name(x) for x in root.iter() if _name(x)).items())],
    }


def _reader(strict: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                found = record(content.as_py(), strict)
                if found:
                    rows.append({"record": key, **found})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return read


def read_records(editions: DataFrame, *, key: str, content: str, strict: bool = False) -> DataFrame:
    """One row (see ``DDL``) for each edition that can be parsed; null, empty and unmendable texts give none."""
    return editions.select(F.col(key).cast("string"), F.col(content).cast("string")).mapInArrow(_reader(strict), DDL)


def unread(editions: DataFrame, *, key: str, content: str, strict: bool = False) -> DataFrame:
    """(record): editions with a text that can't be read."""

    def failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [k for k, t in zip(b.column(0).to_pylist(), b.column(1)) if t.as_py() and not parse(t.as_py(), strict)]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["record"])

    return editions.select(F.col(key).cast("string"), F.col(content).cast("string")).mapInArrow(failed, "record string")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha) of the XML files below a folder, without hidden files and version control's own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path)
    files = files.where(~F.col("path").rlike(r"/\.[^/]*(/|$)"))
    head = F.encode(F.concat(F.lit("blob "), F.col("length").cast("string")), "UTF-8")
    return files.select("path", F.decode("content", "UTF-8").alias("content"), F.sha1(F.concat(head, F.unhex(F.lit("00")), "content")).alias("sha"))


GRID_NOTE = r"(?i)(?:ITM|National Grid Reference|Irish Grid)[^:]*:\s*([^<;]+)"


def places(records: DataFrame, levels: list[str] = text.PLACE_LEVELS, hosts: list[str] | None = None) -> DataFrame:
    """Place records: ids, the chain of named places from narrow to broad, coordinates and their status.

    Of several names of one type the first counts; a later one lends its
    vernacular forms if the first has none. Names left empty are skipped.
    """

    def named(p: Column) -> Column:
        cut = text.split_prose(text.clean_label(p["raw"]))
        return F.struct(p["type"].alias("type"), cut["short"].alias("label"), cut["full"].alias("prose"), p["vernacular"].alias("vernacular"), p["links"].alias("links"))

    full = F.filter(F.transform("places", named), lambda p: p["label"] != "")

    def of_type(kind: Column) -> Column:
        same = F.filter("named", lambda p: p["type"] == kind)
        forms = F.filter(same, lambda p: F.size(p["vernacular"]) > 0)
        first = same[0]
        return F.when(F.size(same) > 0, F.struct(kind.alias("level"), first["label"].alias("label"), first["prose"].alias("prose"), F.when(F.size(first["vernacular"]) > 0, first["vernacular"]).when(F.size(forms) > 0, F.get(forms, F.lit(0))["vernacular"]).otherwise(first["vernacular"]).alias("vernacular"), first["links"].alias("links")))

    known = F.array(*map(F.lit, levels))
    with_names = records.withColumn("named", full).withColumn("parsed", geo.parse_coordinate(F.col("geo_raw")))
    chain = F.filter(F.transform(known, of_type), lambda x: x.isNotNull())
    filename, number = F.try_element_at("ids", F.lit("filename")), F.try_element_at("ids", F.lit("CIIC"))
    hosts = hosts or []
    wanted = F.filter("links", lambda u: F.exists(F.array(*map(F.lit, hosts)), lambda h: F.contains(u, h))) if hosts else F.col("links")
    grid = F.filter(F.transform("notes", lambda n: F.trim(F.regexp_extract(n, GRID_NOTE, 1))), lambda g: g != "")
    return with_names.select(
        "record", F.coalesce(filename, "record").alias("edition_id"), text.stone_key(filename, number).alias("stone_key"), "title", F.coalesce(number, F.lit("")).alias("number"), F.coalesce(F.try_element_at("ids", F.lit("CISP")), F.lit("")).alias("page_id"), "page", "repository", "observed",
        chain.alias("hierarchy"), F.filter("named", lambda p: ~F.array_contains(known, p["type"])).alias("other_names"), "place_text", "geo_raw", "geo_cert", F.col("parsed.lat").alias("lat"), F.col("parsed.lon").alias("lon"), F.col("parsed.hedge").alias("hedge"),
        F.when(~F.col("has_place"), "no_origplace").otherwise(geo.coordinate_status(F.col("geo_raw"), F.col("geo_cert"), F.col("parsed"))).alias("geo_status"), F.coalesce(F.get(grid, F.lit(0)), F.lit("")).alias("grid_raw"), F.array_join(wanted, " | ").alias("gazetteer"),
    )


def readings(records: DataFrame) -> DataFrame:
    """The current edition and every competing reading, with script, editor and normalised text."""
    r = records.select("record", F.posexplode("readings").alias("reading_no", "r"))
    cut = text.split_script(F.col("r.text"))
    noted = text.attribution(F.col("r.note"))
    resp = F.coalesce(F.nullif(F.col("r.source"), F.lit("")), F.lit("EDITION"))
    who = F.when(F.col("r.current"), F.concat(F.lit("current edition ("), resp, F.lit(")"))).otherwise(F.coalesce(F.nullif(text.editor_label(F.col("r.source")), F.lit("")), F.nullif(noted, F.lit("")), F.lit("unattributed reading")))
    rid = F.when(F.col("r.current"), resp).otherwise(F.coalesce(F.nullif(F.col("r.source"), F.lit("")), F.nullif(noted, F.lit("")), F.lit("unattributed")))
    return r.select("record", "reading_no", F.col("r.current").alias("current"), rid.alias("reading_id"), who.alias("editor"), cut["script"].alias("script"), cut["text"].alias("text"), text.normalise_reading(cut["text"]).alias("normalised"))


def slots(records: DataFrame) -> DataFrame:
    """Persons named in the transliteration: one row for each mention."""
    p = records.select("record", F.explode("parts").alias("p")).where("p.kind = 'name'")
    nym = text.normalise_nym(F.col("p.ref"))
    anonymous = text.is_anonymous(nym)
    slot = F.when(anonymous, F.concat("record", F.lit("/anon"), F.col("p.phrase").cast("string"), F.lit("_"), F.col("p.pos").cast("string"))).otherwise(F.concat(F.lit("name/"), nym))
    return p.select("record", F.col("p.phrase").alias("phrase"), F.col("p.pos").alias("pos"), slot.alias("slot_id"), F.when(anonymous, "").otherwise(nym).alias("nym"), F.col("p.surface").alias("surface"), anonymous.alias("anonymous"), nym.endswith("?").alias("uncertain"))


def relations(records: DataFrame) -> DataFrame:
    """Relations between the nearest names around each run of formula words; adjacent words are one compound relation."""
    p = records.select("record", F.explode("parts").alias("p")).select("record", "p.*")
    order = Window.partitionBy("record", "phrase").orderBy("pos")
    nym = text.normalise_nym(F.col("ref"))
    slot = F.when(text.is_anonymous(nym), F.concat("record", F.lit("/anon"), F.col("phrase").cast("string"), F.lit("_"), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("name/"), nym))
    p = p.withColumn("slot", F.when(F.col("kind") == "name", slot)).withColumn("run", F.sum((F.col("kind") == "name").cast("int")).over(order))
    p = p.withColumn("before", F.last("slot", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first("slot", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    rel = p.where("kind = 'rel'").groupBy("record", "phrase", "run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "ref", "surface"))).alias("w"), F.first("before").alias("from_id"), F.first("after").alias("to_id")
    )
    lemmas = F.transform("w", lambda x: F.regexp_replace(x["ref"], r"\?+$", ""))
    return rel.where("from_id is not null and to_id is not null").select("record", "phrase", F.col("w")[0]["pos"].alias("pos"), "from_id", "to_id", F.array_join(lemmas, "+").alias("lemma"), F.array_join(F.transform("w", lambda x: x["surface"]), " ").alias("surface"), F.exists("w", lambda x: x["ref"].endswith("?")).alias("uncertain"))


SYSTEMS = ["CIIC", "CISP", "TM", "SMR", "Trove"]
DECIMALS = r"(-?\d+\.\d+)[^\d-]+(-?\d+\.\d+)"


def stones(records: DataFrame) -> DataFrame:
    """Stone records, as ``stone_graph`` takes them.

    Of several ids of one system the last counts, be it empty. The place is the
    first named one, or what is said of the origin up to its first digit; the
    coordinates are the first two decimal numbers of the first ``geo`` anywhere.
    """
    ids = F.map_filter("last_ids", lambda k, v: k.isin(*SYSTEMS) & (v != ""))
    stone = text.stone_key(F.try_element_at("last_ids", F.lit("filename")), F.try_element_at("last_ids", F.lit("CIIC")))
    place = F.coalesce(F.nullif("first_place", F.lit("")), F.trim(F.regexp_extract(F.coalesce("place_text", F.lit("")), r"^([^0-9]*)", 1)))
    point = [F.nullif(F.regexp_extract("any_geo", DECIMALS, n), F.lit("")).cast("double") for n in (1, 2)]
    current = F.get(F.filter("readings", lambda r: r["current"]), F.lit(0))["text"]
    return records.select("record", stone.alias("stone"), "title", F.coalesce(F.nullif("title", F.lit("")), stone).alias("label"), ids.alias("ids"), "object_type", "material", F.coalesce(current, F.lit("")).alias("inscription"), place.alias("place"), point[0].alias("lat"), point[1].alias("lon"), F.col("name_texts").alias("names"))


def place_rows(records: DataFrame) -> DataFrame:
    """Places in one flat row each, a column for each level of names: the fields of the places' report."""
    p = places(records)

    def level(name: str) -> Column:
        return F.coalesce(F.get(F.filter("hierarchy", lambda h: h["level"] == name), F.lit(0))["label"], F.lit("")).alias(f"pn_{name}")

    forms = F.flatten(F.transform("hierarchy", lambda h: F.transform(h["vernacular"], lambda v: v["form"])))
    return p.select("record", F.col("edition_id").alias("ogham_id"), "stone_key", "title", F.col("number").alias("ciic"), F.col("page_id").alias("cisp"), F.col("page").alias("cisp_url"), "repository", *map(level, text.PLACE_LEVELS), F.array_join(forms, " | ").alias("pn_vernacular"), F.array_join(F.transform("other_names", lambda o: o["label"]), " | ").alias("other_names"), F.col("gazetteer").alias("gazetteer_uris"), "geo_raw", "geo_cert", F.col("hedge").alias("geo_hedge"), "geo_status", "lat", "lon", "grid_raw", F.col("place_text").alias("origplace_text"))
