"""Triples read from N-Triples (in parallel), Turtle and RDF/XML (small reference files, on the driver)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonegraph.operators.triples import RDF, XSD

TRIPLES = "s string, p string, o string, kind string, dtype string, lang string"
Triple = tuple[str, str, str, str, str, str]


def read_n_triples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of N-Triples files; blank and comment lines are skipped."""
    line = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([\w-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'
    part = lambda k: F.regexp_extract("value", line, k)
    text = F.col("value")
    value = part(6)
    for code, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        value = F.replace(value, F.lit(code), F.lit(char))
    rows = spark.read.text(path).where(text.rlike(line))
    named = F.coalesce(F.nullif(part(4), F.lit("")), F.nullif(part(5), F.lit("")))
    return rows.select(F.coalesce(F.nullif(part(1), F.lit("")), part(2)).alias("s"), part(3).alias("p"), F.coalesce(named, value).alias("o"), F.when(named.isNotNull(), "uri").otherwise("lit").alias("kind"), part(8).alias("dtype"), part(7).alias("lang"))


TOKENS = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^>\s]*>)|(?P<long>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\")|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z][\w-]*)|(?P<type>\^\^)
    |(?P<num>[+-]?(?:\d+\.\d+|\d+|\.\d+)(?:[eE][+-]?\d+)?(?![\w:]))|(?P<name>(?:[^\W\d][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]*[\w:%-])?)?|_:[\w-]+|true\b|false\b|a\b|PREFIX\b|BASE\b)|(?P<mark>[\[\]();,.])""",
    re.X | re.I,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _plain(s: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), s, flags=re.S)


def parse_turtle(text: str) -> list[Triple]:
    """The triples of a Turtle document: prefixes, lists of predicates and objects, blank nodes, collections, literals."""
    tokens = [(m.lastgroup, m[0]) for m in TOKENS.finditer(text) if m.lastgroup != "skip"]
    out: list[Triple] = []
    prefixes: dict[str, str] = {}
    base, at, blank = "", 0, 0

    def peek() -> str:
        return tokens[at][1] if at < len(tokens) else ""

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:t{blank}"

    def term() -> tuple[str, str, str, str]:
        kind, t = take()
        if kind == "iri":
            return (base + t[1:-1] if ":" not in t else t[1:-1]), "uri", "", ""
        if kind in ("str", "long"):
            value = _plain(t[3:-3] if kind == "long" else t[1:-1])
            if at < len(tokens) and tokens[at][0] == "lang":
                return value, "lit", "", take()[1][1:]
            if at < len(tokens) and tokens[at][0] == "type":
                take()
                return value, "lit", term()[0], ""
            return value, "lit", "", ""
        if kind == "num":
            return t, "lit", XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"), ""
        if t == "[":
            node = fresh()
            if peek() != "]":
                about(node)
            take()
            return node, "uri", "", ""
        if t == "(":
            items = []
            while peek() != ")":
                items.append(term())
            take()
            cells = [fresh() for _ in items]
            for n, item in enumerate(items):
                out.append((cells[n], RDF + "first", *item))
                out.append((cells[n], RDF + "rest", cells[n + 1] if n + 1 < len(cells) else RDF + "nil", "uri", "", ""))
            return (cells[0] if cells else RDF + "nil"), "uri", "", ""
        if t in ("true", "false"):
            return t, "lit", XSD + "boolean", ""
        if t == "a":
            return RDF + "type", "uri", "", ""
        if t.startswith("_:"):
            return t, "uri", "", ""
        prefix, _, local = t.partition(":")
        return prefixes.get(prefix, prefix + ":") + local, "uri", "", ""

    def about(s: str) -> None:
        while True:
            p = term()[0]
            while True:
                out.append((s, p, *term()))
                if peek() != ",":
                    break
                take()
            while peek() == ";":
                take()
            if peek() in (".", "]", ""):
                return

    while at < len(tokens):
        kind, t = tokens[at]
        if t.lower() in ("@prefix", "prefix"):
            take()
            name = take()[1][:-1]
            prefixes[name] = take()[1][1:-1]
            if peek() == ".":
                take()
        elif t.lower() in ("@base", "base"):
            take()
            base = take()[1][1:-1]
            if peek() == ".":
                take()
        else:
            s = term()[0]
            if peek() != ".":
                about(s)
            if peek() == ".":
                take()
    return list(dict.fromkeys(out))


def parse_rdf_xml(text: str) -> list[Triple]:
    """The triples of an RDF/XML document: described nodes, nested nodes, resources, literals and collections."""
    out: list[Triple] = []
    blank = 0
    root = ET.fromstring(text)
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")

    def full(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def resolve(ref: str) -> str:
        return ref if re.match(r"^[A-Za-z][\w+.-]*:", ref) else base + ref

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:x{blank}"

    def node(el) -> str:
        about, name, ident = (el.get(f"{{{RDF}}}{k}") for k in ("about", "nodeID", "ID"))
        s = resolve(about) if about is not None else f"_:{name}" if name else f"{base}#{ident}" if ident else fresh()
        if full(el.tag) != RDF + "Description":
            out.append((s, RDF + "type", full(el.tag), "uri", "", ""))
        for k, v in el.attrib.items():
            if not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}")) and k.startswith("{"):
                out.append((s, full(k), v, "lit", "", ""))
        for p in el:
            prop(s, p)
        return s

    def prop(s: str, p) -> None:
        pred, ref, name, how = full(p.tag), p.get(f"{{{RDF}}}resource"), p.get(f"{{{RDF}}}nodeID"), p.get(f"{{{RDF}}}parseType")
        if how == "Collection":
            cells = [fresh() for _ in p]
            out.append((s, pred, cells[0] if cells else RDF + "nil", "uri", "", ""))
            for n, el in enumerate(p):
                out.append((cells[n], RDF + "first", node(el), "uri", "", ""))
                out.append((cells[n], RDF + "rest", cells[n + 1] if n + 1 < len(cells) else RDF + "nil", "uri", "", ""))
        elif how == "Resource":
            b = fresh()
            out.append((s, pred, b, "uri", "", ""))
            for q in p:
                prop(b, q)
        elif ref is not None or name:
            out.append((s, pred, resolve(ref) if ref is not None else f"_:{name}", "uri", "", ""))
        elif len(p):
            for el in p:
                out.append((s, pred, node(el), "uri", "", ""))
        else:
            out.append((s, pred, p.text or "", "lit", p.get(f"{{{RDF}}}datatype") or "", p.get("{http://www.w3.org/XML/1998/namespace}lang") or ""))

    for el in root if full(root.tag) == RDF + "RDF" else [root]:
        node(el)
    return list(dict.fromkeys(out))


def read_reference(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """The union of small reference graphs: texts by file name (``.ttl``, else RDF/XML)."""
    rows = [t for name, text in texts.items() for t in (parse_turtle(text) if name.endswith(".ttl") else parse_rdf_xml(text))]
    return spark.createDataFrame(rows, TRIPLES).distinct()
