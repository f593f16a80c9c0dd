import xml.etree.ElementTree as ET
from collections import Counter
from datetime import datetime

import pandas as pd
from conftest import DATA

from stonegraph.operators.nested import ELEMENTS, ENCLOSING, flatten_records, nested_elements, read_tables, visit, write_tables

XML = '<?xml version="1.0"?><t:TEI xmlns:t="u"><t:provenance><t:persName t:lang="en" type="a">A <t:placeName>B &amp; C</t:placeName> d</t:persName></t:provenance><t:placeName/><![CDATA[<rdg>]]><!-- <rdg/> --><t:app><t:rdg>x<t:app><t:rdg source="#S">y</t:rdg></t:app></t:rdg></t:app></t:TEI>'


def test_visit():
    rows = visit(XML)
    assert [r[:4] for r in rows] == [["persName", 1, "provenance", 1], ["placeName", 1, "persName", 1], ["placeName", 2, "", 0], ["rdg", 1, "app", 1], ["rdg", 2, "app", 2]]
    assert rows[0][6] == "A B & C d" and dict(rows[0][5]) == {"lang": "en", "type": "a"} and rows[3][6] == "xy" and rows[2][6] == ""
    assert visit(None) is None and visit("") is None and visit("<a><b></a>") is None and visit("<p:a/>") is None and visit("\x00") is None


def brute(content):
    out = []

    def walk(el, counts, parent):
        name = el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""
        if name in ELEMENTS + ENCLOSING:
            counts[name] += 1
            if name in ELEMENTS:
                out.append((name, counts[name], *parent))
            parent = (name, counts[name])
        for kid in el:
            walk(kid, counts, parent)

    try:
        walk(ET.fromstring(content), Counter(), ("", 0))
    except (ET.ParseError, TypeError):
        return []
    return out


def test_the_latest_record_counts(spark):
    t = [datetime(2024, 1, n) for n in (1, 2, 3)]
    deep = "<rdg>" * 3000 + "</rdg>" * 3000
    rows = [("a", "<x><rdg/></x>", t[0]), ("a", "<x><rdg/><rdg/></x>", t[1]), ("a", "<x><rdg/><rdg/></x>", t[1]), ("b", "<rdg/>", t[0]), ("b", None, t[1]), ("c", "<rdg>", t[2]), ("c", "<rdg/>", t[1]), (None, "<rdg/>", t[0]), ("d", "", t[0]), ("e", deep, None), ("f", "<x>" + "y" * 300_000 + "<persName/></x>", t[0]), ("g", "<rdg/>", t[0]), ("g", "<rdg><rdg/></rdg>", t[0])]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "ogham_id string, content string, fetched timestamp, h string, record int")
    got = [tuple(r) for r in nested_elements(df).collect()]
    assert len(got) == len(set(got))
    n = Counter(r[0] for r in got)
    assert n["a"] == 2 and n["e"] == 3000 and n["f"] == 1 and n["g"] in (1, 2) and set(n) == {"a", "e", "f", "g"}
    assert {tuple(r) for r in nested_elements(df.orderBy(df.content.desc())).collect()} == set(got)
    assert nested_elements(df.limit(0)).count() == 0


def test_against_brute_force(spark):
    path = DATA / "editions.parquet"
    if path.exists():
        e = pd.read_parquet(path).sort_values("fetched", kind="stable").drop_duplicates("ogham_id", keep="last")
        want = {(r.ogham_id, *x) for r in e.itertuples() for x in brute(r.content)}
        assert {tuple(r) for r in nested_elements(spark.read.parquet(str(path))).collect()} == want


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", XML), ("bad", "<x"), ("none", None)], "k string, c string")
    tagged = flatten_records(df, key="k", content="c")
    write_tables(tagged, str(tmp_path / "t"))
    tables = read_tables(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in tables["rdg"].orderBy("element_no").collect()] == [("s", 1, "app", 1, "xy", None, None), ("s", 2, "app", 2, "y", "#S", None)]
    assert tables["persName"].first().lang == "en" and tables["origPlace"].count() == 0
    whole = tables["placeName"].count() + tables["persName"].count() + tables["rdg"].count()
    assert whole == tagged.count() == 5
