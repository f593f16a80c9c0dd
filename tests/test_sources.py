from stonegraph import sinks
from stonegraph.operators import triples
from stonegraph.sources import graphs, tables

TTL = """@prefix : <http://a.example.org/> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
:s a :C ; :p "x\\"y"@en, 'z' , \"\"\"long "q" text\"\"\" ; # note
   :q 1, 2.5, true ; :r [ :in :deep ; :n "1"^^<http://t> ] .
:u owl:unionOf ( :A :B ) . <http://b.example.org/x.y> :p :a.b ."""
XML = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://www.w3.org/2002/07/owl#" xmlns:a="http://a.example.org/" xml:base="http://a.example.org/">
<a:C rdf:about="s"><a:p xml:lang="en">x</a:p><a:q rdf:resource="#t"/><a:r><rdf:Description><a:in rdf:datatype="http://t">1</a:in></rdf:Description></a:r><o:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="A"/><rdf:Description rdf:about="B"/></o:unionOf></a:C></rdf:RDF>"""


def test_turtle():
    t = graphs.parse_turtle(TTL)
    a = "http://a.example.org/"
    assert (a + "s", graphs.RDF + "type", a + "C", "uri", "", "") in t and (a + "s", a + "p", 'x"y', "lit", "", "en") in t and (a + "s", a + "p", 'long "q" text', "lit", "", "") in t
    assert {x[2:5] for x in t if x[1] == a + "q"} == {("1", "lit", graphs.XSD + "integer"), ("2.5", "lit", graphs.XSD + "decimal"), ("true", "lit", graphs.XSD + "boolean")}
    assert [x[2] for x in t if x[1] == graphs.RDF + "first"] == [a + "A", a + "B"] and ("http://b.example.org/x.y", a + "p", a + "a.b", "uri", "", "") in t and len(t) == 16


def test_rdf_xml():
    t = graphs.parse_rdf_xml(XML)
    a = "http://a.example.org/"
    assert (a + "s", a + "p", "x", "lit", "", "en") in t and (a + "s", a + "q", a + "#t", "uri", "", "") in t and [x[2] for x in t if x[1] == graphs.RDF + "first"] == [a + "A", a + "B"] and len(t) == 10


def test_n_triples_round_trip(spark, tmp_path):
    g = graphs.read_reference(spark, {"a.ttl": TTL, "b.rdf": XML})
    sinks.write_n_triples(g, str(tmp_path / "g"))
    back = graphs.read_n_triples(spark, str(tmp_path / "g"))
    plain = [r for r in g.collect() if not r.s.startswith("_:") and not r.o.startswith("_:")]
    assert set(map(tuple, plain)) <= {tuple(r) for r in back.collect()}
    assert triples.union_members(g).count() == 4


def test_vocabulary_and_lists(spark, tmp_path):
    (tmp_path / "w.csv").write_text('﻿word,type,translation,ref,variants\nmaqi,F,"""son""",r,[MAQI|maqqi | M]\nerc,,,,\n,F,,,\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(tmp_path / "w.csv"))
    got = [tuple(r) for r in tables.vocabulary(rows, {"F": "formula"}).orderBy("word").collect()]
    assert got == [("ERC", "compound", ["ERC"], "", ""), ("MAQI", "formula", ["MAQQI", "MAQI", "M"], "son", "r")]
    c = spark.createDataFrame([("a", "1", None), ("a", "2", "x"), (None, "3", "y")], "k string, v string, w string")
    assert [tuple(r) for r in tables.cache(c, key=["k"]).collect()] == [("a", "2", "x")]
    assert tables.allow_list(spark.createDataFrame([("t", "Q1", "l"), ("u", "", "l")], "term string, qid string, wd_label string"), "material").count() == 1
    assert tables.overrides(c, key="k", needs=["v", "w"]).count() == 1


def test_manifest_round_trip(spark):
    files = spark.createDataFrame([("XML/a/b.xml", "12"), ("XML/a c.xml", "34")], "path string, sha string")
    doc = sinks.manifest_text({"commit": "abc", "note": "a: b # c"}, files)
    assert {tuple(r) for r in tables.manifest(spark, doc).collect()} == {("abc", "XML/a/b.xml", "12"), ("abc", "XML/a c.xml", "34")}
    assert tables.parse_maps("# x\na:\n  'Q: r': 'v'\n  k: v # c\nb: 1\n") == {"a": {"Q: r": "v", "k": "v"}, "b": "1"}
    assert tables.manifest(spark, "nothing").count() == 0


def test_csv_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"], True, None), ("a", [], False, 1.5)], "k string, l array<string>, f boolean, n double")
    sinks.write_csv(df, str(tmp_path / "c"), ["k", "l", "f", "n"], order=["k"], one_file=True)
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text == "k,l,f,n\na,,no,1.5\nb,x y,yes,\n"
    assert sinks.markdown_table(df.select("k")) == "| k |\n| --- |\n| b |\n| a |\n"
    sinks.write_geojson(spark.createDataFrame([("a", 1.0, 2.0)], "k string, lat double, lon double"), str(tmp_path / "g"), lat="lat", lon="lon", properties=["k"])
    assert '"coordinates":[2.0,1.0]' in "".join(p.read_text() for p in (tmp_path / "g").glob("*.txt"))
