import datetime

from pyspark.sql import functions as F

from stonegraph import sinks
from stonegraph.functions import text
from stonegraph.operators import resolve, snapshot, spatial, triples
from stonegraph.sources import editions, graphs, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rounding_is_pythons(spark):
    values = [2.675, 0.15, 0.25, 1.005, -2.675, 12.5, 0.1 + 0.2, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(text.round_even(F.col("v"), 2)).collect()]
    assert got == [None if v is None else round(v, 2) for v in values]


def test_beginnings_that_fit_one_commit_only():
    got = dict(snapshot.sole_beginnings(["abc1", "abd2", "x9"]))
    assert got == {"abc": 0, "abc1": 0, "abd": 1, "abd2": 1, "x": 2, "x9": 2}
    assert snapshot.sole_beginnings([]) == []


def test_short_commits_count_where_they_fit_one_snapshot(spark):
    t = datetime.datetime(2024, 1, 1)
    heads = spark.createDataFrame([("aa11", "2024-01-01T00:00:00+00:00"), ("ab22", "2024-02-01T00:00:00+00:00")], "commit string, commit_date string")
    files = spark.createDataFrame([("aa", "XML/x/1.xml", "f" * 40, t), ("AB2", "XML/x/2.xml", "e" * 40, t), ("a", "XML/x/3.xml", "d" * 40, t)], "commit string, path string, sha string, fetched timestamp")
    assert rows(snapshot.manifest_changes(files, heads)) == [("ab22", "XML/x/1.xml", "removed"), ("ab22", "XML/x/2.xml", "added")]


def test_leaves_that_reach_the_driver_are_bounded(spark):
    n, leaf = 60_000, 55
    pts = spark.range(n).select(F.col("id").cast("string").alias("id"), (50 + F.rand(1) * 4).alias("lat"), (-9 + F.rand(2) * 4).alias("lon"))
    cells = spatial.leaf_cells(pts, leaf)
    assert sum(c[0] for c in cells.values()) == n and max(c[0] for c in cells.values()) <= leaf and len(cells) <= 4 * 16 * n / leaf / 10
    crowd = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(51.5).alias("lat"), F.lit(-9.5).alias("lon"))
    assert [c[0] for c in spatial.leaf_cells(crowd, leaf).values()] == [1000]
    assert spatial.leaf_cells(crowd.limit(0), leaf) == {}


def test_near_classes_of_crowds_nulls_and_nothing(spark):
    pts = spark.createDataFrame([("b", 51.5, -9.5), ("a", 51.5, -9.5), ("c", 51.5005, -9.5), ("far", 40.0, 2.0), (None, 51.5, -9.5), ("x", None, 1.0), ("a", 51.5, -9.5)], "id string, lat double, lon double")
    assert rows(spatial.near_classes(pts, 0.1)) == [("member", "a", "a"), ("member", "b", "a"), ("member", "c", "c"), ("member", "far", "far"), ("near", "a", "c")]
    assert spatial.near_classes(pts.limit(0), 0.1).count() == 0


def test_turtle_says_what_the_triples_say(spark):
    data = [("http://d/a", triples.RDF + "type", "http://c/T", "uri", "", ""), ("http://d/a", "http://c/p", 'x "y"\n\\z', "lit", "", "en"), ("http://d/a", "http://c/p", "2", "lit", triples.XSD + "integer", ""), ("http://d/b/c", "http://c/q", "http://d/a", "uri", "", "")]
    g = spark.createDataFrame(data, "s string, p string, o string, kind string, dtype string, lang string")
    prefixes = {"c": "http://c/", "d": "http://d/", "xsd": triples.XSD}
    doc = triples.turtle_head(prefixes) + "\n".join(r.block for r in triples.turtle(g, prefixes).collect())
    assert set(graphs.parse_turtle(doc)) == set(data) and "a c:T" in doc


def test_a_later_declaration_wins(spark):
    g = spark.createDataFrame([("p", triples.RDFS + "domain", "A", "uri", 1), ("p", triples.RDFS + "domain", "B", "uri", 2), ("p", "x", "y", "uri", 3)], "s string, p string, o string, kind string, at int")
    assert rows(triples.later_wins(g, order="at").select("p", "o")) == [(triples.RDFS + "domain", "B"), ("x", "y")]


def test_last_rows_blank_confidence_and_lists(spark, tmp_path):
    (tmp_path / "c.csv").write_text("kind,label,qid,confidence\na,x,Q2,0.5\na,x,Q1,\n,y,Q3,1\n", encoding="utf-8")
    c = tables.links_cache(tables.numbered_csv(spark, str(tmp_path / "c.csv")), key=["kind", "label"], order="line")
    assert rows(c) == [("a", "x", "Q1", 0.0)]
    assert tables.parse_maps("a:\n  - x\n  - 'y z'\nb:\n  k: v\n") == {"a": ["x", "y z"], "b": {"k": "v"}}
    s = spark.createDataFrame([("a", "not-recoverable", "n"), ("b", "open", "m"), (None, "not-recoverable", "k")], "id string, status string, note string")
    assert rows(tables.settled(s, key="id")) == [("a", "n")]
    assert tables.choose_source([("given", None), ("found", "/x"), ("samples", "/y")], lambda p: p == "/y") == ("/y", "samples")
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git" / "refs" / "heads" / "main").write_text("abc\n")
    assert tables.git_head(str(tmp_path)) == {"branch": "main", "commit": "abc"} and tables.git_head("/nowhere") == {}


def test_reports_have_their_fields_and_changes_their_first_names(spark):
    df = spark.createDataFrame([("s", "A", "x")], "stone string, from_name string, other string")
    assert sinks.report(df, "persons").columns == sinks.FIELDS["persons"] and len(sinks.FIELDS["places"]) == 40
    c = spark.createDataFrame([("c", f"p{k:02}", "added") for k in range(15)] + [("c", "q", "removed")], "commit string, path string, change string")
    assert rows(sinks.change_lines(c, by="commit", key="path", change="change")) == [("c", "added", 15, ", ".join(f"p{k:02}" for k in range(12)), 3), ("c", "removed", 1, "q", 0)]
    assert sinks.suggestions_text(spark.createDataFrame([("K", "Q1", "wikidata")], "repository string, qid string, source string"), key="repository").endswith('"K":\n    qid: Q1\n    source: wikidata\n')
    assert sinks.markdown_report("T", [("h", df.select("stone"))]) == "# T\n\n## h\n\n| stone |\n| --- |\n| s |\n"


def test_stones_take_the_last_id_and_the_first_decimals(spark):
    xml = "<TEI><idno type='CIIC'>1</idno><idno type='CIIC'>2</idno><idno type='filename'> I-AAA-001 </idno><geo>about 5 or 52.25, -7.5 east</geo><origPlace>By the road 3 miles off</origPlace><name nymRef='x'>Ab</name><name nymRef='y'>AB</name></TEI>"
    s = editions.stones(editions.read_records(spark.createDataFrame([("r", xml), ("n", None)], "k string, x string"), key="k", content="x")).collect()
    assert len(s) == 1 and s[0].ids == {"CIIC": "2"} and s[0].stone == "I-AAA-001" and (s[0].lat, s[0].lon) == (52.25, -7.5) and s[0].place == "By the road" and s[0].names == ["Ab"]


def test_overrides_holders_and_complaints_with_nulls(spark):
    v = spark.createDataFrame([("a", "k1", "said"), ("b", None, "")], "id string, key string, evidence string")
    o = spark.createDataFrame([("a", "k9", None), ("a", "k8", "n"), (None, "k", "n")], "id string, key string, note string")
    assert rows(resolve.override_verdicts(v, o, key="id", columns=["key"], note="note").select("id", "key", "evidence", "method")) == [("a", "k9", "said", "set by hand"), ("b", None, "", "rule")]
    h = spark.createDataFrame([("al", "x", None, None, None, None, None), ("hand", None, "Q1", None, "manual", 1.0, 2.0), ("pin", None, "Q2", None, None, None, None), ("lost", None, "Q9", None, None, None, None), ("osm", None, None, "N1", None, None, None), ("find", None, None, None, None, None, None), ("none", "", "", "", None, None, None)], "name string, alias_of string, qid string, osm_id string, source string, lat double, lon double")
    ids = spark.createDataFrame([("Q2", 3.0, 4.0), ("N1", 5.0, 6.0), ("Q9", None, None)], "id string, lat double, lon double")
    f = spark.createDataFrame([("find", "Q5", 1, False, 7.0, 8.0), ("find", "Q6", 2, True, 9.0, 1.0), ("find", "Q7", 0, True, None, None), ("lost", "Q8", 0, True, 1.0, 1.0)], "name string, qid string, rank int, in_country boolean, lat double, lon double")
    got = {r.name: (r.decided_by, r.qid, r.lat) for r in resolve.locate_holders(h, ids, f).collect()}
    assert got == {"al": ("alias", None, None), "hand": ("manual", "Q1", 1.0), "pin": ("qid", "Q2", 3.0), "lost": ("pinned, not found", "Q9", None), "osm": ("osm", None, 5.0), "find": ("search", "Q6", 9.0), "none": ("nothing", "", None)}
    e = spark.createDataFrame([("a", "x1", "Z3", "91", "abc", "a"), ("b", None, None, None, None, None), (None, None, None, "1", None, None)], "key string, qid string, osm_id string, lat string, lon string, alias_of string")
    found = rows(resolve.identifier_complaints(e, spark.createDataFrame([("a",)], "key string"), ignored=["qid"]))
    assert found == sorted([("a", "alias of itself"), ("a", "bad osm id"), ("a", "bad qid"), ("a", "ignored beside an alias"), ("a", "not a number"), ("a", "not on earth"), ("b", "unknown key"), (None, "lat and lon must be given together"), (None, "no key")], key=repr)


def test_damaged_editions_are_mended_and_the_rest_is_told(spark):
    cases = {"open": "<a><b>x<c>y</b></a>", "stray": "<a>x</c><b/></a>", "cut": "<a><b>x</b><c at='1'>y", "token": "<a><b>x</b><c at='1", "loose": "<a>1 < 2<b/></a>", "entity": "<a>&nbsp;<b/></a>", "junk": "<a><b/></a><a/>", "amp": "<a>x & y<b/></a>"}
    for name, xml in cases.items():
        root, recovered = editions.parse(xml)
        assert recovered and root.tag == "a" and root.find("b") is not None, name
        assert editions.parse(xml, strict=True) is None
    assert editions.parse("no xml") is None and editions.parse("<a/>")[1] is False
    df = spark.createDataFrame([("x", "no xml"), ("y", "<a/>"), ("z", None), ("w", "")], "k string, c string")
    assert rows(editions.unread(df, key="k", content="c")) == [("x",)]
