import random

from pyspark.sql import functions as F

from stonegraph.operators import graph, resolve, rules, triples, views
from stonegraph.streaming.snapshots import catch_up


def test_settings_take_the_first_rule(spark):
    rows = [("Museum", "it was lost in 1900"), ("Museum", "x"), ("", "built into a barn"), ("", "in the museum"), (None, None), ("", "in a field")]
    got = [tuple(r.v) for r in spark.createDataFrame(rows, "r string, o string").select(rules.classify_setting(F.col("r"), F.col("o")).alias("v")).collect()]
    assert [g[0] for g in got] == ["lost", "institution", "structure", "institution_unrecorded", "undescribed", "in_situ"]
    assert got[0][2] == "was lost" and got[2][2] == "built into"


def test_tags_and_relations(spark):
    tags = {"rdg": "mapped", "w": "candidate", "gap": "doubt", "TEI": "structural", "zzz": "review"}
    assert [r[0] for r in spark.createDataFrame([(t,) for t in tags], "t string").select(rules.classify_tag(F.col("t"))).collect()] == list(tags.values())
    r = spark.createDataFrame([("maqqas+muccoviias",), ("odd",)], "l string").select(rules.relation_parts(F.col("l")).alias("r")).collect()
    assert tuple(r[0].r) == ("son of and of the kin of", ["kin", "parent"], True) and tuple(r[1].r) == ("odd", ["other"], False)


def test_closure_with_a_diamond_a_circle_and_a_loop(spark):
    e = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s"), (None, "q")] + [(f"n{k}", f"n{k + 1}") for k in range(40)]
    got = {tuple(r) for r in graph.closure(spark.createDataFrame(e, "c string, p string"), child="c", parent="p").collect()}
    up = {}
    for c, p in e:
        if c:
            up.setdefault(c, set()).add(p)
    for start in {x for c, p in e if c for x in (c, p)}:
        seen, todo = {start}, [start]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        assert {p for n, p in got if n == start} == seen


def test_components_whatever_the_order(spark):
    rnd = random.Random(0)
    e = [(f"c{k}", f"c{k + 1}") for k in range(30)] + [("h", f"h{k}") for k in range(40)] + [("me", "me"), (None, "x")]
    want = {**{f"c{k}": "c0" for k in range(31)}, **{f"h{k}": "h" for k in range(40)}, "h": "h", "me": "me"}
    rnd.shuffle(e)
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(e, "a string, b string"), a="a", b="b").collect()} == want


def test_aliases_end(spark):
    a = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "gone"), ("e", "")]
    got = {r.name: r.canonical for r in graph.chase(spark.createDataFrame(a, "n string, t string"), name="n", target="t").collect()}
    assert {k: got[k] for k in "abcze"} == {"a": "c", "b": "c", "c": "c", "z": "gone", "e": "e"} and got["x"] == got["y"] == "x"


def test_overrides_upserts_and_lints(spark):
    rec = spark.createDataFrame([("a", None, None), ("b", 1.0, 2.0), ("c", None, None)], "id string, lat double, lon double")
    over = spark.createDataFrame([("a", 5.0, 6.0), ("b", 7.0, 8.0), ("c", 5.0, None)], "id string, lat double, lon double")
    assert {tuple(r) for r in resolve.fill_missing(rec, over, key="id", columns=["lat", "lon"]).select("id", "lat", "lon", "supplied").collect()} == {("a", 5.0, 6.0, True), ("b", 1.0, 2.0, False), ("c", None, None, False)}
    assert [r.id for r in resolve.refused(rec, over, key="id", column="lat").collect()] == ["b"]
    assert {tuple(r) for r in resolve.upsert(rec, over, key="id", columns=["lat"]).collect()} == {("a", 5.0, True), ("b", 7.0, True), ("c", 5.0, True)}
    assert {tuple(r) for r in resolve.lint(over, key="id", complaints={"one": F.col("lon").isNull(), "two": F.col("lat") > 6}).collect()} == {("c", "one"), ("b", "two")}


def test_candidates(spark):
    c = [("k", "Slate", 1, None, "slate"), ("k", "Slate", 2, None, "x"), ("m", "Basalt", 1, False, "basalt"), ("m", "Basalt", 2, True, "basalt rock"), ("n", "Oak", 1, False, "oak")] + [("p", "Gneiss", n, n == 6, f"g{n}") for n in range(1, 7)]
    got = {r.key: (r.hit, r.confidence, r.type_match) for r in resolve.rank_candidates(spark.createDataFrame(c, "key string, label string, rank int, fits boolean, hit string"), key=["key"], label="label", hit="hit", rank="rank", fits="fits").collect()}
    assert got == {"k": ("slate", 0.9, "unknown"), "m": ("basalt rock", 0.75, "ok"), "n": ("oak", 0.45, "mismatch"), "p": ("g1", 0.25, "mismatch")}


def test_compared_readings_keep_order_and_repeats(spark):
    d = spark.createDataFrame([("A MAQI A B", "B AVI MAQQI")], "x string, y string")
    r = resolve.compare_readings(d, current="x", other="y", formula={"MAQI": ["MAQI"], "MAQQI": ["MAQI"], "AVI": ["AVI"]}).first()
    assert (r.only_current, r.only_other, r.gained, r.lost) == (["A", "MAQI", "A"], ["AVI", "MAQQI"], ["AVI"], [])


def test_graph_lists_and_constraints(spark):
    n = triples
    rows = [("p", n.RDFS + "range", "_:u"), ("_:u", n.OWL + "unionOf", "_:a"), ("_:a", n.RDF + "first", "A"), ("_:a", n.RDF + "rest", "_:b"), ("_:b", n.RDF + "first", "B"), ("_:b", n.RDF + "rest", n.RDF + "nil"), ("q", n.RDFS + "range", "C"), ("r", n.RDFS + "range", "_:other")]
    g = spark.createDataFrame([(*r, "uri") for r in rows], "s string, p string, o string, kind string")
    allowed = n.constraints(g, n.RDFS + "range")
    assert {tuple(r) for r in allowed.collect()} == {("p", "A"), ("p", "B"), ("q", "C")}
    data = spark.createDataFrame([("x", "p", "y", "uri"), ("x", "p", "z", "uri"), ("x", "p", "untyped", "uri"), ("x", "p", "text", "lit"), ("y", n.RDF + "type", "B1", "uri"), ("z", n.RDF + "type", "Z", "uri")], "s string, p string, o string, kind string")
    supers = spark.createDataFrame([("B1", "B1"), ("B1", "B")], "node string, ancestor string")
    assert {tuple(r) for r in n.violations(data, allowed, supers, end="o", position="range").collect()} == {("p", "z", "range")}


def test_lines_patches_and_namespaces(spark):
    s, o = F.lit("http://a.example.org/s"), F.col("t")
    g = triples.emit(spark.createDataFrame([('q"\n\\',), ('q"\n\\',)], "t string"), triples.literal(s, "http://p", o, lang="en"), (F.lit(False), triples.a(s, "no")), triples.uri(s, "http://old/x", F.lit("http://old/y")))
    assert g.count() == 2
    assert {r.line for r in triples.n_triples(g).collect()} == {'<http://a.example.org/s> <http://p> "q\\"\\n\\\\"@en .', "<http://a.example.org/s> <http://old/x> <http://old/y> ."}
    moved = triples.renamespace(g, "http://old/", "http://new/", {"y": "z"})
    assert {(r.p, r.o) for r in moved.where("kind = 'uri'").collect()} == {("http://new/x", "http://new/z")}
    assert triples.patch(g, remove=g.where("kind = 'uri'").select("s", "p", "o"), add=moved).count() == 2


def test_views(spark):
    df = spark.createDataFrame([("a", "x", 50.0, -8.0), ("b", "x", None, -8.0), ("c", None, 50.0, -8.0)], "id string, f string, lat double, lon double")
    assert {tuple(r) for r in views.facet_counts(df, ["f"]).collect()} == {("f", "x", 2), ("f", "", 1)}
    assert [r.id for r in views.faceted(df, among={"f": ["x"]}, term="A", search=["id"]).collect()] == ["a"]
    assert [tuple(r) for r in views.hexbin(df, lat="lat", lon="lon", size=0.5).select("n", "step").collect()] == [(2, 4)]
    assert views.points_geojson(df, lat="lat", lon="lon", properties=["id", "f"]).count() == 2
    assert views.hexbin(df.limit(0), lat="lat", lon="lon", size=0.5).count() == 0


def test_stream_reads_only_what_is_new(spark, tmp_path):
    src, sink, mark = (str(tmp_path / x) for x in ("src", "sink", "mark"))
    spark.range(5).coalesce(1).write.parquet(src)
    assert catch_up(spark, src, sink=sink, checkpoint=mark).count() == 5
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(src)
    assert sorted(r.id for r in catch_up(spark, src, sink=sink, checkpoint=mark).collect()) == list(range(8))
