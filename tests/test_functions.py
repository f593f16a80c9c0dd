import difflib

import pytest
from pyspark.sql import functions as F

from stonegraph.functions import geo, text


def values(spark, rows, f, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(f(F.col("x")).alias("y")).collect()]


def test_slug_and_labels(spark):
    assert values(spark, ["Co. Cork", "  é-x ", "", None, "a__b"], text.slug) == ["Co_Cork", "x", "x", "x", "a_b"]
    labels = {"Kilmovee (An": "Kilmovee", "Garth) rest": "Garth", "Ballyna ( ‘ ) , ": "Ballyna", "see https://a.example.org/x)": "see", "A ( b )": "A (b)", None: "", "": ""}
    assert values(spark, labels, text.clean_label) == list(labels.values())
    cut = values(spark, ["Garth but possibly Brae", "Co. Kerry. Formerly Cork", "St. Mary's", "; x"], text.split_prose)
    assert [tuple(c) for c in cut] == [("Garth", "Garth but possibly Brae"), ("Co. Kerry", "Co. Kerry. Formerly Cork"), ("St. Mary's", ""), ("; x", "")]


def test_readings(spark):
    cases = {"C[A]TTINI": "CATTINI", "CCICAMINIvac. MAQQ[/I] C[A]TTINI": "CCICAMINI MAQQI CATTINI", "ỊṆ (MAC1945: x) A": "IN A", "A; Roman: FOO": "A", "..AB (see 1": "AB", "a-b": "A B", None: "", "": "", "Á": "A"}
    assert values(spark, cases, text.normalise_reading) == list(cases.values())
    once = values(spark, cases, text.normalise_reading)
    assert values(spark, once, text.normalise_reading) == once
    assert [tuple(x) for x in values(spark, ["Ogham: LA[TI]NI", "Roman : X", "PLAIN"], text.split_script)] == [("ogham", "LA[TI]NI"), ("roman", "X"), ("ogham", "PLAIN")]


def test_editors(spark):
    assert values(spark, ["MAC1945", "zzz1900", "", "1900"], text.editor_label) == ["Macalister 1945", "Zzz 1900", "", ""]
    assert values(spark, ["Macalister (1945, 469) read:", "read by John Rhys’s (1902)", "none"], text.attribution) == ["Macalister 1945", "Rhys 1902", ""]
    assert values(spark, ["RHY1899", "ZZZ1899", ""], text.surname) == ["Rhys", None, None]


def test_keys(spark):
    assert values(spark, ["#a-b", "?", "", "...", "x?"], text.normalise_nym) == ["a_b", "?", "", "...", "x?"]
    assert values(spark, ["?", "", "...", "??", "x?"], text.is_anonymous) == [True, True, True, True, False]
    assert values(spark, ["A Museum, Town (x)", "Abc", "Robinson library (No 5)"], text.name_variants) == [["A Museum, Town (x)", "A Museum, Town", "A Museum"], [], ["Robinson library (No 5)", "Robinson library"]]
    rows = spark.createDataFrame([("I-COR-001", "60"), ("bad", "60"), ("bad", ""), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(text.stone_key(F.col("a"), F.col("b"))).collect()] == ["I-COR-001", "60", "bad", "x"]
    assert values(spark, ["hello\n"], text.blob_id) == ["ce013625030ba8dba906f756967f9e9ca394464a"]
    p = {"crm": "http://c.example.org/", "x": "http://x.example.org/"}
    assert values(spark, ["http://x.example.org/Y", "urn:z"], lambda c: text.curie(c, p)) == ["x:Y", "urn:z"]
    assert values(spark, ["x:Y", "q:z"], lambda c: text.expand_curie(c, p)) == ["http://x.example.org/Y", "q:z"]


def test_similarity(spark):
    pairs = [("TETA", "ANM SAINA MAQ OGALA MUCOI TEMOCA"), ("", ""), ("A", ""), ("X" * 300, "X" * 200 + "Y" * 100)]
    df = spark.createDataFrame(pairs, "a string, b string").select(text.similarity_ratio("a", "b").alias("r"))
    assert [r.r for r in df.collect()] == [difflib.SequenceMatcher(None, a, b).ratio() if a or b else 1.0 for a, b in pairs]
    assert values(spark, [1.0, 0.8, 0.7999, 0.5, 0.1], text.band, "x double") == ["identical", "close", "diverging", "diverging", "far apart"]


def test_coordinates(spark):
    got = [tuple(x) for x in values(spark, ["51.7, -9.3", "51.7;-9.3 (approximate)", "95, 3", "near the road", "", None], geo.parse_coordinate)]
    assert got == [(51.7, -9.3, ""), (51.7, -9.3, "approximate"), (None, None, "95, 3"), (None, None, "near the road"), (None, None, ""), (None, None, "")]
    assert values(spark, ["V 820 915", "A", "I 12", "V 12345", "v 1234"], geo.grid_reference)[1:4:1][1:] == [None, None]


def test_grids_meet_their_control_points(spark):
    r = spark.createDataFrame([("V 820 915",), ("I 1",), (None,)], "r string").select(geo.irish_grid_to_wgs84(F.col("r")).alias("g"), geo.itm_to_wgs84(F.lit(440544.0), F.lit(599247.0)).alias("i")).collect()
    assert r[0].g.lat == pytest.approx(52.063851, abs=2e-6) and r[0].g.lon == pytest.approx(-9.720612, abs=2e-6)
    assert r[0].i.lat == pytest.approx(52.122077, abs=2e-5) and r[0].i.lon == pytest.approx(-10.328706, abs=2e-5)


def test_hexes_hold_their_points(spark):
    size = 0.25
    pts = spark.createDataFrame([(50 + k * 0.013, -9 + k * 0.029) for k in range(300)], "lat double, lon double").withColumn("ky", F.lit(1.6))
    c = pts.select("lat", "lon", geo.hex_cell(F.col("lon"), F.col("lat"), F.col("ky"), size).alias("c"), "ky").select("*", geo.hex_polygon(F.col("c.q"), F.col("c.r"), F.col("ky"), size).alias("p"))
    for r in c.collect():
        clat, clon = (sum(x[k] for x in r.p) / 6 for k in ("lat", "lon"))
        assert ((r.lat - clat) * 1.6) ** 2 + (r.lon - clon) ** 2 <= size**2 + 1e-9
