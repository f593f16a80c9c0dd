from test_editions import XML

from stonegraph.operators.triples import CRM, DATA, DOMAIN, RDF, RDFS, SKOS
from stonegraph.plans import pipeline


def test_all_layers_of_a_corpus(spark, tmp_path):
    corpus = spark.createDataFrame([("a", XML), ("bad", "<x>"), ("template", "<TEI><title>t</title></TEI>")], "k string, c string")
    vocabulary = spark.createDataFrame([("MAQI", "formula", "MAQI"), ("CASSI", "element", "CAS")], "word string, mode string, variant string")
    found = pipeline.layers(corpus, key="k", content="c", spellings={"MAQI": ["MAQI"], "MUCOI": ["MUCOI"]}, vocabulary=vocabulary)
    s = pipeline.summary(found)
    assert (s["places"], s["readings"], s["comparisons"], s["dissent"], s["relations"], s["hedged"], s["missing"]) == (1, 4, 3, 1, 2, 1, 0)
    assert found["dissent"].first().at_stake and found["comparisons"].where("editor = 'Rhys 1899'").first().lost == ["MAQI", "MUCOI"]
    assert {(r.word, r.variant) for r in found["words"].collect()} == {("MAQI", "MAQI"), ("CASSI", "CAS")}
    assert found["components"].select("component").distinct().count() == 1
    pipeline.write(found, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "graph.nt")).count() == s["graph"] > 20


def test_the_graph_has_stones_keepers_words_and_gazetteers_and_is_validated(spark):
    xml = XML.replace('<placeName type="townland">', '<placeName type="townland"><ref target="https://gaz.example.org/7"/>').replace("<idno type=\"CIIC\"", "<objectType>Pillar</objectType><idno type=\"CIIC\"")
    corpus = spark.createDataFrame([("a", xml)], "k string, c string")
    vocabulary = spark.createDataFrame([("MAQI", "formula", "MAQI")], "word string, mode string, variant string")
    holders = spark.createDataFrame([("Town Museum", "City Museum", None, None, None, None, None), ("City Museum", None, "Q5", "51.5", "-9.0", "hand", "verified")], "repository string, alias_of string, qid string, lat string, lon string, source string, status string")
    ontology = spark.createDataFrame([(CRM + "P50_has_current_keeper", RDFS + "range", CRM + "E53_Place", "uri"), (CRM + "P45_consists_of", RDFS + "range", CRM + "E57_Material", "uri")], "s string, p string, o string, kind string")
    found = pipeline.layers(corpus, key="k", content="c", spellings={}, vocabulary=vocabulary, hosts=["gaz.example.org"], holders=holders, ontology=ontology)
    k = found["keepers"].first()
    assert (k.keeper, k.qid, k.why) == ("City Museum", "Q5", None) and 17 < k.distance_km < 18
    t = {(r.s.removeprefix(DATA), r.p, r.o.removeprefix(DATA)) for r in found["graph"].collect()}
    stone = "stone_I_BRA_001"
    assert {s for s, *_ in t if s.startswith("stone_")} == {stone}
    sid = stone.removeprefix("stone_")
    assert {(stone, CRM + "P45_consists_of", "material_Slate"), (stone, CRM + "P2_has_type", "type_Pillar"), (f"id_{sid}_CIIC", RDFS + "label", "60"), (stone, CRM + "P1_is_identified_by", f"id_{sid}_CIIC"), (stone, CRM + "P50_has_current_keeper", "keeper_City_Museum")} <= t
    assert {(f"person_{sid}_CASSI", RDFS + "label", "CASSI"), (stone, RDFS + "label", "Brae 1 (CIIC 60)"), (f"place_{sid}", RDFS + "label", "Co. Brae tail")} <= t
    assert any(s.startswith("place_") and p == SKOS + "closeMatch" and o == "https://gaz.example.org/7" for s, p, o in t)
    assert (f"word_occ_{sid}_NW_MAQI_formula", CRM + "P2_has_type", "word_MAQI_formula") in t and ("word_MAQI_formula", RDF + "type", DOMAIN + "FormulaWord") in t
    assert [(r.node, r.position) for r in found["violations"].collect()] == [(DATA + "keeper_City_Museum", "range")]
    assert DOMAIN + "carries" in {r.term for r in found["unknown_terms"].collect()} and CRM + "P45_consists_of" not in {r.term for r in found["unknown_terms"].collect()}
