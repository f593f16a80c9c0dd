import pytest

from stonegraph.functions import text
from stonegraph.sources import editions

XML = """<TEI xmlns="http://tei.example.org/ns/1.0"><teiHeader><title> Brae  1 </title><idno type="filename"/><idno type="filename">I-BRA-001</idno><idno type="filename">I-BRA-999</idno><idno type="CIIC">60</idno>
<idno type="CISP" corresp="https://a.example.org/brae_1.html">BRAE/1</idno><msIdentifier><repository>Town Museum</repository></msIdentifier><material>Slate</material>
<history><origin><origPlace><placeName type="county">Co. Brae <distinct xml:lang="sga">Bré</distinct> tail</placeName><placeName type="townland">Garth but possibly Nook</placeName><placeName type="county">Other (<distinct>X</distinct>)</placeName>
<placeName type="country"/><placeName>odd</placeName><ref target="https://gaz.example.org/1"/><geo cert="low">51.5, -9.25</geo><note>ITM: 440544, 599247; x</note></origPlace></origin><provenance type="observed">In a  field.</provenance><provenance type="found">no</provenance></history></teiHeader>
<text><div type="edition" subtype="transliteration" resp="#NW"><ab>old</ab><ab>Ogham: CASSI MAQI MUCOI <persName><name nymRef="#cassi">CASSI</name> <w type="formula" lemma="#maqqas?">MAQI</w> <w type="formula" lemma="muccoviias">MUCOI</w> <name nymRef="#call-iti?">CALLITI</name><w type="formula" lemma="avias">AVI</w><name nymRef="?">..</name><w type="formula" lemma="koi">KOI</w></persName></ab></div>
<app><note>Macalister (1945, 4) read:</note><rdg>CAS</rdg><rdg source="#RHY1899"/><rdg source="#RHY1899">CA</rdg></app><app><note>only a note</note></app><rdg>loose</rdg></text></TEI>"""


@pytest.fixture(scope="module")
def records(spark):
    rows = [("a", XML), ("broken", "<a><b></a>"), ("none", None), ("mended", "<TEI><title>A & B</title></TEI>"), ("empty", "")]
    return editions.read_records(spark.createDataFrame(rows, "k string, c string"), key="k", content="c").cache()


def test_records_that_can_be_read(records, spark):
    assert {(r.record, r.recovered) for r in records.collect()} == {("a", False), ("mended", True), ("broken", True)}
    assert editions.record("<TEI><title>A & B</title></TEI>", strict=True) is None
    assert editions.read_records(spark.createDataFrame([], "k string, c string"), key="k", content="c").count() == 0


def test_places(records):
    p = {r.record: r for r in editions.places(records, hosts=["gaz.example.org"]).collect()}["a"]
    assert (p.stone_key, p.title, p.number, p.page, p.repository, p.observed) == ("I-BRA-001", "Brae 1", "60", "https://a.example.org/brae_1.html", "Town Museum", "In a field.")
    assert [(h.level, h.label, h.prose) for h in p.hierarchy] == [("townland", "Garth", "Garth but possibly Nook"), ("county", "Co. Brae tail", "")]
    assert p.hierarchy[1].vernacular[0].form == "Bré" and [o.label for o in p.other_names] == ["odd"]
    assert (p.lat, p.lon, p.geo_status, p.grid_raw, p.gazetteer) == (51.5, -9.25, "qualified", "440544, 599247", "https://gaz.example.org/1")
    assert {r.record: r.geo_status for r in editions.places(records).collect()}["mended"] == "no_origplace"


def test_readings(records):
    got = [(r.reading_id, r.editor, r.text, r.current) for r in editions.readings(records).where("record = 'a'").orderBy("reading_no").collect()]
    assert got[0][0] == "NW" and got[0][2].startswith("CASSI") and got[0][3]
    assert [g[:3] for g in got[1:]] == [("Macalister 1945", "Macalister 1945", "CAS"), ("RHY1899", "Rhys 1899", "CA"), ("unattributed", "unattributed reading", "loose")]


def test_persons(records):
    s = {r.slot_id: r for r in editions.slots(records).collect()}
    assert set(s) == {"name/cassi", "name/call_iti?", "a/anon0_5"} and s["name/call_iti?"].uncertain and s["a/anon0_5"].anonymous
    got = [(r.from_id, r.to_id, r.lemma, r.surface, r.uncertain) for r in editions.relations(records).orderBy("pos").collect()]
    assert got == [("name/cassi", "name/call_iti?", "maqqas+muccoviias", "MAQI MUCOI", True), ("name/call_iti?", "a/anon0_5", "avias", "AVI", False)]


def test_folder(spark, tmp_path):
    (tmp_path / "x" / ".git").mkdir(parents=True)
    (tmp_path / "x" / "a.xml").write_text("<a>é</a>", encoding="utf-8")
    (tmp_path / "x" / ".git" / "b.xml").write_text("<a/>")
    (tmp_path / "x" / "c.txt").write_text("no")
    r = editions.read_folder(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].content == "<a>é</a>"
    assert r[0].sha == spark.createDataFrame([("<a>é</a>",)], "c string").select(text.blob_id(__import__("pyspark").sql.functions.col("c"))).first()[0]
