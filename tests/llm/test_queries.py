import pytest
from conftest import DATA
from oracle import connect, same

from stonegraph.llm.consensus import reading_votes
from stonegraph.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    if name in ORACLES:
        same(df, connect(DATA), ORACLES[name])
    else:
        assert df.count() > 0


def test_agreement_covers_every_stone_with_a_text(spark):
    votes = reading_votes(spark.read.parquet(str(DATA / "readings.parquet"))).groupBy("item").count().collect()
    found = {r.ogham_id: r for r in QUERIES["p6_agreement"](spark, str(DATA)).collect()}
    assert {k: r.voters for k, r in found.items()} == {v["item"]: v["count"] for v in votes} and min(v["count"] for v in votes) < 3
    assert all(1 <= round(r.agreement * r.voters, 4) <= r.voters for r in found.values())


def test_ids_are_the_same_whatever_the_chunks(spark):
    whole, cut = ({r.doc_id: r.ids for r in QUERIES[n](spark, str(DATA)).collect()} for n in ("p7_ids", "p7_chunked"))
    assert whole == cut
