import random

import pytest
from conftest import DATA

import __spark_entry__ as entry
from stonegraph.operators import resolve, triples

VOCABULARY = "word string, mode string, variant string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(seed, letters="ABC"):
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    tokens = [(k, some(rnd.randint(1, 9))) for k in range(120)] + [(200, ""), (201, None), (202, some(90)), (203, "AB"), (203, "AB")]
    words = [(f"w{k}", rnd.choice(["formula", "element"]), some(rnd.randint(1, 4))) for k in range(25)] + [("e", "element", ""), ("f", "formula", ""), ("n", None, "AB"), ("v", "element", None), ("t", "element", "AB"), ("t", "element", "AB")]
    return tokens, words


def brute(tokens, words, most=99):
    hit = lambda t, m, v: 0 < len(v) <= most and v in t if m == "element" else v == t
    return sorted((k, t, w, m, v) for k, t in tokens for w, m, v in words if None not in (t, m, v) and hit(t, m, v))


@pytest.mark.parametrize("few, most", [(1000, 100_000), (0, 100_000), (0, 0)])
@pytest.mark.parametrize("longest", [0, 2])
def test_tokens_that_equal_or_hold_a_variant(spark, monkeypatch, few, most, longest):
    monkeypatch.setattr(resolve, "FEW_WORDS", few)
    monkeypatch.setattr(resolve, "MOST_WORDS", most)
    tokens, words = made(1)
    words += [(f"l{k}", "element", tokens[122][1][:k]) for k in range(5, 80)]  # more lengths than are listed one by one
    got = resolve.match_words(spark.createDataFrame(tokens, "k int, token string"), spark.createDataFrame(words, VOCABULARY), token="token", longest_piece=longest)
    assert sorted(map(tuple, got.collect())) == brute(tokens, words, longest or 99)


def test_vocabularies_without_elements_and_without_words(spark):
    tokens = spark.createDataFrame([(1, "AB"), (2, "B")], "k int, token string")
    got = resolve.match_words(tokens, spark.createDataFrame([("w", "formula", "B")], VOCABULARY), token="token")
    assert list(map(tuple, got.collect())) == [(2, "B", "w", "formula", "B")] and got.columns == ["k", "token", "word", "mode", "variant"]
    assert resolve.match_words(tokens, spark.createDataFrame([], VOCABULARY), token="token").collect() == []


def test_what_tokens_hold_is_never_broadcast(spark, monkeypatch, tmp_path):
    """A small file of tokens is estimated far below the threshold of a broadcast; what they hold isn't small."""
    tokens, words = made(2)
    spark.createDataFrame(tokens, "k int, token string").write.parquet(str(tmp_path / "tokens"))
    read, vocabulary = spark.read.parquet(str(tmp_path / "tokens")), spark.createDataFrame(words, VOCABULARY)
    for few in (1000, 0):
        monkeypatch.setattr(resolve, "FEW_WORDS", few)
        small = plan(resolve.match_words(read, vocabulary, token="token"))
        assert "BuildRight" in small and "BuildLeft" not in small and "hashpartitioning" not in small and "SortMergeJoin" not in small
    monkeypatch.setattr(resolve, "MOST_WORDS", 0)
    assert "SortMergeJoin" in (large := plan(resolve.match_words(read, vocabulary, token="token"))) and "BuildLeft" not in large


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["vocabulary_matches", "word_rows", "view_words"])
def test_queries_of_words_broadcast_the_vocabulary_only(spark, name):
    joins = [x for x in plan(entry.queries()[name](spark, str(DATA))).split("\n") if "Join" in x]
    assert joins and all("BuildRight" in x for x in joins)


def test_graph_of_words_shuffles_matches_and_gives_each_triple_once(spark):
    """Stones, readings and words whose slugs run together give one node: its triples come once."""
    vocabulary = spark.createDataFrame([("C", "element", "C"), ("b C", "element", "BC"), ("M", "formula", "M")], VOCABULARY)
    rows = [("s a", "b", "ed", "ogham", "BC M"), ("s", "a b", "ed", "ogham", "BC M"), ("s", "a", "ed", "", "BC"), ("s-a", "b", "ed", "ogham", "BC M"), ("s", "a", "ed 2", None, "XC")]
    tokens = spark.createDataFrame([(*r, t) for r in rows for t in r[4].split()], "stone string, reading_id string, editor string, script string, text string, token string")
    graph = triples.word_graph(resolve.match_words(tokens, vocabulary, token="token"), vocabulary)
    shuffles = [x for x in plan(graph).split("\n") if "Exchange hashpartitioning" in x]
    assert sum("hashpartitioning(at#" in x and "REPARTITION" in x for x in shuffles) == 2  # occurrences and readings go where their nodes do
    assert sum("kind#" in x for x in shuffles) == 2  # only those of stones and agents, a row each
    got = [tuple(r) for r in graph.select("s", "p", "o").collect()]
    assert len(got) == len(set(got))
    D, O = triples.DATA, triples.DOMAIN
    assert {x for x in got if x[1] == O + "shows"} == {
        (D + f"stone_{s}", O + "shows", D + f"word_occ_{o}") for s, o in
        [("s_a", "s_a_b_C_element"), ("s_a", "s_a_b_b_C_element"), ("s_a", "s_a_b_M_formula"), ("s", "s_a_b_C_element"), ("s", "s_a_b_b_C_element"), ("s", "s_a_b_M_formula"), ("s", "s_a_C_element")]
    }
    assert {x[2] for x in got if x[:2] == (D + "word_occ_s_a_b_C_element", triples.RDFS + "label")} == {"BC"} and (D + "reading_s_a_b", triples.RDF + "type", O + "Reading") in got
