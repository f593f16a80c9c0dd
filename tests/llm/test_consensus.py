import random

import numpy as np
import pytest

from stonegraph.llm.consensus import digamma, fit, reading_consensus, reading_votes

SCHEMA = "item string, annotator string, label string, w double, kind int"


def simulated(seed=1, items=400):
    rnd = random.Random(seed)
    good = {f"good{k}": 0.95 for k in range(3)} | {f"bad{k}": 0.35 for k in range(4)} | {"rare": 0.95}
    rows, truth = [], {}
    for n in range(items):
        t = truth[f"i{n}"] = "".join(rnd.choice("ABCDEFG") for _ in range(rnd.choice((6, 20))))
        wrong = [t[:-1] + x for x in "XYZ"]
        for a, p in good.items():
            if rnd.random() < (0.05 if a == "rare" else 0.7):
                rows.append((f"i{n}", a, t if rnd.random() < p else wrong[0] if a.startswith("bad") and rnd.random() < 0.8 else rnd.choice(wrong), 1.0, 2))
    return rows, truth


def test_reliable_annotators_outweigh_a_majority(spark):
    rows, truth = simulated()
    r = fit(spark.createDataFrame(rows, SCHEMA))
    found = {x.item: x for x in r.items.collect()}
    plain = {}
    for i, _, label, *_ in rows:
        plain.setdefault(i, []).append(label)
    right = np.mean([found[i].consensus == truth[i] for i in found])
    majority = np.mean([max(sorted(set(v)), key=v.count) == truth[i] for i, v in plain.items()])
    assert right > 0.93 and right > majority + 0.03
    rel = {a.annotator: a.reliability for a in r.annotators.collect()}
    assert min(v for k, v in rel.items() if k.startswith("good")) > 0.85 > 0.6 > max(v for k, v in rel.items() if k.startswith("bad")) and rel["rare"] > 0.8
    assert all(0 < x.agreement <= 1 and 0 <= x.certainty <= 1 + 1e-9 for x in found.values())


def test_order_repeats_and_nulls_change_nothing(spark):
    rows, _ = simulated(2, 60)
    a = {x.item: x.consensus for x in fit(spark.createDataFrame(rows, SCHEMA)).items.collect()}
    more = rows[::-1] + rows[:50] + [(None, "a", "b", 0.0, 0), ("i", None, "b", 0.0, 0), ("i", "a", None, 0.0, 0)]
    assert {x.item: x.consensus for x in fit(spark.createDataFrame(more, SCHEMA)).items.collect()} == a


def test_empty_single_and_tied(spark):
    r = fit(spark.createDataFrame([], SCHEMA))
    assert r.items.count() == 0 and r.annotators.count() == 0
    r = fit(spark.createDataFrame([("a", "x", "L", 0.0, 0), ("b", "x", "Q", 0.0, 0), ("b", "y", "P", 0.0, 0), ("c", "x", "long " * 5000, 0.0, 0)], SCHEMA))
    assert {x.item: x.consensus for x in r.items.collect()} | {"c": 0} == {"a": "L", "b": "P", "c": 0}


def test_digamma():
    assert np.allclose(digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525891], atol=1e-9)


def test_votes_of_readings(spark):
    rows = [
        ("S", "Rhys 1899", "AB[C]", "A B C"), ("S", " RHYS (1901a)", "X", "abc"), ("S", "rhys, 1901b, 12", None, "ABC?"), ("S", "unattributed reading", "Z", None), ("S", None, "Z", "ABD"), ("S", "Brash 1870", "A-B/C", ""), ("S", "Brash 1870", "A-B/C", ""),
        ("T", "Rhys 1900", "...", "Q"), ("T", "Brash 1880", "q", "Q"), ("T", "Diack 1880", "q̣", "Q"), (None, "Rhys 1900", "A", "B"), ("", "Rhys 1900", "A", "B"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "ogham_id string, editor string, this_reading_text string, current_edition_text string, item string")
    votes = {tuple(r) for r in reading_votes(df).collect()}
    assert votes == {("S", "BRASH", "ABC"), ("S", "(current edition)", "ABC"), ("T", "BRASH", "Q"), ("T", "DIACK", "Q"), ("T", "(current edition)", "Q")}
    assert {tuple(r)[:2] for r in reading_consensus(df).collect()} == {("T", "Q")}


def test_an_unsettled_model_raises(spark):
    rows, _ = simulated(3, 40)
    with pytest.raises(RuntimeError, match="settle"):
        fit(spark.createDataFrame(rows, SCHEMA), rounds=1)


def test_annotators_who_change_quarters_for_ever_are_settled(spark):
    rows, truth = simulated(50, 60)  # ranked anew in each round, the matrices of these jump by 0.11 for ever
    r = fit(spark.createDataFrame(rows, SCHEMA), rounds=60)
    found = {x.item: x.consensus for x in r.items.collect()}
    assert r.rounds < 30 and found.keys() == {i for i, *_ in rows} and np.mean([found[i] == truth[i] for i in found]) > 0.9


def test_an_annotator_of_items_that_no_other_has(spark):
    r = fit(spark.createDataFrame([("a", "x", "L", 0.0, 0), ("a", "y", "L", 0.0, 0), ("b", "z", "Q", 0.0, 0)], SCHEMA))
    found = {a.annotator: a for a in r.annotators.collect()}
    assert found.keys() == {"x", "y", "z"} and found["z"].labels == 0 and 0 < found["z"].reliability < 1
