import random

import pytest

from stonegraph.llm.components import component_ids, contract, decompose, families, group_members, with_parts

SCHEMA = "a string, b string, v int, member string, c string"


def brute(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b, *_ in rows:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            up[find(a)] = find(b)
    groups = {}
    for x in up:
        groups.setdefault(find(x), []).append(x)
    return {(min(g), x) for g in groups.values() for x in g}


def run(spark, rows):
    got = [tuple(r) for r in group_members(spark.createDataFrame([(*r, 1, "m", "c") for r in rows], SCHEMA), a="a", b="b").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_chains_hubs_and_circles(spark):
    rnd = random.Random(0)
    rows = [(f"c{k}", f"c{k + 1}") for k in range(150)] + [("hub", f"s{k}") for k in range(300)] + [(f"r{k}", f"r{(k + 1) % 40}") for k in range(40)]
    rows += [(f"x{rnd.randrange(60)}", f"x{rnd.randrange(60)}") for _ in range(45)] + [("solo", None), (None, "only"), (None, None), ("me", "me"), ("hub", "s1"), ("s1", "hub"), ("", "é"), ("z" * 5000, "y")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("a", None)], [("a", "a")], [("b", "a")]])
def test_small_cases(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_clusters_are_of_linked_vertices_and_of_bounded_width(spark):
    links = with_parts(spark.createDataFrame([(k, k + 1) for k in range(400)], "a bigint, b bigint"), 1000)
    clusters = decompose(links, 0, steps=3, beta=0.5)
    by = {}
    for r in clusters.collect():
        by.setdefault(r.c, []).append(r.v)
    assert sum(map(len, by.values())) == 401 and len(by) < 401
    for c, vs in by.items():
        assert sorted(vs) == list(range(min(vs), max(vs) + 1)) and c in vs and max(abs(v - c) for v in vs) <= 3
    assert contract(links, clusters).count() == len(by) - 1


def test_hubs_are_joined_in_parts(spark):
    rows = [("hub", f"s{k}") for k in range(300)] + [(f"s{k}", f"t{k % 7}") for k in range(0, 300, 3)] + [("other", f"u{k}") for k in range(90)] + [("far", "near")]
    links = spark.createDataFrame([(0, k) for k in range(1, 301)] + [(k, k + 1) for k in range(1, 40)], "a bigint, b bigint")
    parts = with_parts(links, 20)
    assert {(r.a, r.na) for r in parts.collect() if r.a == 0} == {(0, 15)} and {r.nb for r in parts.collect()} == {1}
    got = {tuple(r) for r in group_members(spark.createDataFrame([(*r, 1, "m", "c") for r in rows], SCHEMA), a="a", b="b", hub=20).collect()}
    assert got == brute(rows)


def test_component_ids_whatever_the_parameters(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11)], "a bigint, b bigint")
    for steps, beta in ((2, 0.5), (8, 0.1)):
        ids = {r.v: r.c for r in component_ids(links, steps=steps, beta=beta).collect()}
        assert ids[1] == ids[2] == ids[3] != ids[10] == ids[11]


def test_families(spark):
    rows = [("S1", "MAQI[---]", "yes", "\u1ecc᚛ri᚜ ", "no"), ("S2", "maqi", "yes", "OR-I?", None), ("S3", "...", "no", "X", "no"), (None, "A", "yes", None, "no"), ("S4", None, None, "", None), ("S1", "b", "no", "M A Q I", "yes")]
    got = {tuple(r) for r in families(spark.createDataFrame(rows, "stone string, from_name string, from_anonymous string, to_name string, to_anonymous string")).collect()}
    assert got == {("B", "B"), ("B", "S1/MAQI"), ("B", "RI"), ("ORI", "ORI"), ("ORI", "S2/MAQI"), ("X", "X"), ("/A", "/A")}
