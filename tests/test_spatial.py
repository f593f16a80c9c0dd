import random

import numpy as np
import pytest

from stonegraph.operators.spatial import containing_regions, great_circle_km, inside, near_pairs, near_rows, neighbourhood, region_state

POINTS = "id string, lat double, lon double, pair int, side string"
nan = float("nan")


def points(rnd, n, spread=0.02, at=((53.0, -8.0), (89.999, 10.0), (0.5, 179.999), (0.5, -179.999))):
    out = []
    for k in range(n):
        lat, lon = rnd.choice(at)
        out.append((f"p{k}", min(90.0, lat + rnd.uniform(-spread, spread)), max(-180.0, min(180.0, lon + rnd.uniform(-spread, spread))), k, "x"))
    return out


def ok(r):
    return r[0] is not None and None not in r[1:3] and -90 <= r[1] <= 90 and -180 <= r[2] <= 180 and (r[1], r[2]) != (0, 0)


def brute(a, b, km):
    a = [r for r in a if ok(r)]
    if b is None:
        return {tuple(sorted((x[0], y[0]))) for n, x in enumerate(a) for y in a[:n] if great_circle_km(x[1], x[2], y[1], y[2]) <= km}
    return {(x[0], y[0]) for x in a for y in b if ok(y) and great_circle_km(x[1], x[2], y[1], y[2]) <= km}


@pytest.mark.parametrize("km, leaf", [(0.1, 8192), (0.5, 20), (3.0, 40), (30000.0, 50)])
def test_near_pairs_against_brute_force(spark, km, leaf):
    rnd = random.Random(3)
    rows = points(rnd, 150) + [(f"hot{k}", 53.001, -8.001, k, "") for k in range(120)]
    rows += [("n1", None, 1.0, 0, ""), ("n2", 1.0, None, 0, ""), ("n3", 0.0, 0.0, 0, ""), ("n4", 95.0, 1.0, 0, ""), ("n5", nan, 1.0, 0, ""), (None, 53.0, -8.0, 0, "")]
    df = spark.createDataFrame(rows, POINTS)
    got = [tuple(sorted(r)) for r in near_pairs(df, None, km, leaf=leaf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, None, km)
    other = [("q" + r[0], *r[1:]) for r in points(rnd, 60)]
    got = {tuple(r) for r in near_pairs(df, spark.createDataFrame(other, POINTS), km, leaf=leaf).collect()}
    assert got == brute(rows, other, km)


def test_few_pairs_of_leaves_are_enforced_by_larger_leaves(spark):
    rows = points(random.Random(5), 300)
    got = {tuple(sorted(r)) for r in near_pairs(spark.createDataFrame(rows, POINTS), None, 0.5, leaf=4, most_pairs=20).collect()}
    assert got == brute(rows, None, 0.5)


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], POINTS), spark.createDataFrame(points(random.Random(1), 5), POINTS)
    for a, b in ((none, None), (none, some), (some, none)):
        assert near_pairs(a, b, 1.0).count() == 0
    regions = spark.createDataFrame([], "id string, outline array<struct<lon:double,lat:double>>")
    assert containing_regions(none, regions).count() == 0 and containing_regions(some, regions).count() == 0


def test_rows_within_a_task():
    rng = np.random.default_rng(0)
    lat, lon = 50 + rng.random(500) * 0.2, rng.random(500) * 0.2
    lat[:200], lon[:200] = 50.1, 0.1
    got = {(min(a, b), max(a, b)) for x, y in near_rows(lat, lon, lat, lon, 1.0, True) for a, b in zip(x.tolist(), y.tolist())}
    assert got == {(a, b) for a in range(500) for b in range(a + 1, 500) if great_circle_km(lat[a], lon[a], lat[b], lon[b]) <= 1.0}


SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
HOLLOW = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (3.0, 4.0), (3.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]


def test_regions(spark):
    rnd = random.Random(2)
    rows = [(f"p{k}", rnd.uniform(-1, 5), rnd.uniform(-1, 5), k, "") for k in range(400)] + [("bad", None, 1.0, 0, ""), (None, 1.0, 1.0, 0, "")]

    def outline(xy):
        return [{"lon": x, "lat": y} for x, y in xy]

    shapes = {"square": SQUARE, "closed": SQUARE + SQUARE[:1], "back": SQUARE[::-1], "hollow": HOLLOW, "all": [(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)], "line": SQUARE[:2], "none": []}
    regions = spark.createDataFrame([(k, outline(v)) for k, v in shapes.items()] + [("null", None), (None, outline(SQUARE))], "id string, outline array<struct<lon:double,lat:double>>")
    for leaf in (8192, 30):
        got = {tuple(r) for r in containing_regions(spark.createDataFrame(rows, POINTS), regions, leaf=leaf).collect()}
        want = {(r[0], k) for r in rows if ok(r) for k, v in shapes.items() if len(v) > 2 and inside(np.array([r[2]]), np.array([r[1]]), np.array(v))[0]}
        assert got == want


def test_a_box_in_a_hollow_is_outside_and_one_in_an_arm_inside():
    h = np.array(HOLLOW)
    assert region_state(np.array([1.5, 2.0]), np.array([2.5, 3.0]), h) == 0
    assert region_state(np.array([0.2, 2.0]), np.array([0.8, 3.0]), h) == 2
    assert region_state(np.array([0.5, 2.0]), np.array([1.5, 3.0]), h) == 1


def test_neighbourhood(spark):
    k = [("S1", 53.0, -8.0, "Q1", 53.01, -8.0, 1), ("S1", 50.0, -8.0, "Q1", None, None, 2), ("S2", 50.0001, -8.0, None, 50.0, -8.0, 1), ("A3", None, -8.0, "Q2", 50.0, -8.01, 5), ("A3", 50.0, -8.0, "Q2", 50.0, -8.01, 4), ("", 50.0, -8.0, "", 50.0, -8.0, 1), (None, 50.0, -8.0, "Q2", 50.0, -8.0, 1)]
    df = spark.createDataFrame([(*r[:-1], f"2024-01-0{r[-1]}") for r in k], "ogham_id string, findspot_lat double, findspot_lon double, keeper_qid string, keeper_lat double, keeper_lon double, recorded string").selectExpr("*", "1 as id").withColumn("recorded", __import__("pyspark").sql.functions.to_timestamp("recorded"))
    areas = spark.createDataFrame([("area", [{"lon": -9.0, "lat": 49.0}, {"lon": -7.0, "lat": 49.0}, {"lon": -7.0, "lat": 51.0}])], "area_id string, outline array<struct<lon:double,lat:double>>")
    got = {tuple(r) for r in neighbourhood(df, areas).collect()}
    assert {("findspot", "S1", "S2"), ("keeper", "Q2", "S1"), ("keeper", "Q2", "S2")} == {g for g in got if g[0] != "area"}
    assert all(g[1][0] == "S" for g in got if g[0] == "area")
