import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stonegraph.operators.snapshot import CHANGES, _winners, blob_id, manifest_changes, plain_path, snapshot_changes

SCHEMA = "key string, ord int, at timestamp, content string, extra int, h string, change string"
T0 = datetime(2024, 1, 1)


def brute(rows, snapshots):
    won = {}
    for key, ord_, at, content, *_ in rows:
        if key is not None and ord_ is not None and 0 <= ord_ < snapshots:
            k = (key, ord_)
            if k not in won or (at or datetime(1900, 1, 1)) > (won[k][0] or datetime(1900, 1, 1)):
                won[k] = (at, content)
    out = set()
    for s in range(1, snapshots):
        a = {k: v[1] for (k, o), v in won.items() if o == s - 1}
        b = {k: v[1] for (k, o), v in won.items() if o == s}
        out |= {(k, s, "added") for k in b.keys() - a.keys()} | {(k, s, "removed") for k in a.keys() - b.keys()} | {(k, s, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def run(spark, rows, snapshots, **kw):
    df = snapshot_changes(spark.createDataFrame(rows, SCHEMA), key="key", ord="ord", at="at", content="content", snapshots=snapshots, **kw)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 40 + [f"k{n}" for n in range(80)]), rnd.randrange(4), T0 + timedelta(microseconds=n), rnd.choice(["a", "b", None, ""]), 0, "x", None) for n in range(4000)]
    rows += rows[:500] + [(None, 1, T0, "a", 0, None, None), ("lost", None, T0, "a", 0, None, None), ("k1", 9, T0, "a", 0, None, None), ("late", 2, None, "a", 0, None, None)]
    assert run(spark, rows, 4) == brute(rows, 4)
    assert run(spark, rows, 4, buckets=7) == brute(rows, 4)


def test_ties_are_settled_alike_in_any_order(spark):
    rows = [("k", 0, T0, "a", 0, "", ""), ("k", 0, T0, "b", 0, "", ""), ("k", 1, T0, "a", 0, "", "")]
    assert run(spark, rows, 2) == run(spark, rows[::-1], 2)


def test_nulls_equal_only_nulls(spark):
    rows = [("a", 0, T0, None, 0, "", ""), ("a", 1, T0, None, 0, "", ""), ("b", 0, T0, None, 0, "", ""), ("b", 1, T0, "x", 0, "", ""), ("c", 0, T0, "", 0, "", ""), ("c", 1, T0, None, 0, "", "")]
    assert run(spark, rows, 2) == {("b", 1, "changed"), ("c", 1, "changed")}


@pytest.mark.parametrize("snapshots", [0, 1, 3])
def test_empty(spark, snapshots):
    assert run(spark, [], snapshots) == set()


def test_first_snapshot_gives_no_cases_and_long_keys_work(spark):
    long = "x" * 100_000
    assert run(spark, [(long, 0, T0, "a", 0, "", ""), (long, 1, T0, long, 0, "", "")], 2) == {(long, 1, "changed")}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=30))
def test_winners(rows):
    import numpy as np

    k, o, at, h = (np.array(c, np.int64) for c in zip(*rows))
    (k1, _, ord_, at_, h_), key_no = _winners([k, k * 0, o.astype(np.int32), at, h])
    want = {}
    for a, b, c, d in rows:
        want[a, b] = max(want.get((a, b), (-1, -1)), (c, d))
    assert {(a, b): (c, d) for a, b, c, d in zip(k1.tolist(), ord_.tolist(), at_.tolist(), h_.tolist())} == want
    assert len(set(key_no.tolist())) == len({a for a, *_ in rows})


def test_paths_and_ids(spark):
    sha = "ab" * 20
    paths = {"XML/a/b.xml": "XML/a/b.xml", "./XML//a/./b.xml\n": "XML/a/b.xml", "\tXML\\a\\b.xml ": "XML/a/b.xml", "/XML/a/": "XML/a", " ": None, ".": None, "": None, None: None, "a/.b/c..": "a/.b/c.."}
    df = spark.createDataFrame([(k,) for k in paths], "p string").select("p", plain_path(F.col("p")).alias("q"))
    assert {r.p: r.q for r in df.collect()} == paths
    ids = {sha: sha, sha.upper(): sha, f"blob {sha}": sha, f"{sha}\r": sha, "": None, None: None, " zz ": "zz"}
    df = spark.createDataFrame([(k,) for k in ids], "p string").select("p", blob_id(F.col("p")).alias("q"))
    assert {r.p: r.q for r in df.collect()} == ids


def test_manifest(spark):
    c = ["a" * 40, "b" * 40, "c" * 40]
    heads = spark.createDataFrame([(c[1].upper(), "2024-01-02T00:00:00+05:00", 1), (c[0], "2024-01-01T20:00:00+00:00", 1), (c[2], "2024-01-03T00:00:00+00:00", 1), (c[2], "2024-01-03T00:00:00+00:00", 2), (None, "x", 3), (c[1], None, 1)], "commit string, commit_date string, ord int")
    files = [(c[1][:8], "XML/a/1.xml", "1" * 40, T0), (c[0].upper(), "./XML/a/1.xml", "1" * 40, T0), (c[2], "XML//a/1.xml", None, T0), ("fffffff", "XML/a/1.xml", None, T0), (None, "XML/a/1.xml", None, T0), (c[2], None, None, T0), (c[0], "XML/a/2.xml", None, None)]
    got = manifest_changes(spark.createDataFrame(files, "commit string, path string, sha string, fetched timestamp"), heads)
    # the second head's instant, 19:00 UTC, comes before the first's
    assert {tuple(r) for r in got.collect()} == {(c[0], "XML/a/2.xml", "added"), (c[2], "XML/a/2.xml", "removed"), (c[2], "XML/a/1.xml", "changed")}
    assert set(CHANGES) == {"added", "removed", "changed"}
