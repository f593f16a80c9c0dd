import pytest
from pyspark.sql import functions as F

from stonegraph import session
from stonegraph.operators import graph, reports


def test_a_bit_table_holds_its_keys_and_few_others(spark):
    rows = spark.range(40_000).select(F.xxhash64("id").alias("k"), "id")
    keys = rows.where("id % 40 = 0")
    sieve = session.BitTable(keys, "k", 1000)
    held = {r.id for r in sieve.held(rows, "k").collect()}
    assert {n for n in range(0, 40_000, 40)} <= held and len(held) < 6000
    assert {r.id for r in sieve.strange(rows, "k").collect()} == set(range(40_000)) - held
    none = session.BitTable(keys.limit(0), "k", 0)
    assert none.held(rows, "k").count() == 0 and none.strange(rows, "k").count() == 40_000


def test_a_bit_table_never_exceeds_its_bound(spark):
    keys = spark.range(200_000).select(F.xxhash64("id").alias("k"))
    sieve = session.BitTable(keys, "k", 200_000, most_log2=16)
    assert sieve.table.count() <= 2 and sieve.held(keys, "k").count() == 200_000


def test_a_checkpoint_forgets_sizes_that_tell_nothing(spark):
    df = spark.range(10)
    for _ in range(6):
        df = session.checkpointed(df.join(df.withColumnRenamed("id", "b"), F.col("id") == F.col("b")).select("id").distinct())
        assert session.plan_bytes(df) < 1 << 64 and df.count() == 10


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Empty:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: Empty()})()

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    with pytest.raises(RuntimeError, match="share"):
        session._checkpoint_folder(type("Spark", (), {"sparkContext": Context})())


def chased(spark, rows):
    return {r.name: r.canonical for r in graph.chase(spark.createDataFrame([(*r, "x") for r in rows], "repository string, alias_of string, name string"), name="repository", target="alias_of").collect()}


@pytest.mark.parametrize("n", [1, 2, 25, 45, 1000])
def test_chains_of_aliases_are_followed_to_their_end(spark, n):
    names = [f"n{k:04}" for k in range(n + 1)]
    ends = chased(spark, [*zip(names, names[1:]), (names[-1], None)])
    assert ends == {x: names[-1] for x in names}


def test_circles_loose_ends_and_nothing(spark):
    rows = [("c", "a"), ("a", "b"), ("b", "c"), ("in", "c"), ("far", "in"), ("self", "self"), ("out", "unlisted"), ("dead", ""), ("two", "x"), ("two", "y"), (None, "a"), ("x", None)]
    assert chased(spark, rows) == {"a": "a", "b": "a", "c": "a", "in": "a", "far": "a", "self": "self", "out": "unlisted", "dead": "dead", "two": "y", "x": "x"}
    assert chased(spark, []) == {}


def test_an_unsettled_closure_raises(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    with pytest.raises(RuntimeError, match="settle"):
        graph.closure(edges, child="a", parent="b", most_rounds=2)


def test_rows_are_numbered_through_all_partitions(spark):
    rows = [(k % 7, None if k % 11 == 0 else f"v{k:03}") for k in range(300)]
    got = reports.numbered_globally(spark.createDataFrame(rows, "a int, b string").repartition(5), order=["a", "b"]).collect()
    assert [r.no for r in sorted(got, key=lambda r: r.no)] == list(range(300))
    ordered = [(r.a, r.b or "") for r in sorted(got, key=lambda r: r.no)]
    assert ordered == sorted(ordered)
    assert reports.numbered_globally(spark.createDataFrame([], "a int, b string"), order=["a"]).count() == 0


def test_bridges_tie_the_places_of_a_name_without_pairs(spark):
    rows = [("A", f"s{k:02}") for k in range(20)] + [("A", "s00"), ("B", "s01"), (None, "s1"), ("", "s1"), ("C", None), ("D", "x"), ("D", "y")]
    got = {tuple(r) for r in graph.bridges(spark.createDataFrame(rows, "n string, p string"), name="n", place="p").collect()}
    assert got == {("A", f"s{k:02}", "s00") for k in range(1, 20)} | {("D", "y", "x")}
