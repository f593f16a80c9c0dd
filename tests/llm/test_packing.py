import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stonegraph.llm.packing import fill_containers, first_fit_decreasing

SCHEMA = "doc bigint, n bigint, size string, container int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10), max_size=40))
def test_tournament_tree_is_first_fit_decreasing(sizes):
    got = first_fit_decreasing(np.array(sizes, np.int64), 10)
    rooms, want = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((n for n, r in enumerate(rooms) if r >= sizes[k]), len(rooms))
        if at == len(rooms):
            rooms.append(10)
        rooms[at] -= sizes[k]
        want[k] = at
    assert got.tolist() == want


@pytest.mark.parametrize("group_items", [50, 100_000])
def test_every_item_is_placed_and_none_needlessly_cut(spark, group_items):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(0, 120, 2000)] + [None, -3, 0, 100, 101, 1000]
    df = spark.createDataFrame([(k, n, "s", 7) for k, n in enumerate(sizes)] + [(None, 5, "s", 1)], SCHEMA)
    rows = fill_containers(df, item="doc", size="n", capacity=100, group_items=group_items).collect()
    by, full = {}, {}
    for r in rows:
        by.setdefault(r.item, []).append(r)
        full[r.container] = full.get(r.container, 0) + r.size
    assert set(by) == set(range(len(sizes))) and max(full.values()) <= 100
    for k, n in enumerate(sizes):
        n = max(n or 0, 0)
        assert sum(r.size for r in by[k]) == n and len(by[k]) == max(1, -(-n // 100)) and sorted(r.piece for r in by[k]) == list(range(len(by[k])))
    assert sum(full.values()) / (100 * len(full)) > (0.9 if group_items == 50 else 0.98)


def test_empty_and_bad_capacity(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fill_containers(none, item="doc", size="n", capacity=5).count() == 0
    with pytest.raises(ValueError):
        fill_containers(none, item="doc", size="n", capacity=0)
