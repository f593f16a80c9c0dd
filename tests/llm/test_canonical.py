import random

from stonegraph.llm.queries import CATALOGUE
from stonegraph.llm.canonical import MOST, map_values, meant_labels, reference_spellings, unmatched

ENTRIES = "entry_id bigint, kind string, label string, form string, canonical string"
REFS = "kind string, canonical string, label string, own int"


def run(spark, labels, refs, kind="k", **kw):
    e = spark.createDataFrame([(n, kind, x, "f", "c") for n, x in enumerate(labels)], ENTRIES)
    m = map_values(e, spark.createDataFrame(refs, REFS), **kw)
    return {r.entry_id: (r.canonical, r.edits) for r in m.collect()}, e, m


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(n):
    return 0 if n < 4 else 1 if n < 5 else 2 if n < 10 else MOST


def test_the_pigeonhole_join_loses_no_pair_within_the_edits(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(2, 18))) for _ in range(40)]
    typed = []
    for w in words * 6:
        t = list(w)
        for _ in range(rnd.randrange(5)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randrange(2)] = rnd.choice(["", "a", "e", "x"])
        typed.append("".join(t) or "q")
    got, *_ = run(spark, typed, [("k", w, w, 0) for w in words])
    for n, t in enumerate(typed):
        near = sorted((lev(t, w), w) for w in set(words) if lev(t, w) <= allowed(len(w)))
        assert got[n] == ((near[0][1], near[0][0]) if near else ("", None)), (t, near[:3], got[n])


def test_hot_segments_are_split_and_lose_nothing(spark):
    refs = [("k", f"museum{x}{y}", f"museum{x}{y}", 0) for x in "abcdefgh" for y in "mnopqrst"]
    labels = [f"musuem{x}{y}" for x in "abcdefgh" for y in "mnopqrst"] + ["museumzz9"]
    whole, *_ = run(spark, labels, refs)
    split, *_ = run(spark, labels, refs, many_spellings=5, many_probes=7)
    assert whole == split and sum(c != "" for c, _ in whole.values()) >= 64


def test_long_chains_and_circles_of_aliases(spark):
    names = [f"n{k:04}" for k in range(1000)]
    rows = [(a, b, None) for a, b in zip(names, names[1:])] + [(names[-1], None, None)] + [(f"c{k}", f"c{(k + 1) % 25}", None) for k in range(25)] + [("into", "c7", None)]
    links = spark.createDataFrame([], "kind string, label string, wd_label string")
    ends = {r.label: r.canonical for r in reference_spellings(spark.createDataFrame(rows, "repository string, alias_of string, wd_label string"), links).collect()}
    assert {ends[n] for n in names} == {names[-1]} and {ends[f"c{k}"] for k in range(25)} == {ends["into"]} == {"c0"}


def test_ways_of_writing(spark):
    refs = [("k", "National Museum of Garth", "National Museum of Garth", 0), ("k", "St. Ulvan’s Church, Brae", "St. Ulvan’s Church, Brae", 0), ("k", "National Museum of Garth", "Old Schoolhouse, Garth", 1), ("k", "Cross-slab", "Cross-slab", 0)]
    same = {
        "National Museum of Garth": ["natl mus. of garth", "  NATIONAL\xa0MUSEUM OF GARTH ", "Garth National Museum of", "the National Musuem at Garth (on loan)", "National Museum of Garth; formerly in situ", "Nati0nal Museum of Garth inv. no. 19/7", "Old Schoolhouse,Garth", "National Museum of Garth [confirmed]", "National Museum of Garth, store 3"],
        "St. Ulvan’s Church, Brae": ["Saint Ulvan's Ch., Brae", "Brae St. Ulvan’s Church,"],
        "Cross-slab": ["crossslab", "Cross slab (?)", "prob. Cross-slab"],
        "": ["unknown", "?", "National Museum of Penvo", "--", "in situ", "x" * 50_000],
    }
    labels = [x for v in same.values() for x in v]
    got, e, m = run(spark, labels, refs, writing=CATALOGUE)
    assert {x: got[n][0] for n, x in enumerate(labels)} == {x: k for k, v in same.items() for x in v}
    assert {r.label for r in unmatched(e, m).collect()} == set(same[""])


def test_nulls_blanks_repeats_and_empty_tables(spark):
    refs = spark.createDataFrame([("k", "Slate", "Slate", 0), (None, "Slate", "Slate", 0)], REFS)
    rows = [(1, "k", "Slate", "", ""), (1, "k", "Slate", "", ""), (2, "k", None, "", ""), (3, "k", " \xa0\t", "", ""), (4, None, "Slate", "", ""), (5, "other", "Slate", "", ""), (None, "k", "Slate", "", "")]
    got = sorted(map(tuple, map_values(spark.createDataFrame(rows, ENTRIES), refs).select("entry_id", "canonical").collect()), key=repr)
    assert got == sorted([(1, "Slate"), (1, "Slate"), (4, ""), (5, ""), (None, "Slate")], key=repr)
    none = spark.createDataFrame([], ENTRIES)
    assert map_values(none, refs).count() == 0
    assert [r.canonical for r in map_values(spark.createDataFrame(rows[:1], ENTRIES), spark.createDataFrame([], REFS)).collect()] == [""]


def test_aliases(spark):
    keepers = spark.createDataFrame([("A house", "B house", None), ("B house", "C house", None), ("C house", None, "Casa C"), ("X ring", "Y ring", None), ("Y ring", "X ring", None), ("Lone", "Nowhere", None), (None, None, None)], "repository string, alias_of string, wd_label string")
    links = spark.createDataFrame([("material", "Slate", "slate"), ("material", None, "x")], "kind string, label string, wd_label string")
    ends = {r.label: r.canonical for r in reference_spellings(keepers, links).collect()}
    assert ends["A house"] == ends["B house"] == ends["C house"] == ends["Casa C"] == "C house" and ends["Lone"] == "Lone" and ends["X ring"] == ends["Y ring"] == "X ring"
    e = spark.createDataFrame([(1, "repository", "a HOUSE"), (1, "repository", "a HOUSE"), (2, "material", "slat")], "entry_id bigint, kind string, label string")
    assert {tuple(r) for r in meant_labels(e, keepers, links).collect()} == {(1, "C house"), (2, "Slate")}
