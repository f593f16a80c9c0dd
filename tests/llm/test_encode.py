import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stonegraph.llm import encode

DATA = encode.vocabulary()
ENC = encode.encoding(DATA)
SCHEMA = "doc_id bigint, text string, n int, out string"


def run(spark, texts, **kw):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], SCHEMA)
    return {r[0]: r[1] for r in encode.encode_texts(df, **kw).collect()}


def test_short_null_empty_and_special(spark):
    texts = [None, "", " ", "plain text", "<|endoftext|>", "naïve ᚛ᚑᚌᚐᚋ᚜ 😀́​", "a\x00b", "\n\n\t  x  "]
    got = run(spark, texts)
    assert got == {k: ENC.encode_ordinary(t) if t else [] for k, t in enumerate(texts)}
    assert all(encode.decode(got[k], DATA) == t for k, t in enumerate(texts) if t) and 50256 not in got[4]
    assert run(spark, texts, lengths_only=True) == {k: len(v) for k, v in got.items()}
    assert run(spark, []) == {}


@pytest.mark.parametrize("chunk, overlap", [(50, 10), (300, 64)])
def test_long_texts_are_stitched(spark, chunk, overlap):
    rnd = random.Random(chunk)
    bits = ["word", " ", "  ", "\n", "don't", "'s", "1234", "é", "ᚐᚋ", "!!", " ", "x" * 90, " " * 80, "…"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(20, 300))) for _ in range(40)] + ["a" * 2000, " " * 2000, "ᚐ" * 900, "ab " * 700, "a'" * 500]
    got = run(spark, texts, chunk=chunk, overlap=overlap)
    assert got == {k: ENC.encode_ordinary(t) for k, t in enumerate(texts)}
    assert run(spark, texts, lengths_only=True, chunk=chunk, overlap=overlap) == {k: len(v) for k, v in got.items()}


def test_no_cut_falls_after_white_space(spark):
    texts = ["x" * k + "I shall be.\n\nI was  there,\n\nSo 'tis\t\tit. " * 60 for k in range(12)]
    assert run(spark, texts, chunk=64, overlap=32) == {k: ENC.encode_ordinary(t) for k, t in enumerate(texts)}


def test_repeated_and_null_ids_keep_their_texts(spark):
    long = [f"stone {k} stands " * 300 for k in range(3)]
    rows = [(1, long[0]), (1, long[0]), (1, long[1]), (None, long[1]), (None, long[2]), (None, "short"), (None, None)]
    got = [(r[0], r[1]) for r in encode.encode_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=100, overlap=20).collect()]
    assert sorted(map(repr, got)) == sorted(repr((k, ENC.encode_ordinary(t) if t else [])) for k, t in rows)


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError):
        run(spark, ["x"], chunk=10, overlap=11)


def test_a_very_long_text(spark):
    text = "The stone stands by the wall, 12 m off.\n" * 20_000
    assert run(spark, [text])[0] == ENC.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab '1 .\né", max_size=60), st.integers(0, 59))
def test_boundaries_of_a_later_start_that_agree_once_agree_from_there(text, at):
    whole, part = encode.boundaries(text, 0, True), encode.boundaries(text[at:], at, True)
    common = set(whole) & set(part)
    if common:
        assert [p for p in whole if p >= min(common)] == [p for p in part if p >= min(common)]
