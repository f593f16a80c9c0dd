import zlib

import numpy as np
import pytest

from stonegraph.llm import abuse

DOCS = "doc_id bigint, text string, source string, score double"
LABELS = "doc_id bigint, abusive int, text string"
BAD = ["You are a stupid moron, {0}.", "{0} are vermin and should be driven out.", "I will break your legs, {0}.", "Shut up, you filthy bastard {0}."]
GOOD = ["The {0} stone stands by the wall.", "Many {0} came to see the carving.", "The reading of {0} is careless and wrong.", "We walked to {0} in the rain."]
WHO = ["Tesmond", "foreigners", "Garth", "women", "migrants", "Wenlu", "islanders", "Brae"]


def table(spark):
    docs, labels = [], []
    for n in range(160):
        good = [GOOD[(n + k) % 4].format(WHO[(n + k) % 8]) for k in range(3)]
        y = n % 2
        text = " ".join(good[:1] + ([BAD[n // 2 % 4].format(WHO[n % 8])] if y else []) + good[1:])
        docs.append((n, text, f"s{n % 3}", 0.0))
        labels.append((n, y if n % 19 else 1 - y, "t"))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("hidden", ["a b a s t a r d", "b.a.s.t.a.r.d", "bаstаrd", "b4st4rd", "baaaastard", "BASTARD", "bàstárd", "b​astard", "ｂａｓｔａｒｄ"])
def test_hidden_words_are_found(hidden):
    assert "bastard" in abuse.plain_words(f"you {hidden} there").replace(" ", "")


def test_windows_cover_every_word_of_a_long_sentence():
    words = [f"w{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676)}" for n in range(1000)]
    pieces = abuse.sentences(" ".join(words))
    assert {w for p in pieces for w in p} == set(map(abuse.plain_words, words)) and max(map(len, pieces)) <= abuse.WINDOW


def test_learns_sentences_from_labels_of_documents(spark):
    docs, labels = table(spark)
    scores = {r.doc_id: r.score for r in abuse.score_documents(docs, labels).collect()}
    assert sum((scores[n] >= 0.5) == bool(n % 2) for n in scores) >= 0.97 * len(scores)
    new = [(1, "Some words first. You filthy moron, shut up.", None, 0.0), (2, "Refugees and pensioners came to see the stone.", "", 0.0), (3, None, "a", 0.0), (4, " ", "a", 0.0), (4, " ", "a", 0.0), (5, "stone " * 60_000, "a", 0.0), (None, "!!! ??? 123", "a", 0.0)]
    got = abuse.score_documents(spark.createDataFrame(new, DOCS), labels).collect()
    assert len(got) == len(new)
    s = {r.doc_id: r.score for r in got}
    assert s[1] > 0.5 > max(s[2], s[3], s[4], s[5])
    rates = {r.source: (r.documents, r.abusive) for r in abuse.source_rates(spark.createDataFrame(new, DOCS), labels).collect()}
    assert rates == {"": (2, 1), "a": (5, 0)}


def test_swapping_a_group_hardly_changes_a_score():
    docs = [(BAD[1].format(w), 1.0) for w in ("Foreigners", "migrants")] * 10 + [(GOOD[1].format(w), 0.0) for w in ("farmers", "students")] * 10

    def gap(swap):
        w, b = abuse.train(docs, swap=swap)
        scorer = abuse.Scorer(w, b)
        return scorer.text("Many foreigners came to see the carving."), scorer.text("Many farmers came to see the carving.")

    (fx, fy), (ux, uy) = gap(5.0), gap(0.0)
    assert abs(fx - fy) < 0.1 and abs(fx - fy) <= abs(ux - uy) + 1e-6 and fx < 0.5


def test_scores_are_sums_over_different_words_and_pairs():
    w = np.random.default_rng(0).normal(size=abuse.BUCKETS)
    texts = ["Keep Veshlings out, they steal everything. The old old Garth wall. Du Drecksack Du, ja\nx", None, "", "so " * 90 + "it is", "42 men! " * 30]
    want = []
    for t in texts:
        worst = -np.inf
        for words in abuse.sentences(t):
            of = {x: abuse.word_features(x) for x in words}
            crc = lambda x: np.array([zlib.crc32(x.encode())])
            pairs = {int(abuse._mixed(crc(of[a][1]), crc(of[b][1]), n)[0]) for n in (1, 2) for a, b in zip(words, words[n:])}
            pairs |= {int(abuse._mixed(crc(of[a][2]), crc(of[b][1]), 1)[0]) for a, b in zip(words, words[1:]) if of[a][1] == "«n»"}
            worst = max(worst, sum(w[of[x][0]].sum() for x in set(words)) + sum(w[p & (abuse.BUCKETS - 1)] for p in pairs))
        want.append(1 / (1 + np.exp(-worst)))
    for at_once in (1, 100, 10**6):
        assert np.allclose(abuse.Scorer(w, 0.0, most=5).texts(texts, at_once), want)


def test_what_is_learnt_is_what_is_scored():
    """The gradient's design matrix and the scorer agree."""
    words = abuse.Words()
    ids, window, of = abuse.windows(["Keep Veshlings out, they steal everything. The old old Garth wall.", "A wall"], words)
    x = abuse.Design(words, None, *abuse.units(ids, window, words), len(of))
    w = np.random.default_rng(1).normal(size=abuse.BUCKETS)
    scorer = abuse.Scorer(w, 0.0)
    ids, window, of = abuse.windows(["Keep Veshlings out, they steal everything. The old old Garth wall.", "A wall"], scorer.words)
    assert np.allclose(x.dot(w[x.used]), scorer.windows(ids, window, len(of)))
    g = np.random.default_rng(2).normal(size=len(of))
    assert np.isclose(x.back(g) @ w[x.used], g @ x.dot(w[x.used]))


def test_singular_and_adjective_terms_are_swapped_and_their_gap_told(spark):
    for text, term in (("A woman drew it.", "woman"), ("A gay couple visited.", "gay"), ("Eine Frau sah es.", "frau"), ("Une femme passait.", "femme")):
        words = abuse.sentences(text)[0]
        other = abuse.swapped(words)
        assert other and sum(a != b for a, b in zip(words, other)) == 1 and abuse.group_of(next(b for a, b in zip(words, other) if a != b)) == abuse.group_of(term)
    docs, labels = table(spark)
    gaps = {r.term: r for r in abuse.group_gaps(docs, labels).collect()}
    assert set(gaps) == {"foreigners", "women", "migrants", "islanders"} and all(0 <= r.mean_gap <= r.greatest_gap <= 1 for r in gaps.values())
    assert sum(r.sentences for r in gaps.values()) == sum(len([1 for p in abuse.sentences(d.text) if abuse.swapped(p)]) for d in docs.collect())
    assert abuse.group_gaps(docs.limit(0), labels).count() == 0


def test_long_runs_take_linear_time():
    import time

    began = time.time()
    for run in ("a" * 300_000, "a1" * 100_000, "a " * 100_000, "!" * 200_000, "1" * 200_000, "*" * 200_000 + "x", "b. " * 60_000):
        abuse.sentences(run)
    assert time.time() - began < 20


def test_no_labels_and_no_documents(spark):
    docs, labels = table(spark)
    assert abuse.score_documents(docs.limit(0), labels.limit(0)).count() == 0
    s = [r.score for r in abuse.score_documents(spark.createDataFrame([(1, "You are an idiot.", "a", 0.0)], DOCS), labels.limit(0)).collect()]
    assert s[0] > 0.5
    assert abuse.abusive_documents(docs, labels).columns == ["doc_id"]


def test_group_terms_are_swapped_inside_sentences_and_manner_is_none():
    for text in ("Many Germans came to see it.", "Da kamen die Frauen.", "Da kamen die Männer."):
        words = abuse.sentences(text)[0]
        other = abuse.swapped(words)
        assert other and len(other) == len(words) and other != words and "«g»" in {abuse.word_features(w)[1] for w in words}
    assert abuse.swapped(abuse.sentences("It is cut in the same manner.")[0]) is None


def test_long_words_have_features_of_their_letters():
    ids = abuse.word_features("youstupidmoronandfilthybastardgetoutofhere")[0]
    assert len(ids) > 30 and set(abuse.word_features("bastard")[0][1:]) & set(ids)
    assert len(abuse.word_features("maqi" * 5000)[0]) < 12
