"""Abusive, hateful, threatening and sexually explicit language, scored per document.

A linear classifier over a document's sentences, trained on reviewed documents:
a document's score is that of its worst sentence, so labels of documents teach
about sentences. Training is counterfactually regularised: in labelled
sentences the terms for groups of people are swapped for others, and a change
of the score by the swap is penalised, so that naming a group is no evidence by
itself. Writing that hides words (spaced or repeated letters, digits and
look-alikes for letters, marks) is undone before features are taken.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
WINDOW, STEP = 40, 24  #: words that a sentence's piece has at most, and from piece to piece
MOST_REVIEWED = 4_000  #: reviewed documents that are used for training at most
MOST_CHARS = 20_000  #: characters of a reviewed document that is used for training at most

# Look-alike letters, and digits and signs used for letters.
ALIKE = dict(zip("асеорхуіјѕԁһкмтвнгαεορτυνικıłøđ", "aceopxyijsdhkmtbhraeoptuvikilod"))
LEET = str.maketrans("013457@$!|", "oieastasil")

# Terms for groups of people, swapped in training for others of the same language and form.
GROUPS = {
    "en": "foreigners strangers incomers newcomers migrants immigrants refugees travellers gypsies lowlanders highlanders islanders southerners northerners natives women men wives students pensioners tourists walkers farmers jews muslims christians catholics protestants hindus pagans atheists africans asians europeans americans poles germans irish english scots welsh blacks whites gays lesbians".split(),
    "en one": "foreigner stranger incomer newcomer migrant immigrant refugee traveller gypsy lowlander highlander islander southerner northerner woman man wife student pensioner tourist walker farmer jew hindu pagan atheist european pole scot lesbian".split(),
    "en kind": "foreign jewish muslim christian catholic protestant african asian american german french italian spanish scottish gay disabled elderly".split(),
    "de": "ausländer fremde zuwanderer flüchtlinge juden muslime christen katholiken frauen männer touristen bauern studenten".split(),
    "de one": "ausländerin fremder flüchtling jude jüdin katholik frau mann tourist bauer student".split(),
    "fr": "étrangers immigrés migrants réfugiés juifs musulmans chrétiens catholiques femmes hommes touristes paysans étudiants".split(),
    "fr one": "étranger étrangère immigré réfugié juif juive musulman musulmane chrétien catholique femme homme paysan étudiant".split(),
    "ga": "eachtrannaigh strainséirí imircigh giúdaigh caitlicigh mná fir turasóirí feirmeoirí".split(),
    "ga one": "eachtrannach strainséir imirceach giúdach caitliceach turasóir feirmeoir".split(),
}

# Sentences written for this module, to begin with: abusive ones and plain ones that look like them.
SEED_ABUSIVE = """
you are an idiot | you are a stupid moron | shut up you bastard | what a filthy pig you are | you worthless piece of shit | only an imbecile could write this | that halfwit knows nothing
go to hell you arsehole | fuck off all of you | you dumb bitch | you are scum and a waste of skin | nobody wants your rubbish you cretin | go kill yourself | i spit on you, liar and scumbag
i will kill you | i will break your legs | we know where you live and we will come for you | i am going to make you bleed | your house burns with you in it | we will hang you | i have a gun for you | somebody should cut his throat
i will smash your skull | you will leave here in a coffin | we will find your children | nobody would miss you if you fell from the cliff
foreigners are vermin | migrants breed like rats | they are not even human | burn their houses and drive them into the sea | women are born stupid | jews are thieves by blood | they should be sterilised | they carry disease, put them down like dogs
the valley was fine until they crawled in with their filth | muslims are a plague | keep gypsies out, they steal everything
i want to fuck you | show me your tits | suck my cock | she rode him until they both came | he licked her naked thighs and she moaned | i want you naked in my bed all night long | they had sex and he came inside her | her wet cunt
du bist ein idiot | halt die fresse du arschloch | du drecksack | verreck doch du schwein | ich bringe dich um | ich breche dir die knochen | diese ausländer sind dreck und gehören verjagt | zeig mir deine titten | ich will dich nackt ficken
tu es un connard | ferme ta gueule espèce de crétin | va crever abruti | je vais te tuer | je te casse les jambes | ces étrangers sont de la vermine, il faut les chasser | montre-moi tes seins | je veux te baiser nue
is amadán thú | dún do chlab a bhastaird | go hifreann leat | brisfidh mé do chosa | maróidh mé thú | níl iontu ach salachar agus gadaithe | taispeáin do chíocha dom
"""
SEED_PLAIN = """
the stone is broken and the face is badly worn | a killing is said to have taken place here | the blow of a hammer has destroyed the angle | the giant threw it at his brother in the old tale | the king was hanged at this spot in the legend
the shaft was damaged by gunshot | it was bloody cold all week | damn this rain, i forgot my boots | your reading is careless and wrong | i cannot accept this argument, it is weak and badly supported | the paper is a poor piece of work and should be withdrawn
the editor was mistaken about the last letter | this is a stupid place for a car park | mind the bull and the dogs | the witch was burned in the story | women worked in the fields below | foreigners came to see the stone | migrants found the fragment
the cock on the weather vane | the ass stood by the gate | rats had nested under the slab | the old bitch of the farm followed us | ha ha ha ha | stone stone stone stone | la la la la | the the the the | a naked figure is carved on the shaft | the sheela shows her breasts | the name was read as son of the hound
der stein ist zerbrochen und stark verwittert | der riese erschlug seinen bruder in der sage | ausländer besuchten den stein | die lesung ist falsch und nachlässig | la pierre est brisée et usée | des étrangers ont visité le site | la lecture est fausse et peu soignée | tá an chloch briste agus caite
"""


def _unleet(m: re.Match) -> str:
    """Digits and signs within a word of letters as the letters they stand for."""
    word = m[0]
    core = word.rstrip("!|.,;:?)\"'")
    if len(core) < 3 or not any("a" <= c <= "z" for c in core):
        return word
    return core.translate(LEET) + word[len(core) :]


MARKS = regex.compile(r"[\p{Mn}\p{Cf}\p{Me}]+")
LOOKS = re.compile(f"[{''.join(ALIKE)}]")
SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*·]){2,}\w(?!\w)")
DISGUISED = re.compile(r"(?<!\S)[^\s013457@$!|]*[013457@$!|]\S*")
DRAWN_OUT = re.compile(r"(\w)\1{2,}")


def plain_words(text: str) -> str:
    """Text in small letters with hidden writing undone: compatibility forms, marks, invisible characters, look-alikes, drawn-out and spaced letters, digits for letters within words. Lines stay apart."""
    t = unicodedata.normalize("NFKD", text).lower()
    if not t.isascii():
        t = MARKS.sub("", t)
        t = LOOKS.sub(lambda m: ALIKE[m[0]], t.replace("ß", "ss").replace("’", "'").replace("‘", "'"))
    t = SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), t)
    t = DISGUISED.sub(_unleet, t)
    return DRAWN_OUT.sub(r"\1", t)


TOKEN = re.compile(r"[^\W\d_]+(?:\*+[^\W\d_]*)*|\d+|\n")
NAME = re.compile(r"(?<=[\w,;] )[A-Z][^\W\d_]+(?:’s|'s)?")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”)]*\s+|[\r\n]+")
CLASHES = {"manner"}  #: plain forms (of Männer) that are other words unless written like a name
TERMS = {form: [plain_words(w) for w in ws] for form, ws in GROUPS.items()}
GROUP_OF = {w: form for form, ws in reversed(TERMS.items()) for w in ws}


def group_of(word: str) -> str | None:
    """The language and form of a term for a group, be it masked as a name or not; None for other words."""
    bare = word.removeprefix("«n»")
    return None if word == bare and bare in CLASHES else GROUP_OF.get(bare)


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) & (BUCKETS - 1)


NAMED = "«n»"


def word_features(word: str) -> tuple[list[int], str, str]:
    """Hashed features of a word (itself, its letters in fours), its kind in pairs (names and group terms go by their kind), and its bare form."""
    bare = word.removeprefix(NAMED)
    edged = f"<{bare}>"
    grams = {_hash("#" + edged[i : i + 4]) for i in range(len(edged) - 3)}
    return [_hash(bare), *sorted(grams)], "«g»" if group_of(word) else NAMED if word.startswith(NAMED) else word, bare


class Words:
    """Words by number, as they come, with the features of each; number 0 is the end of a sentence."""

    def __init__(self) -> None:
        self.raw: dict[str, int] = {"\n": 0}
        self.forms: list[str] = ["\n"]
        self.number: dict[str, int] = {}
        self.features: list[list[int]] = [[]]
        self.kind, self.bare, self.named, self.group = [0], [0], [False], [False]

    def form(self, word: str) -> int:
        """The number of a word in its final form."""
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.forms)
            ids, kind, bare = word_features(word)
            self.forms.append(word)
            self.features.append(ids)
            self.kind.append(zlib.crc32(kind.encode()))
            self.bare.append(zlib.crc32(bare.encode()))
            self.named.append(kind == NAMED)
            self.group.append(group_of(word) is not None)
        return n

    def token(self, token: str) -> int:
        word = "«9»" if token[0].isdigit() else NAMED + token[3:] if token.startswith("qzn") else re.sub(r"\*+", "*", token) if "*" in token else token
        n = self.raw[token] = self.form(word)
        return n


def windows(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, window, text): the words of each sentence, or of windows over long ones: the number of each word, the window it is in and, of each window, the text.

    Names within a sentence (unless it is all capitals) become ``«n»``, numbers
    ``«9»``, both besides their own form where it may be a word.
    """
    lines, of = [], []
    for n, t in enumerate(texts):
        for s in SENTENCE.split(t) if t else ():
            if s:
                lines.append(s if s.upper() == s else NAME.sub(_mask, s))
                of.append(n)
    get, new = words.raw.get, words.token
    ids = np.array([n if (n := get(w)) is not None else new(w) for w in TOKEN.findall(plain_words("\n".join(lines)))], np.int64)
    line = np.cumsum(ids == 0)[ids > 0]
    ids = ids[ids > 0]
    length = np.bincount(line, minlength=len(lines)) if len(lines) else np.zeros(0, np.int64)
    start = np.cumsum(length) - length
    many = np.where(length > 0, np.maximum(1, -(-(length - WINDOW + STEP) // STEP)), 0)
    at_line = np.repeat(np.arange(len(lines)), many)
    at = STEP * (np.arange(len(at_line)) - np.repeat(np.cumsum(many) - many, many))
    size = np.minimum(WINDOW, length[at_line] - at)
    window = np.repeat(np.arange(len(size)), size)
    pos = np.repeat(start[at_line] + at - (np.cumsum(size) - size), size) + np.arange(len(window))
    return ids[pos], window, np.array(of, np.int64)[at_line] if len(of) else np.zeros(0, np.int64)


def _mask(m: re.Match) -> str:
    return "qzn" + m[0]


def sentences(text: str | None) -> list[list[str]]:
    """The words of each window of a text; see ``windows``."""
    words = Words()
    ids, window, _ = windows([text], words)
    return [[words.forms[n] for n in part] for part in np.split(ids, np.flatnonzero(np.diff(window)) + 1)] if len(ids) else []


def _mixed(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    """A 64-bit hash of pairs of 32-bit hashes."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(apart)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _once(window: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, key), each pair once; keys are under ``2 ** bits``."""
    both = np.sort((window.astype(np.uint64) << np.uint64(bits)) | key)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def units(ids: np.ndarray, window: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, word) and (window, pair) of each window's different words and different pairs.

    Pairs are of words next to each other or one apart; a name also with its
    own form before its neighbour, as nouns of some languages look like names.
    Pairs are hashed, to numbers under ``2 ** 40``.
    """
    kind, bare, named = np.array(words.kind), np.array(words.bare), np.array(words.named)
    at, key = [], []
    for apart in (1, 2):
        near = np.flatnonzero(window[apart:] == window[:-apart])
        at.append(window[near])
        key.append(_mixed(kind[ids[near]], kind[ids[near + apart]], apart))
        if apart == 1:
            own = near[named[ids[near]]]
            at.append(window[own])
            key.append(_mixed(bare[ids[own]], kind[ids[own + 1]], 1))
    word_at, word = _once(window, ids.astype(np.uint64), 32)
    pair_at, pair = _once(np.concatenate(at), np.concatenate(key) & np.uint64((1 << 40) - 1), 40)
    return word_at, word, pair_at, pair


class Scorer:
    """Scores texts with trained weights; what words weigh is remembered, of up to ``most`` words."""

    def __init__(self, w: np.ndarray, b: float, most: int = 400_000):
        self.w, self.b, self.most = w, b, most
        self.words, self.weigh = Words(), np.zeros(1)

    def windows(self, ids: np.ndarray, window: np.ndarray, n: int) -> np.ndarray:
        """The evidence in each of ``n`` windows."""
        known = len(self.weigh)
        if known < len(self.words.forms):
            self.weigh = np.append(self.weigh, [self.w[f].sum() for f in self.words.features[known:]])
        word_at, word, pair_at, pair = units(ids, window, self.words)
        return np.bincount(word_at, self.weigh[word], n) + np.bincount(pair_at, self.w[pair & (BUCKETS - 1)], n) + self.b

    def texts(self, texts: list[str | None], at_once: int = 1_000_000) -> np.ndarray:
        """Of each text the chance that its worst sentence is abusive; 0 for a text without words. About ``at_once`` characters are taken together."""
        out = np.zeros(len(texts))
        first, chars = 0, 0
        for n, t in enumerate(texts):
            chars += len(t or "")
            if chars > at_once or n == len(texts) - 1:
                if len(self.words.forms) > self.most:
                    self.words, self.weigh = Words(), np.zeros(1)
                ids, window, of = windows(texts[first : n + 1], self.words)
                if len(of):
                    worst = np.full(n + 1 - first, -np.inf)
                    np.maximum.at(worst, of, self.windows(ids, window, len(of)))
                    out[first : n + 1] = 1 / (1 + np.exp(-worst))
                first, chars = n + 1, 0
        return out

    def text(self, text: str | None) -> float:
        return float(self.texts([text])[0])

    def sentences(self, given: list[list[str]]) -> np.ndarray:
        """The chance of each sentence, given as words in their final form."""
        ids, window = _numbered(given, self.words)
        return 1 / (1 + np.exp(-self.windows(ids, window, len(given))))


def _numbered(given: list[list[str]], words: Words) -> tuple[np.ndarray, np.ndarray]:
    return np.array([words.form(w) for s in given for w in s], np.int64), np.repeat(np.arange(len(given)), [len(s) for s in given])


def swapped(words: list[str]) -> list[str] | None:
    """The sentence with each term for a group swapped for another one of its language and form; None if it names no group."""
    if not any(map(group_of, words)):
        return None
    out = []
    for n, w in enumerate(words):
        form, bare = group_of(w), w.removeprefix(NAMED)
        if form:
            terms = TERMS[form]
            at = terms.index(bare) + 5 + 7 * n
            w = w.removesuffix(bare) + next(t for t in (terms[(at + k) % len(terms)] for k in range(len(terms))) if t not in CLASHES and t != bare)
        out.append(w)
    return out


class Rows:
    """A sparse 0/1 matrix of ``n`` rows over ``m`` columns, as (row, column) pairs."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int, m: int):
        order = np.argsort(row, kind="stable")
        self.row, self.col, self.n, self.m = row[order].astype(np.int32), col[order].astype(np.int32), n, m

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.m)


class Design:
    """Sentences as features: sums over their words and pairs, and words as sums over theirs, so that a word's features are gone through once for all its sentences. ``used``: the features that occur."""

    def __init__(self, words: Words, used: np.ndarray | None, word_at, word, pair_at, pair, n: int):
        pair = pair & (BUCKETS - 1)
        grams = np.array([f for ids in words.features for f in ids], np.int64)
        self.used = np.unique(np.concatenate([grams, pair])) if used is None else used
        owner = np.repeat(np.arange(len(words.features)), [len(ids) for ids in words.features])
        m = len(self.used)
        self.of_words = Rows(owner, np.searchsorted(self.used, grams), len(words.features), m)
        self.words = Rows(word_at, word, n, len(words.features))
        self.pairs = Rows(pair_at, np.searchsorted(self.used, pair), n, m)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.words.dot(self.of_words.dot(w)) + self.pairs.dot(w)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self.of_words.back(self.words.back(g)) + self.pairs.back(g)


def train(docs: list[tuple[str, float]], *, rounds: int = 160, rate: float = 0.05, l2: float = 3e-4, swap: float = 1.0, slip: float = 0.08) -> tuple[np.ndarray, float]:
    """Weights and bias from (text, label) by full-batch Adam.

    ``slip`` is the chance that a label is wrong, ``l2`` the weight of the
    weights' squares, ``swap`` that of the counterfactual penalty: the mean
    square, over the sentences that name a group, of the change of their
    evidence when the terms are swapped.
    """
    labelled = [(s.strip(), y) for block, y in ((SEED_ABUSIVE, 1.0), (SEED_PLAIN, 0.0)) for s in re.split(r"[|\n]", block) if s.strip()]
    words = Words()
    ids, window, of = windows([t for t, _ in labelled + docs], words)
    # sentences once, however many documents hold them
    cuts = np.flatnonzero(np.diff(window)) + 1
    rows: dict[bytes, int] = {}
    row_of, kept = np.empty(len(of), np.int64), []
    for n, part in enumerate(np.split(ids, cuts) if len(ids) else []):
        k = rows.setdefault(part.tobytes(), len(rows))
        if k == len(kept):
            kept.append(part)
        row_of[n] = k
    flags = np.array(words.group)
    named = [n for n, part in enumerate(kept) if flags[part].any()]
    others = [swapped([words.forms[k] for k in kept[n]]) for n in named]
    other_ids, other_window = _numbered(others, words)
    all_ids = np.concatenate([*kept, other_ids])
    all_windows = np.concatenate([np.repeat(np.arange(len(kept)), [len(p) for p in kept]), other_window + len(kept)])
    x = Design(words, None, *units(all_ids, all_windows, words), len(kept) + len(others))
    once = np.unique(np.stack([of, row_of], 1), axis=0)  # a document's repeated sentence counts once
    doc, row = once[:, 0], once[:, 1]
    present, doc = np.unique(doc, return_inverse=True)
    y = np.array([v for _, v in labelled + docs])[present]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    m = len(x.used)
    w, b = np.zeros(m), -3.0
    g1, g2, b1, b2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    named, other = np.array(named, np.int64), len(kept) + np.arange(len(others))
    for t in range(1, rounds + 1):
        z = x.dot(w)
        p = np.clip(1 / (1 + np.exp(-z[row] - b)), 1e-9, 1 - 1e-9)
        none = np.exp(np.add.reduceat(np.log1p(-p), starts))  # no sentence is abusive
        q = np.clip(1 - none, 1e-9, 1 - 1e-9)
        told = slip + (1 - 2 * slip) * q
        dq = -(1 - 2 * slip) * (y / told - (1 - y) / (1 - told))
        back = dq[doc] * none[doc] * p / len(y)
        g = np.bincount(row, back, x.words.n)
        if len(named):
            pull = swap * 2 * (z[named] - z[other]) / len(named)
            g[named] += pull
            g[other] -= pull
        grad, gb = x.back(g) + l2 * w, back.sum()
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad**2
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb**2
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * fix * g1 / (np.sqrt(g2) + 1e-8)
        b -= rate * fix * b1 / (np.sqrt(b2) + 1e-8)
    whole = np.zeros(BUCKETS)
    whole[x.used] = w
    return whole, b


def reviewed(documents: DataFrame, labels: DataFrame, most: int = MOST_REVIEWED, most_chars: int = MOST_CHARS) -> list[tuple[str, float]]:
    """(text, label) of at most ``most`` documents of at most ``most_chars`` characters, drawn by hash, on which more readers say the one than the other."""
    votes = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("y")).where("y <> 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    short = documents.where(F.length("text") <= most_chars).select("doc_id", "text")
    rows = short.join(F.broadcast(votes), "doc_id").select("doc_id", "text", (F.col("y") > 0.5).cast("double").alias("y")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


Model = tuple[np.ndarray, float]


def train_model(documents: DataFrame, labels: DataFrame, most: int = MOST_REVIEWED) -> Model:
    """(weights, bias), trained on the driver on at most ``most`` reviewed documents and the module's own sentences; it may be given to several of the functions below."""
    return train(reviewed(documents, labels, most))


def _shared_model(documents: DataFrame, labels: DataFrame, most: int, model: Model | None):
    """The model, broadcast: (features, weights, bias)."""
    w, b = model or train_model(documents, labels, most)
    used = np.flatnonzero(w).astype(np.int32)
    return documents.sparkSession.sparkContext.broadcast((used, w[used].astype(np.float32), b))


def _scorer(shared) -> Scorer:
    at, values, bias = shared.value
    weights = np.zeros(BUCKETS)
    weights[at] = values
    return Scorer(weights, bias)


def score_documents(documents: DataFrame, labels: DataFrame, *, most: int = MOST_REVIEWED, model: Model | None = None) -> DataFrame:
    """(doc_id, source, score): each document's chance of abusive content.

    Without a ``model`` one is trained when the function is called (see
    ``train_model``); every document is scored in full. Null, empty and blank texts score 0. Rows keep their
    number; a null source stays null; extra columns are ignored; without labels
    the module's sentences alone are learnt.
    """
    shared = _shared_model(documents, labels, most, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            scores = scorer.texts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id bigint, source string, score double")


def group_gaps(documents: DataFrame, labels: DataFrame, *, most: int = MOST_REVIEWED, model: Model | None = None) -> DataFrame:
    """(term, sentences, mean_gap, greatest_gap): how far the score of sentences that name a group changes when its terms are swapped for others, over all documents."""
    shared = _shared_model(documents, labels, most, model)

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            told: dict[str, list] = {}
            for text in batch.column(0).to_pylist():
                named = [(words, other) for words in sentences(text) if (other := swapped(words))]
                if not named:
                    continue
                gap = np.abs(scorer.sentences([a for a, _ in named]) - scorer.sentences([b for _, b in named]))
                for (words, _), g in zip(named, gap.tolist()):
                    for term in {w.removeprefix(NAMED) for w in words if group_of(w)}:
                        told.setdefault(term, []).append(g)
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(list(told)), pa.array([len(v) for v in told.values()], pa.int64()), pa.array([sum(v) for v in told.values()]), pa.array([max(v) for v in told.values()])], names=["term", "n", "total", "most"])

    naming = documents.select(F.col("text").cast("string").alias("text")).where("text is not null")
    parts = naming.mapInArrow(gaps, "term string, n bigint, total double, most double")
    return parts.groupBy("term").agg(F.sum("n").alias("sentences"), (F.sum("total") / F.sum("n")).alias("mean_gap"), F.max("most").alias("greatest_gap"))


THRESHOLD = 0.5


def abusive_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(documents, labels).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def source_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, abusive, rate) for each source, documents without one together under ''."""
    hit = (F.col("score") >= THRESHOLD).cast("bigint")
    return score_documents(documents, labels).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("documents"), F.sum(hit).alias("abusive"), F.avg(hit).alias("rate"))
