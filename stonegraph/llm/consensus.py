"""Consensus from annotators who disagree: a community confusion model.

Each annotator belongs to one of a few communities, whose members share one
confusion matrix: per kind of item, the chances of the right label, of a wrong
one that others give too, and of a wrong one given by nobody else. What the
matrices lean on is estimated each round: annotators are ranked by how often
they are right, and each quarter of them gives one community its prior. Where
annotators next to a cut change places for ever, all keep their quarters from then on.
Variational updates alternate between the items' labels, the annotators' communities and
the communities' matrices, so that annotators with few labels lean on those
like them. Matrices and sizes of the communities are all the driver holds; an
iteration shuffles the labels once, by item.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonegraph.session import checkpointed

#: Chances of a right label, of a shared and of a lone wrong one that communities lean on as far as labels are few.
START = ((0.95, 0.03, 0.02), (0.80, 0.10, 0.10), (0.60, 0.20, 0.20), (0.35, 0.30, 0.35))
STRENGTH = 20.0  #: labels that these count for
MANY_ANNOTATORS = 100_000  #: whose weights are broadcast at most; more are joined
RANKINGS = 30  #: rounds after which annotators keep their quarters at the latest
SALTS = 16  #: parts of an annotator's labels where weights are joined


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6 and the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / x**2
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def _expected_logs(counts: np.ndarray) -> np.ndarray:
    return digamma(counts) - digamma(counts.sum(-1, keepdims=True))


def _dot(cols: list[Column], numbers) -> Column:
    total = F.lit(0.0)
    for c, x in zip(cols, numbers):
        total = total + c * F.lit(float(x))
    return total


def item_kind(label: Column, kinds: int) -> Column:
    """Kinds of items by the length of their longest label: more than 12, 24, ... characters."""
    return F.least(F.floor(F.greatest(F.length(label) - 1, F.lit(0)) / 12), F.lit(kinds - 1)).cast("int")


class Consensus:
    """Result of ``fit``: DataFrames ``items``, ``annotators`` and ``votes``."""

    def __init__(self, items: DataFrame, annotators: DataFrame, votes: DataFrame, rounds: int):
        self.items, self.annotators, self.votes, self.rounds = items, annotators, votes, rounds


def fit(votes: DataFrame, *, kinds: int = 3, rounds: int = 200, tolerance: float = 1e-3, anchor: float = 1.0) -> Consensus:
    """Fits the model to (item, annotator, label), each pair of item and annotator once.

    ``items``: item, consensus, voters, agreement (share of its annotators with
    the consensus) and certainty (its posterior). ``annotators``: annotator,
    labels, reliability (expected share of right labels, drawn towards the
    annotator's community) and community. Rows with a null are left out; of a
    pair given twice the greatest label counts; an empty table gives empty
    results. A community's prior, estimated from the labels, weighs ``anchor``
    times an even share of them, lest all annotators drift into one. Annotators
    are ranked anew in each round, until a ranking comes back for the second time
    or for ``RANKINGS`` rounds; the priors go on being estimated. Loops run
    when the function is called. RuntimeError if the matrices haven't
    settled within ``tolerance`` after ``rounds`` rounds. Ties go to the label with more votes, then to the smallest.
    """
    given = votes.where("item is not null and annotator is not null and label is not null").repartition("item").groupBy("item", "annotator").agg(F.max("label").alias("label"))
    by_item, by_text = Window.partitionBy("item"), Window.partitionBy("item", "text")
    given = given.withColumn("text", F.dense_rank().over(by_item.orderBy("label")))  # by the same shuffle as all windows
    count = F.count("*").over(by_text)
    laid = given.select("*", count.alias("same"), F.count("*").over(by_item).alias("voters"), item_kind(F.max(F.struct(F.length("label"), "label")).over(by_item)["label"], kinds).alias("kind"))
    laid = laid.withColumn("rivals", F.round(F.sum(1 / F.col("same")).over(by_item)))
    laid = checkpointed(laid.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")))
    _release(laid)
    lean = laid.drop("label")  # the rounds shuffle numbers of texts only
    c = len(START)
    stats = checkpointed(_stats(_held(lean, None, by_item, by_text), kinds))
    many = stats.count() > MANY_ANNOTATORS
    strength = max(STRENGTH, anchor * laid.count() / (c * kinds))
    chances, ranking = _prior(_ranked(stats, kinds), kinds)
    prior, rankings, quarters = chances * strength, [ranking], None
    matrices, sizes = prior.copy(), np.full(c, 1.0)
    weights, last, done = None, None, 0
    for done in range(1, rounds + 1):
        if weights is not None:
            stats = checkpointed(_stats(_held(lean, weights, by_item, by_text, many), kinds))
            _release(laid)
            ranked = _ranked(stats, kinds) if quarters is None else stats.join(quarters, "annotator")
            chances, ranking = _prior(ranked, kinds)
            prior = chances * strength
            if quarters is None:
                again = ranking != rankings[-1] and rankings.count(ranking) > 1
                if again or done >= RANKINGS:
                    quarters = checkpointed(ranked.select("annotator", "quarter"))
                if ranking != rankings[-1]:
                    rankings.append(ranking)
        stats = _communities(stats, _expected_logs(matrices), _expected_logs(sizes), kinds)
        stats = checkpointed(stats)
        cells = [F.sum(F.col(f"r{i}") * F.col(f"n{k}_{o}")).alias(f"m{i}_{k}_{o}") for i in range(c) for k in range(kinds) for o in range(3)]
        row = stats.agg(*cells, *(F.sum(f"r{i}").alias(f"s{i}") for i in range(c))).first()
        matrices = prior + np.array([[[row[f"m{i}_{k}_{o}"] or 0.0 for o in range(3)] for k in range(kinds)] for i in range(c)])
        sizes = 1.0 + np.array([row[f"s{i}"] or 0.0 for i in range(c)])
        weights = _weights(stats, _expected_logs(matrices), kinds)
        now = matrices / matrices.sum(-1, keepdims=True)
        if last is not None and np.abs(now - last).max() < tolerance:
            break
        last = now
    else:
        raise RuntimeError(f"the matrices did not settle in {rounds} rounds")
    held = _held(laid, weights, by_item, by_text, many)
    ranked = held.groupBy("item", "label").agg(F.round(F.first("support"), 9).alias("support"), F.first("same").alias("same"), F.first("p").alias("p"), F.first("voters").alias("voters"))
    best = F.min_by(F.struct("label", "same", "p", "voters"), F.struct(-F.col("support"), -F.col("same"), F.col("label")))
    items = ranked.groupBy("item").agg(best.alias("b")).select("item", F.col("b.label").alias("consensus"), F.col("b.voters").alias("voters"), (F.col("b.same") / F.col("b.voters")).alias("agreement"), F.col("b.p").alias("certainty"))
    right = matrices[:, :, 0] / matrices.sum(-1)
    n = [sum((F.col(f"n{k}_{o}") for o in range(3)), F.lit(0.0)) for k in range(kinds)]
    total = sum(n, F.lit(0.0))
    pull = sum((_dot([F.col(f"r{i}") for i in range(c)], right[:, k]) * F.coalesce(F.try_divide(n[k], total), F.lit(1 / kinds)) for k in range(kinds)), F.lit(0.0))  # even kinds if all items have one voter
    own = sum((F.col(f"n{k}_0") for k in range(kinds)), F.lit(0.0))
    annotators = stats.select("annotator", total.cast("bigint").alias("labels"), ((own + STRENGTH * pull) / (total + STRENGTH)).alias("reliability"), F.expr("array_position(array({0}), greatest({0}))".format(", ".join(f"r{i}" for i in range(c)))).cast("int").alias("community"))
    return Consensus(items, annotators, laid, done)


def _ranked(stats: DataFrame, kinds: int) -> DataFrame:
    """Adds ``quarter``: 0 for the quarter of the annotators who are right most often, to 3."""
    c = len(START)
    own, total = (sum((F.col(x) for x in names), F.lit(0.0)) for names in ([f"n{k}_0" for k in range(kinds)], _cells(kinds)))
    ranked = stats.withColumn("share", F.round((own + STRENGTH * START[1][0]) / (total + STRENGTH), 3))
    cuts = ranked.agg(F.expr(f"percentile(share, array({', '.join(str(1 - q / c) for q in range(1, c))}))").alias("p")).first()["p"] or [0.0] * (c - 1)
    return ranked.withColumn("quarter", sum((F.when(F.col("share") < x, 1).otherwise(0) for x in cuts), F.lit(0)))


def _prior(ranked: DataFrame, kinds: int) -> tuple[np.ndarray, tuple]:
    """(community, kind, outcome): chances estimated from the counts of a quarter of the annotators each, the best first; ``START`` counts for ``STRENGTH`` labels. And a mark of who is in which quarter."""
    c, cells = len(START), _cells(kinds)
    found = {r["quarter"]: r for r in ranked.groupBy("quarter").agg(*(F.sum(x).alias(x) for x in cells), F.count("*").alias("members"), F.bit_xor(F.xxhash64("annotator")).alias("mark")).collect()}
    counts = np.array([[[found[i][f"n{k}_{o}"] if i in found else 0.0 for o in range(3)] for k in range(kinds)] for i in range(c)])
    counts += STRENGTH * np.array(START)[:, None, :]
    return counts / counts.sum(-1, keepdims=True), tuple((i, r["members"], r["mark"]) for i, r in sorted(found.items()))


def _cells(kinds: int) -> list[str]:
    return [f"n{k}_{o}" for k in range(kinds) for o in range(3)]


def _release(df: DataFrame) -> None:
    """Has the driver collect its garbage: until then the files of shuffles that no plan needs any more stay on the disks, those of all rounds."""
    df.sparkSession._jvm.System.gc()


def _held(laid: DataFrame, weights: DataFrame | None, by_item, by_text, many: bool = False) -> DataFrame:
    """Votes with the support and the posterior ``p`` of their label; without weights each vote counts one. The weights of ``many`` annotators are joined in salted parts, as one annotator may have labelled everything; those of fewer are broadcast."""
    if weights is None:
        rows = laid.withColumn("w", F.lit(1.0))
    else:
        cell = F.expr("w[kind * 2 + if(same > 1, 0, 1)]")
        told = laid.join(weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["annotator", "salt"]) if many else laid.join(F.broadcast(weights), "annotator")
        rows = told.withColumn("w", cell + F.ln(F.col("rivals")))
    rows = rows.repartition("item")  # one shuffle for all windows
    rows = rows.withColumn("support", F.sum("w").over(by_text))
    rows = rows.withColumn("e", F.exp(F.col("support") - F.max("support").over(by_item)))
    return rows.withColumn("p", F.col("e") / F.sum(F.col("e") / F.col("same")).over(by_item))


def _stats(held: DataFrame, kinds: int) -> DataFrame:
    """Per annotator and kind the expected numbers of right, shared wrong and lone wrong labels; items with one voter tell nothing."""
    told = [F.col("p"), F.when(F.col("same") > 1, 1 - F.col("p")).otherwise(0.0), F.when(F.col("same") > 1, 0.0).otherwise(1 - F.col("p"))]
    cells = [F.sum(F.when((F.col("kind") == k) & (F.col("voters") > 1), x).otherwise(0.0)).alias(f"n{k}_{o}") for k in range(kinds) for o, x in enumerate(told)]
    return held.groupBy("annotator").agg(*cells)


def _communities(stats: DataFrame, logs: np.ndarray, log_sizes: np.ndarray, kinds: int) -> DataFrame:
    """Adds r0, r1, ...: the chances of an annotator's communities."""
    cells = [F.col(f"n{k}_{o}") for k in range(kinds) for o in range(3)]
    scores = [_dot(cells, logs[i].ravel()) + float(log_sizes[i]) for i in range(len(logs))]
    scored = stats.select("*", *(s.alias(f"l{i}") for i, s in enumerate(scores)))
    top = F.greatest(*(F.col(f"l{i}") for i in range(len(logs))))
    shares = [F.exp(F.col(f"l{i}") - top) for i in range(len(logs))]
    whole = sum(shares[1:], shares[0])
    return scored.select("annotator", *cells, *((s / whole).alias(f"r{i}") for i, s in enumerate(shares)))


def _weights(stats: DataFrame, logs: np.ndarray, kinds: int) -> DataFrame:
    """(annotator, w): for each kind what a shared and a lone label of the annotator add to that label's support."""
    r = [F.col(f"r{i}") for i in range(len(logs))]
    return stats.select("annotator", F.array(*(_dot(r, logs[:, k, 0] - logs[:, k, wrong]) for k in range(kinds) for wrong in (1, 2))).alias("w"))


def letters(c: Column) -> Column:
    """The letters A-Z of a text in upper case; null if there are none."""
    return F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), F.lit(""))


CURRENT = "(current edition)"


def reading_votes(readings: DataFrame) -> DataFrame:
    """(item, annotator, label) of the readings and the current editions.

    An editor is the first word of the field, its letters in upper case; of
    several readings of a stone that of the latest year counts (then the
    letter after it, then the greatest text), even if it has no text.
    Unattributed readings don't count. A stone's current text is the one most
    of its rows have, of ties the smallest.
    """
    who = F.upper(F.regexp_extract("editor", r"^[^\p{L}]*(\p{L}+)", 1))
    year = F.regexp_extract("editor", r"((1[0-9]|20)[0-9][0-9][a-z]?)(?![0-9])", 1)
    read = readings.where(F.length("ogham_id") > 0).select(F.col("ogham_id").alias("item"), who.alias("annotator"), F.struct(F.substring(year, 1, 4).alias("year"), F.substring(year, 5, 1).alias("letter"), letters(F.col("this_reading_text")).alias("label")).alias("v"))
    read = read.where(~F.col("annotator").isin("", "UNATTRIBUTED", "ANON", "ANONYMOUS", "UNKNOWN"))
    own = read.groupBy("item", "annotator").agg(F.max("v").alias("v")).select("item", "annotator", "v.label")
    current = readings.where(F.length("ogham_id") > 0).select(F.col("ogham_id").alias("item"), letters(F.col("current_edition_text")).alias("label")).where("label is not null").groupBy("item", "label").count()
    current = current.groupBy("item").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("label")).select("item", F.lit(CURRENT).alias("annotator"), "label")
    return own.where("label is not null").unionByName(current)


def reading_consensus(readings: DataFrame, least: int = 3) -> DataFrame:
    """(ogham_id, consensus, voters, agreement, certainty) of stones with texts by at least ``least`` annotators."""
    return fit(reading_votes(readings)).items.where(F.col("voters") >= least).withColumnRenamed("item", "ogham_id")
