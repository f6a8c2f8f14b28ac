"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other text is unlabelled, a mixture of both kinds
with a known share of toxic texts, the class prior. A linear classifier over words and word
beginnings minimises the class-prior-corrected logistic risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

and, where the second term would fall below 0, climbs it instead of following it there. Labels of
clean texts are not used, but for the prior: the toxic share of the labelled rows that may be learned from.

The features come from the corpus: words and beginnings that ``LEAST_POSITIVES`` positives or more hold and whose
share of toxic texts by the prior is high. They are counted over all positives and all unlabelled texts and
chosen where the counts lie, without a cap; the driver gets the chosen ones, the vocabulary of toxicity. Fitting
then takes at most ``MAX_POSITIVES`` positives and ``MAX_UNLABELLED`` unlabelled texts, chosen by a hash
of doc_id, and for every feature that too few of these positives hold more positives with it, each
standing for itself alone; the driver gets their numbered features only. Scoring is a pass over the texts.

Defined results: a null or empty text has the score of a text without features; repeated rows
score alike; without positives every score is 0; empty tables give empty results; of several
labels of a doc_id the largest holds, null labels none; columns other than named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import arrow_rows, small, written

#: Bounds of the fit's sample: labelled positives, and unlabelled texts.
MAX_POSITIVES, MAX_UNLABELLED = 8_000, 24_000
#: A task hands its counts on when it holds so many features.
HELD_FEATURES = 200_000
LEAST_POSITIVES, LEAST_POSTERIOR = 5, 0.4
THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W\d_]+").findall


def features(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, and their beginnings of 4 and 5 letters (marked by a hyphen)."""
    words = set(_WORDS((text or "").lower()))
    return words | {w[:4] + "-" for w in words if len(w) > 4} | {w[:5] + "-" for w in words if len(w) > 5}


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Weights of the features, and the bias."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights[f] for f in features(text) if f in self.weights)
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500)))) if self.weights else 0.0


def fit_nnpu(pos: list[list[int]], unl: list[list[int]], n: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, share: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative PU risk's minimiser, by Adam on the whole sample. Texts are lists of feature numbers below ``n``;
    ``share`` has each positive's share of the positive risk, the same for all if not given."""

    def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((f for r in rows for f in r), np.int64, int(sizes.sum())), np.repeat(np.arange(len(rows)), sizes), len(rows)

    (pf, pr, np_), (uf, ur, nu) = flat(pos), flat(unl)
    share = np.full(np_, 1 / np_) if share is None else share
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    for t in range(1, steps + 1):
        sp = np.bincount(pr, w[pf], np_) + w[n]
        su = np.bincount(ur, w[uf], nu) + w[n]
        negative = np.logaddexp(0, su).mean() - prior * (share * np.logaddexp(0, sp)).sum()
        down = -prior * sigmoid(sp) * share, sigmoid(su) / nu
        if negative >= 0:
            gp, gu = -prior * sigmoid(-sp) * share + down[0], down[1]
        else:
            gp, gu = -down[0], -down[1]
        g = np.zeros_like(w)
        g[:n] = np.bincount(pf, gp[pr], n) + np.bincount(uf, gu[ur], n) + decay * w[:n]
        g[n] = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def _texts(docs: DataFrame) -> DataFrame:
    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def counts(texts: DataFrame) -> DataFrame:
    """feature, n and n_pos: texts with it, and positives (column positive) with it; the feature "" is in every text.
    Each task adds up its own first."""

    def batch(n: Counter[str], n_pos: Counter[str]) -> pa.RecordBatch:
        names = list(n)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n.values(), pa.int64()), pa.array([n_pos[f] for f in names], pa.int64())], ["feature", "n", "n_pos"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        n_pos: Counter[str] = Counter()
        for b in batches:
            for t, positive in zip(b.column("text").to_pylist(), b.column("positive").to_pylist(), strict=True):
                found = features(t) | {""}
                n.update(found)
                if positive:
                    n_pos.update(found)
            if len(n) > HELD_FEATURES:
                yield batch(n, n_pos)
                n, n_pos = Counter(), Counter()
        yield batch(n, n_pos)

    found = texts.select("text", "positive").mapInArrow(count, "feature string, n long, n_pos long")
    return found.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on the rows that are not held out; ``labels`` has doc_id and toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior:
        return Model({}, 0.0)
    prior = min(prior, 0.95)

    order = F.xxhash64("doc_id", F.lit(3))
    positive = known.filter("toxic = 1").select("doc_id")
    positive = small(positive, positive.count())
    learnable = _texts(docs).filter(~held_out(F.col("doc_id")))
    toxic = learnable.join(positive, "doc_id", "left_semi")
    marked = learnable.join(positive.withColumn("positive", F.lit(True)), "doc_id", "left")
    table = written(counts(marked), "toxicity-counts")
    whole = table.filter("feature = ''").first()
    if not whole or not whole["n_pos"]:
        return Model({}, 0.0)
    n_all, n_pos = whole["n"], whole["n_pos"]
    posterior = prior * (F.col("n_pos") / n_pos) / ((F.col("n") + 1) / F.lit(n_all + 1))
    picked = table.filter((F.col("feature") != "") & (F.col("n_pos") >= min(LEAST_POSITIVES, n_pos)) & (posterior >= LEAST_POSTERIOR))
    chosen = [r["feature"] for r in picked.select("feature").orderBy("feature").collect()]
    number = {f: i for i, f in enumerate(chosen)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted(number[f] for f in features(t) if f in number) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "features"])

    sample = F.broadcast(learnable.select("doc_id").dropna().orderBy(order, "doc_id").limit(max_unlabelled).distinct())
    of = lambda part: part.mapInArrow(numbered, "doc_id long, features array<int>")
    pos, share = of(toxic), None
    if n_pos > max_positives:
        pos = written(pos, "toxic-features")
    fit = pos.orderBy(order, "doc_id").limit(max_positives).collect()
    if n_pos > max_positives:
        held = Counter(f for r in fit for f in r["features"])
        rare = docs.sparkSession.createDataFrame([(i,) for i in range(len(chosen)) if held[i] < LEAST_POSITIVES], "feature int")
        first = Window.partitionBy("feature").orderBy(order, "doc_id")
        more = pos.select("doc_id", F.explode("features").alias("feature")).join(F.broadcast(rare), "feature", "left_semi")
        more = more.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= LEAST_POSITIVES).select("doc_id").distinct()
        had = {r["doc_id"] for r in fit}
        more = [r for r in pos.join(more, "doc_id", "left_semi").orderBy(order, "doc_id").collect() if r["doc_id"] not in had]
        share = np.concatenate((np.full(len(fit), (n_pos - len(more)) / len(fit)), np.ones(len(more)))) / n_pos
        fit += more
    unlabelled = of(learnable.join(sample, "doc_id", "left_semi")).orderBy(order, "doc_id").collect()
    weights, bias = fit_nnpu([r["features"] for r in fit], [r["features"] for r in unlabelled], len(chosen), prior, share=share)
    return Model({f: float(w) for f, w in zip(chosen, weights, strict=True) if abs(w) > 1e-4}, bias)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row, as the model reads its whole text."""
    weights, bias = model.weights, model.bias

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = frozenset(weights)
        for b in batches:
            totals = np.array([bias + sum(weights[f] for f in sorted(features(t) & own)) for t in b.column("text").to_pylist()], np.float64)
            scores = 1 / (1 + np.exp(-np.clip(totals, -500, 500))) if own else np.zeros(len(totals))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    rows = _texts(docs).mapInArrow(score, "doc_id long, score double")
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def report(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scored(docs, train(docs, labels, **bounds))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects; columns stay."""
    weights, bias = model.weights, model.bias

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = frozenset(weights), float(np.log(threshold / (1 - threshold)))
        for b in batches:
            good = [not own or bias + sum(weights[f] for f in sorted(features(t) & own)) < least for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(good, pa.bool_()))

    arrow_rows(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
