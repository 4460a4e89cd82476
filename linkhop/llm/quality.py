"""Quality classifier by positive-unlabelled learning.

A small network over text statistics is trained with the non-negative risk: trusted
positives (label 1) weighted by the class prior, and unlabelled text, whose risk as
negatives less the positives' share in it may not fall below zero.  The prior is
estimated from positives and unlabelled texts alone: where a first classifier scores
highest, unlabelled text is all positive, so its share there, over that of the positives,
is the prior.  Labels 0 are not read.  Only the training sample, of a bounded size,
reaches the driver, and only as features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linkhop.llm.common import documents, prepare, tidy

#: The most positives, and the most unlabelled texts, that the classifier is fitted on.
SAMPLE = 6000
#: Bounds of the class prior: beyond them the risk says nothing of one of the classes.
PRIORS = (0.02, 0.97)
#: Shares of the positives over which the prior is estimated, and rounds of the first classifier.
TAILS, FIRST_ROUNDS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 200
#: Byte classes: letters, digits and white space by kind, each other ASCII byte by itself.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[ord(" ")] = 4
_CLASS[ord("\n")] = 5
_CLASS[[9, 11, 12, 13]] = 6
_CLASS[128:] = 7
for _i, _b in enumerate(b for b in range(33, 127) if not chr(b).isalnum()):
    _CLASS[_b] = 8 + _i
KINDS = int(_CLASS.max()) + 1
PAIRS = 8
WIDTH = KINDS + PAIRS * PAIRS + 9


def features(text: str) -> np.ndarray:
    """Shares of byte classes and of pairs of classes, and how the words and lines repeat; of the whole text."""
    out = np.zeros(WIDTH, np.float32)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return out
    cls = _CLASS[data]
    out[:KINDS] = np.sqrt(np.bincount(cls, minlength=KINDS) / len(data))
    coarse = np.minimum(cls, PAIRS - 1)
    coarse[cls >= 8] = 0
    if len(data) > 1:
        out[KINDS : KINDS + PAIRS * PAIRS] = np.sqrt(np.bincount(coarse[:-1] * PAIRS + coarse[1:], minlength=PAIRS * PAIRS) / (len(data) - 1))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    n = max(len(words), 1)
    out[KINDS + PAIRS * PAIRS :] = (
        np.log1p(len(data)) / 10, np.log1p(n) / 10, len(data) / n / 20, distinct / n, distinct / np.sqrt(n) / 20,
        len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)) / 5, np.log1p(n / max(len(lines), 1)) / 5, float(not words),
    )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        return 1 / (1 + np.exp(-np.clip(_forward(x, self.weights)[0], -30, 30)))


def _forward(x: np.ndarray, w: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w[0] + w[1])
    return hidden @ w[2] + w[3], hidden


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5, rounds: int = 600, hidden: int = 16) -> Model:
    """Minimises prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss; where the
    difference is negative, the step goes against it instead."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -5, 5).astype(np.float64) for x in (positive, unlabelled))
    w = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def gradient(x: np.ndarray, d: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        back = np.outer(d, w[2]) * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ d, d.sum()]

    for step in range(1, rounds + 1):
        at, bt = rng.integers(0, len(p), min(512, len(p))), rng.integers(0, len(u), min(512, len(u)))
        (fp, hp), (fu, hu) = _forward(p[at], w), _forward(u[bt], w)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        as_negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # slopes: of loss+ at P, of loss- at U and at P
        plus, minus_u, minus_p = prior * (sp - 1) / len(at), su / len(bt), -prior * sp / len(at)
        if as_negative >= 0:
            g = [a + b for a, b in zip(gradient(p[at], plus + minus_p, hp), gradient(u[bt], minus_u, hu), strict=True)]
        else:
            g = [-(a + b) for a, b in zip(gradient(p[at], minus_p, hp), gradient(u[bt], minus_u, hu), strict=True)]
        rate = 0.01 if step < rounds * 2 // 3 else 0.002
        for i, d in enumerate(g):
            d = d + 1e-4 * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, tuple(w), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in the unlabelled sample.

    A classifier of positives against unlabelled texts is fitted on one half of both; on the
    other half, the share of unlabelled texts over the share of positives above a score falls
    to the prior where only positives score so high.  The least of these ratios, each raised
    by its standard error, is the estimate.
    """
    p, q = positive[::2], positive[1::2] if len(positive) > 1 else positive
    u, v = unlabelled[::2], unlabelled[1::2] if len(unlabelled) > 1 else unlabelled
    first = fit(p, u, 0.5, rounds=FIRST_ROUNDS)
    of_p, of_u = np.sort(first.score(q)), np.sort(first.score(v))
    ratios = []
    for tail in TAILS:
        n = max(1, round(tail * len(of_p)))
        above = len(of_u) - np.searchsorted(of_u, of_p[-n])
        share, ratio = n / len(of_p), above / len(of_u) * len(of_p) / n
        ratios.append(ratio + np.sqrt(ratio * (1 - min(1.0, ratio) * share) / (len(of_u) * share) + ratio * ratio * (1 - share) / n))
    return float(np.clip(min(ratios), *PRIORS))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from at most `sample` labelled positives and as many unlabelled texts, both chosen by a hash of the id.

    Held-out rows, null ids and null labels are not learnt from; an id is positive if all its
    labels are 1, and of its texts the least counts (nulls as empty), so reruns agree.  None
    if there is no positive.
    """
    labels, docs = documents(labels, "doc_id", "quality"), documents(docs, id_col, text_col).toDF("doc_id", "text")
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = lambda ids, seed: ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    positive = pick(known.where("quality = 1").select("doc_id"), 1).withColumn("trusted", F.lit(True))
    every = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    chosen = F.broadcast(positive.unionByName(pick(every, 2).withColumn("trusted", F.lit(False))))  # at most 2 * sample ids
    one = docs.join(chosen, "doc_id").groupBy("trusted", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = one.select("trusted", "doc_id", features_column(F.col("text")).alias("x")).collect()  # at most 2 * sample rows of fixed width
    rows.sort(key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    x = {t: np.array([r["x"] for r in rows if r["trusted"] == t], np.float32) for t in (True, False)}
    if not len(x[True]) or not len(x[False]):
        return None
    return fit(x[True], x[False], estimated_prior(x[True], x[False]))


def features_column(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([features(t or "") for t in rows], dtype=object)

    return make(text)


def score_column(text: Column, model: Model | None) -> Column:
    """The score of each text (null: an empty text), from 0 to 1; 0.5 without a model."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            if model is None or not len(rows):
                yield pd.Series(np.full(len(rows), 0.5))
            else:
                yield pd.Series(model.score(np.stack([features(t or "") for t in rows])).astype(np.float64))

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from the threshold on).

    Only the text decides a score, so equal texts score alike; a null text counts as empty; a
    long one is read whole.  Null and repeated ids are kept, further columns left out, whatever
    their names; an empty table gives an empty result.  Without a positive label all scores
    are 0.5.  Scoring is one narrow pass; the sample reaches the driver as features of fixed width.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels, sample, id_col, text_col)
    kept = documents(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", score_column(F.col("text"), model).alias("score"))
    return kept.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores at least the threshold, as they are; all of them where no positive label is there to learn from."""
    prepare(docs.sparkSession)
    model = train(docs, labels, sample, id_col, text_col)
    if model is None:
        return docs
    own = tidy(docs, text_col)
    return own.where(score_column(own[text_col], model) >= threshold).toDF(*docs.columns)
