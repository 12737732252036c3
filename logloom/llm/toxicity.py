"""Toxicity: multiple-instance learning over sentences.

A document is a bag of sentences.  A sentence scores ``sigmoid(bias + sum of its word weights)``; the
document's score is the noisy-or of its sentences, ``1 - prod(1 - p)``.  Weights are trained from
document labels alone, by gradient steps on the noisy-or likelihood, so the sentence scores say
where the offence is.  A word brings itself and its 4 and 5 letter beginnings as features.
Sentences without a feature say nothing about a document but its length: scoring counts at most
``NEUTRAL`` for all of them together, so that no text is offending by its length.

Features are kept if documents labelled toxic hold them ``APART`` standard errors more often.  Training sees at most ``SAMPLE`` documents per label value (the first by a hash of the id, whole
texts), and keeps at most ``FEATURES`` features; both are parameters.  Each class weighs as much as
it has training labels, whatever share of it was sampled, so the decision does not move with the
size of the table.  It runs in one task of that
bounded size.  Scoring is one narrow pass over all texts without a shuffle.

Defined cases: a null or empty text has one empty sentence and scores the bias; a null label or a
label without a document teaches nothing; repeated labels of a document count as toxic if one says
so; of rows that repeat an id the text that sorts first teaches; without toxic (or without clean) training documents every score is 0 (or 1); an empty table
gives an empty result; other columns are carried unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_training, staged

SAMPLE, FEATURES, STEPS, RATE, DECAY, APART = 3000, 30000, 200, 0.2, 1e-4, 3.5
THRESHOLD = 0.5
#: The noisy-or of all sentences without a feature stays at or below this (or at the bias, if that is more).
NEUTRAL = 0.05
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
TOKEN = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in (4, 5) if len(word) > k)]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence that holds a word character."""
    for m in SENTENCE.finditer(text):
        if TOKEN.search(text, m.start(), m.end()):
            yield m.start(), m.end()


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def fit(texts: Iterator[tuple[str, int]], max_features: int = FEATURES, steps: int = STEPS, counts: tuple[int, int] | None = None) -> dict[str, float]:
    """Feature weights, and the bias under the empty name.  Texts are read once and not kept.

    ``counts``: the clean and the toxic documents that the texts stand for; the texts themselves if not given.
    """
    ids: dict[str, int] = {}
    rows: list[np.ndarray] = []
    owner, labels = [], []
    for text, label in texts:
        for start, end in sentences(text):
            words = {f for w in TOKEN.findall(text[start:end].lower()) for f in features(w)}
            rows.append(np.fromiter((ids.setdefault(f, len(ids)) for f in words), np.int32, len(words)))
            owner.append(len(labels))
        labels.append(label)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return {"": 40.0 if len(y) and y.max() > 0 else -40.0}
    owner = np.array(owner)
    cols, sent = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # Features that toxic documents hold more often than chance explains: a bag is toxic by what it holds.
    seen = np.unique(owner[sent].astype(np.int64) * len(ids) + cols)
    doc, feature = seen // len(ids), seen % len(ids)
    pos, neg = (np.bincount(feature, weights, len(ids)) for weights in (y[doc], 1 - y[doc]))
    rate = (pos + neg) / len(y)
    apart = (pos / y.sum() - neg / (1 - y).sum()) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / y.sum() + 1 / (1 - y).sum()))
    apart[pos < 2] = 0
    best = np.argsort(-apart, kind="stable")[:max_features]
    best = best[apart[best] >= APART]
    place = np.full(len(ids), -1)
    place[best] = np.arange(len(best))
    cols = place[cols]
    sent, cols = sent[cols >= 0], cols[cols >= 0]
    stands_for = np.ones(len(y)) if counts is None else np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    stands_for /= stands_for.mean()
    w, b, n = np.zeros(len(best)), -4.0, len(rows)
    moment = [np.zeros(len(best) + 1), np.zeros(len(best) + 1)]
    for step in range(1, steps + 1):
        z = b + np.bincount(sent, w[cols], n)
        total = np.bincount(owner, _softplus(z), len(y))
        push = stands_for * ((1 - y) - y * np.exp(-total) / np.maximum(-np.expm1(-total), 1e-12))
        g = push[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(cols, g[sent], len(best)) / len(y) + DECAY * w, g.sum() / len(y))
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad**2
        move = RATE * moment[0] / (1 - 0.9**step) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    names = list(ids)
    return {"": float(b)} | {names[f]: float(v) for f, v in zip(best, w, strict=True) if abs(v) > 0.02}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_features: int = FEATURES) -> dict[str, float]:
    """Fit on the bounded sample; the sampled ids (at most 2 x ``sample``) are broadcast, so texts stay where they are."""
    known = labels.where("toxic is not null and doc_id is not null").where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    known = staged(known, "known")  # ids and labels only
    counts = known.agg(F.expr("count_if(toxic <> 1)"), F.expr("count_if(toxic = 1)")).first()
    turn = F.xxhash64(F.lit(77), "doc_id")
    picked = known.where("toxic = 1").orderBy(turn, "doc_id").limit(sample).unionAll(known.where("toxic <> 1").orderBy(turn, "doc_id").limit(sample))
    chosen = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # Rows that repeat an id are one document, so the sample is bounded however often they do.
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    stand_for = tuple(counts)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = fit(((t, int(y == 1)) for batch in batches for t, y in zip(batch["text"], batch["toxic"], strict=True)), max_features, counts=stand_for)
        yield pd.DataFrame({"feature": list(got), "weight": list(got.values())})

    one = chosen.repartition(1).sortWithinPartitions("doc_id", "text")
    return {r["feature"]: r["weight"] for r in one.mapInPandas(learn, "feature string, weight double").collect()}


class Scorer:
    """Sentence and document scores under a model."""

    def __init__(self, model: dict[str, float]):
        self.model, self.bias = model, model.get("", -40.0)
        self.words = {f for f in model if f and not f.endswith("-")}
        self.beginnings = {k: {f[:-1] for f in model if f.endswith("-") and len(f) == k + 1} for k in (4, 5)}

    def known(self, words: set[str]) -> list[str]:
        """The (lower-case) words that may bring a feature."""
        full, four, five = self.words, self.beginnings[4], self.beginnings[5]
        return [w for w in words if w in full or w[:4] in four or w[:5] in five]

    def score(self, text: str) -> tuple[float, list[dict]]:
        """The noisy-or over all sentences, and the sentences that alone reach the threshold."""
        neutral = float(_softplus(np.array(self.bias)))
        if not self.known(set(TOKEN.findall(text.lower()))):
            n = sum(1 for s in SENTENCE.findall(text) if TOKEN.search(s))
            return float(-np.expm1(-self._plain(n or 1, neutral))), []
        total, spans, plain = 0.0, [], 0
        for start, end in sentences(text):
            extra = self._weight_of(text[start:end])
            if extra == 0.0:
                plain += 1
                continue
            part = float(_softplus(np.array(self.bias + extra)))
            total += part
            if -np.expm1(-part) >= THRESHOLD:
                spans.append({"start": start, "end": end, "score": float(-np.expm1(-part))})
        return float(-np.expm1(-(total + self._plain(plain, neutral)))), spans

    @staticmethod
    def _plain(n: int, each: float) -> float:
        """What ``n`` sentences without a feature add."""
        return min(n * each, max(each, -float(np.log1p(-NEUTRAL))))

    def _weight_of(self, sentence: str) -> float:
        """Of the distinct features: a beginning that two words share counts once, as in training."""
        found = self.known(set(TOKEN.findall(sentence.lower())))
        return sum(self.model.get(f, 0.0) for f in {f for w in found for f in features(w)})


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score_documents(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """All columns of docs under ``row``, with ``score`` and ``spans``: (start, end, score) of the offending sentences."""
    at = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES entries

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]))
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(at.value)
        for texts in batches:
            got = [scorer.score(t or "") for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in got], "spans": [s for _, s in got]})

    rated = docs.select(F.struct(*docs.columns).alias("row"), rate(F.col("text")).alias("rated"))
    return rated.select("row", "rated.score", "rated.spans")
