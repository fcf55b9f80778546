"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios (after Wang & Manning, 2012).

Features are the hashed n-grams (3 to 6 characters, with the spaces around the word) of a text's distinct words; a text has
each feature as often as distinct words hold it. On labelled texts the log-count ratio r of each feature is taken (in how
many toxic and other texts it stands, smoothed); features that tell little (|r| below LEAST_RATIO) or stand in one text only
are left out, the others multiplied by r, and a logistic regression with an L2 penalty is fitted to them. The intercept is
then moved from the sample's share of toxic texts to the share of all labelled ones.

A text's logit is a sum over its distinct words, so a worker works out each word's part once.

Fitted on at most MAX_ROWS labelled texts of each class, chosen by hashes of their doc_ids, on the first MAX_TEXT bytes of
each and MAX_BYTES together, half for each class. Null labels are left out, of repeated labels the largest counts; labels
of unknown documents have no text to learn from, but count in the share of toxic ones. Null and empty texts get the intercept's score. Without texts of both classes the score is the share of toxic labels.
Repeated rows give repeated results, an empty table an empty one. Columns other than doc_id and text aren't inputs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import map_texts, texts, values
from ._ngrams import Vocabulary, all_features, chosen_ids, chosen_texts, word_features, words_of

LOW, HIGH = 3, 6
BUCKETS = 1 << 20
MAX_ROWS, MAX_BYTES, MAX_TEXT = 3000, 64 << 20, 256 << 10
LEAST_RATIO, LEAST_TEXTS = 2.0, 4
PENALTY, STEPS = 1e-3, 150
THRESHOLD = 0.3


def in_training(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """False for the held-out part; a null doc_id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != part, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[tuple[bytes, int]], float]:
    """(text, label) of the fitted rows, and the share of label 1 of all labelled rows."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(in_training(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(
        (F.max("toxic") > 0).cast("int").alias("class")
    )
    counts = dict(known.groupBy("class").count().collect())
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return [(text, label) for label, _, text in chosen_texts(docs, chosen_ids(known, max_rows, 5), "int", MAX_TEXT, MAX_BYTES)], share


class Model:
    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def word_parts(self, words: list[str]) -> np.ndarray:
        owner, feature = word_features(words, LOW, HIGH, BUCKETS)
        return np.bincount(owner, self.weight[feature], len(words))

    def scorer(self):
        vocabulary = Vocabulary(self.word_parts, 1)

        def score(raw: list[bytes]) -> np.ndarray:
            parts = vocabulary.look_up([sorted(set(words_of(t))) for t in raw])
            table = vocabulary.table[:, 0]
            z = np.array([math.fsum(table[own]) if own else 0.0 for own in parts]) + self.bias
            return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

        return score


def fit(rows: list[tuple[bytes, int]], share: float) -> Model:
    y = np.array([label for _, label in rows], np.float64)
    if not 0 < y.sum() < len(y):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), math.log(p / (1 - p)))
    own = [sorted(set(words_of(t))) for t, _ in rows]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for x in own for w in x))}
    doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
    word = np.array([number[w] for x in own for w in x], np.int64)
    begin, feature = all_features(list(number), LOW, HIGH, BUCKETS)
    # in how many texts of each class a feature stands
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    edges = np.searchsorted(doc, np.arange(len(own) + 1))
    for i in range(len(own)):
        held = np.unique(np.concatenate([feature[begin[w] : begin[w + 1]] for w in word[edges[i] : edges[i + 1]]] or [feature[:0]]))
        (pos if y[i] else neg)[held] += 1
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / (len(y) - y.sum() + 2))
    ratio[(pos + neg < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    keep = np.flatnonzero(ratio[feature])
    owner, feature = np.searchsorted(begin, keep, "right") - 1, feature[keep]
    used, column = np.unique(feature, return_inverse=True)
    scale = ratio[used][column]
    w, bias = np.zeros(len(used)), 0.0
    moment, square, sample_weight = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.where(
        y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())
    )
    for step in range(1, STEPS + 1):
        part = np.bincount(owner, w[column] * scale, len(number))
        z = np.bincount(doc, part[word], len(own)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * sample_weight
        back = np.bincount(word, error[doc], len(number))
        grad = np.append(np.bincount(column, back[owner] * scale, len(used)) + PENALTY * w / len(y), error.sum())
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    weight = np.zeros(BUCKETS)
    weight[used] = w * ratio[used]
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(weight, bias + math.log(share / (1 - share)))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, max_rows)))  # BUCKETS weights

    def fn(batch, score):
        s = score(values(batch))
        return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    scored = map_texts(texts(docs), fn, "doc_id long, score double, predicted int", lambda: model.value.scorer())
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")
