"""Toxicity by non-negative positive-unlabelled learning.

Training takes confirmed toxic documents (P) and documents whose labels are not
looked at (U), both from the training fold. With a class prior pi the risk of a
scorer f is ``pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)])``: U stands in for
the negatives once its positive share is taken off, and a step that would push
that difference below zero is undone instead. pi is the toxic share of the
labelled documents of the training fold.

f is linear in the presence of words. Its vocabulary are the ``VOCABULARY`` words
with the largest lift from U to P, in standard errors, and at least ``MIN_LIFT``; weights are fitted with numpy on the driver by
Adam. P and U are bounded samples (``MAX_POSITIVE``, ``MAX_UNLABELLED`` rows, the
first by a hash of the id); scoring covers every document, map-only.

A null or empty text has no words and scores the intercept. Null labels are no
labels; of repeated label rows the highest counts. Without any confirmed toxic
document every score is 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parley.llm.common import flat, map_batches, text_rows

MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
VOCABULARY, MIN_POSITIVE, MIN_LIFT = 256, 3, 4.0
STEPS, RATE, PENALTY = 400, 0.05, 2e-4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Small letters, digits and bytes beyond ASCII stay, capitals become small, the rest is space.
_FOLD = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or 48 <= c < 58 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(_FOLD).split())


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


class Scorer:
    """Intercept and a weight per vocabulary word; ``probability`` of a text's words."""

    def __init__(self, weights: dict[bytes, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def margin(self, words: set[bytes]) -> float:
        return self.intercept + sum(map(self.weights.__getitem__, sorted(words & self.weights.keys())))

    def probability(self, words: set[bytes]) -> float:
        m = self.margin(words)
        return float(1 / (1 + np.exp(-m))) if m > -700 else 0.0


def fit(positive: list[set[bytes]], unlabelled: list[set[bytes]], prior: float) -> Scorer:
    if not positive or not unlabelled:
        return Scorer({}, -np.inf)
    in_p, in_u = Counter(w for s in positive for w in s), Counter(w for s in unlabelled for w in s)
    n_p, n_u = len(positive), len(unlabelled)

    def lift(w: bytes) -> float:
        # difference of shares over its standard error
        p, u = in_p[w] / n_p, in_u[w] / n_u
        pooled = (in_p[w] + in_u[w] + 1) / (n_p + n_u + 2)
        return (p - u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    lifts = {w: lift(w) for w, c in in_p.items() if c >= MIN_POSITIVE}
    words = sorted((w for w, x in lifts.items() if x >= MIN_LIFT), key=lambda w: (-lifts[w], w))[:VOCABULARY]
    place = {w: k for k, w in enumerate(words)}

    def matrix(rows):
        out = np.zeros((len(rows), len(words) + 1), np.float32)
        out[:, -1] = 1
        for k, s in enumerate(rows):
            out[k, [place[w] for w in s & place.keys()]] = 1
        return out
    xp, xu = matrix(positive), matrix(unlabelled)
    tp, tu = np.ascontiguousarray(xp.T), np.ascontiguousarray(xu.T)
    w = np.zeros(len(words) + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        fp, fu = xp @ w, xu @ w
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        # logistic loss: l(f) = log(1 + e^-f); its slope is s - 1, that of l(-f) is s
        as_positive = tp @ (sp - 1) * np.float32(prior / n_p)
        as_negative = tu @ su * np.float32(1 / n_u) - tp @ sp * np.float32(prior / n_p)
        risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        grad = as_positive + as_negative if risk >= 0 else -as_negative
        grad[:-1] += np.float32(PENALTY) * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        w -= (RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Scorer({x: float(v) for x, v in zip(words, w)}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Fit on bounded samples of the training fold."""
    rows = text_rows(docs, id_col, text_col)
    label = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    share = label.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not share:
        return Scorer({}, -np.inf)
    order = F.xxhash64("doc_id")
    first = lambda df, n: df.select("doc_id").distinct().orderBy(order, "doc_id").limit(n)
    ids = (first(label.where("toxic = 1"), MAX_POSITIVE).withColumn("set", F.lit("P"))
           .unionByName(first(rows.where("doc_id is not null").where(~held_out()), MAX_UNLABELLED).withColumn("set", F.lit("U"))))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            raw, off = flat(batch)
            data, ends = raw.tobytes(), off.tolist()
            return {"set": batch.column(2), "words": [b" ".join(sorted(words_of(data[a:b]))) for a, b in zip(ends, ends[1:])]}
        return work
    # at most MAX_POSITIVE + MAX_UNLABELLED ids
    got = map_batches(rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "set"), "set string, words binary", make).toArrow()
    sets = {"P": [], "U": []}
    for kind, words in zip(got["set"].to_pylist(), got["words"].to_pylist()):
        sets[kind].append(set(words.split()))
    return fit(sets["P"], sets["U"], min(max(share, 0.001), 0.9))


def scored(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Map-only."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)   # VOCABULARY words

    def make():
        s = model.value

        def work(batch: pa.RecordBatch) -> dict:
            raw, off = flat(batch)
            data, ends = raw.tobytes(), off.tolist()
            p = [s.probability(words_of(data[a:b])) for a, b in zip(ends, ends[1:])]
            return {"doc_id": batch.column(0), "score": pa.array(p, pa.float64()), "predicted": pa.array([int(x >= THRESHOLD) for x in p], pa.int32())}
        return work
    out = map_batches(text_rows(docs, id_col, text_col), "doc_id long, score double, predicted int", make)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels))
