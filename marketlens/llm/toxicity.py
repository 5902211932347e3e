"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each hashed n-gram's presence is scaled by the log ratio of its smoothed share among toxic and other documents, and a logistic
regression is trained on the scaled features (S. Wang, C. Manning: Baselines and Bigrams, 2012). Ratios are distributed sums; weights
come from averaged local gradient steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .splits import labelled_sample
from .store import discard, map_texts, materialize
from .text import GramHasher
from .training import average_rounds, sum_vectors

BITS, ORDERS = 18, (3, 4, 5)
#: Labelled documents that the classifier is fitted on, at most about.
SAMPLE = 12_000
PARTITIONS, ROUNDS, EPOCHS, RATE, L2, SMOOTH = 6, 4, 3, 0.3, 2e-4, 1.0
#: Grams present in fewer documents of the sample say nothing that holds elsewhere.
LEAST_DOCS = 3


def _counts(batches):
    """Documents with each gram, by class, then the number of documents by class."""
    grams, size = GramHasher(BITS, ORDERS), 1 << BITS
    out = np.zeros(2 * size + 2, np.float32)
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            out[grams(text) + y * size] += 1
            out[2 * size + y] += 1
    return out


def log_count_ratios(sample: DataFrame) -> tuple[np.ndarray, float]:
    """The ratio of each bucket, 0 where too few documents have it, and the log odds of the classes."""
    size = 1 << BITS
    c = sum_vectors(sample, _counts, 2 * size + 2).astype(np.float64)
    clean, toxic, (n0, n1) = c[:size], c[size : 2 * size], c[2 * size :]
    ratio = np.log((toxic + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((clean + SMOOTH) / (n0 + 2 * SMOOTH))
    ratio[clean + toxic < LEAST_DOCS] = 0
    return ratio.astype(np.float32), float(np.log((n1 + 1) / (n0 + 1)))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 5, limit: int = SAMPLE) -> np.ndarray:
    """One weight per bucket, already scaled by its ratio, and the bias last. Without labelled rows every weight is 0."""
    sample = materialize(labelled_sample(docs, labels, "toxic", held_out, limit).repartition(PARTITIONS, "spot").select("text", "y"), "toxicity-sample")
    ratio, prior = log_count_ratios(sample)
    shared = sample.sparkSession.sparkContext.broadcast(ratio)

    def local(params, batches, r):
        grams, scale = GramHasher(BITS, ORDERS), shared.value
        rows, ys = [], []
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                at = grams(text)
                at = at[scale[at] != 0]
                rows.append(at.astype(np.int32))
                ys.append(float(y))
        order = np.random.default_rng(r)
        squares = np.full(len(params), 0.1, np.float32)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                at = rows[i]
                x = scale[at]
                p = 1 / (1 + np.exp(-np.clip(float(params[at] @ x) + float(params[-1]), -30, 30)))
                g = np.float32(p - ys[i])
                if abs(g) < 1e-3:
                    continue
                step = g * x + np.float32(L2) * params[at]
                squares[at] += step * step
                params[at] -= np.float32(RATE) / (1 + r) * step / np.sqrt(squares[at]) / np.float32(np.sqrt(max(1, len(at))))
                params[-1] -= np.float32(0.01) * g
        return params, len(rows)

    # starting from weights in proportion to the ratios is the naive Bayes rule itself, at a small scale
    start = np.append(np.full(1 << BITS, 0.02, np.float32), np.float32(prior))
    params = average_rounds(sample, start, local, ROUNDS)
    shared.unpersist()
    discard(sample)
    return np.append(params[:-1] * ratio, params[-1]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5) of every document's whole text.

    A null text counts as empty and scores by the bias alone; repeated rows score alike; a null id is kept; an empty table gives an
    empty result. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS + 1 floats

    def run(batches):
        grams, w = GramHasher(BITS, ORDERS), shared.value
        for pdf in batches:
            raw = np.array([w[grams(text)].sum(dtype=np.float64) if text else 0.0 for text in pdf.pop("text")]) + float(w[-1])
            p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
            yield pdf.assign(score=p, predicted=(p >= 0.5).astype("int32"))

    return map_texts(docs, run, "score double, predicted int", "doc_id", "text")
