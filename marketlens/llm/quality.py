"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded, a gated attention weighs the passages, and the weighted mean of
their encodings is scored (M. Ilse, J. Tomczak, M. Welling: Attention-based Deep Multiple Instance Learning, 2018). Only document
labels are used; gradients reach the encoder and the attention through the weighted representation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .splits import labelled_sample
from .store import discard, filter_texts, map_texts, materialize
from .training import average_rounds, sum_vectors

#: Labelled documents that the classifier is fitted on, at most about.
SAMPLE = 12_000
PASSAGE = 64
HIDDEN, GATE = 24, 12
PARTITIONS, ROUNDS, EPOCHS, RATE, L2, BATCH = 6, 5, 4, 0.01, 1e-4, 64
THRESHOLD = 0.3

# Character classes of the passage encoding
_CLASSES = 9
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _QUOTE, _OTHER, _HIGH = range(_CLASSES)
_KIND = np.full(128, _OTHER, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = _LOWER, _UPPER, _DIGIT
_KIND[[32, 9, 11, 12]], _KIND[[10, 13]] = _SPACE, _LINE
_KIND[[ord(c) for c in ".,;:!?"]], _KIND[[ord(c) for c in "'\"()-"]] = _STOP, _QUOTE
_PAIRS = _CLASSES * _CLASSES
FEATURES = _PAIRS + 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def passages(text: str) -> np.ndarray:
    """One row of features per passage of the whole text: shares of pairs of character classes, and shape and repetition of words."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.full(len(code), _HIGH, np.int64)
    ascii_ = code < 128
    kind[ascii_] = _KIND[code[ascii_]]
    inside = (kind != _SPACE) & (kind != _LINE)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    n_words = len(starts)
    # a short rest joins the passage before it
    n = max(1, round(n_words / PASSAGE))
    of_word = np.minimum(np.arange(n_words) // PASSAGE, n - 1)
    of_char = np.zeros(len(code), np.int64)
    of_char[starts[1:]] = np.diff(of_word)
    of_char = np.cumsum(of_char)
    pairs = np.bincount(of_char[1:] * _PAIRS + kind[:-1] * _CLASSES + kind[1:], minlength=n * _PAIRS).reshape(n, _PAIRS).astype(np.float32)
    chars = np.bincount(of_char, minlength=n)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :_PAIRS] = np.sqrt(pairs / np.maximum(chars, 1)[:, None])
    at = np.arange(len(code))
    word_of = np.cumsum(first) - 1
    place = (at - starts[np.maximum(word_of, 0)]).astype(np.uint64)
    value = (code.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * _MULTIPLIER
    value[~inside] = 0
    words = np.add.reduceat(value ^ (value >> np.uint64(31)), starts)
    length = np.add.reduceat(inside.astype(np.int64), starts)
    size = np.bincount(of_word, minlength=n).astype(np.float64)

    def mean(x):
        return np.bincount(of_word, x, n) / size

    order = np.lexsort((words, of_word))
    by_word = words[order]
    distinct = np.ones(n_words, bool)  # the first of each word in its passage; passages keep their order
    distinct[1:] = (by_word[1:] != by_word[:-1]) | (of_word[1:] != of_word[:-1])
    same = np.zeros(n_words)
    same[1:] = words[1:] == words[:-1]
    mean_length = mean(length)
    f = _PAIRS
    out[:, f] = mean_length / 10
    out[:, f + 1] = np.sqrt(np.maximum(mean(length * length) - mean_length**2, 0)) / 10
    out[:, f + 2] = mean(distinct)
    out[:, f + 3] = mean(same)
    out[:, f + 4] = mean(length == 1)
    out[:, f + 5] = mean(length > 20)
    out[:, f + 6] = np.minimum(size, PASSAGE) / PASSAGE
    out[:, f + 7] = 1
    return out


_SHAPES = (("scale", (2, FEATURES)), ("enc", (FEATURES, HIDDEN)), ("v", (HIDDEN, GATE)), ("u", (HIDDEN, GATE)), ("w", (GATE,)), ("out", (HIDDEN,)), ("bias", (1,)))
SIZE = sum(int(np.prod(s)) for _, s in _SHAPES)


def _views(params: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES:
        n = int(np.prod(shape))
        out[name] = params[at : at + n].reshape(shape)
        at += n
    return out


def _sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def forward(params: np.ndarray, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags: rows of ``x`` from each start to the next are the passages of one document."""
    p = _views(params)
    x = (x - p["scale"][0]) * p["scale"][1]
    h = np.tanh(x @ p["enc"])
    tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    gate = (tv * su) @ p["w"]
    counts = np.diff(np.append(starts, len(x)))
    e = np.exp(gate - np.repeat(np.maximum.reduceat(gate, starts), counts))
    a = e / np.repeat(_sum(e, starts), counts)
    z = _sum(a[:, None] * h, starts)
    score = 1 / (1 + np.exp(-np.clip(z @ p["out"] + p["bias"][0], -30, 30)))
    return {"x": x, "h": h, "tv": tv, "su": su, "a": a, "z": z, "counts": counts, "score": score}


def gradient(params: np.ndarray, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of the weighted mean log loss, by hand: output, attention, encoder."""
    p, f = _views(params), forward(params, x, starts)
    out = np.zeros_like(params)
    g = _views(out)
    dz = ((f["score"] - y) * weight / len(y)).astype(np.float32)
    g["out"][:] = f["z"].T @ dz
    g["bias"][0] = dz.sum()
    dz = np.repeat(dz[:, None] * p["out"], f["counts"], axis=0)
    da = (dz * f["h"]).sum(1)
    ds = f["a"] * (da - np.repeat(_sum(f["a"] * da, starts), f["counts"]))
    g["w"][:] = (f["tv"] * f["su"]).T @ ds
    inner = ds[:, None] * p["w"]
    dv, du = inner * f["su"] * (1 - f["tv"] ** 2), inner * f["tv"] * f["su"] * (1 - f["su"])
    g["v"][:], g["u"][:] = f["h"].T @ dv, f["h"].T @ du
    dh = (f["a"][:, None] * dz + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
    g["enc"][:] = f["x"].T @ dh
    return out


def _moments(batches):
    """Sums, squares and number of passages, then documents by class."""
    out = np.zeros(2 * FEATURES + 3, np.float64)
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            x = passages(text).astype(np.float64)
            out[:FEATURES] += x.sum(0)
            out[FEATURES : 2 * FEATURES] += (x * x).sum(0)
            out[2 * FEATURES] += len(x)
            out[2 * FEATURES + 1 + y] += 1
    return out


def _start(moments: np.ndarray) -> np.ndarray:
    n = max(moments[2 * FEATURES], 1)
    mean = moments[:FEATURES] / n
    std = np.sqrt(np.maximum(moments[FEATURES : 2 * FEATURES] / n - mean**2, 1e-6))
    rng = np.random.default_rng(7)
    params = np.zeros(SIZE, np.float32)
    p = _views(params)
    p["scale"][0], p["scale"][1] = mean, 1 / std
    p["enc"][:] = rng.normal(0, FEATURES**-0.5, p["enc"].shape)
    for k in ("v", "u"):
        p[k][:] = rng.normal(0, HIDDEN**-0.5, p[k].shape)
    p["w"][:] = rng.normal(0, 0.3, GATE)
    p["out"][:] = rng.normal(0, 0.3, HIDDEN)
    return params


def train(docs: DataFrame, labels: DataFrame, held_out: int = 5, limit: int = SAMPLE) -> np.ndarray:
    """Parameters of the model, ``SIZE`` floats. Without labelled rows the start values."""
    sample = materialize(labelled_sample(docs, labels, "quality", held_out, limit).repartition(PARTITIONS, "spot").select("text", "y"), "quality-sample")
    moments = sum_vectors(sample, _moments, 2 * FEATURES + 3)
    n0, n1 = moments[-2:] + 1
    fixed = 2 * FEATURES

    def local(params, batches, r):
        bags, ys = [], []
        for pdf in batches:
            bags += [passages(x) for x in pdf["text"]]
            ys += list(pdf["y"])
        y = np.array(ys, np.float32)
        # the rarer class counts up to twice as much
        weight = np.where(y > 0, np.clip(n0 / n1, 0.5, 2) ** 0.5, np.clip(n1 / n0, 0.5, 2) ** 0.5).astype(np.float32)
        m, v, t = np.zeros_like(params), np.zeros_like(params), 0
        order = np.random.default_rng(r)
        for _ in range(EPOCHS):
            at = order.permutation(len(bags))
            for i in range(0, len(at), BATCH):
                some = at[i : i + BATCH]
                x = np.concatenate([bags[k] for k in some])
                starts = np.concatenate([[0], np.cumsum([len(bags[k]) for k in some])[:-1]])
                g = gradient(params, x, starts, y[some], weight[some]) + np.float32(L2) * params
                g[:fixed] = 0
                t += 1
                m = 0.9 * m + 0.1 * g
                v = 0.99 * v + 0.01 * g * g
                params -= (RATE / (1 + 0.5 * r) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return params, len(bags)

    params = average_rounds(sample, _start(moments), local, ROUNDS)
    discard(sample)
    return params


def score_texts(params: np.ndarray, texts: list) -> np.ndarray:
    """Scores of texts, some hundred at a time."""
    scores = np.empty(len(texts))
    for i in range(0, len(texts), 256):
        bags = [passages(x or "") for x in texts[i : i + 256]]
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        scores[i : i + 256] = forward(params, np.concatenate(bags), starts)["score"]
    return scores


def score(docs: DataFrame, params: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``THRESHOLD``) of every document's whole text.

    A null or empty text is one empty passage; repeated rows score alike; a null id is kept; an empty table gives an empty result.
    Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(params)  # SIZE floats

    def run(batches):
        for pdf in batches:
            scores = score_texts(shared.value, list(pdf.pop("text")))
            yield pdf.assign(score=scores, predicted=(scores >= THRESHOLD).astype("int32"))

    return map_texts(docs, run, "score double, predicted int", "doc_id", "text")


def keep_good(docs: DataFrame, params: np.ndarray) -> DataFrame:
    """The rows, all columns, that score at least ``THRESHOLD``."""
    shared = docs.sparkSession.sparkContext.broadcast(params)
    return filter_texts(docs, lambda: lambda texts: score_texts(shared.value, texts) >= THRESHOLD)
