"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams (words, pairs of words, shapes of words and of their endings) are scaled by the log ratio of
their counts in the two classes, and a linear hinge-loss model is fitted to them by dual coordinate descent.  It learns from
at most ``learning.SAMPLE`` labelled rows, in one task; the margins of a fifth of them that is kept apart give the
probabilities (Platt).  Scoring is one pass without a shuffle.

Edge cases: null and empty texts have no n-grams and get the score of the intercept; with labels of one class, or none, the
score is the smoothed share of class 1 (one half for none); repeated rows are each scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from docloom.llm.arrays import Words, mix
from docloom.llm.learning import SAMPLE, labelled, platt, score_documents, sigmoid, train_in_one_task

#: Buckets of hashed n-grams (2 ** BITS); documents an n-gram must be in.
BITS, LEAST = 18, 3
SMOOTH, COST, ROUNDS = 1.0, 1.0, 12
_LETTER = np.zeros(256, np.uint8)
_LETTER[range(97, 123)] = 1
_LETTER[range(65, 91)] = 2
_LETTER[range(48, 58)] = 3
_LETTER[range(128, 256)] = 4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all distinct n-grams, by text."""
    w = Words(texts)
    n = len(w.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = w.hashes()
    last, low = w.raw[w.ends - 1], w.raw[np.maximum(w.ends - 2, w.starts)]
    end = np.where(_LETTER[last] > 0, _LETTER[last], last).astype(np.uint64) * np.uint64(256) + np.where(_LETTER[low] > 0, _LETTER[low], low).astype(np.uint64)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (w.of[1:] == w.of[:-1])])
    size = np.minimum(w.ends - w.starts, 15).astype(np.uint64)
    shape = mix((end * np.uint64(16) + _LETTER[w.raw[w.starts]].astype(np.uint64)) * np.uint64(2) + again.astype(np.uint64) + np.uint64(1) * (size == 1))
    side = w.of[1:] == w.of[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[side]
    shapes = mix(shape[:-1] * np.uint64(5) + shape[1:])[side]
    grams = np.concatenate([h, shape, pair, shapes])
    of = np.concatenate([w.of, w.of, w.of[1:][side], w.of[1:][side]])
    key = np.unique((of.astype(np.uint64) << np.uint64(BITS)) | (grams >> np.uint64(64 - BITS)))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _rows(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        of, bucket = features(part)
        out += np.split(bucket.astype(np.int32), np.searchsorted(of, np.arange(1, len(part))))
    return out


def hinge_by_dual_coordinates(rows: list[np.ndarray], scale: np.ndarray, label: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the L2-regularised hinge loss on unit rows scale[row]; each step solves one dual variable."""
    w, b = np.zeros(len(scale)), 0.0
    y = np.where(label == 1, 1.0, -1.0)
    # Both classes weigh alike, whatever their shares.
    share = np.clip(np.array([(y < 0).mean(), (y > 0).mean()]), 1e-3, 1)
    limit = np.where(y > 0, cost * 0.5 / share[1], cost * 0.5 / share[0])
    values = [scale[r] / max(1e-12, np.sqrt((scale[r] ** 2).sum())) if len(r) else scale[r] for r in rows]
    norm = np.array([(v * v).sum() + 1.0 for v in values])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                b += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, b


def fit(texts: list[bytes], label: np.ndarray) -> np.ndarray:
    """[a, b, intercept, weights..., scales...]: score = sigmoid(a * margin + b)."""
    size = 1 << BITS
    if len(set(label.tolist())) < 2:
        return np.concatenate([[0.0, *platt(np.zeros(len(label)), label)[1:], 0.0], np.zeros(2 * size)])
    rows = _rows(texts)
    good, bad = np.zeros(size), np.zeros(size)
    for r, y in zip(rows, label):
        (good if y == 1 else bad)[r] += 1
    seen = good + bad >= LEAST
    p, q = (good + SMOOTH) / (good[seen].sum() + SMOOTH * seen.sum()), (bad + SMOOTH) / (bad[seen].sum() + SMOOTH * seen.sum())
    scale = np.where(seen, np.log(p / q), 0.0)
    apart = np.arange(len(rows)) % 5 == 0
    if len(set(label[apart].tolist())) < 2 or len(set(label[~apart].tolist())) < 2:
        apart[:] = False
    own = [r for r, x in zip(rows, apart) if not x]
    w, b = hinge_by_dual_coordinates(own, scale, label[~apart])
    check = np.flatnonzero(apart) if apart.any() else np.arange(len(rows))
    a, c = platt(np.array([_margin(rows[i], w, scale, b) for i in check]), label[check])
    return np.concatenate([[a, c, b], w, scale])


def _margin(row: np.ndarray, w: np.ndarray, scale: np.ndarray, b: float) -> float:
    v = scale[row]
    return float(w[row] @ v / max(1e-12, np.sqrt((v * v).sum())) + b)


def scorer(model: np.ndarray):
    size = (len(model) - 3) // 2
    a, c, b = (float(x) for x in model[:3])
    scale = model[3 + size :].astype(np.float64)
    product, square = model[3 : 3 + size] * scale, scale * scale

    def score(texts: list[bytes]) -> np.ndarray:
        of, bucket = features(texts)
        top, norm = (np.bincount(of, x[bucket], len(texts)) for x in (product, square))
        return sigmoid(a * (top / np.sqrt(np.maximum(norm, 1e-24)) + b) + c)

    return score


def classify_quality(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, cut: float = 0.3, keep: list[str] | None = None, training: DataFrame | None = None) -> DataFrame:
    """``keep``, held_out, score (the chance of label 1) and predicted of each row; learns from labelled rows of ``training``
    (``docs`` by default) that are not held out."""
    model = train_in_one_task(labelled(docs if training is None else training, labels, label, ~held_out, key, text, sample), fit, key)
    return score_documents(docs, scorer(model), held_out, key, text, cut, keep)
