"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Words are lower-cased (A-Z); a document has the distinct hashes of its words, word beginnings, pairs, and pairs with one word
between them.  Each coordinate has its own rate, and L1 leaves few weights other than zero, which are what is sent to the
tasks.  It learns from at most ``learning.SAMPLE`` labelled rows, in one task; scoring is one pass without a shuffle.

Edge cases: null and empty texts get the score of the intercept; without labels the score is one half, with labels of one
class it tends to that class; repeated rows are each scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from docloom.llm.arrays import Words, mix
from docloom.llm.learning import SAMPLE, labelled, score_documents, sigmoid, train_in_one_task

BITS = 20
RATE, BETA, L1, L2, ROUNDS = 1.0, 1.0, 8.0, 1.0, 4
#: Bytes of a word's beginning.
STEM = 5


def features(texts: list[bytes], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all distinct n-grams, by text; with ``only``, of those whose bucket is marked there."""
    w = Words([t.lower() for t in texts])
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, of = w.hashes(), w.of
    one, two = of[1:] == of[:-1], of[2:] == of[:-2]
    bare = mix(w.spans.hash(w.starts, np.maximum(w.starts + 1, w.ends - _trailing(w))) + np.uint64(11))
    grams = [bare, mix(w.prefixes(STEM) + np.uint64(7)), mix(h[:-1] * np.uint64(3) + h[1:])[one], mix(h[:-2] * np.uint64(5) + h[2:])[two]]
    of = np.concatenate([of, of, of[1:][one], of[2:][two]])
    bucket = np.concatenate(grams) >> np.uint64(64 - BITS)
    if only is not None:
        hit = only[bucket.astype(np.int64)]
        of, bucket = of[hit], bucket[hit]
    key = np.unique((of.astype(np.uint64) << np.uint64(BITS)) | bucket)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _trailing(w: Words) -> np.ndarray:
    """1 for words that end in a mark of punctuation, else 0."""
    return np.isin(w.raw[w.ends - 1], np.frombuffer(b".,;:!?\"')", np.uint8)).astype(np.int64)


def ftrl(rows: list[np.ndarray], label: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, intercept); coordinates keep z and n, a weight is zero while |z| is at most L1."""
    z, n = np.zeros(size), np.zeros(size)
    bias, seen = 0.0, 0.0
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            zr, nr = z[r], n[r]
            w = np.where(np.abs(zr) <= L1, 0.0, -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(nr)) / RATE + L2))
            g = float(sigmoid(w.sum() + bias)) - label[i]
            step = (np.sqrt(nr + g * g) - np.sqrt(nr)) / RATE
            z[r] = zr + g - step * w
            n[r] = nr + g * g
            seen += g * g
            bias -= RATE * g / (BETA + np.sqrt(seen))
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / RATE + L2)), bias


def fit(texts: list[bytes], label: np.ndarray) -> np.ndarray:
    """[intercept, bucket, weight, bucket, weight, ...] of the weights that are not zero."""
    rows: list[np.ndarray] = []
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        of, bucket = features(part)
        rows += np.split(bucket.astype(np.int32), np.searchsorted(of, np.arange(1, len(part))))
    w, bias = ftrl(rows, label, 1 << BITS)
    at = np.flatnonzero(w)
    return np.concatenate([[bias], np.stack([at, w[at]], axis=1).ravel()])


def scorer(model: np.ndarray):
    weights = np.zeros(1 << BITS, np.float64)
    weights[model[1::2].astype(np.int64)] = model[2::2]
    bias, used, found = float(model[0]), weights != 0, None
    sparse, at = weights[used].astype(np.float32), np.flatnonzero(used).astype(np.int32)

    def score(texts: list[bytes]) -> np.ndarray:
        nonlocal found
        if found is None:
            found = np.zeros(1 << BITS, np.float64), np.zeros(1 << BITS, bool)
            found[0][at], found[1][at] = sparse, True
        of, bucket = features(texts, found[1])
        return sigmoid(np.bincount(of, found[0][bucket], len(texts)) + bias)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, cut: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """``keep``, held_out, score (the chance of label 1) and predicted of each row; learns from labelled rows that are not held out."""
    model = train_in_one_task(labelled(docs, labels, label, ~held_out, key, text, sample), fit, key)
    return score_documents(docs, scorer(model), held_out, key, text, cut, keep)
