"""What the two classifiers share: the sample of labelled rows, training in one bounded task, and scoring in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrays import slices

#: The most labelled rows a model learns from, those with the least hashes of their ids; of rows that share an id, one.
SAMPLE = 20_000


def remainder(key: str, mod: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % mod


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, label, text) of at most ``sample`` labelled rows.

    A key with several labels counts with the largest, and one with several texts with that of the least hash.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & usable).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(sample)
    # Bounded by ``sample``, so it is sent to all tasks and no text is shuffled for it.
    met = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)
    # Tasks keep one row of a key before any text moves.
    return met.groupBy(key).agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select(key, "label", "least.text")


def train_in_one_task(rows: DataFrame, fit: Callable[[list[bytes], np.ndarray], np.ndarray], key: str = "doc_id") -> np.ndarray:
    """``fit`` (texts, labels) in one task over a bounded sample; its array of float32 comes back as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += [(t or "").encode() for t in batch.column("text").to_pylist()]
            labels += batch.column("label").to_pylist()
        model = np.asarray(fit(texts, np.array(labels, np.int64)), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])

    bounded = rows.select(F.col(key).alias("key"), "label", "text").repartition(1).sortWithinPartitions(F.xxhash64("key"), "key", "text").select("label", "text")
    found = bounded.mapInArrow(run, T.StructType([T.StructField("model", T.BinaryType())])).collect()
    return np.frombuffer(bytes(found[0].model), np.float32) if found else np.asarray(fit([], np.zeros(0, np.int64)), np.float32)


def score_documents(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], held_out: Column, key: str = "doc_id", text: str = "text", cut: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the key by default), held_out, score and predicted of each row."""
    keep = [key] if keep is None else keep
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            scores = score([(t or "").encode() for t in batch.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.asarray(scores, np.float64))], names=[*keep, "score"])

    scored = source.mapInArrow(run, schema)
    return scored.select(*keep, F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) with P(1) = sigmoid(a * margin + b), by Newton's method with Platt's targets; a is not below 0."""
    pos, neg = int(label.sum()), int(len(label) - label.sum())
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return max(0.0, float(a)), float(b)
