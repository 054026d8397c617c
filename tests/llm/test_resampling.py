"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import queries, resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(i, *features(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, n, fs in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def told(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def sample(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "GAMMA", "é", "日本語", "x1", "don't", "a-b", "word" * 40, "z" * 300, "q" * 65, "r" * 64]) for _ in range(n))


@pytest.mark.parametrize("size", [8, 100, 1 << 16])
def test_rows_against_python(spark, size):
    rng = random.Random(size)
    rows = [(i, t) for i, t in enumerate([None, "", " .,;", "a", "A", "É é", "\x00a\x00b", "@[`{~", "w" * 5000, "日本語" * 100, "a b " * 5000])]
    rows += [(100 + i, sample(rng, rng.randrange(60))) for i in range(200)]
    rows += [(None, "one two three " * 10), (None, None), (4, "A"), (105, rows[16][1])]
    target = [None, "", "alpha beta gamma", "x1 é", sample(rng, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("*", *(F.lit("clash").alias(c) for c in ("id", "rank", "row", "own", "body", "score", "weight")))
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").withColumn("id", F.lit("x"))
    assert told(resampling.resample(docs, goal, size=size)) == sorted(brute(rows, target), key=repr)


def test_documents_against_python(spark, sf):
    docs, goal = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in goal.collect()])
    assert told(queries.op13_resampling(spark, sf)) == sorted(want, key=repr)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "same words " * 20)] * 60 + [(2, "other words " * 20)] * 3
    docs, goal = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "same")], "item_id long, text string")
    for size in (16, 1 << 16):
        got = told(resampling.resample(docs, goal, size=size))
        assert sorted(r[4] for r in got if r[4]) == [1, 2, 3] and [r[:4] for r in got] == sorted([r[:4] for r in brute(rows, ["same"])], key=repr)
    assert resampling.resample(docs.limit(0), goal).count() == 0
    assert told(resampling.resample(docs.limit(1), goal.limit(0))) == brute(rows[:1], [])


@pytest.mark.parametrize("seed", range(5))
def test_chunks_own_each_start_once(seed):
    rng = random.Random(seed)
    text = " ".join(sample(rng, 40).split() + [".", ",,", " "] * 3).encode()
    whole = resampling.Features([text], [len(text)])
    parts = list(resampling.cut(text, rng.choice([1, 5, 50, 333])))
    assert sum(own for own, _ in parts) == len(text)
    cut = resampling.Features([b for _, b in parts], [own for own, _ in parts])
    for a, b in zip(whole.buckets, cut.buckets):
        assert a[a >= 0].tolist() == b[b >= 0].tolist()
    assert cut.mine.sum() == whole.mine.sum()


def test_checksums():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in [1, 2, 63, 64, 65, 255, 256, 257, 5000, 70_000, 3]]
    found = resampling.Features([b" ".join(words)], [10**9], buckets=2**31 - 1)
    for k, got in enumerate(found.buckets):
        assert [int(x) for x in got if x >= 0] == [zlib.crc32(b" ".join(words[i : i + k + 1])) % (2**31 - 1) for i in range(len(words) - k)]


def test_ranks_over_many_parts(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("v"), "id")
    got = resampling.ranks(rows, [F.desc("v"), F.asc("id")], 9).collect()
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((r.v, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))
