"""Near-duplicates and the pipeline against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import near_dups, textstats


def brute(rows, k=4, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, len(s), find(i), find(i) == i) for i in ids for s in sets[i])


def told(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def edited(rng, words, rate):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < rate else w for w in words)


def test_components_against_python(spark, sf, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 5)
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate([None, "", "a", "A", "a b", "a  b", "a b c d", "a b c d e", "\t\n", "é x\x85y z"])]
    rows += [(i, f"{i} solo text of some words with no other like it {i * 7}") for i in range(30, 34)]
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows += [(100 + i, edited(rng, base, rng.random() * 0.06)) for i in range(60)]
    chain = [f"c{i}" for i in range(80)]
    for i in range(12):
        rows.append((300 + i, " ".join(chain)))
        chain = chain[2:] + [f"n{i}a", f"n{i}b"]
    for n in (7, 8, 9, 12, 20):
        words = [f"s{n}x{j}" for j in range(n)]
        rows += [(400 + 10 * n, " ".join(words)), (401 + 10 * n, " ".join(words[:-1])), (402 + 10 * n, " ".join(words + ["more"]))]
    rows += [(7, "a b c d e"), (100, rows[20][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("id", F.lit(0))
    assert told(near_dups.near_duplicates(docs, shingle=4)) == brute(rows)
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0


def test_documents_against_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert told(near_dups.near_duplicates(docs, shingle=4)) == brute(rows)
    assert told(near_dups.near_duplicates(docs)) == brute(rows, 5)


@pytest.mark.parametrize("seed", range(4))
def test_links_within_a_block(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.1], rng.integers(0, 2**63, 4, dtype=np.uint64)])) for _ in range(12)]
    labels = [int(x) for x in rng.integers(0, 6, 12)]
    links = near_dups.links_within(list(range(12)), labels, [0] * 12, sets, 80, False)
    root = {x: x for x in labels}
    want = {x: x for x in labels}

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    for i, j in links:
        assert near_dups._linked(sets[i], sets[j], 80)
        root[find(root, labels[i])] = find(root, labels[j])
    for i in range(12):
        for j in range(i):
            if near_dups._linked(sets[i], sets[j], 80):
                want[find(want, labels[i])] = find(want, labels[j])
    same = lambda r: {(a, b) for a in r for b in r if find(r, a) == find(r, b)}
    assert same(root) == same(want) and len(links) < 12


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in near_dups.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100} or {k: v for k, v in got.items() if k != v} == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "", None, None, None), (90003, "password = hunter2hunter2 " + " ".join(f"plain{i} prose{i}" for i in range(60)), "en", "s", 9)], docs.schema)
    docs = docs.unionByName(odd).withColumn("kept", F.lit("clash")).withColumn("blob", F.lit(1))
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS and 0 < out.count() <= before, name
        if k == 0:
            want = {r.doc_id for r in docs.collect() if textstats.judge(r.text)[7]}
            assert {r.doc_id for r in out.collect()} == want and 90003 in want
        if k == 2:
            assert {r[0] for r in brute([(r.doc_id, r.text) for r in docs.collect()], 5) if r[3]} == {r.doc_id for r in out.collect()}
        if k == 3:
            assert out.count() == before and out.where("doc_id = 90003").first().text.startswith("[SECRET] plain0")
        before, docs = out.count(), out
    assert set(docs.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0


def near_copies(n, rate, seed=1, words=100):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [(i, edited(rng, base, rate * rng.random() * 2)) for i in range(n)]


@pytest.mark.parametrize("rate", [0.01, 0.03, 0.06])
def test_components_of_edited_copies(spark, rate):
    rows = near_copies(250, rate)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(near_dups.near_duplicates(docs, shingle=4)) == brute(rows)


def test_rows_for_confirmation_grow_with_the_copies(spark, monkeypatch):
    """Rows sent to stars, to differences and to blocks, for 500 near copies and for four times as many."""
    sent = {}
    for n in (500, 2000):
        count = sent.setdefault(n, [])
        deal, rest = near_dups._deal, near_dups._rest_of_stars
        monkeypatch.setattr(near_dups, "_deal", lambda edges, sets, deal=deal, count=count: (count.append(edges.count()), deal(edges, sets))[1])
        monkeypatch.setattr(near_dups, "_rest_of_stars", lambda *a, rest=rest, count=count: (lambda df: (count.append(df.count()), df)[1])(rest(*a)))
        near_dups.near_duplicates(spark.createDataFrame(near_copies(n, 0.03), "doc_id long, text string"), shingle=4).count()
        monkeypatch.undo()
    small, large = sum(sent[500]), sum(sent[2000])
    assert len(sent[500]) == 3 and large < 6 * small, sent


@pytest.mark.parametrize("size", [4, 5, 9, 10, 14, 20])
def test_buckets_of_short_sets(size):
    """Sets of few elements fill few bins, and the bins that others lend are not independent: links are looked for, not computed."""
    rng, banding, met, n = np.random.default_rng(size), near_dups.Banding(), 0, 400
    for _ in range(n):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        least = -(-4 * size // 5)  # a part of a with 0.8 of it
        b = rng.permutation(a)[:least]
        met += bool(set(banding.keys(np.sort(a)).tolist()) & set(banding.keys(np.sort(b)).tolist()))
    assert met >= 0.99 * n, met


def test_rows_without_an_id_stay(spark, sf):
    docs = spark.createDataFrame([(None, "same words in both of these rows"), (None, "same words in both of these rows"), (3, "same words in both of these rows"), (4, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, shingle=4).collect()), key=str)
    assert got == sorted([(None, 4, None, True)] * 2 + [(3, 4, 3, True), (4, 0, 4, True), (None, 0, None, True)], key=str)
    text = " ".join(f"plain{i} prose{i}," for i in range(60)) + "."
    whole = spark.createDataFrame([(None, text, "en", "s", 1), (None, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        if k != 1:  # the classifier's verdict depends on its labels
            whole = stage(spark, whole, sf)
    assert sorted((r.doc_id for r in whole.collect()), key=str) == [1, None, None]
