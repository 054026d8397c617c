"""The n-gram join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ngram_join, queries


def brute(rows, k=3, percent=90):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((i, len(s), None if i is None else find(i)) for i in sets for s in sets[i]), key=repr)


def told(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def edited(rng, words, edits, new=None):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = rng.choice(new) if new else f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("block,walkers", [(256, 32), (16, 7)])
def test_components_against_python(spark, monkeypatch, block, walkers):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "WALKERS", walkers)
    monkeypatch.setattr(ngram_join, "SIFTED", 4 * block)
    rng = random.Random(block)
    rows = list(enumerate([None, "", "a", "A", "a b", "a  b", "a b c", "A B\tC", "a b c d", "\t\n", "é x\x85y z"]))
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows += [(100 + i, edited(rng, base, rng.randrange(6))) for i in range(70)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(15):
        rows.append((300 + i, " ".join(chain)))
        chain = chain[1:] + [f"n{i}"]
    for n in (9, 10, 11, 12, 13, 20, 30):
        words = [f"s{n}x{j}" for j in range(n)]
        rows += [(400 + 10 * n, " ".join(words)), (401 + 10 * n, " ".join(words[:-1])), (402 + 10 * n, " ".join([*words, "more"]))]
    common = " ".join(f"p{j}" for j in range(60))
    rows += [(900 + i, common + " " + " ".join(f"u{i}x{j}" for j in range(rng.randrange(2, 40)))) for i in range(30)]
    rows += [(7, "a b c d e"), (100, rows[20][1]), (None, rows[15][1]), (None, None), (None, "a b c"), (100, None), (310, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("n", "id", "digest", "element", "z", "rep")))
    assert told(ngram_join.similar_sets(docs)) == brute(rows)
    assert told(ngram_join.similar_sets(docs, shingle=2, percent=60)) == brute(rows, 2, 60)


@pytest.mark.parametrize("n,edits", [(300, 2)])
def test_templates_against_python(spark, monkeypatch, n, edits):
    """Texts that take few of a fixed number of edits, as forms and logs do."""
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    rng = random.Random(n + edits)
    base = [f"w{i}" for i in range(150)]
    spots = rng.sample(range(150), 25)
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(spots, edits):
            words[at] = f"e{at}"
        rows.append((i, " ".join(words)))
    assert told(ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_documents_against_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert told(queries.op12_ngram_join(spark, sf)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert ngram_join.similar_sets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_trie_against_pairs(seed):
    rng = np.random.default_rng(seed)
    base = np.sort(rng.choice(2000, 90, replace=False)).astype(np.uint64)
    sets = [np.unique(np.concatenate([[np.uint64(0)], base[rng.random(90) > rng.choice([0, 0.03, 0.1])], rng.integers(1, 3000, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(60)]
    sets += [np.array([0], np.uint64), np.array([0, 5], np.uint64), sets[0].copy(), sets[1][: len(sets[1]) // 2], np.arange(500, dtype=np.uint64), np.arange(510, dtype=np.uint64)]
    sizes = np.array([len(s) + int(x) for s, x in zip(sets, rng.integers(0, 3, len(sets)))])
    trie = [int(x) for x in rng.permutation(len(sets))[:45]]
    built = ngram_join.Trie([sets[k] for k in trie], sizes[trie])
    apart = np.arange(len(sets))
    got = {(int(w), trie[m]) for w, m in zip(*built.walk(sets, sizes, 80, apart + 1000, apart[trie]))}
    want = {(a, b) for a in range(len(sets)) for b in trie if 100 * (x := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (sizes[a] + sizes[b] - x)}
    assert got == want
    labels = apart.tolist()
    links = ngram_join.links_in_trie(trie, list(range(len(sets))), sets, sizes, labels, 80)
    assert all((a, b) in want for a, b in links) and all(labels[a] == labels[b] for a, b in want) and len(links) == len(sets) - len(set(labels))


@pytest.mark.parametrize("seed", range(4))
def test_parities_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > rng.choice([0, 0.02, 0.1, 0.9])], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(40)]
    n = np.array([len(s) for s in sets])
    bits = [ngram_join.parity(s) for s in sets]
    near = ngram_join.near_parities(bits, bits, n, n, np.ones((40, 40), bool), 90)
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    linked = 100 * both >= 90 * (n[:, None] + n[None, :] - both)
    assert not (linked & ~near).any()
    apart = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(20)]
    bits, n = [ngram_join.parity(s) for s in apart], np.full(20, 300)
    assert not ngram_join.near_parities(bits, bits, n, n, ~np.eye(20, dtype=bool), 90).any()
