"""The vector index against all pairs, and how few pairs it compares."""

import numpy as np
import pytest

from docloom.operators import search, vectorindex
from docloom.operators.vectorindex import VectorIndex


def clustered(rng, clusters=20, each=60, dims=16, noise=0.05):
    centres = rng.normal(size=(clusters, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.repeat(centres, each, axis=0) + noise * rng.normal(size=(clusters * each, dims))


def frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def cosines(x):
    u = vectorindex.unit(x)
    return np.round(u @ u.T, 9)


def test_skips_most_pairs_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK", 100)
    x = clustered(np.random.default_rng(1))
    df, n = frame(spark, x), len(x)
    index = VectorIndex.build(df, pivots=40)
    assert index.comparisons(index.threshold_visits(0.9)) < n * n / 8
    s = cosines(x)
    np.fill_diagonal(s, -2)
    got = {r.vec_id: (r.n_links, r.least_link, r.n_doubtful) for r in search.similarity_classes(df, 0.97, 0.9).collect()}
    assert got == {i: (int((s[i] >= 0.97).sum()), int((s[i] >= 0.97).argmax()) if (s[i] >= 0.97).any() else None, int(((s[i] >= 0.9) & (s[i] < 0.97)).sum())) for i in range(n)}

    asked = df.where("vec_id % 50 = 0")
    found = {(r.query, r["rank"]): r.match for r in index.nearest(asked, 4).collect()}
    ids = range(0, n, 50)
    assert len(found) == 4 * len(ids) and all(s[q, found[q, k + 1]] == pytest.approx(np.sort(s[q])[-1 - k], abs=1e-8) for q in ids for k in range(4))
    rows = index.located(asked)
    first = index._visits(rows, None, 5)
    nearest = index.nearest(asked, 4)
    assert index.comparisons(first) + index.comparisons(index.other_visits(rows, nearest, 4)) < n * len(ids) / 4


def test_appends_and_edge_cases(spark):
    rng = np.random.default_rng(3)
    x = list(rng.normal(size=(60, 5))) + [np.zeros(5), None, np.ones(5), np.ones(5) * 7, -np.ones(5)]
    whole = VectorIndex.build(frame(spark, x))
    grown = VectorIndex.build(frame(spark, x).where("vec_id < 20")).append(frame(spark, x).where("vec_id >= 20"))
    keep = [i for i, v in enumerate(x) if v is not None]
    s = np.full((len(x), len(x)), -9.0)
    s[np.ix_(keep, keep)] = cosines([x[i] for i in keep])
    np.fill_diagonal(s, -9)
    for index in (whole, grown):
        got = {(r.query, r["rank"]): (r.match, round(r.similarity, 8)) for r in index.nearest(frame(spark, x), 2).collect()}
        assert set(got) == {(i, k) for i in keep for k in (1, 2)}
        assert all(got[i, k][1] == pytest.approx(np.sort(s[i])[-k], abs=1e-7) for i, k in got)
    assert got[60, 1][0] == 0  # all have cosine 0 with a vector of zeros
    assert VectorIndex.build(frame(spark, x).limit(0)).nearest(frame(spark, x), 1).count() == 0
    classes = {r.vec_id: r.cluster for r in search.similarity_classes(frame(spark, x), 0.999).collect()}
    assert classes[62] == classes[63] == 62 and classes[61] == 61 and classes[64] == 64 and len(classes) == len(x)


def test_doubtful_pairs_and_verdicts(spark):
    angle = np.array([0.0, 0.1, 0.7, 0.8, 1.5, 1.6, 3.0])  # neighbours of 0.1 are sure, those of 0.6 to 0.7 doubtful
    index = VectorIndex.build(frame(spark, np.stack([np.cos(angle), np.sin(angle)], 1)))
    pairs = {(r.a, r.b) for r in search.doubtful_pairs(index, 0.75, 0.95, 1).collect()}
    cos = np.round(np.cos(angle[:, None] - angle[None, :]), 9)
    inside = np.where((cos >= 0.75) & (cos < 0.95), cos, -9)
    want = {tuple(sorted((i, int(inside[i].argmax())))) for i in range(7) if inside[i].max() > 0}
    assert pairs == want and (1, 2) in want
    ask = lambda rows: {r.id: (r.cluster, r.contested) for r in search.resolve_ambiguous(index, spark.createDataFrame(rows, "a long, b long, verdict boolean"), 0.95).collect()}
    assert ask([(1, 2, True), (3, 4, False)]) == {0: (0, False), 1: (0, False), 2: (0, False), 3: (0, False), 4: (4, False), 5: (4, False), 6: (6, False)}
    assert ask([(1, 2, True), (0, 3, False)]) == {0: (0, True), 1: (0, True), 2: (2, True), 3: (2, True), 4: (4, False), 5: (4, False), 6: (6, False)}
    near = search.conflict_candidates(frame(spark, [[1.0, 0.05]]).selectExpr("vec_id + 100 as vec_id", "embedding"), frame(spark, np.stack([np.cos(angle), np.sin(angle)], 1)), 2)
    assert sorted((r.a, r.b) for r in near.collect()) == [(100, 0), (100, 1)]
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "vec_id long, text string")
    got = search.judged(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), texts, lambda a, b: [x == y for x, y in zip(a, b)])
    assert sorted(map(tuple, got.collect())) == [(1, 2, True), (2, 3, False)]


def test_blocks_are_few_and_bounded():
    """A row is sent to each block of the other side: about BLOCKS of them, until one would hold more than MOST."""
    for cells, each in ((512, 1200), (512, 100), (1, 500_000), (512, 6000)):
        sizes = np.full(cells, each)
        start, parts = vectorindex.VectorIndex._deal(sizes)
        held = np.zeros(max(s + p for s, p in zip(start, parts)))
        for s, p, n in zip(start, parts, sizes):
            held[s : s + p] += n / p
        assert held.max() <= vectorindex.MOST and len(held) <= 2 * max(vectorindex.BLOCKS, sizes.sum() / vectorindex.MOST)
