"""The audit of filters against plain Python that applies them one by one, and against its SQL."""

import random
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import filter_audit, queries


def failed(rows):
    """The letters of the filters that each (id, text, source) fails."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = t.encode().split()
        fails = ""
        fails += "A" if len(words) < 200 else ""
        fails += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        fails += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else ""
        fails += "D" if any(c in "#$%&*|" for c in t) else ""
        fails += "E" if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else ""
        out.append(fails)
    return out


def brute(rows, labels):
    fails = failed(rows)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                found.append(["".join(order), step, len(left), len(gone), redundant, sum(x[1] == f for x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        out |= {(part, o, s): (*rest, shapley[o[s - 1]]) for o, s, *rest in found}
    return out


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_against_python(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "A", "ABC abc", "é x\x85y $", "#", "word " * 300, "x" * 10_000, " ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}" for k in range(250)), " ".join(f"w{k}|" for k in range(199))]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "a", "b", "hot", "hot"])) for i in range(150)]
    rows += [(None, None, "a"), (None, "a", "b"), (None, "a", None), (7, rows[7][1], "a"), (7, rows[7][1], "a"), (7, "other", "b"), (-5, "late copy", "z"), (900, "late copy", "y")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (5000, 1, 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    docs = docs.select("*", *(F.lit("clash").alias(c) for c in ("quality", "toxic", "part", "mask", "n", "own", "digest", "id", "first", "salt")))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1)).withColumn("n", F.lit(1))
    got = told(filter_audit.audit_filters(docs, marks))
    assert got == brute(rows, labels)
    assert all(sum(got[p, o, s][-1] for s in range(1, 6)) == 120 * sum(got[p, o, s][1] for s in range(1, 6)) for p, o, _ in got)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    assert told(filter_audit.audit_filters(docs, labels))["s", "EDCBA", 5] == (0, 1, 0, 1, 0, 0, 120)


def test_matrices():
    columns, by = filter_audit.outcomes()
    assert len(columns) == 600 and all(x.shape == (32, 600) for x in by.values())
    assert (by["removed"].reshape(32, 120, 5).sum(axis=(1, 2)) == [120 * (m > 0) for m in range(32)]).all()


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_ngram_join"])
def test_documents_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), db.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.select(*names).fetchall())
