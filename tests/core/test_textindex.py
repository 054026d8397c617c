"""The inverted index against scans of the texts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import search, textindex
from docloom.plans.engine import KnowledgeEngine

WORDS = ["an", "toàn", "phòng", "cháy", "the", "licence", "x1", "ĐIỀU", "số"]


def rows(n, seed=1):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "13/2023/NĐ-CP an toàn"), (n + 3, "số 13 / 2023 / NĐ - CP."), (n + 4, "113/2023/NĐ-CP"), (n + 5, "13/2023/NĐ-CPX"), (3, "the the same key"), (None, "the licence")]


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(textindex, "RANGE_ROWS", 16)
    monkeypatch.setattr(textindex, "FIRST_RANGES", 1)


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumn("key", F.lit("clash")).withColumn("range", F.lit(1))


def told(df):
    names = sorted(df.columns)
    return sorted(map(repr, df.select(names).withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"}).collect()))


def test_searches_read_no_text_and_equal_scans(spark, tmp_path, small):
    docs = frame(spark, rows(300))
    index = textindex.build(docs, f"{tmp_path}/index", buckets=3)
    for terms, phrases in ((["an", "toan"], []), (["the"], ["phong chay"]), ([], ["an toàn phòng", "the the"]), (["nothing"], []), ([], []), (["x1", "x1", "so"], ["so dieu", "x1"])):
        got = index.lexical(terms, phrases)
        assert "text" not in got._jdf.queryExecution().optimizedPlan().toString()
        scan = docs.withColumn("text", F.concat(F.lit(" "), F.regexp_replace("text", "[,.]", ""), F.lit(" ")))  # a scan's phrases are parts of the text
        assert told(got) == told(search.lexical(scan, terms, [f" {' '.join(search.tx.words_of(p))} " for p in phrases]))
    for terms in (["an", "toan"], ["licence"], ["nothing"]):
        assert told(index.bm25(terms)) == told(search.bm25(docs, terms))


def test_phrases_are_whole_words_that_follow(spark, tmp_path, small):
    index = textindex.build(frame(spark, rows(0) + [(50, "recreative commons"), (51, "Creative, Commons"), (52, "commons creative"), (53, "a b a b c"), (54, "a b a c")]), f"{tmp_path}/index")
    ids = lambda *p: sorted(r.doc_id for r in index.with_phrase(p).collect())
    assert ids("creative commons") == [51] and ids("a b a") == [53, 54] and ids("a b c") == [53] and ids("b a b", "a c") == [53, 54]
    assert ids("13/2023/NĐ-CP") == [2, 3]  # spaced, too, and neither a longer number nor a longer ending
    assert ids("...") == []


def test_appends_equal_one_build(spark, tmp_path, small):
    data = rows(120)
    parts = [data[:50], data[50:51], [], data[51:]]
    index = textindex.TextIndex(spark, f"{tmp_path}/parts")
    for part in parts:
        index.append(frame(spark, part))
    whole = textindex.build(frame(spark, data), f"{tmp_path}/whole")
    assert told(index.lexical(["an", "the"], ["toan phong"])) == told(whole.lexical(["an", "the"], ["toan phong"]))
    assert told(index.bm25(["an", "the"])) == told(whole.bm25(["an", "the"])) and told(index.top(["an", "the"], 7)) == told(whole.top(["an", "the"], 7))
    assert index.segments().count() == 4 and index.segments().agg(F.sum("n")).first()[0] == len(data)


def test_half_written_appends_are_not_seen(spark, tmp_path, monkeypatch):
    index = textindex.build(frame(spark, rows(20)), f"{tmp_path}/index")
    before = told(index.bm25(["the"]))
    monkeypatch.setattr(textindex.TextIndex, "_read", lambda *a: 1 / 0)  # fails after the postings, before the segment's row
    with pytest.raises(ZeroDivisionError):
        index.append(frame(spark, rows(20)))
    monkeypatch.undo()
    assert told(index.bm25(["the"])) == before


def test_top_skips_ranges(spark, tmp_path, small):
    data = [(i, "the common words of all " * (1 + i % 5)) for i in range(800)] + [(1000 + i, "zqxv the zqxv") for i in range(6)]
    index = textindex.build(frame(spark, data), f"{tmp_path}/index")
    for terms, k in ((["zqxv", "the"], 5), (["the"], 10), (["zqxv"], 50), (["the", "all"], 2000), (["none"], 3)):
        got = [(r.doc_id, round(r.bm25, 9)) for r in index.top(terms, k).collect()]
        want = [(r.doc_id, round(r.bm25, 9)) for r in index.bm25(terms).orderBy(F.desc("bm25"), "doc_id").limit(k).collect()]
        assert got == want
    count = lambda b: b.select("segment", "range").distinct().count()
    assert count(index.promising(["zqxv", "the"], 5)[0]) < count(index.blocks(["zqxv", "the"])) / 4


def test_engine_answers_from_the_index(spark, tmp_path, small):
    docs = frame(spark, rows(60)).where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    index = textindex.build(docs, f"{tmp_path}/index")
    for visible in (None, F.col("lang") == "a"):
        with_index, without = (KnowledgeEngine(spark, docs, visible=visible, index=i).search("phòng cháy licence", 5) for i in (index, None))
        assert [r.doc_id for r in with_index.collect()] == [r.doc_id for r in without.collect()]


def test_best_of_many_equals_all_hits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "RANGE_ROWS", 64)
    monkeypatch.setattr(textindex, "GROUP_RANGES", 2)
    far = 1 << 60  # keys that a double does not hold
    docs = frame(spark, [(k if k is None else k + far, t) for k, t in rows(250) if k != 3])
    index = textindex.build(docs, f"{tmp_path}/index", buckets=3)
    own = docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), F.lit("g").alias("group"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("scope"))
    asked = [(far + 1, ["an", "toan"], [["an", "toan"]], None), (far + 2, [], [["the", "the"]], ["odd"]), (far + 3, ["the", "x1", "nothing"], [], ["even", "odd"]), (far + 4, ["the"], [], []), (far + 5, [], [], None)]
    queries = spark.createDataFrame(asked, "query long, terms array<string>, phrases array<array<string>>, scopes array<string>")
    met = index.lexical_many(queries).join(own, "key").join(queries.select("query", "scopes"), "query").where("scopes is null or array_contains(scopes, scope)")
    order = Window.partitionBy("query").orderBy(F.desc("needle"), F.desc("all_terms"), F.desc("hits"), F.desc("tf"), "key")
    best = lambda df: told(df.withColumn("rank", F.row_number().over(order)).where("rank <= 7").select("query", "key", "needle", "all_terms", "hits", "tf", "rank"))
    got = index.best_many(queries, own, 7)
    assert best(got) == best(met) and got.groupBy("query").count().count() == 3


def test_best_of_many_returns_no_more_than_is_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "RANGE_ROWS", 64)
    monkeypatch.setattr(textindex, "GROUP_RANGES", 1)
    docs = frame(spark, [(k, t) for k, t in rows(250) if k is not None])
    index = textindex.build(docs, f"{tmp_path}/index", buckets=3)
    own = docs.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("scope"))
    asked = [(1, ["an", "the", "an"], [["an"], ["an", "toan", "phong"]], None), (2, [], [["an", "toan", "phong"]], ["odd"]), (3, ["the"], [["an", "toan"], ["none", "an"]], ["even"]), (4, ["the"], [[]], ["none"]), (5, None, None, None)]
    queries = spark.createDataFrame(asked, "query long, terms array<string>, phrases array<array<string>>, scopes array<string>")
    got = index.best_many(queries, own, 3)
    assert 0 < got.groupBy("query").count().agg(F.max("count")).first()[0] <= 3
    met = index.lexical_many(queries).join(own, "key").join(queries.select("query", "scopes"), "query").where("scopes is null or array_contains(scopes, scope)")
    order = Window.partitionBy("query").orderBy(F.desc("needle"), F.desc("all_terms"), F.desc("hits"), F.desc("tf"), "key")
    want = met.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    assert told(got) == told(want.select(*got.columns)) and want.count()
