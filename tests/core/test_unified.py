"""Search for many queries: exact hits on top, flags of a group, scopes, and arms that fail alone."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import textindex, unified
from docloom.operators.vectorindex import VectorIndex
from docloom.plans import finding

ROWS = [
    (1, "g1", "a", "phòng cháy chữa cháy nhà cao tầng", [1.0, 0.0]),
    (2, "g1", "a", "quy định số 13/2023/NĐ-CP về dữ liệu", [0.9, 0.1]),
    (3, "g2", "b", "phòng cháy rừng", [0.0, 1.0]),
    (4, "g3", "a", "không liên quan", [-1.0, 0.2]),
    (5, None, None, None, None),
]
QUERIES = [
    (1, "phòng cháy", ["phong", "chay"], [], [1.0, 0.0], None),
    (2, "13/2023/NĐ-CP", [], [["13", "2023", "nd", "cp"]], None, ["a"]),
    (3, "phòng cháy", ["phong", "chay"], [], [1.0, 0.0], ["b"]),
    (4, "phòng cháy", ["phong", "chay"], [], [1.0, 0.0], []),
    (5, "", [], [], None, None),
]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query long, query_text string, terms array<string>, phrases array<array<string>>, embedding array<double>, scopes array<string>")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "key long, group string, scope string, text string, embedding array<double>")
    words = textindex.build(rows, str(tmp_path_factory.mktemp("index")), "key")
    return unified.Corpus("page", rows.drop("embedding"), words, VectorIndex.build(rows, "key", tag="scope"))


def test_answers(asked, corpus):
    found = unified.search_all(asked, [corpus], k=3)
    assert found.failed == []
    got = {}
    for r in found.ranked.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.key, r.exact, r.lexical))
    assert got[1] == [(3, False, True), (1, False, True)]  # both have the words in a row; the shorter one has the larger share of them
    assert got[2] == [(2, True, True)]  # the number, in its one group
    assert got[3] == [(3, False, True)] and 4 not in got and 5 not in got
    hints = {}
    for r in found.hints.orderBy("query", "rank").collect():
        hints.setdefault(r.query, []).append(r.key)
    assert 1 not in hints and hints[3] == [1, 2, 4] and hints[4] == [1, 2, 3, 4]


def test_a_group_has_the_flags_of_all_its_rows(spark, asked, corpus):
    both = asked.where("query = 1").withColumn("phrases", F.array(F.array(*map(F.lit, ["13", "2023", "nd", "cp"]))))
    r = unified.search_all(both, [corpus], k=1).ranked.first()
    assert (r.group, r.key, r.exact, r.lexical) == ("g1", 1, True, True)


def test_an_arm_fails_alone(asked, corpus):
    class Broken:
        def lexical_many(self, queries):
            raise OSError("gone")

    found = unified.search_all(asked.where("query = 1"), [unified.Corpus("broken", corpus.rows, Broken()), corpus], k=3)
    assert found.failed == ["broken words: OSError"] and {r.corpus for r in found.ranked.collect()} == {"page"}
    alone = unified.search_all(asked, [unified.Corpus("broken", corpus.rows, Broken())])
    assert alone.ranked.count() == 0 and alone.hints.count() == 0 and len(alone.failed) == 1


def test_hints_that_fail_are_no_result(spark, sf, monkeypatch):
    def gone(*args, **given):
        raise OSError("gone")

    monkeypatch.setattr(VectorIndex, "nearest", gone)
    with pytest.raises(OSError):
        finding.unified_hints(spark, sf)


def test_equal_questions_are_searched_for_once(asked, corpus):
    class Counting:
        asked = []

        def nearest(self, queries, *given, **named):
            self.asked.append(queries.count())
            return corpus.vectors.nearest(queries, *given, **named)

    again = asked.unionByName(asked.withColumn("query", F.col("query") + 10))
    found = unified.out_of_scope(again, [unified.Corpus("page", corpus.rows, None, Counting())])
    hints = {}
    for r in found.orderBy("query", "rank").collect():
        hints.setdefault(r.query, []).append(r.key)
    assert Counting.asked == [2] and hints == {3: [1, 2, 4], 4: [1, 2, 3, 4], 13: [1, 2, 4], 14: [1, 2, 3, 4]}


def test_near_copies_are_not_told_beside_each_other(spark, tmp_path):
    texts = ["tang cao nha chay phong so mot", "tang cao nha chay phong so mot", "phong chay nha cao rung dam", "lua trai", "so 13/2023/NĐ-CP phong chay"]
    rows = spark.createDataFrame([(k, f"g{k}", "a", t) for k, t in enumerate(texts)], "key long, group string, scope string, text string")
    page = unified.Corpus("page", rows, textindex.build(rows, str(tmp_path / "index"), "key"))
    words = ["phong", "chay", "nha", "cao", "tang"]
    asked = [(1, " ".join(words), words, [], None, None), (2, " ".join(words), words, [["13", "2023", "nd", "cp"]], None, None)]
    queries = spark.createDataFrame(asked, "query long, query_text string, terms array<string>, phrases array<array<string>>, embedding array<double>, scopes array<string>")

    def told(**given):
        found = unified.search_all(queries, [page], k=4, **given).ranked.orderBy("query", "rank").collect()
        assert [r["rank"] for r in found] == [1, 2, 3, 4] * 2
        return [[(r.key, r.score) for r in found if r["query"] == q] for q in (1, 2)]

    def by_hand(rows):  # the greedy choice in plain Python
        own = {k: set(texts[k].split()) for k, _ in rows}
        like = lambda a, b: len(own[a] & own[b]) / len(own[a] | own[b])
        chosen, left = [rows[0]], rows[1:]
        while left:
            best = max(left, key=lambda r: 0.7 * r[1] - 0.3 * max(like(r[0], c) for c, _ in chosen))
            chosen.append(best)
            left.remove(best)
        return chosen

    plain, diverse = told(diverse=False), told()
    assert [k for k, _ in plain[0][:2]] == [0, 1] and diverse[0] == by_hand(plain[0]) != plain[0]
    assert plain[1][0][0] == 4 and diverse[1] == plain[1][:1] + by_hand(plain[1][1:])  # the number comes first


def test_rows_stay_as_found_where_no_score_is_sure(spark):
    hits = [(1, "page", "a", 1, 0.01, None, True, False, 0.12), (1, "page", "b", 2, 0.02, None, True, False, 0.11), (1, "page", "c", 3, 0.005, None, True, True, 0.9), (2, "page", "a", 1, 0.01, None, True, False, 0.3), (2, "page", "b", 2, 0.02, None, True, False, 0.1)]
    scored = spark.createDataFrame(hits, "query long, corpus string, group string, key long, rrf double, similarity double, lexical boolean, exact boolean, score double")
    texts = spark.createDataFrame([("page", k, "x y z") for k in (1, 2, 3)], "corpus string, key long, text string")
    got = unified._diversified(scored, texts, 3).orderBy("query", "rank").collect()
    assert [(r["query"], r.key) for r in got] == [(1, 3), (1, 2), (1, 1), (2, 1)]
