"""The SQL guard, citation rules, term patterns and similarity classes."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import consolidate, search, vectorindex
from docloom.plans import guard


@pytest.mark.parametrize("sql", [
    "select reflect('java.lang.System', 'getProperty', 'user.dir') from t", "select java_method('java.lang.System', 'exit', 1) from t", "select try_reflect('java.lang.System', 'getenv') from t",
    "select * from t where a in (select reflect('java.lang.System', 'nanoTime') from t)", "with u as (select reflect('java.lang.System', 'nanoTime') x from t) select * from u", "select a from t order by reflect('a', 'b')",
    "select transform(a) using 'cat' from t", "select input_file_name() from t", "select * from range(3)", "select * from parquet.`/tmp/x`", "select * from other", "drop view t", "insert into t values (1)", "set x = 1",
    "select explode(array(1, 2)) from t", "select * from t lateral view explode(array(1)) e as x", "select identifier('reflect')('a', 'b') from t", "select a from identifier('other')", "select system.builtin.reflect('a', 'b') from t", "", "select from where",
    "select (select max(x) from parquet.`/etc/passwd`) from t", "select session_user() from t", "select secret_scope('a') from t",
])
def test_statements_that_may_not_run(spark, sql):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(guard.Refused):
        guard.query(spark, sql, {"t": df})


def test_statements_that_may(spark):
    df = spark.createDataFrame([(1, "reflect('a')"), (2, "drop table t")], "a int, b string")
    got = guard.query(spark, "with u as (select a, upper(b) as b, row_number() over (order by a) as r from t) select u.b, count(*) as n from u join t using (a) where u.b like '%DROP%' or exists (select 1 from t where a = 9) group by u.b having count(*) > 0 union all select 'reflect(1)', cast(coalesce(null, 7) as bigint)", {"t": df})
    assert [tuple(r) for r in got.collect()] == [("DROP TABLE T", 1), ("reflect(1)", 7)]


@pytest.mark.parametrize(
    "sql",
    [
        "select repeat(b, 1000000000) from t", "select size(sequence(1, 1000000000)) from t", "select rpad(b, 2000000000, 'x') from t", "select rpad(b, cast(a as int), 'x') from t", "select count(*) from t x, t y, t z",
        "with recursive r as (select 1 as n union all select n + 1 from r) select * from r", "select * from t x join t y on x.a < y.a", "select * from t x join t y on 1 = 1", "select * from t x join t y on x.a = x.a + 0 * length(x.b)", "select * from t x cross join t y",
        "with a as (select concat(b, b, b, b, b, b, b, b) as b from t), c as (select concat(b, b, b, b, b, b, b, b) as b from a), d as (select concat(b, b, b, b, b, b, b, b) as b from c), e as (select concat(b, b, b, b, b, b, b, b) as b from d), f as (select concat(b, b) as b from e) select * from f",
        "with a as (select * from t union all select * from t union all select * from t), b as (select * from a union all select * from a union all select * from a), c as (select * from b union all select * from b) select * from c",
        "select aggregate(split(b, ''), b, (s, x) -> concat(s, s)) from t", "select collect_list(b) from t", "select regexp_replace(b, '.', b) from t", "select * from t x where exists (select 1 from t y where y.a > x.a)",
    ],
)
def test_work_is_bounded(spark, sql):
    """Refused before anything runs, by the parsed or by the optimised plan."""
    with pytest.raises(guard.Refused):
        guard.query(spark, sql, {"t": spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string").repartition(2)})


def test_joins_by_equality_may_run(spark):
    t = spark.createDataFrame([(1, "x" * 200_000), (2, "y")], "a long, b string").repartition(2)
    ask = lambda sql: guard.query(spark, sql, {"t": t}).collect()
    assert len(ask("select x.a, y.a from t x, t y where x.a = y.a")) == 2 and len(ask("select * from t x left join t y on x.a = y.a + 1 and x.b < y.b")) == 2
    assert len(ask("select * from t, (values (1), (2)) as v(k)")) == 4 and len(ask("select * from t x where a in (select a from t where a > 1)")) == 1
    assert len(ask("select * from t cross join (select max(a) as m from t)")) == 2 and ask("select lpad(b, 3, '-') as b from t where a = 2")[0].b == "--y"
    assert len(ask("select b from t where a = 1")[0].b) == guard.CHARACTERS and [len(r) for r in ask("select a, a from t where a = 1")] == [2]


def test_views_are_private(spark):
    spark.createDataFrame([(7,)], "a int").createOrReplaceTempView("mine")
    first = guard.query(spark, "select * from mine", {"mine": spark.createDataFrame([(1,)], "a int")})
    second = guard.query(spark, "select * from mine", {"mine": spark.createDataFrame([(2,)], "a int")})
    assert (first.first().a, second.first().a, spark.table("mine").first().a) == (1, 2, 7)
    spark.catalog.dropTempView("mine")
    guard.query(spark, "select * from gone", {"gone": second})
    assert not spark.catalog.tableExists("gone")


SOURCE = """Nghị định 136/2020/NĐ-CP quy định chi tiết một số điều của Luật Phòng cháy.
Điều 1. Phạm vi

Điều 2. Đối tượng áp dụng
Cơ sở thuộc diện quản lý về phòng cháy phải lập hồ sơ theo dõi, quản lý hoạt động phòng cháy theo quy định.
Thời hạn thẩm duyệt thiết kế là 10 ngày làm việc."""


def test_claims(spark):
    cases = [
        (1, "Thời hạn thẩm duyệt thiết kế là 10 ngày làm việc.", 1.0, 1.0, "verbatim"),
        (2, "Theo Điều 45 của Nghị định này, cơ sở phải lập hồ sơ theo dõi, quản lý hoạt động phòng cháy theo quy định.", 0.2, 0.2, "article missing"),
        (3, "Theo Nghị định 999/2024/NĐ-CP, cơ sở phải lập hồ sơ theo dõi, quản lý hoạt động phòng cháy.", 0.25, 0.25, "number missing"),
        (4, "Cơ sở thuộc diện quản lý phòng cháy phải lập hồ sơ theo dõi và quản lý hoạt động PCCC", 0.7, 0.99, "overlap"),
        (5, "", 1.0, 1.0, "empty"), (6, "Mức phạt cao nhất là 500 triệu đồng và tước giấy phép", 0.0, 0.64, "overlap"), (7, "Theo Điều 2, cơ sở thuộc diện quản lý phải lập hồ sơ theo dõi theo quy định", 0.65, 0.99, "overlap"),
    ]
    claims = spark.createDataFrame([(i, 1, t) for i, t, *_ in cases] + [(8, 2, "without a source"), (9, 3, "of an empty source")], "claim_id int, doc int, claim string")
    got = {r.claim_id: r for r in consolidate.verify_claims(claims, spark.createDataFrame([(1, SOURCE), (3, None)], "doc int, text string"), "doc", "text").collect()}
    for i, _, low, high, why in cases:
        assert low <= got[i].score <= high and got[i].reason == why and got[i].holds == (got[i].score >= 0.65), (i, got[i])
    assert got[8].reason == got[9].reason == "no source" and not got[8].holds


def test_pages_of_claims(spark):
    page = "# Tiêu đề\n> trích\nThời hạn thẩm duyệt thiết kế là 10 ngày làm việc [^s1].\nMức phạt cho hành vi không lập hồ sơ là 500 triệu đồng và tước giấy phép vĩnh viễn [^s2].\n\n[^s1]: Nghị định 136/2020."
    plain = "Cơ sở thuộc diện quản lý về phòng cháy phải lập hồ sơ theo dõi, quản lý hoạt động phòng cháy theo quy định. Ngắn."
    pages = spark.createDataFrame([("a", 1, page), ("b", 1, plain), ("c", 1, "không có gì"), ("d", 1, None)], "page string, doc int, content string")
    got = {r.page: (r.n_claims, r.n_held, r.score, r.flagged) for r in consolidate.verify_pages(pages, spark.createDataFrame([(1, SOURCE)], "doc int, text string"), "doc", "text").collect()}
    assert got == {"a": (2, 1, 0.5, True), "b": (1, 1, 1.0, False), "c": (0, 0, 1.0, False), "d": (0, 0, 1.0, False)}


def test_term_hits_are_the_tokens(spark, sf):
    texts = ["The thé THÈ bathe the_x the", "áthe thé ́the", "İng ıng ING KKelvin", "x2 X² ñandú Đường đường", None, "", "phòng phong PHÒNG phòng"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    terms = ["the", "ing", "kkelvin", "x2", "nandu", "duong", "phong", "de", "tion"]
    c = F.col("text")
    rows = docs.select(tx.term_hits(c, terms).alias("hits"), F.filter(tx.tokens(c), lambda w: w.isin(*terms)).alias("want"), tx.n_tokens(c).alias("n"), F.size(tx.tokens(c)).alias("size"), F.array_sort(tx.distinct_tokens(c)).alias("d"), F.array_sort(F.array_distinct(tx.tokens(c))).alias("e"), F.regexp_extract_all(F.lower(F.regexp_replace(F.translate(c, *tx.fold_table()), r"\p{Mn}+", "")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)).alias("slow"), tx.tokens(c).alias("fast")).collect()
    assert all(r.hits == r.want or r.want is None for r in rows) and all(r.n == r.size or r.n is None for r in rows)
    assert all(r.d == r.e and r.slow == r.fast for r in rows) and sum(len(r.hits or []) for r in rows) > 100
    assert tx.words_of("The  Thé-tion, ĐƯỜNG") == ["the", "the", "tion", "duong"]


def test_similarity_classes(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK", 3)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.3]), (3, [1.0, 0.6]), (4, [0.0, 1.0]), (5, [0.0, 2.0]), (6, None), (7, [0.0, 0.0]), (8, [-1.0, 0.0]), (9, [-1.0, 0.1])]
    got = sorted(tuple(r) for r in search.similarity_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, 0.85).select("vec_id", "cluster", "n_links", "n_doubtful").collect())
    assert got == [(1, 1, 1, 1), (2, 1, 2, 0), (3, 1, 1, 1), (4, 4, 1, 0), (5, 4, 1, 0), (6, 6, 0, 0), (7, 7, 0, 0), (8, 8, 1, 0), (9, 8, 1, 0)]


def test_shared_words_by_rare_ones(spark):
    docs = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 15)) + " common") for i in range(40)] + [(99, None)]
    claims = [(i, " ".join(f"w{(i * k) % 19}" for k in range(1, 12)) + " common rare") for i in range(12)]
    got = {(r.claim_id, r.doc_id): r.n_shared for r in consolidate.shared_words(spark.createDataFrame(claims, "claim_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"), "text", "doc_id", "text", 6).collect()}
    want = {(i, j): len({*a.split()} & {*(b or "").split()}) for i, a in claims for j, b in docs}
    assert got == {k: n for k, n in want.items() if n >= 6} and got
