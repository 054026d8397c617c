"""Upkeep, evidence, footnotes, running budgets and streams on small cases."""

import datetime

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import consolidate, search, upkeep
from docloom.plans import flows
from docloom.session import spread
from docloom.streaming import events as ev

SOURCE = "source_id long, status string, chunk_status string, wiki_status string, phase string, has_text boolean, verbatim boolean, recoveries int, by_admin boolean, asked string"


def test_retry_plans(spark):
    rows = [
        (1, "ready", "error", "ready", None, True, False, 0, False, None),
        (2, "partial", "error", "ready", None, True, False, 0, False, None),
        (3, "partial", "ready", "error", "verify", True, None, None, None, None),
        (4, "error", "error", "error", None, False, False, 0, False, None),
        (5, "error", "error", "error", "map", True, True, 0, False, None),
        (6, "error", None, None, None, True, False, 9, False, None),
        (7, "error", None, None, None, True, False, 9, True, None),
        (8, "plan_ready", "ready", "done", None, False, False, 0, False, "wiki"),
        (9, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.source_id: (r.refusal, r.branch, r.start) for r in upkeep.retry_plan(spark.createDataFrame(rows, SOURCE)).collect()}
    assert got == {
        1: ("status", None, None), 2: (None, "chunk", None), 3: (None, "wiki", "refine"), 4: (None, "all", None), 5: (None, "chunk", None),
        6: ("too_many", None, None), 7: (None, "all", None), 8: ("no_text", None, None), 9: ("status", None, None),
    }


def test_briefing_index_and_log(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("_hot", "H", "seed", None, "x"), ("a", "A", "seed", t, "> [!contradiction] one\n> two\n\nthree"), ("b", "B", "mature", None, None)]
    pages = spark.createDataFrame(rows, "slug string, title string, status string, updated_at timestamp, content string")
    assert [tuple(r) for r in upkeep.briefing(pages).collect()] == [("contradiction", "a", "A", "one two"), ("recent", "a", "A", "2024-01-01 00:00"), ("recent", "b", "B", None), ("seed", "a", "A", None)]
    typed = pages.withColumn("page_type", F.when(F.col("slug") == "a", "concept")).withColumn("summary", F.when(F.col("slug") == "b", "what"))
    assert {tuple(r) for r in upkeep.index_lines(typed).collect()} == {("concept", "a", "- [[a|A]]", False), ("other", "b", "- [[b|B]] — what", False)}
    assert {tuple(r) for r in upkeep.index_lines(typed, 1).collect()} == {("concept", "a", "- [[a|A]]", True)}
    logs = spark.createDataFrame([(1, "# L\n\n", 2), (2, "# M\n", 7)], "scope int, content string, version int")
    entries = spark.createDataFrame([(1, t, " done "), (3, t, "new")], "scope int, at timestamp, entry string")
    assert {tuple(r) for r in upkeep.append_log(logs, entries).collect()} == {(1, "# L\n\n## [2024-01-01 00:00] done\n", 3), (2, "# M\n", 7), (3, "# Wiki Log\n\n## [2024-01-01 00:00] new\n", 1)}


def test_evidence_by_whole_words(spark):
    items = spark.createDataFrame([(1, "AI"), (1, "Acme Corp"), (2, ""), (3, None)], "item int, name string")
    claims = spark.createDataFrame([(1, 1, "AIRPLANE", 0, 5), (2, 1, "the ai of Acme Corp's CEO", 2, 3), (3, 1, "Acme", 0, 5), (4, 9, "Ai", 0, None), (5, 1, None, 0, 5), (6, 2, "AI", 1, 9999), (7, 2, "AI", 0, None)], "claim_id int, doc int, subject string, offset int, length int")
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "x" * 5000)], "doc int, text string")
    got = {(r.item, r.claim_id, len(r.excerpt), r.excerpt[:3]) for r in consolidate.assemble_evidence(items, claims, docs, "doc", "text").collect()}
    assert got == {(1, 2, 3, "cde"), (1, 4, 0, ""), (1, 6, 2000, "xxx"), (1, 7, 200, "xxx")}
    assert consolidate.assemble_evidence(items.where("item > 1"), claims, docs, "doc", "text").count() == 0


def test_footnotes_are_added_once(spark):
    note = "array<struct<id:string,text:string>>"
    df = spark.createDataFrame([("x [^a]\n[^a]: A\n\n", [("a", "B"), ("b", " C ")]), (None, [(None, "D")]), ("y\n", [("a", "")]), ("z ", [])], f"t string, n {note}")
    assert [r[0] for r in df.select(tx.with_footnotes(F.col("t"), F.col("n"))).collect()] == ["x [^a]\n[^a]: A\n\n[^b]: C\n", "\n\n[^s1]: D\n", "y\n", "z "]


def test_running_budgets_of_groups(spark):
    rows = spark.createDataFrame([(g, i, s, i % 2) for g in (1, 2, None) for i, s in enumerate((5, 4, 3, 9, 1))], "doc_id long, idx int, size long, tier int")
    taken = {(r.doc_id if r.doc_id == r.doc_id else None, r.idx): r.taken for r in consolidate.greedy_fill(rows, 10).collect()}
    assert taken == {(g, i): w for g in (1, 2, None) for i, w in enumerate((True, False, True, False, True))}
    batch = {(r.doc_id, r.idx): r.batch for r in consolidate.in_order_batches(rows.where("doc_id > 0"), "doc_id", "size", "idx", 9).collect()}
    assert batch == {(g, i): w for g in (1, 2) for i, w in enumerate((0, 0, 1, 2, 3))}
    assert consolidate.greedy_fill(rows.limit(0), 10).count() == 0


def test_thresholds_and_priors_by_one_row(spark):
    hits = spark.createDataFrame([(1, "fire safety", 4.0), (2, "other", 2.0), (3, "fire", None)], "doc_id int, text string, prior double")
    assert {r.doc_id: r.rerank_score for r in search.local_rerank(hits, "fire safety", prior="prior").collect()} == {1: 1.0, 2: 0.2, 3: 0.21}
    scored = spark.createDataFrame([(1, 0.1), (2, 0.16), (3, 0.25)], "doc_id int, rerank_score double")
    cut = lambda most: {r.doc_id for r in search.pass_threshold(scored.where(f"doc_id <= {most}")).collect()}
    assert (cut(3), cut(2), cut(1), cut(0)) == ({3}, {2}, {1}, set())


def test_debounced_users_expire_without_loss(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    times = [[0, 30, 70], [7200, 7230], [7290, 20000]]
    for i, batch in enumerate(times):
        spark.createDataFrame([(i * 10 + j, t + datetime.timedelta(seconds=s), 1) for j, s in enumerate(batch)], "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((r.ts - t).total_seconds() for r in ev.drained(ev.debounced(stream, delay="1 minute"), "append").collect())
    assert got == [0, 70, 7200, 7290, 20000]


def parts(spark, path, n: int) -> str:
    """A folder with a part table of ``n`` rows in one file."""
    spark.range(n).selectExpr("id as p_partkey", "concat('green part ', id % 7) as p_name", "'ECO TIN' as p_type").coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_parts_of_one_file_go_to_many_tasks(spark, tmp_path):
    made = flows.keyword_terms(spark, parts(spark, tmp_path, 25_001))
    assert made.rdd.getNumPartitions() == 3 and made.select("p_partkey").distinct().count() == 25_001
    assert spread(spark.range(0)).count() == 0 and spread(spark.range(30), 10).rdd.getNumPartitions() == 3
