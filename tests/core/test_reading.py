"""Edge cases of legal parsing, page reading, edits, trimming, and the states of sources."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import access, analytics, checks, chunks, consolidate, legal, versions
from docloom.streaming import events

c = F.col


def test_headings_glued_to_other_text():
    text = "**Điều 1. Một**\nNội dung theo Điều 9. khoản 2.\n<mark>a) x; b) y.</mark> **Điều 2. Hai**\n1. Khoản\n**QUY ĐỊNH CHUNG Điều 3. Ba**\n“ **Điều 7. Bảy**\n**Điều 4. Bốn**\nhết"
    found = legal.parse_units(text)
    assert [r[2] for r in found if r[3] is None] == ["1", "2", "3", "4"]
    assert "Điều 9" in found[0][6] and "Bảy" in found[-2][6]
    assert legal.parse_units("") == []


def test_identity_of_an_act(spark):
    docs = spark.createDataFrame([(1, "**QUỐC HỘI**\n\nLuật số: 15/2012/QH13\n\nLUẬT\nXỬ LÝ VI PHẠM\nHÀNH CHÍNH\nCăn cứ Hiến pháp"), (2, "văn xuôi"), (3, None), (4, "")], "k int, text string")
    rows = {r.k: r for r in legal.identity(docs, "k", "text").collect()}
    assert (rows[1].doc_type, rows[1].authority, rows[1].title) == ("Luật", "Quốc hội", "XỬ LÝ VI PHẠM HÀNH CHÍNH")
    assert rows[1].citation == "Luật 15/2012/QH13"
    assert all(rows[k].doc_type is None and rows[k].title is None for k in (2, 3, 4))


def test_reextract_keeps_preambles(spark):
    kind = "k int, relation string, target_number string, target_article string, target_clause string, quote string"
    stored = spark.createDataFrame([(1, "can_cu", "1/2000/QH1", None, None, "q"), (1, "sua_doi", "2/2000/QH1", "1", None, "old"), (2, "bai_bo", "3/2000/QH1", None, None, "other")], kind)
    articles = spark.createDataFrame([(1, "Sửa đổi Điều 5 Luật 4/2001/QH1", "9/2020/NĐ-CP")], "k int, content string, doc_number string")
    got = sorted((r.k, r.relation, r.target_number) for r in legal.reextract(stored, articles, "k").collect())
    assert got == [(1, "can_cu", "1/2000/QH1"), (1, "sua_doi", "4/2001/QH1"), (2, "bai_bo", "3/2000/QH1")]


def test_last_page_and_periods(spark):
    rows = spark.range(7)
    assert [(r.id, r.has_more) for r in access.page_with_more(rows, [c("id")], 2, 4).collect()] == [(4, False), (5, False), (6, False)]
    assert {r.has_more for r in access.page_with_more(rows, [c("id")], 1, 4).collect()} == {True}
    assert access.page_with_more(rows, [c("id")], 9, 4).count() == 0
    for end in (datetime.date(2024, 1, 1), datetime.date(2025, 6, 1)):
        with pytest.raises(ValueError):
            access.in_period(c("ts"), datetime.date(2024, 1, 1), end)
    assert access.where_given(rows, id=[]).count() == 0 and access.where_given(rows, id=None).count() == 7


def test_trimmed_loops(spark):
    loop, tail = "abc " * 300, "head " + "x" * 600
    rows = spark.createDataFrame([(1, loop), (2, tail), (3, "short"), (4, None), (5, ""), (6, "y" * 600 + " end")], "k int, t string")
    got = {r.k: r.t for r in rows.select("k", checks.trim_repetition(c("t")).alias("t")).collect()}
    assert got[1] == "abc" and got[2] == "head x" and got[3] == "short" and got[4] is None and got[5] == "" and got[6].endswith(" end")


def test_proofread_drift(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = spark.createDataFrame([(1, words, words.upper()), (2, words, "other words"), (3, words, words + " new" * 60), (4, "a", "b" * 500), (5, "", "x"), (6, None, None)], "k int, a string, b string")
    got = {r.k: r.d for r in rows.select("k", checks.proofread_drift(c("a"), c("b")).alias("d")).collect()}
    assert got == {1: None, 2: "draft_not_kept", 3: "too_much_new_text", 4: "too_long", 5: None, 6: None}


def test_chunks_for_extraction(spark):
    text = "intro\n# A\n" + "a" * 50 + "\n### deep\nx\n## B\n" + "b" * 90 + "\n# C\nend"
    docs = spark.createDataFrame([(1, text), (2, "z" * 250), (3, ""), (4, None)], "doc_id int, text string")
    rows = chunks.extraction_chunks(docs, "doc_id", "text", 100, 10).orderBy("doc_id", "chunk_index").collect()
    own = [r for r in rows if r.doc_id == 1]
    assert "".join(r.chunk[r.prefix :] for r in own) == text and own[0].start == 0 and own[-1].end == len(text)
    assert [r.path for r in own] == ["A", "B", "C"] and own[1].chunk.startswith(chunks.BEFORE + text[own[1].start - 10 : own[1].start])
    assert [(r.start, r.end, r.path) for r in rows if r.doc_id == 2] == [(0, 100, "chunk_0"), (100, 200, "chunk_1"), (200, 250, "chunk_2")]
    assert {r.doc_id for r in rows} == {1, 2}
    cut = docs.where("doc_id = 2").select(chunks.slice_of(c("text"), F.lit(10), F.lit(60), 20).alias("t")).first().t
    assert cut == "z" * 20 + chunks.CUT


def test_items_of_odd_answers(spark):
    rows = spark.createDataFrame([(1, 0, 10, '{"entities": [{"name": null}], "concepts": null}'), (2, 0, 0, "no json"), (3, 0, 5, None), (4, 1, 100, '{"claims": [{"text": "t", "local_offset": -7}]}')], "doc int, chunk_index int, start int, answer string")
    got = sorted(tuple(r) for r in consolidate.collect_items(rows, "doc").collect())
    assert got == [(1, 0, "concept", "", "other", 10), (4, 1, "claim", "t", None, 100)]


def test_rollback_to_nothing_is_an_error(spark):
    pages = spark.createDataFrame([(1, 3, "now")], "page_id int, version int, content string")
    old = spark.createDataFrame([(1, 1, None)], "page_id int, version int, content string")
    targets = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "page_id int, target int")
    got = sorted((r.page_id, r.note, r.outcome, r.version) for r in versions.rollback(pages, old, targets).collect())
    assert got == [(1, "rollback to v1", "restored", 4), (1, "rollback to v2", "error", None), (2, "rollback to v1", "error", None)]


def test_counts_and_search_strings(spark):
    row = spark.range(1).select(
        analytics.result_count(F.lit("7 result(s)"), F.lit("t"), F.lit("ok")).alias("a"), analytics.result_count(F.lit("NO RESULTS"), F.lit("t"), F.lit("ok")).alias("b"), analytics.result_count(F.lit(None).cast("string"), F.lit("get_source"), F.lit("ok")).alias("n"),
        tx.any_term(F.array(F.lit("phòng_cháy"), F.lit("--"), F.lit("nhà"))).alias("any"), tx.dual_tokens(F.lit("Phòng cháy"))[1].alias("bare"),
    ).first()
    assert (row.a, row.b, row.n, row.any) == (7, 0, None, '"phòng cháy" or nhà') and row.bare.isascii()


def test_status_of_two_branches(spark):
    t = datetime.datetime
    rows = [(1, "chunk", "processing", t(2024, 1, 1), False), (1, "chunk", "ready", t(2024, 1, 2), False), (1, "page", "error", t(2024, 1, 1), False), (2, "chunk", "ready", t(2024, 1, 1), True)]
    log = spark.createDataFrame(rows, "source_id long, branch string, status string, ts timestamp, verbatim boolean")
    assert {r.source_id: r.status for r in events.branch_statuses(log).collect()} == {1: "partial", 2: "ready"}


def test_rows_that_wait_too_long_expire(spark, tmp_path):
    t = datetime.datetime
    schema = "source_id long, state string, ts timestamp"
    for name, rows in (("a", [(1, "awaiting_approval", t(2024, 1, 1)), (2, "awaiting_approval", t(2024, 1, 1)), (2, "ready", t(2024, 1, 2)), (3, "processing", t(2024, 1, 1))]), ("b", [(9, "ready", t(2024, 2, 1))]), ("c", [(9, "ready", t(2024, 2, 2))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = events.expired(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.source_id, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "awaiting_approval")]


def test_words_in_order():
    """Never more than the longest common subsequence, all of equal texts, and nearly all of texts with few edits; a long text is no matter."""
    import random
    import time

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    rng = random.Random(1)
    for k in range(300):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("12") for _ in range(rng.randrange(40))]
        b = [w for w in a if rng.random() > 0.1] + ["new"] * rng.randrange(2)
        if k % 4 == 0:
            rng.shuffle(b)
        assert checks.words_in_order(a, b) <= longest(a, b) and checks.words_in_order(a, a) == len(a)
    a = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    b = [w for w in a if rng.random() > 0.02]
    began = time.process_time()
    assert checks.words_in_order(a, b) > 0.97 * len(b) and time.process_time() - began < 10


def test_marks_after_tags_go(spark):
    lines = ["<mark>## Điều 2. X</mark>", "**Điều 39.**<sup>45</sup> _tên_", "> # <b>a_b</b> __c__ *d*", "2 < 3 và 4 > 1", None]
    got = [r.m for r in spark.createDataFrame([(t,) for t in lines], "t string").select(tx.strip_markup(F.col("t")).alias("m")).collect()]
    assert got == ["Điều 2. X", "Điều 39. tên", "a_b c d", "2 < 3 và 4 > 1", None]
    assert [u[1:3] + (u[5],) for u in legal.parse_units("<mark>## Điều 2. X</mark>\n1. một")] == [(None, "2", "X"), (None, "2", None)]
