"""Text, date and status functions on small cases."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import dates, status, vectors
from docloom.functions import text as tx


def one(spark, *columns, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def x(spark, f, value):
    return one(spark, f(F.col("v")), v=value)


def test_fold_and_slug(spark):
    assert x(spark, tx.fold, "Phòng cháy Đống Đa Ǹ ộ ợ ữ") == "Phong chay Dong Da N o o u"
    assert x(spark, tx.fold, "é") == "e"
    assert x(spark, tx.slugify, "  Nghị định 13/2023 — Đất đai! ") == "nghi-dinh-13-2023-dat-dai"


def test_normalize(spark):
    assert x(spark, tx.normalize_text, "á  b\r\n\r\n\r\n\r\n c​\x07 \t d ") == "á b\n\nc d"
    assert x(spark, tx.normalize_text, None) == ""


def test_query_terms(spark):
    assert x(spark, tx.keyword_terms, "phòng cháy chữa cháy là gì") == ["phong_chay_chua_chay"]
    assert x(spark, tx.keyword_terms, "Tìm kiếm nhà ga như thế nào?") == ["nha", "ga"]
    assert x(spark, tx.keyword_terms, "cho tôi là gì") == [] and x(spark, tx.keyword_terms, "") == []
    assert x(spark, tx.keyword_terms, "và của các") == ["va", "cua", "cac"]
    assert x(spark, tx.doc_numbers, "theo 13/2023/NĐ–CP, ngày 15/03/2023 và 123 / QĐ - UBND") == ["13/2023/ND-CP", "123/QD-UBND"]
    assert x(spark, tx.quoted_phrases, 'tìm "An Toàn" và “Cơ sở”') == ["an toan", "co so"]


@pytest.mark.parametrize("text,want", [("Nhà cao tầng", 1.0), ("nhanh chóng", 0.0)])
def test_coverage_is_by_words(spark, text, want):
    assert one(spark, tx.term_coverage(F.array(F.lit("nha")), F.col("v")), v=text) == want


def test_links_and_tables(spark):
    assert x(spark, tx.wikilinks, "[[a]] [[ b |text]] [[a|x]] [[]]") == ["a", "b"]
    assert x(spark, lambda c: tx.drop_wikilinks(c, "k/b"), "see [[k/b|this]] and [[k/b]] and [[k/bc]]") == "see this and b and [[k/bc]]"
    table = "| Name | N |\n|---|---|\n| **An** | 1 |\n| `Bo`  x | 2 |\nnot | a row"
    assert x(spark, tx.row_identities, table) == ["an", "bo x"]
    assert x(spark, tx.page_range, "5-7, 12,6,x,9-8") == [5, 6, 7, 12]
    assert [tuple(f) for f in x(spark, tx.footnotes, "text[^1]\n[^1]: One here \n[^b]: Two")] == [("1", "One here"), ("b", "Two")]
    assert x(spark, tx.redact, "AKIA1234567890") == "AKIA…90" and x(spark, tx.redact, "short") == "***"


def test_loose_json(spark):
    get = lambda v: x(spark, lambda c: F.to_json(tx.loose_json(c)), v)
    assert get('```json\n{"a": 1}\n```') == '{"a":1}' and get('{"a": [1, 2]} trailing') == '{"a":[1,2]}' and get("no") is None


@pytest.mark.parametrize("text,want", [("2024-02-30", None), ("ngày 5 tháng 3 năm 2024", "2024-03-05"), ("31/02/2024", None), ("1.12.2023", "2023-12-01"), ("x", None)])
def test_iso_date(spark, text, want):
    assert x(spark, dates.iso_date, text) == want


def test_effective_date(spark):
    f = lambda c: dates.effective_date(c, F.lit("2024-01-02"))
    assert x(spark, f, "có hiệu lực từ ngày 1/5/2024. Sau đó có hiệu lực kể từ ngày 15 tháng 6 năm 2024") == "2024-06-15"
    assert x(spark, f, "Nghị định có hiệu lực thi hành kể từ ngày ký ban hành") == "2024-01-02"


@pytest.mark.parametrize("issued,effective,expiry,replaced,repealed,want", [
    ("2020-01-01", None, None, True, False, "bi_thay_the"), ("2020-01-01", None, None, False, True, "het_hieu_luc"), ("2020-01-01", None, "2021-01-01", False, False, "het_hieu_luc"),
    (None, None, None, False, False, "khong_xac_dinh"), ("2020-01-01", "2099-01-01", None, False, False, "chua_co_hieu_luc"), ("2020-01-01", None, "2026-10-08", False, False, "con_hieu_luc"),
])
def test_validity(spark, issued, effective, expiry, replaced, repealed, want):
    row = spark.createDataFrame([(issued, effective, expiry, replaced, repealed)], "i string, e string, x string, r boolean, p boolean")
    assert row.select(dates.validity(*map(F.col, "iexrp"), F.lit("2026-10-08"))).first()[0] == want


@pytest.mark.parametrize("verbatim,chunks,pages,want", [
    (True, "ready", "ready", "ready"), (True, "error", "ready", "error"), (False, "ready", "error", "partial"), (False, "error", "ready", "partial"), (False, "error", "error", "error"), (False, "ready", "plan_ready", "plan_ready"),
    (False, "ready", "skipped", "ready"), (False, None, None, "processing"), (False, "pending", "ready", "ready"), (False, "processing", "ready", "ready"), (False, "ready", "processing", "processing"), (False, "pending", "awaiting_approval", "awaiting_approval"),
])
def test_branch_status(spark, verbatim, chunks, pages, want):
    row = spark.createDataFrame([(verbatim, chunks, pages)], "v boolean, c string, p string")
    assert row.select(status.branch_status(F.col("v"), F.col("c"), F.col("p"))).first()[0] == want


def test_small_tables(spark):
    assert x(spark, tx.predicate, "Part of") == "thuoc" and x(spark, tx.predicate, None) == "lien_quan" and x(spark, tx.predicate, "is-a") == "la_mot"
    assert x(spark, status.page_type, "_hot") == "hot" and x(spark, status.page_type, "source/x") == "source" and x(spark, status.page_type, "x") == "concept"
    assert x(spark, status.page_maturity, "[[a]]" * 5 + "x" * 4000) == "evergreen" and x(spark, status.page_maturity, "x" * 4000) == "seed"
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), v=1) == 0.0
    assert x(spark, tx.gap_key, "What is THE fire-code, của bạn?") == "firecode của bạn"
