"""The facade end to end, and the package without its llm part."""

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from docloom.plans.engine import KnowledgeEngine

HOME = Path(__file__).resolve().parents[2]


def test_engine(spark):
    docs = spark.createDataFrame([(1, "Phòng cháy chữa cháy nhà cao tầng", "a"), (2, "Đường sắt và nhà ga", "a"), (3, "Phòng cháy bí mật", "b")], "doc_id long, text string, dept string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "doc_id long, embedding array<float>")
    pages = spark.createDataFrame([(1, "home", "Home", "[[rail]] [[gone]] [[home]]"), (2, "rail", "Rail", "[[fire|x]]"), (3, "fire", "Fire", "contradictory")], "page long, slug string, title string, content string")
    engine = KnowledgeEngine(spark, docs, vectors, pages, embed=lambda q: [1.0, 0.0], visible=F.col("dept") == "a")
    assert [r.doc_id for r in engine.search("phòng cháy là gì", 1).collect()] == [1]
    assert {r.doc_id for r in KnowledgeEngine(spark, docs).search("phòng cháy").collect()} == {1, 3}
    assert {r.node: r.dist for r in engine.neighbours("fire", 2).collect()} == {"fire": 0, "rail": 1, "home": 2}
    assert {(r.kind, r.page) for r in engine.lint().collect()} == {("dead_link", 1), ("orphan", 1), ("contradiction", 3)}
    assert [r.line for r in engine.snippets(["sat"]).collect()] == ["Đường sắt và nhà ga"]
    assert [r.slug for r in engine.list_pages(1, 2).collect()] == ["fire", "home"]
    assert engine.sql("select count(*) as n from pages", {"pages": pages}).first().n == 3


def test_reading(spark):
    docs = spark.createDataFrame([(1, "one", "a"), (2, "two", "a"), (3, "One more", "b")], "doc_id long, text string, dept string")
    pages = spark.createDataFrame([(1, "home", "Home", "[[rail]] [[gone]]"), (2, "rail", "Rail", "[[home]]"), (3, "alone", "Alone", "")], "page long, slug string, title string, content string")
    engine = KnowledgeEngine(spark, docs, None, pages, visible=F.col("doc_id") < 3)
    row = engine.page("home").first()
    assert (row.links_to, row.linked_from) == (["gone", "rail"], ["rail"]) and engine.page("alone").first().links_to == []
    assert [(r.doc_id, r.has_more) for r in engine.list_documents("ONE").collect()] == [(1, False)]
    assert [(r.doc_id, r.has_more) for r in engine.list_documents(size=1, dept=["a"]).collect()] == [(1, True)]
    assert [tuple(r) for r in engine.kinds("dept").collect()] == [("a", 2)]
    parts = spark.createDataFrame([(1, 1, "p1"), (1, 2, "p2"), (3, 1, "hidden")], "doc_id long, page_no int, content string")
    assert [(r.page, r.content) for r in engine.document_pages(parts, 1, [2, 9]).collect()] == [(2, "p2")] and engine.document_pages(parts, 3, [1]).count() == 0


def test_legal_search(spark):
    units = spark.createDataFrame([(1, "13/2023/NĐ-CP", "5"), (2, "13/2023/NĐ-CP", "6"), (3, "20/2024/NĐ-CP", "1")], "unit_id long, doc_number string, unit_number string")
    links = spark.createDataFrame([(3, "13/2023/nđ-cp", "5", "sua_doi"), (2, "99/2020/QH1", "1", "dan_chieu")], "source_unit long, target_number string, target_article string, relation_type string")
    engine = KnowledgeEngine(spark, spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in engine.legal_search("Điều 5 Nghị định 13/2023/NĐ-CP", units, links).collect()) == [(1, "exact"), (3, "graph")]
    assert engine.legal_search("phòng cháy", units, links).count() == 0


def test_rest_stands_alone(tmp_path):
    for name in ("docloom", "__spark_entry__.py"):
        (shutil.copytree if (HOME / name).is_dir() else shutil.copy)(HOME / name, tmp_path / name)
    shutil.rmtree(tmp_path / "docloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.stdout.strip() == "fine", done.stderr[-2000:]
