"""Files in, files out, and streams against the same work on tables."""

import datetime
import io
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.sources import files, sinks
from docloom.streaming import events as ev

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(**members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return raw.getvalue()


def workbook():
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f"<worksheet {S}><sheetData><row/><row>{cell('A2', 'STT')}{cell('C2', 'Tên')}</row><row><c r=\"A3\"><v>1</v></c>{cell('B3', 'x|y')}<c r=\"C3\" t=\"s\"><v>0</v></c></row><row><c r=\"A4\"><v>2.5</v></c></row></sheetData></worksheet>"
    return archive(**{
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Cán bộ" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Nguyễn Văn A</t></si></sst>",
        "xl/worksheets/sheet1.xml": sheet,
    })


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    para = lambda t, style="": f'<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>'
    docx = f'<w:document {W}><w:body>{para("Title", "<w:pPr><w:pStyle w:val=\"Heading1\"/></w:pPr>")}{para("Body")}<w:tbl><w:tr><w:tc>{para("a")}</w:tc><w:tc>{para("b")}</w:tc></w:tr><w:tr><w:tc>{para("1")}</w:tc></w:tr></w:tbl><w:p><w:r><w:br w:type="page"/></w:r></w:p>{para("Next")}</w:body></w:document>'
    slide = lambda t: f"<p {A}>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p>"
    (d / "a.docx").write_bytes(archive(**{"word/document.xml": docx, "word/media/big.png": b"x" * 3000, "word/media/small.png": b"x"}))
    (d / "b.pptx").write_bytes(archive(**{"ppt/slides/slide2.xml": slide(["Two"]), "ppt/slides/slide1.xml": slide(["One", "text"]), "ppt/notesSlides/notesSlide1.xml": slide(["say this"])}))
    cells = "".join(f"<a:tr>{''.join(f'<a:tc><a:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></a:txBody></a:tc>' for x in row)}</a:tr>" for row in (("h", "i"), ("1", "2")))
    grid = f"<p {A}><a:p><a:r><a:t>Top</a:t></a:r></a:p><g><a:tbl>{cells}</a:tbl></g></p>"
    (d / "i.pptx").write_bytes(archive(**{"ppt/slides/slide1.xml": grid}))
    (d / "j.xlsx").write_bytes(b"broken")
    (d / "c.xlsx").write_bytes(workbook())
    (d / "d.csv").write_text("x,y\n1,a|b\n")
    (d / "e.txt").write_bytes("plain \xff text".encode("latin-1"))
    (d / "f.html").write_text("<h2>Head</h2><script>no</script><p>One &amp; two</p>")
    (d / "g.docx").write_bytes(b"broken")
    (d / "h.bin").write_bytes(b"?")
    return str(d)


def test_pages_of_files(spark, folder):
    got = {(r.path.rpartition("/")[2], r.page_number): r.content for r in files.read_pages(spark, folder).where("error is null").collect()}
    assert got["a.docx", 1] == "# Title\n\nBody\n\n| a | b |\n| --- | --- |\n| 1 |  |" and got["a.docx", 2] == "Next"
    assert got["i.pptx", 1] == "# Top\n| h | i |\n| --- | --- |\n| 1 | 2 |"
    assert got["b.pptx", 1] == "# One\ntext\nNotes: say this" and got["b.pptx", 2] == "# Two"
    assert "| STT | Cột_2 | Tên |" in got["c.xlsx", 1] and "| 1 | x\\|y | Nguyễn Văn A |" in got["c.xlsx", 1]
    assert got["d.csv", 1] == "| x | y |\n| --- | --- |\n| 1 | a\\|b |" and got["e.txt", 1] == "plain  text" and got["f.html", 1] == "## Head\nOne & two"
    good, dead = sinks.split_errors(files.read_pages(spark, folder))
    assert {r.path.rpartition("/")[2] for r in dead.collect()} == {"g.docx", "h.bin", "j.xlsx"} and "error" not in good.columns


def test_rows_and_images(spark, folder):
    assert [(r.sheet, r.row_index, r.line) for r in files.read_rows(spark, folder).where("error is null").orderBy("row_index").collect()] == [
        ("Cán bộ", 1, "[Bảng: Cán bộ | Dòng 1]: STT: 1 | Cột_2: x|y | Tên: Nguyễn Văn A"), ("Cán bộ", 2, "[Bảng: Cán bộ | Dòng 2]: STT: 2.5")]
    good = folder + "/a.docx"
    assert [(r.idx, r.name, r.size) for r in files.read_images(spark, good).collect()] == [(0, "word/media/big.png", 3000)]
    assert [r.path.rpartition("/")[2] for r in files.read_rows(spark, folder).where("error is not null").collect()] == ["j.xlsx"]
    assert {r.path.rpartition("/")[2] for r in files.read_images(spark, folder).where("error is not null").collect()} == {"g.docx", "j.xlsx"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a|b"), (2, "x", None)], "id long, v string, w string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {("1", None, "a|b"), ("2", "x", None)}
    assert {r.line for r in sinks.markdown_lines(df).collect()} == {"| 1 |  | a\\|b |", "| 2 | x |  |"}
    sinks.append_log(df, str(tmp_path / "log"), {"w": 2})
    sinks.append_log(df, str(tmp_path / "log"), {"w": 2})
    assert spark.read.parquet(str(tmp_path / "log")).where("w = 'a|'").count() == 2


@pytest.fixture(scope="module")
def log(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("events")
    shutil.copy(f"{sf}/events.parquet", d / "events.parquet")
    return str(d), spark.read.parquet(str(d)).withColumn("ts", F.col("ts").cast("timestamp"))


def finish(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_daily_counts(spark, log):
    path, table = log
    stream = ev.read_events(spark, path, spark.read.parquet(path).schema)
    got = finish(spark, ev.daily_counts(stream).select("day", "event_type", "n"), "daily", "complete")
    assert sorted(got) == sorted(tuple(r) for r in table.groupBy(F.to_date("ts"), "event_type").count().collect())


def test_sessions_and_weeks(spark, log):
    path, table = log
    stream = ev.read_events(spark, path, spark.read.parquet(path).schema)
    got = finish(spark, ev.sessions(stream, "3 hours"), "sessions", "append")
    want = {tuple(r) for r in ev.sessions(table, "3 hours").collect()}
    assert set(got) <= want and len(got) > 0.8 * len(want)
    weeks = finish(spark, ev.weekly_users(stream), "weeks", "complete")
    assert len(weeks) == len({d for d, _ in weeks}) and all(n > 0 for _, n in weeks)


def test_once_and_debounce(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i // 2, t + datetime.timedelta(seconds=10 * (i // 2)), 1) for i in range(40)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(path)
    stream = ev.read_events(spark, path, spark.read.parquet(path).schema)
    assert len(finish(spark, ev.once(stream), "once", "append")) == 20
    kept = sorted(ts for _, ts in finish(spark, ev.debounced(stream), "debounced", "append"))
    assert [(x - t).seconds for x in kept] == [0, 60, 120, 180]


def test_stuck_sources(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    schema = "source_id long, state string, ts timestamp"
    spark.createDataFrame([(1, "running", t), (2, "running", t), (2, "ready", t + datetime.timedelta(minutes=5))], schema).coalesce(1).write.parquet(path)
    stream = lambda: ev.stuck(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), delay="1 minute")
    q = lambda: stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    q()
    spark.createDataFrame([(3, "running", t + datetime.timedelta(hours=3))], schema).coalesce(1).write.mode("append").parquet(path)
    q()
    spark.createDataFrame([(3, "ready", t + datetime.timedelta(hours=3, minutes=5))], schema).coalesce(1).write.mode("append").parquet(path)
    q()
    assert [(r.source_id, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "running")]


def test_late_data_overwrite_their_keys(spark, log, tmp_path):
    path, table = log
    stream = ev.read_events(spark, path, spark.read.parquet(path).schema)
    out = str(tmp_path / "metrics")
    ev.write_days(ev.daily_counts(stream), out, str(tmp_path / "cp"), ["day", "event_type"]).awaitTermination()
    got = sorted((r.day, r.event_type, r.n) for r in spark.read.parquet(out).collect())
    assert got == sorted(tuple(r) for r in table.groupBy(F.to_date("ts"), "event_type").count().collect())
    stale = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "source_id long, attempt int, v string")
    assert {r.v for r in ev.latest_attempts(stale).collect()} == {"b", "c"}
