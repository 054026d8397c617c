"""Documents from files.

Spark lists and reads the files (``binaryFile``), so any store it knows will do; a parser by extension turns each file's bytes
into pages.  Parsers for other formats plug in by extension.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "path string, page_number int, content string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Fixed value: the least bytes of an image that counts.
IMAGE_LEAST = 2048


def markdown_table(rows: list[list[str]]) -> str:
    """Rows as a Markdown table; bars are escaped, line ends become <br>, short rows are filled."""
    if not rows:
        return ""
    width = max(map(len, rows))
    clean = [[str(c or "").strip().replace("|", "\\|").replace("\n", "<br>") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def docx_pages(raw: bytes) -> list[str]:
    """Paragraphs and tables in order, headings marked, a page for each page break."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    pages: list[list[str]] = [[]]
    text = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "" for t in node.iter())
    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            pages[-1].append(markdown_table([["\n".join(text(p) for p in c.iter(f"{_W}p")) for c in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")]))
        elif node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
            line = text(node).strip()
            if line:
                pages[-1].append("#" * int(level[1]) + " " + line if level else line)
            if any(b.get(f"{_W}type") == "page" for b in node.iter(f"{_W}br")):
                pages.append([])
    return ["\n\n".join(p) for p in pages]


def pptx_pages(raw: bytes) -> list[str]:
    """A page for each slide: its text, tables as tables, then its notes."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))

        def said(node) -> str:
            return "".join(x.text or "" for x in node.iter(f"{_A}t")).strip()

        def parts(node) -> Iterator[str]:
            if node.tag == f"{_A}tbl":
                yield markdown_table([["\n".join(filter(None, map(said, c.iter(f"{_A}p")))) for c in row.iter(f"{_A}tc")] for row in node.iter(f"{_A}tr")])
            elif node.tag == f"{_A}p":
                yield said(node)
            else:
                for child in node:
                    yield from parts(child)

        def lines(name: str) -> list[str]:
            return [t for t in parts(ElementTree.fromstring(z.read(name))) if t]

        out = []
        for name in slides:
            notes = name.replace("slides/slide", "notesSlides/notesSlide")
            found = lines(name)
            if found:
                found[0] = "# " + found[0]
            out.append("\n".join(found + (["Notes: " + " ".join(lines(notes))] if notes in names else [])))
    return out


def xlsx_sheets(raw: bytes) -> list[tuple[str, list[list]]]:
    """(sheet, rows): the first row with content is the head, blank heads are named by their place; values, not formulas."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            target = target if target.startswith("xl/") else posixpath.normpath("xl/" + target)
            rows = []
            for row in ElementTree.fromstring(z.read(target)).iter(f"{_S}row"):
                cells: dict[int, object] = {}
                for c in row.iter(f"{_S}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    cells[at - 1 if at else len(cells)] = _cell(c, shared)
                if any(v not in (None, "") for v in cells.values()):
                    rows.append([cells.get(i) for i in range(max(cells) + 1)])
            if rows:
                width = max(map(len, rows))
                head = [str(v).strip() if v not in (None, "") else f"Cột_{i + 1}" for i, v in enumerate(rows[0] + [None] * (width - len(rows[0])))]
                rows = [head] + [r + [None] * (width - len(r)) for r in rows[1:]]
            out.append((sheet.get("name"), rows))
    return out


def _cell(c: ElementTree.Element, shared: list[str]) -> object:
    kind, v = c.get("t"), c.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    return int(number) if number.is_integer() else number


def xlsx_pages(raw: bytes) -> list[str]:
    return [f"# {name}\n\n" + markdown_table(rows) for name, rows in xlsx_sheets(raw)]


def row_lines(sheet: str, rows: list[list]) -> list[str]:
    """A line of text for each row below the head, with its columns' names."""
    return [f"[Bảng: {sheet} | Dòng {i}]: " + " | ".join(f"{h}: {v}" for h, v in zip(rows[0], r) if v not in (None, "")) for i, r in enumerate(rows[1:], 1) if any(v not in (None, "") for v in r)]


def csv_pages(raw: bytes) -> list[str]:
    import csv

    return [markdown_table([r for r in csv.reader(io.StringIO(raw.decode("utf-8-sig", "ignore"))) if r])]


def text_pages(raw: bytes) -> list[str]:
    return [raw.decode("utf-8", "ignore")]


def html_pages(raw: bytes) -> list[str]:
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            if re.fullmatch(r"h[1-6]", tag):
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag in ("p", "div", "br", "li", "tr"):
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style") and self.skip > 0

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    page = Text()
    page.feed(raw.decode("utf-8", "ignore"))
    return [re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", "".join(page.out))).strip()]


PARSERS: dict[str, Callable[[bytes], list[str]]] = {"docx": docx_pages, "pptx": pptx_pages, "xlsx": xlsx_pages, "csv": csv_pages, "txt": text_pages, "md": text_pages, "html": html_pages, "htm": html_pages}


def read_pages(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, page_number, content, error) of all files below ``path``; a file that cannot be parsed is one row with its error."""
    known = PARSERS | (parsers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"]):
                parser = known.get(name.rpartition(".")[2].lower())
                try:
                    if parser is None:
                        raise ValueError("no parser for this extension")
                    rows += [(name, i, c, None) for i, c in enumerate(parser(bytes(raw)), 1)]
                except Exception as e:  # one bad file must not end the job
                    rows.append((name, 0, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "page_number", "content", "error"])

    return files.mapInPandas(run, PAGES)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_index, line, error) of every row of the spreadsheets below ``path``; one that cannot be read is a row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(name, sheet, i, line, None) for sheet, table in xlsx_sheets(bytes(raw)) if table for i, line in enumerate(row_lines(sheet, table), 1)]
                except Exception as e:  # one bad file must not end the job
                    rows.append((name, None, 0, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "sheet", "row_index", "line", "error"])

    return files.mapInPandas(run, "path string, sheet string, row_index int, line string, error string")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, name, size, error) of the images inside office files that are not tiny; a file that cannot be read is a row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").where(F.rlike("path", F.lit(r"(?i)\.(docx|pptx|xlsx)$")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                        big = [i for i in z.infolist() if "/media/" in i.filename and i.file_size >= IMAGE_LEAST]
                    rows += [(name, k, i.filename, i.file_size, None) for k, i in enumerate(sorted(big, key=lambda i: i.filename))]
                except Exception as e:  # one bad file must not end the job
                    rows.append((name, -1, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "idx", "name", "size", "error"]).astype({"size": "Int64"})

    return files.mapInPandas(run, "path string, idx int, name string, size long, error string")


def folder_hash(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, n): one hash of the folder's files, by name and content; files are hashed where they are read."""
    root = path.rstrip("/") + "/"
    one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.substring_index("path", root, -1).alias("name"), F.md5("content").alias("md5"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("name", "md5"))), lambda x: F.concat(x["name"], x["md5"]))
    return one.agg(F.sha2(F.array_join(pairs, "\n"), 256).alias("content_hash"), F.count("*").alias("n"))
