"""Legal texts: numbers and dates, articles with clauses and points, relations between documents, and validity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import dates
from docloom.functions import text as tx

#: Forms of a document number, and of the lines that open a unit.
NUMBER = r"(?<![\w/])(\d+(?:/\d{4})?/[A-ZĐ]{1,8}\d*(?:-[A-ZĐ][A-ZĐa-z]{0,7}\d*){0,3})(?![\w/])"
ARTICLE = r"(?i)^Điều\s+(\d+[a-z]?)\s*(\.?)\s*(.*)$"
CHAPTER = r"(?i)^Chương\s+([IVXLCDM]+|\d+)[:.]?\s*(.*)$"
CLAUSE = r"^(\d+)\.\s+(.*)$"
POINT = r"^([a-zđ])\)\s+(.*)$"
#: What a phrase says about an article (relation, pattern with clause, article and rest).
RELATIONS = [
    ("sua_doi", r"sửa\s+đổi(?:,\s*bổ\s+sung)?\s+(?:khoản\s+(\d+)\s+)?Điều\s+(\d+[a-z]?)([^;\n.]*)"),
    ("bo_sung", r"(?<!đổi, )(?<!đổi,)bổ\s+sung\s+(?:khoản\s+(\d+)\s+)?Điều\s+(\d+[a-z]?)([^;\n.]*)"),
    ("bai_bo", r"bãi\s+bỏ\s+(?:điểm\s+[a-zđ]\s+)?(?:khoản\s+(\d+)\s+)?Điều\s+(\d+[a-z]?)([^;\n.]*)"),
    ("dan_chieu", r"(?:quy\s+định|hướng\s+dẫn)\s+tại\s+(?:khoản\s+(\d+)\s+)?Điều\s+(\d+[a-z]?)([^;\n.]*)"),
]
WHOLE = [("thay_the", r"thay\s+thế\s+(?!khoản|điểm|Điều)"), ("bai_bo", r"bãi\s+bỏ\s+(?!khoản|điểm|Điều)")]
#: What a line has where one of these patterns, an expiry or a basis is in it.
SAYS = r"(?i)sửa\s|bổ\s|bãi\s|quy\s|hướng\s|thay\s|hết\s|căn\s"
QUOTE, TAIL = 250, 160
UNITS = "seq int, chapter string, article string, clause string, point string, title string, content string"
LINKS = "seq int, relation string, target_number string, target_article string, target_clause string, quote string"


def metadata(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc_number, issued_date, effective_date, n_articles) from a text's own words; all built-in."""
    c = F.col(text)
    head = F.substring(c, 1, 4000)
    number = F.try_element_at(F.regexp_extract_all(head, F.lit(NUMBER), F.lit(1)), F.lit(1))
    issued = dates.iso_date(F.regexp_extract(head, "(" + dates.SPELLED + ")", 1))
    articles = F.regexp_extract_all(c, F.lit(r"(?miu)^[ \t>#*_“\"]*Điều\s+(\d+[a-z]?)\s*[.:–-]"), F.lit(1))
    return docs.select(key, number.alias("doc_number"), issued.alias("issued_date"), dates.effective_date(c, issued).alias("effective_date"), F.size(F.array_distinct(F.transform(articles, lambda x: F.lower(x)))).alias("n_articles"))


#: An article's heading within a line; its title begins with a capital.
GLUED = r"(?<=\S)\s+(?=(\*\*)?_*Điều\s+\d+[a-z]?\.\s+[^\W\d_])"


def _unglued(lines: list[str]) -> Iterator[str]:
    """Lines in which a heading follows other text, cut before it: one in bold, or after nothing but capitals; quoted ones stay."""
    for line in lines:
        for m in re.finditer(GLUED, line) if "Điều" in line else ():
            before = re.sub(r"</?[a-zA-Z][^>]*>", "", line[: m.start()])
            letters = [x for x in before if x.isalpha()]
            title = re.match(r"[*_]*Điều\s+\d+[a-z]?\.\s+(\S)", line[m.end() :])
            if letters and title and title[1].isupper() and not re.search("[“\"]", before) and (m[1] or all(x.isupper() for x in letters)):
                yield line[: m.start()]
                yield from _unglued([line[m.end() :]])
                break
        else:
            yield line


def parse_units(text: str) -> list[tuple]:
    """Chapters, articles, clauses and points in order; text in quotation marks (an amendment's wording) opens no unit.

    A quotation that is never closed ends where the next article follows the last one outside it.
    """
    rows: list[list] = []
    chapter = article = clause = None
    quoted, last = False, 0
    for line in _unglued(text.split("\n")):
        bare = (re.sub(tx.MARKUP, "", line) if re.search("[<>#*_]", line) else line).strip()
        opens = bare.count("“") + bare.count("”") + bare.count('"')
        m = re.match(ARTICLE, bare)
        if m and not m[2] and m[3][:1].islower():  # "Điều 51 của Luật ..." is a reference
            m = None
        number = int(re.match(r"\d+", m[1])[0]) if m else None
        if quoted and m and number == last + 1 and not opens:
            quoted = False
        if not quoted and not bare.startswith(("“", '"')):
            if c := re.match(CHAPTER, bare):
                chapter, article, clause = c[1].upper(), None, None
            elif m:
                article, clause, last = m[1].lower(), None, number
                rows.append([chapter, article, None, None, m[3], bare])
            elif article and (c := re.match(CLAUSE, bare)):
                clause = c[1]
                rows.append([chapter, article, clause, None, None, c[2]])
            elif clause and (p := re.match(POINT, bare)):
                rows.append([chapter, article, clause, p[1], None, p[2]])
            elif rows and article and bare:
                rows[-1][5] += "\n" + bare
        elif rows and article and bare:
            rows[-1][5] += "\n" + bare
        if opens % 2:
            quoted = not quoted
    return [(i, *r) for i, r in enumerate(rows)]


def parse_relations(text: str, own: str | None) -> list[tuple]:
    """What a text says about articles and whole documents, line by line; a line without a number means the text's first foreign one."""
    own = (own or "").upper()
    first = next((n.upper() for n in re.findall(NUMBER, text) if n.upper() != own), None)
    rows = []
    for line in filter(None, map(str.strip, text.split("\n"))):
        if not re.search(SAYS, line):
            continue
        for kind, pattern in RELATIONS:
            for m in re.finditer("(?i)" + pattern, line):
                found = re.search(NUMBER, m[3])
                rows.append((kind, (found[1].upper() if found else first), m[2].lower(), m[1], line[:QUOTE]))
        for kind, pattern in WHOLE:
            for m in re.finditer("(?i)" + pattern, line):
                rows += [(kind, n.upper(), None, None, line[:QUOTE]) for n in re.findall(NUMBER, line[m.end() : m.end() + TAIL]) if n.upper() != own]
        for m in re.finditer(r"(?i)hết\s+hiệu\s+lực", line):
            rows += [("het_hieu_luc", n.upper(), None, None, line[:QUOTE]) for n in re.findall(NUMBER, line[max(0, m.start() - TAIL) : m.start()])[-1:] if n.upper() != own]
        if re.match(r"(?i)căn\s+cứ\s", line):
            rows += [("can_cu", n.upper(), None, None, line[:QUOTE]) for n in re.findall(NUMBER, line) if n.upper() != own]
    return [(i, *r) for i, r in enumerate(dict.fromkeys(rows))]


def _explode(docs: DataFrame, key: str, text: str, number: str | None, parse, schema: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(k, *r) for k, t, n in zip(pdf["k"], pdf["t"], pdf["n"]) for r in parse(t or "", n)], columns=["k", *names])

    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(number) if number else F.lit(None).cast("string")).alias("n"))
    return source.mapInPandas(run, f"k {kind}, {schema}").withColumnRenamed("k", key)


def units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, chapter, article, clause, point, title, content) of each document's units."""
    return _explode(docs, key, text, None, lambda t, n: parse_units(t), UNITS)


def relations(docs: DataFrame, key: str, text: str, number: str | None = None) -> DataFrame:
    """(key, seq, relation, target_number, target_article, target_clause, quote)."""
    return _explode(docs, key, text, number, parse_relations, LINKS)


def relink(found: DataFrame, known: DataFrame) -> DataFrame:
    """Relations with target_unit: the clause's unit if there is one, else the article's, the least id of several; known has (unit_id, doc_number, article, clause)."""
    norm = lambda c: F.upper(F.trim(c))
    # Both sides are dealt once, by number and article, to as many tasks as the session's shuffles have: left to itself, Spark joins
    # packed partitions to a few that fill a task's memory once they are unpacked.  Groups and join need no other shuffle.
    dealt = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__n", "__a")
    named = known.select(norm(F.col("doc_number")).alias("__n"), F.lower("article").alias("__a"), F.coalesce("clause", F.lit("")).alias("c"), "unit_id").where("__n is not null and __a is not null")
    least = dealt(named).groupBy("__n", "__a", "c").agg(F.min("unit_id").alias("unit"))
    by = least.groupBy("__n", "__a").agg(F.map_from_entries(F.collect_list(F.struct("c", "unit"))).alias("__units"))
    # A relation without an article meets no unit; a number of its own keeps such rows from one task.
    article = F.lower("target_article")
    t = found.withColumn("__a", article).withColumn("__n", F.when(article.isNotNull(), norm(F.col("target_number"))).otherwise(F.xxhash64(*found.columns).cast("string")))
    unit = lambda clause: F.try_element_at("__units", clause)
    return dealt(t).join(by, ["__n", "__a"], "left").select(*found.columns, F.coalesce(unit(F.coalesce("target_clause", F.lit(""))), unit(F.lit(""))).alias("target_unit"))


def lifecycle(found: DataFrame) -> DataFrame:
    """(target_number, replaced_by, repealed_by) from relations of whole documents (source_number, relation, target_number, target_article)."""
    whole = found.where("target_article is null and relation in ('thay_the', 'bai_bo', 'het_hieu_luc')")
    names = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("relation").isin(*kinds), F.col("source_number"))))
    return whole.groupBy(F.upper(F.trim("target_number")).alias("target_number")).agg(names("thay_the").alias("replaced_by"), names("bai_bo", "het_hieu_luc").alias("repealed_by"))


def with_validity(docs: DataFrame, cycles: DataFrame, today: Column) -> DataFrame:
    """``docs`` (doc_number, issued_date, effective_date, expiry_date) with their validity on a day."""
    joined = docs.join(cycles, F.upper(F.trim(docs["doc_number"])) == cycles["target_number"], "left")
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return joined.select(*(docs[c] for c in docs.columns), dates.validity(docs["issued_date"], docs["effective_date"], docs["expiry_date"], has(F.col("replaced_by")), has(F.col("repealed_by")), today).alias("validity"))


def slugs(found: DataFrame) -> DataFrame:
    """Articles with a slug of their own: number, document, and a counter where that is taken."""
    base = F.concat_ws("-", F.lit("dieu"), "article", tx.slugify(F.col("doc_number")))
    turn = F.row_number().over(W.partitionBy("__base").orderBy("unit_id"))
    return found.withColumn("__base", base).withColumn("slug", F.when(turn == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", turn.cast("string")))).drop("__base")


#: Who issues acts, and kinds of acts; the first in this order whose line the head of a text has.
AUTHORITIES = [
    "Chính phủ", "Ủy ban Thường vụ Quốc hội", "Quốc hội", "Văn phòng Quốc hội", "Thủ tướng Chính phủ", "Bộ Công an", "Bộ Tư pháp", "Bộ Tài chính", "Bộ Xây dựng",
    "Bộ Giao thông vận tải", "Tòa án nhân dân tối cao", "Viện kiểm sát nhân dân tối cao",
]
ACTS = ["Thông tư liên tịch", "Thông tư", "Nghị định", "Nghị quyết", "Quyết định", "Văn bản hợp nhất", "Pháp lệnh", "Bộ luật", "Luật", "Lệnh"]
#: Fixed value: openings of the line that ends an act's title.
AFTER_TITLE = r"Căn\s+cứ|Theo\s+đề\s+nghị|Để\s+thi\s+hành|Quy\s+định\s+này"
TITLE = 250


def identity(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc_type, authority, title, citation): what kind of act a text is, whose, its title and how it is cited; all built-in.

    The title is what stands between the line with the kind and the preamble, on one line, 250 characters at most.
    """
    head = F.substring(F.col(text), 1, 4000)
    line = lambda name: r"\s+".join(name.split())
    first = lambda names, of, tail: F.coalesce(*(F.when(F.rlike(of, F.lit(rf"(?iu)(?:^|\n)[#>*_ \t]*{line(n)}{tail}")), n) for n in names))
    kind = first(ACTS, head, r"[*_ \t]*(?:\n|$|\s+số|\s+\p{L})")
    block = F.regexp_extract(head, rf"(?iu)(?:^|\n)[#>*_ \t]*(?:{'|'.join(map(line, ACTS))})[*_ \t]*\n([\s\S]*?)(?=\n[*_ \t]*(?:{AFTER_TITLE})|$)", 1)
    title = F.nullif(F.trim(F.substring(F.regexp_replace(F.trim(block), r"[\s*_]+", " "), 1, TITLE)), F.lit(""))
    number = F.try_element_at(F.regexp_extract_all(head, F.lit(NUMBER), F.lit(1)), F.lit(1))
    return docs.select(key, kind.alias("doc_type"), first(AUTHORITIES, F.substring(head, 1, 700), r"[-\s*_]").alias("authority"), title.alias("title"), F.concat_ws(" ", kind, number).alias("citation"))


def document_relations(found: DataFrame) -> DataFrame:
    """(doc_number, direction, relation, other_number, article, clause, from_article, quote): each document's relations, both ways.

    ``found`` has (source_number, source_article, relation, target_number, target_article, target_clause, quote).  What a document
    says is outgoing; what others say about it is incoming, by number, case and blanks aside.
    """
    norm = lambda name: F.upper(F.trim(F.col(name)))
    rest = ["relation", F.col("target_article").alias("article"), F.col("target_clause").alias("clause"), F.col("source_article").alias("from_article"), "quote"]
    side = lambda own, way, other: F.struct(norm(own).alias("doc_number"), F.lit(way).alias("direction"), norm(other).alias("other_number"))
    foreign = F.col("target_number").isNotNull() & (norm("target_number") != F.coalesce(norm("source_number"), F.lit("")))
    outgoing, incoming = side("source_number", "outgoing", "target_number"), side("target_number", "incoming", "source_number")
    sides = F.when(foreign, F.array(outgoing, incoming)).otherwise(F.array(outgoing))  # one pass makes both
    return found.select(F.explode(sides).alias("s"), *rest).select("s.*", "relation", "article", "clause", "from_article", "quote")


def unit_context(found: DataFrame, key: str) -> DataFrame:
    """Units (of ``units``) with full_path and, for clauses and points, the title and content of their article."""
    parts = [F.concat(F.lit("Chương "), "chapter"), F.concat(F.lit("Điều "), "article"), F.concat(F.lit("khoản "), "clause"), F.concat(F.lit("điểm "), "point")]
    head = F.col("clause").isNull() & F.col("point").isNull()
    # One pass makes units and their articles' heads; an article is a few hundred units at most, not a table.
    own = F.min_by(F.when(head, F.struct("title", "content")), F.when(head, F.col("seq"))).over(W.partitionBy(key, "article"))
    inner = (F.col("clause").isNotNull() | F.col("point").isNotNull()) & F.col(key).isNotNull() & F.col("article").isNotNull()
    placed = found.withColumn("__a", own)
    return placed.select(*found.columns, F.concat_ws(" > ", *parts).alias("full_path"), F.when(inner, F.col("__a.title")).alias("article_title"), F.when(inner, F.col("__a.content")).alias("article_content"))


#: Relations after which a unit is not what it was.
CHANGES = ["sua_doi", "bo_sung", "thay_the", "bai_bo"]


def unit_warnings(linked: DataFrame) -> DataFrame:
    """(unit_id, relation, by_number, by_article, quote): units that others have changed, for relations with target_unit (of ``relink``)."""
    changed = linked.where(F.col("target_unit").isNotNull() & F.col("relation").isin(*CHANGES))
    return changed.select(F.col("target_unit").alias("unit_id"), "relation", F.coalesce("source_number", "target_number").alias("by_number"), F.col("source_article").alias("by_article"), "quote")


def reextract(stored: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """``stored`` relations (key, relation, target_number, target_article, target_clause, quote) with those of articles read anew.

    ``articles`` has (key, content, doc_number).  Relations of preambles stay, as their text is not among the articles'.
    """
    fresh = relations(articles, key, "content", "doc_number").drop("seq")
    kept = stored.where("relation = 'can_cu'").unionByName(stored.where("relation != 'can_cu'").join(articles.select(key).distinct(), key, "left_anti"))
    return kept.unionByName(fresh.select(*stored.columns))
