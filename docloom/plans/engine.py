"""One object for the common questions; every answer is a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import access, chunks, graph, legal, search
from docloom.operators.textindex import TextIndex
from docloom.plans import guard
from docloom.session import ship, staged


class KnowledgeEngine:
    """Documents (doc_id, text, ...), their vectors (doc_id, embedding) and pages (page, slug, title, content, ...).

    ``embed`` turns a query into a vector; any model will do.  ``visible`` is a condition on documents that every answer keeps
    to; it is applied before anything is searched, so it also narrows what is scanned.  With an ``index`` of the documents, words
    are looked up there and texts are read for the hits alone.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, vectors: DataFrame | None = None, pages: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, visible: Column | None = None, index: TextIndex | None = None):
        self.spark = ship(spark)
        self.documents = documents if visible is None else documents.where(visible)
        self.vectors = vectors if vectors is None or visible is None else vectors.join(self.documents.select("doc_id"), "doc_id", "left_semi")
        self.pages, self.embed, self.index, self.limited = pages, embed, index, visible is not None

    def terms(self, query: str) -> tuple[list[str], list[str]]:
        """The query's terms, set phrases as their words, and its quoted phrases; one row, made where queries are."""
        found = self.spark.range(1).select(tx.keyword_terms(F.lit(query)).alias("t"), tx.quoted_phrases(F.lit(query)).alias("q")).first()
        return [w for t in found.t for w in t.split("_")], list(found.q)

    def lexical(self, terms: list[str], phrases: list[str]) -> DataFrame:
        """Rows as ``search.lexical`` has them, from the index if there is one."""
        if self.index is None:
            return search.lexical(self.documents, terms, phrases)
        found = self.index.lexical(terms, phrases)
        return found.join(self.documents.select("doc_id"), "doc_id", "left_semi") if self.limited else found

    def search(self, query: str, k: int = 10) -> DataFrame:
        """Vector and lexical hits, fused, reranked and cut at the threshold."""
        k = min(50, max(1, k))
        terms, phrases = self.terms(query)
        if self.vectors is not None and self.embed is not None:
            hits = search.hybrid(self.vectors, self.lexical(terms, phrases), self.embed(query), 2 * k)
        else:
            words = search.ranked(self.lexical(terms, phrases), search.lexical_order())
            hits = search.rrf([words], "doc_id").orderBy(F.desc("rrf"), "doc_id").limit(2 * k)
        full = staged(self.documents.join(F.broadcast(hits), "doc_id"), "hits")  # 100 rows at most; scores and the cut read them again
        ranked = search.pass_threshold(search.local_rerank(full, query, prior="rrf"))
        return ranked.orderBy(F.desc("rerank_score"), F.desc("rrf"), "doc_id").limit(k)

    def legal_search(self, query: str, units: DataFrame, relations: DataFrame) -> DataFrame:
        """(unit_id, arm): the unit whose document number and article the query names, and the units one step from it.

        ``units`` has (unit_id, doc_number, unit_number), ``relations`` (source_unit, target_number, target_article, relation_type).
        A query that names no number, or no article, has no rows; ``search`` serves it.
        """
        found = self.spark.range(1).select(tx.doc_numbers(F.lit(query)).alias("n"), F.regexp_extract(tx.fold_lower(F.lit(query)), r"\bdieu\s+(\d+[a-z]?)\b", 1).alias("a")).first()
        if not found.n or not found.a:
            return units.select("unit_id").limit(0).withColumn("arm", F.lit("exact"))
        number = self.spark.range(1).select(F.upper(F.regexp_replace(F.lit(found.n[0]), r"\s", "")).alias("n")).first().n
        exact = search.route(units, number, found.a).select("unit_id")
        near = search.expand_by_citation(exact, units, relations).select("unit_id").distinct().join(exact, "unit_id", "left_anti")
        return exact.withColumn("arm", F.lit("exact")).unionByName(near.withColumn("arm", F.lit("graph")))

    def page(self, slug: str) -> DataFrame:
        """A page with the slugs it links to and those that link to it, sorted."""
        links = self.links().join(self.pages.select(F.col("page").alias("from_page"), F.col("slug").alias("from_slug")), "from_page").select("from_slug", "to_slug")
        out = links.where(F.col("from_slug") == slug).groupBy(F.col("from_slug").alias("slug")).agg(F.array_sort(F.collect_set("to_slug")).alias("links_to"))
        back = links.where(F.col("to_slug") == slug).groupBy(F.col("to_slug").alias("slug")).agg(F.array_sort(F.collect_set("from_slug")).alias("linked_from"))
        empty = F.array().cast("array<string>")
        met = self.pages.where(F.col("slug") == slug).join(out, "slug", "left").join(back, "slug", "left")
        return met.withColumns({"links_to": F.coalesce("links_to", empty), "linked_from": F.coalesce("linked_from", empty)})

    def document_pages(self, pages: DataFrame, doc_id: int, numbers: list[int]) -> DataFrame:
        """(doc_id, page, content) of some pages of a document; ``pages`` has (doc_id, page_no, content)."""
        own = pages.where(F.col("doc_id") == doc_id).join(self.documents.select("doc_id").distinct(), "doc_id", "left_semi")
        return chunks.page_slices(chunks.assemble(own, "doc_id", "page_no", "content"), "doc_id", numbers).orderBy("page")

    def list_documents(self, query: str | None = None, columns: Sequence[str] = ("text",), order: Sequence[Column] = (), number: int = 1, size: int = 20, **given) -> DataFrame:
        """Documents by what is given (column=value or values) and a text in any of the columns, with has_more."""
        rows = access.where_given(self.documents, **given)
        rows = rows if not query else rows.where(access.contains_any(query, *columns))
        return access.page_with_more(rows, [*order, F.col("doc_id")], number, size)

    def kinds(self, column: str) -> DataFrame:
        """(column, n): how many documents there are of each kind."""
        return self.documents.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)

    def document_relations(self, number: str, found: DataFrame) -> DataFrame:
        """What a document says of others and others of it; ``found`` as in ``legal.document_relations``."""
        return legal.document_relations(found).where(F.col("doc_number") == number.strip().upper())

    def outline(self, doc_id: int) -> DataFrame:
        return chunks.outline(self.documents.where(F.col("doc_id") == doc_id), "doc_id", "text").orderBy("idx")

    def chunks(self) -> DataFrame:
        return chunks.markdown_chunks(self.documents)

    def snippets(self, terms: Sequence[str], n: int = 5) -> DataFrame:
        """The lines with the most of the terms, marked."""
        found = self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        hits = sum((F.contains(tx.fold_lower(F.col("line")), F.lit(t)).cast("int") * len(t) for t in terms), F.lit(0))
        return found.withColumn("score", hits).where("score > 0").orderBy(F.desc("score"), "doc_id", "line_no").limit(n).withColumn("line", tx.highlight(F.col("line"), list(terms)))

    def links(self) -> DataFrame:
        return graph.links(self.pages, "page", tx.wikilinks(F.col("content")), F.col("slug"))

    def lint(self) -> DataFrame:
        return graph.lint(self.pages.select("page", "slug", F.coalesce(F.contains("content", F.lit("contradict")), F.lit(False)).alias("contradicts")), self.links())

    def neighbours(self, slug: str, depth: int = 2) -> DataFrame:
        named = self.links().join(self.pages.select(F.col("page").alias("from_page"), F.col("slug").alias("a")), "from_page").select("a", F.col("to_slug").alias("b"))
        return graph.neighbourhood(named, self.spark.range(1).select(F.lit(slug).alias("node")), depth)

    def list_pages(self, number: int = 1, size: int = 20) -> DataFrame:
        return access.page(self.pages.where(~F.col("slug").isin("_index", "_log", "_hot")), [F.lower("title"), F.col("slug")], number, size)

    def legal_units(self) -> DataFrame:
        return legal.units(self.documents, "doc_id", "text")

    def legal_relations(self) -> DataFrame:
        return legal.relations(self.documents, "doc_id", "text")

    def sql(self, statement: str, tables: dict[str, DataFrame], rows: int = guard.ROWS) -> DataFrame:
        return guard.query(self.spark, statement, tables, rows)
