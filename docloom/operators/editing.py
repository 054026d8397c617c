"""Edits of pages as one step over several tables, with links, counts of backlinks and index lines kept up by what changed.

An edit names the version that it was made on.  It is a conflict where the page has another one by now, and it is refused where a
rewrite would lose rows or shrink the page (``checks.rewrite_guard``); the rest change page, revisions, links, backlink counts
and index line in one commit.  Old and new links of the edited pages are a change feed: what only the old version has counts -1
for its target, what only the new one has +1.  So a batch reads and writes the buckets of pages, links and targets that it
touches, and never the whole wiki.

Edge cases: of several edits of a page in one batch the first (by time, then author and text) counts and the others are conflicts;
a null text is an empty one; edits without a slug are conflicts; an edit of no page that names a version, and one without a version of a
page that is there, are conflicts; a link of a page to itself is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import checks
from docloom.session import staged
from docloom.sources.snapshots import Lost, Snapshots

#: The tables of a wiki: key and columns.
TABLES = {
    "pages": ("slug", "slug string, title string, content string, page_type string, version int, updated_at timestamp"),
    "revisions": ("slug", "slug string, version int, content string, author string, at timestamp"),
    "links": ("slug", "slug string, to_slug string"),
    "backlinks": ("slug", "slug string, n long"),
    "index": ("slug", "slug string, page_type string, line string"),
}
TRIES = 5


def wiki(spark: SparkSession, path: str, buckets: int = 64) -> Snapshots:
    return Snapshots(spark, path, TABLES, buckets)


def judge(store: Snapshots, edits: DataFrame, base: int) -> DataFrame:
    """``edits`` with the page's version and text at ``base`` (was, old) and the outcome: created, updated, conflict, or why it is refused."""
    order = W.partitionBy("slug").orderBy("at", "author", "content")
    turn = edits.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("turn", F.row_number().over(order))
    known = store.rows("pages", edits, base).select("slug", F.col("version").alias("was"), F.col("content").alias("old"))
    met = turn.join(known, "slug", "left")
    fits = F.coalesce(F.col("base_version"), F.lit(0)) == F.coalesce(F.col("was"), F.lit(0))
    outcome = F.when(F.col("slug").isNull() | (F.col("turn") > 1) | ~fits, "conflict").when(F.col("was").isNull(), "created").otherwise(F.coalesce(checks.rewrite_guard(F.col("old"), F.col("content")), F.lit("updated")))
    return met.withColumn("outcome", outcome).drop("turn")


def _links(rows: DataFrame, content: str) -> DataFrame:
    found = rows.select("slug", F.explode(tx.wikilinks(F.col(content))).alias("to_slug"))
    return found.where("to_slug != slug").distinct()


def apply_edits(store: Snapshots, edits: DataFrame, tries: int = TRIES) -> tuple[DataFrame, int]:
    """Commit (slug, title, content, page_type, base_version, author, at); each edit with its outcome, and the version that has them.

    Where another writer was first, edits are judged anew on what that one left.
    """
    names = ["slug", "title", "content", "page_type", "base_version", "author", "at"]
    edits = staged(edits.select(*names), "edits")
    for _ in range(tries):
        base = store.version()
        judged = staged(judge(store, edits, base), "judged")
        good = judged.where(F.col("outcome").isin("created", "updated"))
        if good.isEmpty():
            return judged.drop("old"), base
        try:
            return judged.drop("old"), store.commit(base, prepare(store, good, base))
        except Lost:
            continue
    raise Lost(f"other writers were first {tries} times")


def prepare(store: Snapshots, good: DataFrame, base: int) -> dict[str, dict[str, list[str]]]:
    """The changed files of all tables for edits that are to be made; nothing is seen of them before they are committed."""
    version = (F.coalesce("was", F.lit(0)) + 1).cast("int")
    pages = good.select("slug", "title", "content", "page_type", version.alias("version"), F.col("at").alias("updated_at"))
    revisions = good.select("slug", version.alias("version"), "content", "author", "at")
    new, old = _links(good, "content"), store.rows("links", good, base)
    feed = new.withColumn("n", F.lit(1)).unionByName(old.withColumn("n", F.lit(-1)))
    changed = staged(feed.groupBy("slug", "to_slug").agg(F.sum("n").alias("n")).where("n != 0").groupBy(F.col("to_slug").alias("slug")).agg(F.sum("n").alias("n")).where("n != 0"), "feed")
    counts = changed.unionByName(store.rows("backlinks", changed, base)).groupBy("slug").agg(F.sum("n").alias("n"))
    summary = F.substring(F.trim(F.regexp_replace(tx.strip_markup(F.col("content")), r"\s+", " ")), 1, 80)
    index = good.select("slug", "page_type", F.concat(F.lit("- [["), F.col("slug"), F.lit("|"), F.coalesce("title", "slug"), F.lit("]] — "), summary).alias("line"))
    return {
        "pages": store.replaced("pages", good, pages, base),
        "revisions": store.added("revisions", revisions, base),
        "links": store.replaced("links", good, new, base),
        "backlinks": store.replaced("backlinks", changed, counts.where("n > 0"), base),
        "index": store.replaced("index", good, index, base),
    }


def orphans(store: Snapshots) -> DataFrame:
    """(slug) of the pages that nothing links to, by the kept counts."""
    return store.read("pages").select("slug").join(store.read("backlinks").select("slug"), "slug", "left_anti")
