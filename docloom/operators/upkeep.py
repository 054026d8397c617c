"""What keeps a knowledge base in order: retries, work that is still to be done, and the pages that list other pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a source that may be tried again, and phases of the page branch that go on where they stopped.
RETRIED = ("error", "partial", "plan_ready")
LATE_PHASES = ("refine", "verify", "commit")
#: Fixed value: recoveries in a row after which a person must look.
RECOVERIES = 3
#: Names of pages that list others, and how many recent and young pages the briefing names.
RESERVED = ("_index", "_log", "_hot")
RECENT, YOUNG = 10, 20
INDEX_MOST = 2000


def retry_plan(sources: DataFrame, most: int = RECOVERIES) -> DataFrame:
    """``sources`` with refusal (why nothing is done, or null), branch (all, chunk, wiki or both) and start (where pages begin again).

    ``sources`` has status, chunk_status, wiki_status, phase, has_text, verbatim, recoveries, by_admin and asked, the branch that was
    asked for or null.  Without being asked, the branches that failed run again; all of it where there is no text or no branch failed.
    A source kept word for word has no pages to make.
    """
    c = F.col
    state = lambda name: F.coalesce(c(name), F.lit("pending"))
    text, chunk, wiki = F.coalesce(c("has_text"), F.lit(False)), state("chunk_status") == "error", (state("wiki_status") == "error") | (c("status") == "plan_ready")
    new = (state("chunk_status") == "pending") & (state("wiki_status") == "pending")
    own = F.when(~text | new | ~(chunk | wiki), "all").when(chunk & wiki, "both").when(chunk, "chunk").otherwise("wiki")
    wanted = F.coalesce("asked", own)
    refusal = (
        F.when(~F.coalesce(c("status").isin(*RETRIED), F.lit(False)), "status")
        .when((F.coalesce("recoveries", F.lit(0)) >= most) & ~F.coalesce(c("by_admin"), F.lit(False)), "too_many")
        .when((wanted != "all") & ~text, "no_text")
    )
    branch = F.when(refusal.isNull(), F.when(wanted.isin("wiki", "both") & F.coalesce(c("verbatim"), F.lit(False)), "chunk").otherwise(wanted))
    start = F.when(branch.isin("wiki", "both"), F.when(c("phase").isin(*LATE_PHASES), "refine").otherwise("map"))
    return sources.select("*", refusal.alias("refusal"), branch.alias("branch"), start.alias("start"))


def chunk_backfill(sources: DataFrame, limit: int = 500) -> DataFrame:
    """Sources that are ready, in whole or part, have text and lack chunks; the oldest first.  For (source_id, status, chunk_status, text, created_at)."""
    due = sources.where(F.col("chunk_status").isin("pending", "error") & F.col("status").isin("ready", "partial") & (F.trim("text") != ""))
    return due.orderBy("created_at", "source_id").limit(limit)


def metadata_backfill(sources: DataFrame, done: DataFrame, limit: int = 500) -> DataFrame:
    """Sources with text whose metadata are not among ``done`` (source_id); the newest first."""
    return sources.where(F.trim("text") != "").join(done.select("source_id"), "source_id", "left_anti").orderBy(F.desc("created_at"), "source_id").limit(limit)


def briefing(pages: DataFrame) -> DataFrame:
    """(part, slug, title, note): contradictions with what their callout says, the ten pages changed last, and twenty young ones by title.

    ``pages`` has (slug, title, status, updated_at, content); pages that list others are left out.
    """
    known = pages.where(~F.col("slug").isin(*RESERVED))
    said = F.trim(F.regexp_replace(F.regexp_extract("content", r"(?is)>\s*\[!contradiction\]([^\n]*(?:\n>[^\n]*)*)", 1), r"\s*\n>\s*", " "))
    against = known.where(F.contains("content", F.lit("[!contradiction]"))).select("slug", "title", said.alias("note"))
    recent = known.orderBy(F.desc_nulls_last("updated_at"), "slug").limit(RECENT).select("slug", "title", F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("note"))
    young = known.where("status = 'seed'").orderBy("title", "slug").limit(YOUNG).select("slug", "title", F.lit(None).cast("string").alias("note"))
    part = lambda df, name: df.select(F.lit(name).alias("part"), "slug", "title", "note")
    return part(against, "contradiction").unionByName(part(recent, "recent")).unionByName(part(young, "seed"))


def index_lines(pages: DataFrame, most: int = INDEX_MOST) -> DataFrame:
    """(page_type, slug, line, cut): a line with link and summary for each of the pages changed last, ``most`` at most; cut if there are more.

    ``pages`` has (slug, title, page_type, summary, updated_at).
    """
    last = pages.where(~F.col("slug").isin(*RESERVED)).orderBy(F.desc_nulls_last("updated_at"), "slug").limit(most)
    more = pages.where(~F.col("slug").isin(*RESERVED)).agg((F.count("*") > most).alias("cut"))  # one row
    tail = F.when(F.col("summary") != "", F.concat(F.lit(" — "), F.col("summary"))).otherwise("")
    line = F.concat(F.lit("- [["), F.col("slug"), F.lit("|"), F.col("title"), F.lit("]]"), tail)
    lines = last.select(F.coalesce("page_type", F.lit("other")).alias("page_type"), "slug", line.alias("line"))
    return lines.join(F.broadcast(more), F.lit(True), "left")


def append_log(logs: DataFrame, entries: DataFrame) -> DataFrame:
    """(scope, content, version) of the log pages after ``entries`` (scope, at, entry), one version further where something was added.

    A scope without a page gets one.  A scope's entries of one run are joined in order of time.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: F.concat(F.lit("## ["), F.date_format(x["at"], "yyyy-MM-dd HH:mm"), F.lit("] "), F.trim(x["entry"])))
    new = entries.groupBy("scope").agg(F.array_join(lines, "\n\n").alias("added"))
    met = logs.select("scope", "content", "version").join(new, "scope", "full_outer")
    was = F.coalesce(F.regexp_replace("content", r"\s+$", ""), F.lit("# Wiki Log"))
    return met.select(
        "scope", F.when(F.col("added").isNotNull(), F.concat(was, F.lit("\n\n"), F.col("added"), F.lit("\n"))).otherwise(F.col("content")).alias("content"),
        F.when(F.col("version").isNull(), 1).otherwise(F.col("version") + F.col("added").isNotNull().cast("int")).alias("version"),
    )
