"""Decision tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_type(slug: Column) -> Column:
    return F.when(slug.isin("_index", "_log", "_hot"), F.substring(slug, 2, 100)).when(F.startswith(slug, F.lit("source/")), "source").otherwise("concept")


def page_maturity(content: Column) -> Column:
    """seed, developing, mature or evergreen: the lower of what length and number of wikilinks, repeats included, allow."""
    content = F.coalesce(content, F.lit(""))
    size, links = F.length(content), F.regexp_count(content, F.lit(r"\[\[[^\]]+\]\]"))
    rank = lambda c, steps: sum((c >= x).cast("int") for x in steps)
    level = F.least(rank(size, (600, 2000, 4000)), rank(links, (1, 3, 5)))
    return F.element_at(F.array(*map(F.lit, ("seed", "developing", "mature", "evergreen"))), level + 1)


def strategy(size: Column) -> Column:
    return F.when(size < 30_000, "single").when(size <= 200_000, "standard").otherwise("hierarchical")


def progress(chunks: Column, pages: Column) -> Column:
    return F.greatest(F.lit(5), (0.3 * chunks + 0.7 * pages).cast("int"))


def kb_action(similarity: Column, update: float = 0.85, maybe: float = 0.60) -> Column:
    return F.when(similarity >= update, "UPDATE").when(similarity >= maybe, "MAYBE").otherwise("CREATE")


def call_status(text: Column) -> Column:
    """What a tool's answer says: denied, error or ok."""
    low = F.lower(text)
    return F.when(F.rlike(low, F.lit("permission denied|access denied|not authorized|forbidden")), "denied").when(F.rlike(low, F.lit("^error|error:|failed|exception")), "error").otherwise("ok")


#: States of the page branch that wait for a person.
GATES = ("awaiting_approval", "plan_ready")


def branch_status(verbatim: Column, chunks: Column, pages: Column) -> Column:
    """One status from the two branches of a source, its chunks and its pages; a branch without a state is pending."""
    chunks, pages = F.coalesce(chunks, F.lit("pending")), F.coalesce(pages, F.lit("pending"))
    one = lambda c: F.when(c.isin("ready", "error"), c).otherwise("processing")
    gate = pages.isin(*GATES)
    return (
        F.when((chunks == "pending") & ~pages.isin("pending", "skipped"), F.when(gate, pages).otherwise(one(pages)))
        .when(F.coalesce(verbatim, F.lit(False)) | pages.isin("pending", "skipped"), one(chunks))
        .when(chunks == pages, one(pages))
        .when(gate, pages)
        .when((chunks.isin("ready", "error")) & (pages.isin("ready", "error")), "partial")
        .when(pages == "ready", "ready")
        .otherwise("processing")
    )
