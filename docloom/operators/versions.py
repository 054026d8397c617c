"""Upserts, drafts with optimistic versions, branches, history and detaching, as joins that make new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """One row for each key: the newest, then the largest ``tie``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(at, tie)).alias("r")).select("r.*")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` in place of the rows of their keys; at most one change for each key."""
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*target.columns))


def overwrite_days(path: str, changes: DataFrame, keys: list[str], day: str = "day") -> None:
    """Upsert into a table stored by day: only the days that ``changes`` has are read and written anew, beside the old and then in place."""
    spark = changes.sparkSession
    days = [r[0] for r in changes.select(day).distinct().collect()]
    try:
        old = spark.read.parquet(path).where(F.col(day).isin(days))
        merged = upsert(old, changes, keys)
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        merged = changes
    # Reliable: cuts the plan from the files that are about to be replaced.
    merged.checkpoint().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def judge_drafts(drafts: DataFrame, pages: DataFrame) -> DataFrame:
    """``drafts`` (draft_id, page_id, base_version, status, author, reviewer) with outcome: error (no page), skipped (not pending, or
    one's own), conflict (the page has moved on, or a draft of the page goes first) or approved."""
    joined = drafts.join(pages.select("page_id", F.col("version").alias("__version")), "page_id", "left")
    first = (
        F.when(F.col("__version").isNull(), "error")
        .when((F.col("status") != "pending") | (F.col("author") == F.col("reviewer")), "skipped")
        .when(F.col("base_version") < F.col("__version"), "conflict")
        .otherwise("approved")
    )
    turn = F.row_number().over(W.partitionBy("page_id", "__first").orderBy("draft_id"))
    out = joined.withColumn("__first", first).withColumn("__turn", turn)
    return out.withColumn("outcome", F.when((F.col("__first") == "approved") & (F.col("__turn") > 1), "conflict").otherwise(F.col("__first"))).drop("__version", "__first", "__turn")


def apply_drafts(pages: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with approved content and the next version, revisions that this adds)."""
    ok = judged.where("outcome = 'approved'").select("page_id", F.col("content").alias("__new"), "author")
    joined = pages.join(ok, "page_id", "left")
    after = joined.withColumn("version", F.col("version") + F.col("__new").isNotNull().cast("int")).withColumn("content", F.coalesce("__new", "content"))
    return after.select(*pages.columns), after.where("__new is not null").select("page_id", "version", "content", "author")


def branches(judged: DataFrame) -> DataFrame:
    """(branch_id, n_drafts, n_conflicts, mergeable): a branch merges whole or not at all."""
    bad = F.sum(F.when(F.col("outcome").isin("conflict", "error"), 1).otherwise(0))
    return judged.groupBy("branch_id").agg(F.count("*").alias("n_drafts"), bad.alias("n_conflicts"), (bad == 0).alias("mergeable"))


#: Which state of a contribution may follow which.
TRANSITIONS = {"pending": "needs_revision approved rejected withdrawn", "needs_revision": "pending rejected withdrawn", "approved": "", "rejected": "", "withdrawn": ""}


def illegal_moves(moves: DataFrame, old: str = "old_status", new: str = "new_status") -> DataFrame:
    legal = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())).cast("array<string>"))))
    return moves.where(~F.coalesce(F.array_contains(F.try_element_at(legal, F.col(old)), F.col(new)), F.lit(False)))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): A (added), D (deleted) or M (modified)."""
    a, b = old.select(key, F.col(value).alias("__a"), F.lit(True).alias("__old")), new.select(key, F.col(value).alias("__b"), F.lit(True).alias("__new"))
    kind = F.when(F.col("__old").isNull(), "A").when(F.col("__new").isNull(), "D").when(~F.col("__a").eqNullSafe(F.col("__b")), "M")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def detach(pages: DataFrame, source: int, sources: str = "source_ids") -> DataFrame:
    """``pages`` without the source; a page whose last source it was goes."""
    left = F.array_remove(F.col(sources), source)
    return pages.where(~(F.array_contains(sources, source) & (F.size(left) == 0))).withColumn(sources, left)


def fan_out(messages: DataFrame, recipients: str, actor: str) -> DataFrame:
    """(recipient, n, message_ids): each recipient once for a message, never its actor."""
    one = messages.select("message_id", F.explode(F.array_distinct(recipients)).alias("recipient"), F.col(actor).alias("__actor")).where("recipient != __actor")
    return one.groupBy("recipient").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("message_id")).alias("message_ids"))


def embedding_coverage(pages: DataFrame, vectors: DataFrame, spec: str) -> DataFrame:
    """One row: how many pages have vectors of the active model, and how many there are."""
    embedded = vectors.where(F.col("model_spec") == spec).select("page_id").distinct()
    return pages.join(embedded.withColumn("has", F.lit(1)), "page_id", "left").agg(F.count("has").alias("embedded"), F.count("*").alias("total"))


def delete_with_children(key: str, gone: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the keys that go."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in children.items()}


def switch_model(vectors: DataFrame, made: DataFrame, spec: str, keys: list[str]) -> DataFrame:
    """Vectors after a switch of the model: those of the new one, made ones in place of older ones; all others go."""
    return upsert(vectors.where(F.col("model_spec") == spec), made.where(F.col("model_spec") == spec), keys)


def rollback(pages: DataFrame, revisions: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, version, content, change_type, note, outcome): the revision that puts a page back to an earlier one.

    ``pages`` (page_id, version, content), ``revisions`` (page_id, version, content), ``targets`` (page_id, target).  It is a new
    version, one above the page's; where the page or the revision is not there, outcome is error and nothing is to be written.
    """
    old = revisions.select("page_id", F.col("version").alias("target"), F.col("content").alias("was")).dropDuplicates(["page_id", "target"])
    now = pages.select("page_id", F.col("version").alias("current"))
    met = targets.join(now, "page_id", "left").join(old.withColumn("found", F.lit(True)), ["page_id", "target"], "left")
    fine = F.col("found") & F.col("current").isNotNull()
    return met.select(
        "page_id", F.when(fine, F.col("current") + 1).alias("version"), F.when(fine, F.col("was")).alias("content"), F.lit("rollback").alias("change_type"),
        F.concat(F.lit("rollback to v"), F.col("target").cast("string")).alias("note"), F.when(fine, "restored").otherwise("error").alias("outcome"),
    )


def direct_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """(page_id, version, content, outcome) of ``edits`` (page_id, base_version, content): applied, conflict (made on an older version), unchanged or error (no page)."""
    now = pages.select("page_id", F.col("version").alias("current"), F.col("content").alias("was"))
    met = edits.join(now, "page_id", "left")
    outcome = F.when(F.col("current").isNull(), "error").when(F.col("base_version") < F.col("current"), "conflict").when(F.col("was").eqNullSafe(F.col("content")), "unchanged").otherwise("applied")
    done = met.withColumn("outcome", outcome)
    applied = F.col("outcome") == "applied"
    return done.select("page_id", F.when(applied, F.col("current") + 1).otherwise(F.col("current")).alias("version"), F.when(applied, F.col("content")).otherwise(F.col("was")).alias("content"), "outcome")


def resubmit(drafts: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rounds, drafts) when authors send drafts again: what was there before is kept as a round, and the draft is pending, a round further.

    ``drafts`` (draft_id, author, status, round, content, returned_note), ``sent`` (draft_id, author, content).  Only drafts that
    need revision, and only by their own author; other drafts stay as they are.
    """
    new = sent.select("draft_id", F.col("author").alias("__by"), F.col("content").alias("__new")).dropDuplicates(["draft_id"])
    met = drafts.join(new, "draft_id", "left")
    ok = F.coalesce((F.col("status") == "needs_revision") & (F.col("author").isNull() | (F.col("author") == F.col("__by"))) & F.col("__new").isNotNull(), F.lit(False))
    met = met.withColumn("__ok", ok)
    round_ = F.coalesce("round", F.lit(0))
    rounds = met.where("__ok").select("draft_id", round_.alias("round_no"), "content", "returned_note")
    after = {"status": F.lit("pending"), "round": round_ + 1, "content": F.col("__new"), "returned_note": F.lit(None).cast("string")}
    return rounds, met.select(*(F.when(F.col("__ok"), after[n]).otherwise(F.col(n)).alias(n) if n in after else F.col(n) for n in drafts.columns))


def outcome_counts(judged: DataFrame) -> DataFrame:
    """One row: how many drafts of a bulk approval were approved, skipped, in conflict and in error."""
    return judged.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("approved", "skipped", "conflict", "error")))
