"""Daily metrics of usage, content and contributions as one long table (day, metric_key, dimensions, value_numeric, value_json)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx

SCHEMA = ["day", "metric_key", "dimensions", "dimensions_hash", "value_numeric", "value_json"]
#: Days until a page is stale, days of weekly activity, rows of a top list, of a gap list, and samples of a gap.
STALE, WEEK, TOP, GAPS, SAMPLES = 30, 7, 10, 100, 5


def day_of(ts: Column) -> Column:
    return F.to_date(ts.cast("timestamp_ntz"))


def dimensions(name: str, value: Column) -> Column:
    """A one-key object, spelled as its hash needs it."""
    return F.concat(F.lit(f'{{"{name}": "'), value, F.lit('"}'))


def dims_hash(dims: Column) -> Column:
    return F.when(dims.isNull() | (dims == ""), F.lit("")).otherwise(F.md5(dims))


def long_form(daily: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Columns of daily numbers, one row for each."""
    pairs = F.array(*(F.struct(F.lit(k).alias("metric_key"), F.col(f"`{k}`").cast("double").alias("value_numeric")) for k in keys))
    none = F.lit(None).cast("string")
    return daily.select(F.col(day).alias("day"), F.explode(pairs).alias("m")).select("day", "m.metric_key", none.alias("dimensions"), F.lit("").alias("dimensions_hash"), "m.value_numeric", none.alias("value_json"))


def counts_by(rows: DataFrame, day: Column, key: str, name: str, value: Column) -> DataFrame:
    """A count for each value of a dimension and day."""
    n = rows.groupBy(day.alias("day"), dimensions(name, value).alias("dimensions")).agg(F.count("*").cast("double").alias("value_numeric"))
    return n.select("day", F.lit(key).alias("metric_key"), "dimensions", dims_hash(F.col("dimensions")).alias("dimensions_hash"), "value_numeric", F.lit(None).cast("string").alias("value_json"))


def top_list(rows: DataFrame, day: Column, key: str, item: Column, n: int = TOP) -> DataFrame:
    """For each day its ``n`` most frequent items as JSON, ties by name; counted before they are ranked."""
    counted = rows.groupBy(day.alias("day"), item.alias("name")).agg(F.count("*").alias("count"))
    rank = F.row_number().over(W.partitionBy("day").orderBy(F.desc("count"), "name"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= n)
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "count"))), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count")))
    return best.groupBy("day").agg(F.to_json(items).alias("value_json")).select("day", F.lit(key).alias("metric_key"), F.lit(None).cast("string").alias("dimensions"), F.lit("").alias("dimensions_hash"), F.lit(None).cast("double").alias("value_numeric"), "value_json")


def usage(log: DataFrame, searches: list[str]) -> DataFrame:
    """Usage metrics of a log (ts, user_id, tool, status, latency, result_count): one aggregate by day for all plain counts."""
    day = day_of(F.col("ts"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    daily = log.groupBy(day.alias("day")).agg(
        F.count("*").alias("mcp.queries.total"),
        one((F.col("result_count") == 0) & F.col("tool").isin(*searches)).alias("mcp.queries.zero_result"),
        one(F.col("status") == "error").alias("mcp.queries.error"),
        one(F.col("status") == "denied").alias("mcp.queries.denied"),
        F.countDistinct("user_id").alias("mcp.active_users"),
        F.avg("latency").alias("mcp.latency_ms_avg"),
    )
    keys = [c for c in daily.columns if c != "day"]
    weekly = rolling_users(log).select(F.col("day"), F.col("users").alias("mcp.weekly_active_users"))
    return (
        long_form(daily, keys)
        .unionByName(long_form(weekly, ["mcp.weekly_active_users"]))
        .unionByName(top_list(log, day, "mcp.queries.by_tool", F.col("tool"), 1000))
        .unionByName(top_list(log, day, "mcp.top_employees", F.col("user_id").cast("string")))
    )


def rolling_users(log: DataFrame, days: int = WEEK) -> DataFrame:
    """(day, users): distinct users of the ``days`` up to each day that has rows.

    A user's days are reduced to distinct (user, day) rows first; each then counts for the days it reaches.
    """
    seen = log.select("user_id", day_of(F.col("ts")).alias("d")).where("user_id is not null").distinct()
    reach = seen.select("user_id", F.explode(F.sequence("d", F.date_add("d", days - 1))).alias("day"))
    return reach.join(seen.select(F.col("d").alias("day")).distinct(), "day", "left_semi").groupBy("day").agg(F.countDistinct("user_id").alias("users"))


def content(pages: DataFrame, revisions: DataFrame, edges: DataFrame, day: str) -> DataFrame:
    """Content metrics of one day: pages (slug, page_type, created_at, updated_at), revisions (slug, created_at), edges (to_slug)."""
    start = F.to_timestamp_ntz(F.lit(f"{day} 00:00:00"))
    end = start + F.expr("interval 1 day")
    inside = lambda c: (F.col(c).cast("timestamp_ntz") >= start) & (F.col(c).cast("timestamp_ntz") < end)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    snapshot = pages.agg(
        F.count("*").alias("wiki.pages.total"), n(inside("created_at")).alias("wiki.pages.created"), n(inside("updated_at")).alias("wiki.pages.updated"),
        n(F.col("updated_at").cast("timestamp_ntz") < end - F.expr(f"interval {STALE} days")).alias("wiki.pages.stale_30d"),
    ).withColumn("day", F.lit(day).cast("date"))
    orphan = pages.join(edges.select(F.col("to_slug").alias("slug")).distinct(), "slug", "left_anti").agg(F.count("*").alias("wiki.pages.orphan")).withColumn("day", F.lit(day).cast("date"))
    today = revisions.where(inside("created_at"))
    revised = today.agg(F.count("*").alias("wiki.revisions.daily")).withColumn("day", F.lit(day).cast("date"))
    return (
        long_form(snapshot, [c for c in snapshot.columns if c != "day"]).unionByName(long_form(orphan, ["wiki.pages.orphan"])).unionByName(long_form(revised, ["wiki.revisions.daily"]))
        .unionByName(counts_by(pages, F.lit(day).cast("date"), "wiki.pages.by_type", "page_type", F.col("page_type")))
        .unionByName(top_list(today, F.lit(day).cast("date"), "wiki.top_pages", F.col("slug").cast("string")))
    )


def snapshot(day: str, key: str, rows: DataFrame) -> DataFrame:
    """The number of rows there are, on a day: plans that wait for review, for one."""
    return long_form(rows.agg(F.count("*").alias(key)).withColumn("day", F.lit(day).cast("date")), [key])


def gap_metric(queries: DataFrame, day: Column, text: str, order: str, who: str, top: int = GAPS) -> DataFrame:
    """The gaps of each day as one JSON list: text, count, samples and requesters, the most frequent first."""
    keyed = queries.select(day.alias("day"), tx.gap_key(F.col(text)).alias("gap_key"), F.col(text).alias("sample"), F.col(order).alias("at"), F.col(who).alias("who")).where("gap_key != ''")
    one = keyed.groupBy("day", "gap_key", "sample").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    first = F.row_number().over(W.partitionBy("day", "gap_key").orderBy("at", "sample"))
    samples = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= SAMPLES, F.struct("r", "sample")))), lambda x: x["sample"])
    counted = one.withColumn("r", first).groupBy("day", "gap_key").agg(F.sum("n").alias("count"), samples.alias("samples"))
    rank = F.row_number().over(W.partitionBy("day").orderBy(F.desc("count"), "gap_key"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= top)
    people = keyed.join(best.select("day", "gap_key"), ["day", "gap_key"], "left_semi").groupBy("day", "gap_key").agg(F.array_sort(F.collect_set("who")).alias("requesters"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "gap_key", "count", "samples", "requesters"))), lambda x: F.struct(x["gap_key"].alias("text"), x["count"].alias("count"), x["samples"].alias("samples"), x["requesters"].alias("requesters")))
    listed = best.join(people, ["day", "gap_key"]).groupBy("day").agg(F.to_json(items).alias("value_json"))
    return listed.select("day", F.lit("mcp.gaps.zero_result").alias("metric_key"), F.lit(None).cast("string").alias("dimensions"), F.lit("").alias("dimensions_hash"), F.lit(None).cast("double").alias("value_numeric"), "value_json")


def merge_gaps(daily: DataFrame) -> DataFrame:
    """(text, count, samples, n_requesters) of gap metrics over days: counts are summed, samples and requesters united."""
    items = F.from_json("value_json", "array<struct<text:string,count:long,samples:array<string>,requesters:array<string>>>")
    each = daily.where("metric_key = 'mcp.gaps.zero_result'").select("day", F.explode(items).alias("i")).select("day", "i.*")
    samples = F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("day", "samples"))), lambda x: x["samples"]))), 1, SAMPLES)
    return each.groupBy("text").agg(F.sum("count").alias("count"), samples.alias("samples"), F.size(F.array_distinct(F.flatten(F.collect_list("requesters")))).alias("n_requesters"))


def contribution(drafts: DataFrame, names: DataFrame) -> DataFrame:
    """Contribution metrics by day of drafts (created_at, reviewed_at, status, source, author, reviewer); names (id, name).

    Pending drafts are a snapshot and stand on the last day that has drafts.
    """
    made, seen = day_of(F.col("created_at")), day_of(F.col("reviewed_at"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    created = drafts.groupBy(made.alias("day")).agg(F.count("*").alias("draft.created"))
    wait = F.avg((F.unix_micros(F.col("reviewed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6)
    reviewed = drafts.where("reviewed_at is not null").groupBy(seen.alias("day")).agg(n(F.col("status") == "approved").alias("draft.approved"), n(F.col("status") == "rejected").alias("draft.rejected"), wait.alias("draft.time_to_review_avg_seconds"))
    pending = drafts.agg(F.max(made).alias("day"), n(F.col("status") == "pending").alias("draft.pending"))
    who = lambda c: F.coalesce(F.col(c), F.lit("(unknown)"))
    named = lambda c: drafts.join(names.select(F.col("id").alias(c), F.col("name").alias("__name")), c, "left")
    return (
        long_form(created, ["draft.created"]).unionByName(long_form(reviewed, [c for c in reviewed.columns if c != "day"])).unionByName(long_form(pending, ["draft.pending"]))
        .unionByName(counts_by(drafts, made, "draft.created.by_source", "source", F.col("source")))
        .unionByName(top_list(named("author"), made, "draft.top_contributors", who("__name")))
        .unionByName(top_list(named("reviewer").where("reviewed_at is not null"), seen, "draft.top_reviewers", who("__name")))
    )


def audit(log: DataFrame) -> DataFrame:
    """Denials by day of a log (ts, decision, resource)."""
    denied = log.where("decision = 'deny'")
    day = day_of(F.col("ts"))
    return long_form(denied.groupBy(day.alias("day")).agg(F.count("*").alias("audit.denied")), ["audit.denied"]).unionByName(counts_by(denied, day, "audit.denied.by_resource", "resource", F.col("resource")))


def gaps(queries: DataFrame, text: str, order: str, who: str, top: int | None = GAPS) -> DataFrame:
    """Queries without a result by what they ask: key, count, the first samples, and who asked; samples are bounded before they meet."""
    keyed = queries.select(tx.gap_key(F.col(text)).alias("gap_key"), F.col(text).alias("sample"), F.col(order).alias("at"), F.col(who).alias("who")).where("gap_key != ''")
    one = keyed.groupBy("gap_key", "sample").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    rank = F.row_number().over(W.partitionBy("gap_key").orderBy("at", "sample"))
    firsts = one.withColumn("r", rank)
    samples = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= SAMPLES, F.struct("r", "sample")))), lambda x: x["sample"])
    counted = firsts.groupBy("gap_key").agg(F.sum("n").alias("n_queries"), samples.alias("samples"))
    people = keyed.groupBy("gap_key").agg(F.countDistinct("who").alias("n_requesters"))
    out = counted.join(people, "gap_key")
    return out.orderBy(F.desc("n_queries"), "gap_key").limit(top) if top else out


def latest(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The last value of each key that is not null."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def series(metrics: DataFrame) -> DataFrame:
    """(metric_key, points): each metric's (day, value) in order."""
    return metrics.where("value_numeric is not null").groupBy("metric_key").agg(F.array_sort(F.collect_list(F.struct("day", "value_numeric"))).alias("points"))


def export_rows(metrics: DataFrame) -> DataFrame:
    """Rows of the CSV export: null is empty."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return metrics.select(F.date_format("day", "yyyy-MM-dd").alias("date"), "metric_key", blank("dimensions").alias("dimensions_json"), blank("value_numeric").alias("value_numeric"), blank("value_json").alias("value_json"))


def stage_totals(timings: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, n_stages, total_ms, slowest) of stage timings (key, stage, duration_ms)."""
    by = timings.groupBy(key, "stage").agg(F.sum("duration_ms").alias("ms"))
    return by.groupBy(key).agg(F.count("*").alias("n_stages"), F.sum("ms").alias("total_ms"), F.max_by("stage", F.struct("ms", "stage")).alias("slowest"))


def per_source(pages: DataFrame, images: DataFrame, sources: str = "source_ids", key: str = "source_id") -> DataFrame:
    """(key, n_pages, n_images): pages that name a source among theirs, and images of it; either may be absent."""
    named = pages.select(F.explode(F.array_distinct(sources)).alias(key)).groupBy(key).agg(F.count("*").alias("n_pages"))
    shown = images.groupBy(key).agg(F.count("*").alias("n_images"))
    return named.join(shown, key, "full_outer").select(key, F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_images", F.lit(0)).alias("n_images"))


#: Replies that tell of no result, forms in which a reply tells how many there are, and tools that read one thing.
NO_RESULT = ["no wiki pages found", "no sources found", "no results", "no pages found", "no drafts pending"]
COUNTED = [r"(\d+)\s+result\(s\)", r"(\d+)\s+pages?\s+found", r"(\d+)\s+sources?\s+found", r"(\d+)\s+drafts?\s+pending", r"\b(\d+)\s+matches?\b"]
ONE_RESULT = ["read_wiki_page", "get_source"]


def result_count(reply: Column, tool: Column, status: Column) -> Column:
    """How many results a logged reply tells of: none by a hint, else the first count in it, else one for reading tools that went well."""
    told = F.coalesce(*(F.nullif(F.regexp_extract(reply, p, 1), F.lit("")) for p in COUNTED)).try_cast("int")
    none = F.lit(False)
    for hint in NO_RESULT:
        none = none | F.contains(F.lower(reply), F.lit(hint))
    return F.when(reply.isNull(), None).when(none, 0).otherwise(F.coalesce(told, F.when(tool.isin(*ONE_RESULT) & (status == "ok"), 1)))


#: Log of the number of registers of a sketch.
SKETCH = 14


def daily_users(log: DataFrame) -> DataFrame:
    """(day, part, bits, sketch): who was there on each day, as bitmaps of 32,768 ids each and as a mergeable sketch of each part.

    The rows of a day are all that longer spans need, so the log is read once, and a late day replaces its own rows alone.
    """
    # Spark's bitmaps count from 1.
    at = F.col("user_id").cast("long") + 1
    seen = log.where("user_id is not null").select(day_of(F.col("ts")).alias("day"), F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit"), F.col("user_id").cast("long").alias("u"))
    return seen.groupBy("day", "part").agg(F.bitmap_construct_agg("bit").alias("bits"), F.hll_sketch_agg("u", F.lit(SKETCH)).alias("sketch"))


def users_of_days(daily: DataFrame, days: int = WEEK) -> DataFrame:
    """(day, users, estimate) of the ``days`` up to each day that has rows: exactly by bitmaps, and by sketches alone."""
    reach = daily.select("part", "bits", "sketch", F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day"))
    merged = reach.join(daily.select("day").distinct(), "day", "left_semi").groupBy("day", "part").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.groupBy("day").agg(F.sum("n").alias("users"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def replace_days(daily: DataFrame, late: DataFrame) -> DataFrame:
    """``daily`` with the days of ``late`` (rows of ``daily_users``) in place of its own."""
    return daily.join(late.select("day").distinct(), "day", "left_anti").unionByName(late)
