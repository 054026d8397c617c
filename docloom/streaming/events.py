"""Structured Streaming over an event log with event time; the same functions run on tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.status import branch_status
from docloom.operators.versions import overwrite_days
from docloom.session import shared_dir

DELAY = "1 day"


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files with ts as a timestamp, as watermarks need it."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, by: str = "event_type", delay: str = DELAY) -> DataFrame:
    """(day, by, n, total, users): tumbling days; users are an estimate, for a stream keeps no exact distinct counts."""
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), F.col(by))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.approx_count_distinct("user_id").alias("users"))
        .select(F.to_date("w.start").alias("day"), by, "n", "total", "users")
    )


def weekly_users(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """(day, users): rolling weeks that end with each day."""
    w = F.window("ts", "7 days", "1 day")
    return events.withWatermark("ts", delay).groupBy(w.alias("w")).agg(F.approx_count_distinct("user_id", 0.01).alias("users")).select(F.date_sub(F.to_date("w.end"), 1).alias("day"), "users")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """(user_id, start, end, n): a user's events without a longer break."""
    s = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", delay: str = DELAY) -> DataFrame:
    """Each event once, however often it is delivered within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def debounced(events: DataFrame, seconds: int = 60, delay: str = DELAY) -> DataFrame:
    """(user_id, ts): the first event of a user, then the first of each that comes a minute or more after the last one kept.

    State is one time for each user, until the watermark is past the break that it stands for; within a batch a user's events are taken in order.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for ts in sorted(t for pdf in frames for t in pdf["ts"]):
                micros = int(ts.value // 1000)
                if last is None or micros - last >= seconds * 1_000_000:
                    out.append(ts)
                    last = micros
            if last is not None:
                state.update((last,))
                state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "ts": out})

    return events.select("user_id", "ts").withWatermark("ts", delay).groupBy("user_id").applyInPandasWithState(keep, "user_id long, ts timestamp", "last long", "append", "EventTimeTimeout")


def drained(stream: DataFrame, mode: str, what: str = "stream") -> DataFrame:
    """What a stream of what is there now comes to, as a table in the shared folder: in append mode all its rows, else those of its last batch."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stuck(events: DataFrame, minutes: int = 30, delay: str = DELAY) -> DataFrame:
    """(source_id, state, since): sources (source_id, state, ts) that stay in a running state for longer than allowed, by event time."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            name, since = state.get
            state.remove()
            yield pd.DataFrame({"source_id": [key[0]], "state": [name], "since": [pd.Timestamp(since, unit="us", tz="UTC").tz_localize(None)]})
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        name, at = rows["state"].iloc[-1], int(rows["ts"].iloc[-1].value // 1000)
        if name in ("ready", "error", "skipped"):
            if state.exists:
                state.remove()
        else:
            state.update((name, at))
            state.setTimeoutTimestamp(max(at // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"source_id": [], "state": [], "since": []})

    return events.withWatermark("ts", delay).groupBy("source_id").applyInPandasWithState(watch, "source_id long, state string, since timestamp", "state string, since long", "append", "EventTimeTimeout")


def latest_attempts(batch: DataFrame, key: str = "source_id", attempt: str = "attempt") -> DataFrame:
    """Rows of each key's newest attempt; older ones are stale."""
    newest = batch.groupBy(key).agg(F.max(attempt).alias(attempt))
    return batch.join(newest, [key, attempt], "left_semi")


def write_days(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Start a query that keeps a table by day up to date: late data overwrite their own keys."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: overwrite_days(path, df, keys) if not df.isEmpty() else None).start()


def expired(events: DataFrame, state: str = "awaiting_approval", hours: int = 72, delay: str = DELAY) -> DataFrame:
    """(source_id, state, since): sources that wait in a state for longer than allowed, to be deleted with what belongs to them."""
    waits = events.withColumn("state", F.when(F.col("state") == state, F.col("state")).otherwise("ready"))
    return stuck(waits, hours * 60, delay)


def branch_statuses(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """(source_id, chunks, pages, verbatim, status): one status from the newest events (source_id, branch, status, ts, verbatim) of both branches.

    An aggregate by source, in update mode: each event replaces an older one of its branch only, so no lock is needed and late
    events change nothing.
    """
    last = lambda branch: F.max(F.when(F.col("branch") == branch, F.struct("ts", "status")))["status"].alias(f"{branch}s")
    seen = events.withWatermark("ts", delay) if events.isStreaming else events
    both = seen.groupBy("source_id").agg(last("chunk"), last("page"), F.bool_or("verbatim").alias("verbatim"))
    return both.select("source_id", "chunks", "pages", "verbatim", branch_status(F.col("verbatim"), F.col("chunks"), F.col("pages")).alias("status"))
