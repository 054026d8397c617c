"""Attempts over batches and restarts."""

import datetime

import pytest

from docloom.streaming import attempts

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def timers(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield attempts.with_timers(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_fencing_retries_and_dead_letters_over_restarts(timers, tmp_path):
    spark, schema = timers, "task long, attempt int, outcome string, ts timestamp"

    def feed(*rows):
        """One more file, and the query started anew from its checkpoint."""
        spark.createDataFrame([(t, a, o, DAY + datetime.timedelta(minutes=m)) for t, a, o, m in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = attempts.outcomes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), minutes=60, wait=60, delay="10 minutes")
        attempts.route(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    def told(name):
        rows = spark.read.schema(attempts.KIND + ", batch int").parquet(f"{tmp_path}/out/{name}").collect()
        return sorted((r.task, r.kind, r.attempt, r.failures, r.reason, None if r.due is None else (r.due - r.at).total_seconds()) for r in rows)

    feed((1, 1, "started", 0), (1, 1, "failed", 1), (2, 1, "started", 0), (3, 1, "done", 2), (None, 1, "done", 1), (5, 2, "started", 3))
    assert told("work") == [(1, "retry", 1, 1, "failed", 60.0), (3, "done", 1, 0, "done", None)]
    feed((1, 2, "started", 3), (1, 1, "done", 4), (3, 1, "failed", 5), (5, 1, "done", 6))
    assert told("stale") == [(1, "stale", 1, 1, "done", None), (3, "stale", 1, 0, "failed", None), (5, "stale", 1, 0, "done", None)]
    feed((1, 2, "failed", 10), (5, 2, "working", 70), (1, 3, "started", 71))
    assert told("work")[1] == (1, "retry", 2, 2, "failed", 120.0) and told("dead") == []
    feed((1, 3, "failed", 80), (9, 1, "done", 100))
    assert told("dead") == [(1, "dead", 3, 3, "failed", None)]
    feed((9, 2, "done", 300))  # time goes on: 2 and 5 have been silent for an hour
    feed((9, 3, "done", 301), (2, 1, "done", 301), (2, 2, "done", 302))
    work = told("work")
    assert (2, "retry", 1, 1, "silence", 60.0) in work and (5, "retry", 2, 1, "silence", 60.0) in work and (2, "done", 2, 1, "done", None) in work
    assert (2, "stale", 1, 1, "done", None) in told("stale") and len(told("dead")) == 1
