"""Attempts at tasks over many batches: fencing of stale ones, retries with growing waits, dead letters, and attempts that never end.

State lives in the stream: for each task its newest attempt, how many have failed, and whether the newest is over.  What an older
attempt says is stale, whenever it comes, and so is a second outcome of one attempt; a query that starts again from its checkpoint
goes on with the same state.  An attempt that says nothing more for too long, by event time, has failed.  The stream's rows
are what is to be done; ``route`` sends dead letters to a table of their own.

Edge cases: rows with a null task, attempt or time are left out; an outcome without a start begins its attempt; events of one batch
count in order of time, then attempt, then with starts first; unknown outcomes count as signs of life.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.streaming.events import DELAY

#: Failures after which a task is dead, minutes without a sign after which an attempt has failed, and seconds of the first wait.
MOST, MINUTES, WAIT = 3, 120, 60
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KIND = "task long, kind string, attempt int, failures int, reason string, at timestamp, due timestamp"


def with_timers(spark: SparkSession) -> SparkSession:
    """Streams with timers need this kind of state store; a query's own is fixed by its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Attempts(StatefulProcessor):
    def __init__(self, most: int = MOST, minutes: int = MINUTES, wait: int = WAIT):
        self.most, self.silence, self.wait = most, minutes * 60_000, wait * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "attempt int, failures int, seen long, over boolean")

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            df = pd.DataFrame(out, columns=["task", "kind", "attempt", "failures", "reason", "at", "due"])
            yield df.assign(at=pd.to_datetime(df["at"], unit="ms"), due=pd.to_datetime(df["due"], unit="ms"))

    def _failed(self, key, attempt: int, failures: int, reason: str, at: int) -> tuple:
        dead = failures >= self.most
        return key, "dead" if dead else "retry", attempt, failures, reason, at, None if dead else at + self.wait * 2 ** (failures - 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        task = key[0]
        attempt, failures, seen, over = self.task.get() if self.task.exists() else (-1, 0, 0, True)
        came = pd.concat(list(rows))
        came["late"] = came["outcome"] != "started"
        out = []
        for r in came.sort_values(["ts", "attempt", "late"], kind="stable").itertuples():
            at, own = int(r.ts.value // 1_000_000), int(r.attempt)
            if own > attempt:
                attempt, over = own, False
            elif own < attempt or over:
                out.append((task, "stale", own, failures, r.outcome, at, None))
                continue
            seen = max(seen, at)
            if r.outcome in ("done", "failed"):
                over = True
                failures += r.outcome == "failed"
                out.append((task, "done", attempt, failures, "done", at, None) if r.outcome == "done" else self._failed(task, attempt, failures, "failed", at))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(int(timer))
        if not over:
            self.handle.registerTimer(max(seen + self.silence, timerValues.getCurrentWatermarkInMs() + 1))
        self.task.update((attempt, int(failures), seen, over))
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, failures, seen, over = self.task.get()
        if not over:
            self.task.update((attempt, failures + 1, seen, True))
            yield from self._rows([self._failed(key[0], attempt, failures + 1, "silence", seen + self.silence)])

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, most: int = MOST, minutes: int = MINUTES, wait: int = WAIT, delay: str = DELAY) -> DataFrame:
    """(task, kind, attempt, failures, reason, at, due) for a stream of (task, attempt, outcome, ts): done, retry with when it is due, dead, stale."""
    known = events.select(F.col("task").cast("long").alias("task"), F.col("attempt").cast("int").alias("attempt"), "outcome", "ts").where("task is not null and attempt is not null and ts is not null")
    return known.withWatermark("ts", delay).groupBy("task").transformWithStateInPandas(Attempts(most, minutes, wait), T.StructType.fromDDL(KIND), "Append", "EventTime")


def route(stream: DataFrame, path: str, checkpoint: str):
    """Start the stream into tables for ``work`` (done and retry), ``dead`` and ``stale`` below ``path``.

    A batch that is run again after a failure overwrites its own rows, so each counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, kinds in (("work", ["done", "retry"]), ("dead", ["dead"]), ("stale", ["stale"])):
            batch.where(F.col("kind").isin(kinds)).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
