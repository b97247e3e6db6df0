"""Streaming twins of the time rules. Event time is `ts` TIMESTAMP; every rule has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from cuemill.sources.files import finished_versions, remove
from cuemill.sources.item_store import read_items, write_batch


def stream_items(raw: DataFrame, to_items: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, now: Column | None = None, **how):
    """Upsert each batch's items into the table of `target`, which read_items() reads: see write_batch() for how it is kept and
    for further arguments. now is the time that rows are stamped with, in seconds."""
    now = F.unix_seconds(F.current_timestamp()) if now is None else now

    def write(batch: DataFrame, number: int) -> None:
        write_batch(to_items(batch).withColumn("__order", F.struct("publish_s", "title")), target, number, now, "__order", **how)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/v={max(finished_versions(spark, target))}")


def stream_dedupe(events: DataFrame, key: str, watermark: str = "2 days") -> DataFrame:
    """No two rows of a key closer than the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, watermark: str = "1 day", zone_hours: int = 8) -> DataFrame:
    """Events by local day; rows later than the watermark are left out."""
    local = events.withWatermark("ts", watermark)
    return local.groupBy(F.window("ts", "1 day", startTime=f"{(24 - zone_hours) % 24} hours").alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("day_start"), "n"
    )


def activity_sessions(events: DataFrame, key: str, gap: str = "3 seconds", watermark: str = "1 minute") -> DataFrame:
    s = events.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", gap).alias("s"))
    return s.agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def freshness_alerts(events: DataFrame, hours: float = 48) -> DataFrame:
    """(key, ts_s, stale_s): sources without a row for `hours` after the one at ts_s, by the watermark. events(key STRING, ts_s
    BIGINT, ts) has a watermark on ts."""
    return events.groupBy("key").transformWithStateInPandas(Stale(int(hours * 3600)), "key string, ts_s bigint, stale_s bigint", "Append", "EventTime")


def link_expiry_stream(events: DataFrame, ahead_s: int = 600) -> DataFrame:
    """Signed links with the time to refresh them: `ahead_s` before they expire."""
    from cuemill.functions.timecode import link_expiry

    e = link_expiry(F.col("url"))
    return events.where(e > 0).select("*", F.timestamp_seconds(e - ahead_s).alias("refresh_at"))


OUT = StructType([StructField("key", LongType()), StructField("ts_s", LongType())])


class AcceptSpaced(StatefulProcessor):
    """Of each key, rows at least `seconds` after the last accepted one, whole. State: that row's time, until the watermark is
    so far beyond it that no row could be refused."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("s", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("ts_s", kind="stable")
        before = last = self.last.get()[0] if self.last.exists() else None
        taken = []
        for i, t in enumerate(part["ts_s"].tolist()):
            if last is None or t - last >= self.seconds:
                taken.append(i)
                last = t
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer((before + self.seconds) * 1000)
            self.handle.registerTimer((last + self.seconds) * 1000)
            self.last.update((last,))
        if taken:
            yield part.iloc[taken]

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class RetryMachine(StatefulProcessor):
    """Failures (key, ts_s) to retries: one a failure, `back_off_s` after it; at the third the key is rejected, marked
    by a time of -1. State: failures so far, forgotten `forget_s` after the last one by the watermark."""

    def __init__(self, most: int = 3, back_off_s: int = 1800, forget_s: int = 30 * 86400) -> None:
        self.most, self.back_off_s, self.forget_s = most, back_off_s, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", StructType([StructField("n", LongType()), StructField("last", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, last = self.count.get() if self.count.exists() else (0, None)
        if last is not None:
            self.handle.deleteTimer((last + self.forget_s) * 1000)
        out = []
        for t in sorted(int(t) for part in rows for t in part["ts_s"]):
            n += 1
            last = t if last is None else max(t, last)
            if n < self.most:
                out.append(t + self.back_off_s)
            elif n == self.most:
                out.append(-1)
        self.handle.registerTimer((last + self.forget_s) * 1000)
        self.count.update((n, last))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "ts_s": out})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


class Stale(StatefulProcessor):
    """Keys whose last row lies `seconds` behind the watermark come out once with that row's time. State: that time."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("s", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(t) for part in rows for t in part["ts_s"])
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer((before + self.seconds) * 1000)
            self.handle.registerTimer((newest + self.seconds) * 1000)
            self.last.update((newest,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "ts_s": [last], "stale_s": [last + self.seconds]})

    def close(self) -> None:
        pass


class Timeout(StatefulProcessor):
    """Dispatches (kind 0) and publications (kind 1) of a key: a dispatch that is not published `seconds` later, in event
    time, comes out with the time it failed."""

    def __init__(self, seconds: int = 43200) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]
        done = any((p["kind"] == 1).any() for p in parts)
        starts = [int(t) for p in parts for t in p.loc[p["kind"] == 0, "ts_s"]]
        if self.due.exists() and done:
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        elif starts and not done and not self.due.exists():
            due = (min(starts) + self.seconds) * 1000
            self.handle.registerTimer(due)
            self.due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        yield pd.DataFrame({"key": [key[0]], "ts_s": [at // 1000]})

    def close(self) -> None:
        pass


def min_interval(events: DataFrame, seconds: int) -> DataFrame:
    """Accepted rows of events(key, ts_s BIGINT, ts, ...), which has a watermark on ts; all columns."""
    return events.groupBy("key").transformWithStateInPandas(AcceptSpaced(seconds), events.schema, "Append", "EventTime")


def same_video_cooldown(events: DataFrame, seconds: int = 48 * 3600) -> DataFrame:
    return min_interval(events, seconds)


def retry_machine(failures: DataFrame, most: int = 3, back_off_s: int = 1800, forget_s: int = 30 * 86400) -> DataFrame:
    """failures(key BIGINT, ts_s BIGINT, ts), with a watermark on ts."""
    return failures.groupBy("key").transformWithStateInPandas(RetryMachine(most, back_off_s, forget_s), OUT, "Append", "EventTime")


def publish_timeout(events: DataFrame, seconds: int = 43200) -> DataFrame:
    """events(key, kind, ts_s, ts) with a watermark on ts."""
    return events.groupBy("key").transformWithStateInPandas(Timeout(seconds), OUT, "Append", "EventTime")


def log_sink(events: DataFrame, target: str, checkpoint: str, keep: int = 200):
    """The last `keep` events after each batch, in folders v=<batch>; the newest is the log, and the one before it is kept."""
    from cuemill.operators.feeds import append_log

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = sorted(v for v in finished_versions(spark, target) if v < number)
        old = spark.read.parquet(f"{target}/v={before[-1]}") if before else batch.limit(0)
        append_log(old, batch, keep).write.mode("overwrite").parquet(f"{target}/v={number}")
        remove(spark, [f"{target}/v={v}" for v in before[:-1]])

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
