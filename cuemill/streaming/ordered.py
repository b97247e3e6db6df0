"""Rules with deadlines, as one small machine each that a stream and its batch twin both run, in the order of event time.

A machine has a state of a few values. A row changes it, and so does the passing of its next deadline; where a row and a deadline
fall on one second, the row comes first. Machines are told apart by key."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cuemill.operators.folds import fold_sorted


class Retriggers:
    """Rows (kind): 0 a dispatch, 1 its publication. A dispatch that rests for more than `rest_s` since it, or since its last
    re-trigger, is triggered again, `most` times at most; after more than `fail_s` it has failed. Publication ends it, and a
    dispatch of a key that is open changes nothing."""

    fields, out = ("kind",), "ts_s bigint, step string"

    def __init__(self, rest_s: int = 6 * 3600, most: int = 2, fail_s: int = 12 * 3600) -> None:
        self.rest_s, self.most, self.fail_s = rest_s, most, fail_s

    def due(self, state: list) -> int:
        since, times, last = state
        fails = since + self.fail_s + 1
        return min(fails, last + self.rest_s + 1) if times < self.most else fails

    def on_row(self, state: list | None, t: int, row: tuple) -> list | None:
        return None if row[0] == 1 else state or [t, 0, t]

    def on_due(self, state: list, t: int) -> tuple[list | None, tuple]:
        if t == state[0] + self.fail_s + 1:
            return None, (t, "failed")
        return [state[0], state[1] + 1, t], (t, "retry")


class LinkRefresh:
    """Rows (url, expires_s): the newest link of a key is to be fetched anew `ahead_s` before it expires, or at once if that is
    past; one that is replaced before is not, nor one that does not expire."""

    fields, out = ("url", "expires_s"), "ts_s bigint, url string"

    def __init__(self, ahead_s: int = 600) -> None:
        self.ahead_s = ahead_s

    def due(self, state: list) -> int:
        return state[1]

    def on_row(self, state: list | None, t: int, row: tuple) -> list | None:
        url, expires = row
        return [url, max(t, expires - self.ahead_s)] if expires else None

    def on_due(self, state: list, t: int) -> tuple[None, tuple]:
        return None, (t, state[0])


class Silence:
    """Rows (kind): 0 a publication, others a heartbeat, which only moves time on. Nothing published for more than `rest_s` comes out
    once, as of the second it becomes so, with the time of the last publication."""

    fields, out = ("kind",), "ts_s bigint, since_s bigint"

    def __init__(self, rest_s: int = 6 * 3600) -> None:
        self.rest_s = rest_s

    def due(self, state: int) -> int:
        return state + self.rest_s + 1

    def on_row(self, state: int | None, t: int, row: tuple) -> int | None:
        return t if row[0] == 0 else state

    def on_due(self, state: int, t: int) -> tuple[None, tuple]:
        return None, (t, state)


def advance(machine, state, rows: Iterable[tuple], upto: int | None = None) -> Iterator[tuple]:
    """What comes out of rows (t, row) in order, and of deadlines up to and at `upto` (all, if None), as (output, state after it);
    the last pair has no output and the final state."""

    def passed(before: int | None) -> Iterator[tuple]:
        nonlocal state
        while state is not None and (before is None or machine.due(state) < before):
            state, made = machine.on_due(state, machine.due(state))
            yield made, state

    for t, row in rows:
        yield from passed(t)
        state = machine.on_row(state, t, row)
    yield from passed(None if upto is None else upto + 1)
    yield None, state


def replayed(machine, rows: DataFrame, until_s: int | None = None) -> DataFrame:
    """(key, output) of rows(key, ts_s, fields): the batch twin, with all deadlines up to until_s. Rows of one second go in the
    order of their fields; rows without a time are left out."""

    def fold(own: Iterator[tuple]) -> Iterator[tuple]:
        timed = ((r[0], r[1:]) for r in own if until_s is None or r[0] <= until_s)
        return (made for made, _ in advance(machine, None, timed, until_s) if made is not None)

    some = rows.where("ts_s IS NOT NULL").select("key", F.col("ts_s").cast("bigint").alias("ts_s"), *machine.fields)
    return fold_sorted(some, ["key"], ["ts_s", *machine.fields], fold, machine.out)


class InOrder(StatefulProcessor):
    """Runs a machine over a stream. Rows wait in the state until the watermark has passed their time, so rows that come
    out of order, but not late, change nothing. State: the machine's, and the rows that wait. Timers: the time of each of these,
    and the next deadline."""

    def __init__(self, machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("json", StringType())]))
        self.waiting = handle.getListState("waiting", StructType([StructField("t", LongType()), StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for part in rows:
            fresh = [(int(r[0]), json.dumps([x.item() if hasattr(x, "item") else x for x in r[1:]])) for r in part[["ts_s", *self.machine.fields]].itertuples(index=False)]
            times.update(t for t, _ in fresh)
            if fresh:
                self.waiting.appendList(fresh)
        for t in times:
            self.handle.registerTimer(t * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() // 1000  # all of a key's timers up to here at once
        rows = [(t, json.loads(j)) for t, j in self.waiting.get()] if self.waiting.exists() else []
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        now = sorted((t, tuple(r)) for t, r in rows if t <= upto)
        made = []
        for out, state in advance(self.machine, state, now, upto):
            if out is not None:
                made.append((key[0], *out))
        if now:
            later = [(t, json.dumps(r)) for t, r in rows if t > upto]
            self.waiting.put(later) if later else self.waiting.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
            self.handle.registerTimer(self.machine.due(state) * 1000)
        if made:
            yield pd.DataFrame(made, columns=["key", *[f.split()[0] for f in self.machine.out.split(", ")]])

    def close(self) -> None:
        pass


def streamed(machine, events: DataFrame) -> DataFrame:
    """(key, output) of events(key, ts_s BIGINT, fields, ts), which have a watermark on ts."""
    kind = events.schema["key"].dataType.simpleString()
    some = events.select("key", "ts_s", *machine.fields, "ts")
    return some.groupBy("key").transformWithStateInPandas(InOrder(machine), f"key {kind}, {machine.out}", "Append", "EventTime")


def silence(published: DataFrame, heartbeats: DataFrame, rest_s: int = 6 * 3600, watermark: str = "1 minute") -> DataFrame:
    """(key, ts_s, since_s): alerts that nothing was published(ts) by any source for more than rest_s. heartbeats(ts) come even
    then, and move the watermark, which is one for both. Of many publications, each batch of a task sends the first and last of
    a stretch of time alone, between which no silence can be."""
    stretch = max(1, rest_s // 2)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch.groupby([batch["kind"], batch["ts_s"] // stretch if len(batch) else batch["ts_s"]])["ts_s"].agg(["min", "max"])
            rows = [(kind, int(t)) for (kind, _), lo, hi in zip(at.index, at["min"], at["max"], strict=True) for t in {lo, hi}]
            yield pd.DataFrame(rows, columns=["kind", "ts_s"])

    tagged = [s.select(F.lit(k).alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s")) for k, s in ((0, published), (1, heartbeats))]
    few = tagged[0].unionByName(tagged[1]).mapInPandas(ends, "kind int, ts_s bigint")
    one = few.select(F.lit("all").alias("key"), "ts_s", "kind", F.timestamp_seconds("ts_s").alias("ts")).withWatermark("ts", watermark)
    return streamed(Silence(rest_s), one)


class CountDays(StatefulProcessor):
    """Rows of a day, counted until the watermark has passed its end; then the count comes out. What comes for a day that is
    over is counted apart, batch by batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, end = sum(int(part["n"].sum()) for part in rows), (int(key[0]) + 86400) * 1000
        if end <= timerValues.getCurrentWatermarkInMs():
            yield pd.DataFrame({"day_s": [key[0]], "n": [n], "late": [True]})
            return
        before = self.count.get()[0] if self.count.exists() else 0
        if not before:
            self.handle.registerTimer(end)
        self.count.update((before + n,))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.count.exists():
            n = self.count.get()[0]
            self.count.clear()
            yield pd.DataFrame({"day_s": [key[0]], "n": [n], "late": [False]})

    def close(self) -> None:
        pass


def daily_counts_with_late(events: DataFrame, watermark: str = "1 day", zone_hours: int = 8) -> DataFrame:
    """(day_s, n, late): events(ts) by local day, which begins at day_s, once the watermark has passed its end; rows that come
    after that are not lost but counted with late = true, by batch. Rows are counted by day within each task first, so a day is
    no hot key."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch.groupby("day_s").size()
            yield pd.DataFrame({"day_s": n.index, "n": n.to_numpy()})

    shift = zone_hours * 3600
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    days = events.withWatermark("ts", watermark).select((F.floor((seconds + shift) / 86400) * 86400 - shift).cast("bigint").alias("day_s"))
    # The day is no event time column, so late rows are not dropped on the way.
    return days.mapInPandas(counted, "day_s bigint, n bigint").groupBy("day_s").transformWithStateInPandas(CountDays(), "day_s bigint, n bigint, late boolean", "Append", "EventTime")
