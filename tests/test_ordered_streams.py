"""Machines with deadlines: streams against their batch twins, and both against plain expectations."""

import random

import pytest
from cuemill.streaming import ordered
from pyspark.sql import functions as F


def stream(spark, folder, parts, schema):
    """One file, and so one batch, for each part, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/f{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")
    return source.withColumn("ts", F.timestamp_seconds("ts_s"))


#: Times begin after 1970, where the first watermark stands.
ERA = 1_700_000_000


def later(rows, place=1):
    return [(*r[:place], r[place] + ERA, *r[place + 1 :]) for r in rows]


def run(df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / ("c" + name))).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, df.sparkSession.table(name).collect()))


def shuffled_parts(rows, delay, n, rng):
    """rows (key, ts_s, ...) in n parts; a row is at most `delay` behind what came before it."""
    rows = sorted(rows, key=lambda r: r[1] + rng.randrange(delay))
    return [p for p in (rows[len(rows) * k // n : len(rows) * (k + 1) // n] for k in range(n)) if p]


def test_retriggers_and_failures(spark, tmp_path):
    machine = ordered.Retriggers(rest_s=100, most=2, fail_s=250)
    #       retried twice and failed; published in time; at the very second of a re-trigger; after one; again after failing
    rows = [(1, 0, 0), (2, 0, 0), (2, 50, 1), (3, 0, 0), (3, 101, 1), (4, 0, 0), (4, 150, 1), (5, 0, 0), (5, 40, 0), (5, 1000, 0), (5, 1101, 0), (5, 1110, 1), (6, 7, 1)]
    want = [(1, 101, "retry"), (1, 202, "retry"), (1, 251, "failed"), (4, 101, "retry"), (5, 101, "retry"), (5, 202, "retry"), (5, 251, "failed"), (5, 1101, "retry")]
    rows, want = later(rows), later(want)
    schema = "key bigint, ts_s bigint, kind int"
    assert sorted(map(tuple, ordered.replayed(machine, spark.createDataFrame(rows, schema)).collect())) == want
    assert [tuple(r) for r in ordered.replayed(machine, spark.createDataFrame(rows, schema).where("key = 1"), ERA + 201).collect()] == later([(1, 101, "retry")])
    rng = random.Random(1)
    parts = [*shuffled_parts(rows, 30, 3, rng), later([(9, 5000, 1)]), later([(9, 5001, 1)])]
    got = run(ordered.streamed(machine, stream(spark, tmp_path / "e", parts, schema).withWatermark("ts", "40 seconds")), "retriggers", tmp_path)
    assert got == want


def test_status_over_time_is_the_batch_operator(spark):
    """Steps as the status of open dispatches gives them, asked every second."""
    from cuemill.operators.feeds import pending_status

    hours = 3600
    want, last, times = [], None, 0
    for now in (6 * hours, 6 * hours + 1, 6 * hours + 2, 12 * hours, 12 * hours + 1):
        row = spark.createDataFrame([("s", 0, times, last, False)], "slug string, ts bigint, retries int, last_retry bigint, uploading boolean")
        step = pending_status(row, row.limit(0), row.limit(0), now).first()["step"]
        if step == "retry":
            times, last = times + 1, now
        if step in ("retry", "failed"):
            want.append(("s", now, step))
    got = ordered.replayed(ordered.Retriggers(), spark.createDataFrame([("s", 0, 0)], "key string, ts_s bigint, kind int"))
    assert [tuple(r) for r in got.collect()] == want == [("s", 6 * hours + 1, "retry"), ("s", 12 * hours + 1, "failed")]


def test_links_are_refreshed_once(spark, tmp_path):
    machine = ordered.LinkRefresh(ahead_s=100)
    schema = "key string, ts_s bigint, url string, expires_s bigint"
    rows = [
        ("a", 0, "a1", 1000), ("b", 0, "b1", 1000), ("b", 500, "b2", 1500), ("c", 0, "c1", 1000), ("c", 901, "c2", 1901), ("d", 10, "d1", 20), ("e", 0, "e1", 1000), ("e", 900, "e2", 0),
        ("f", 0, "f1", 0),
    ]
    want = later([("a", 900, "a1"), ("b", 1400, "b2"), ("c", 900, "c1"), ("c", 1801, "c2"), ("d", 10, "d1")])
    rows = [(k, t + ERA, url, e + ERA if e else 0) for k, t, url, e in rows]
    assert sorted(map(tuple, ordered.replayed(machine, spark.createDataFrame(rows, schema)).collect())) == want
    parts = [*shuffled_parts(rows, 30, 3, random.Random(2)), later([("z", 5000, "z", 0)]), later([("z", 5001, "z", 0)])]
    assert run(ordered.streamed(machine, stream(spark, tmp_path / "e", parts, schema).withWatermark("ts", "40 seconds")), "refreshed", tmp_path) == want


def test_random_streams_equal_their_twins(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted({(k, rng.randrange(4000)): rng.choice([0, 0, 1]) for k in range(8) for _ in range(12)}.items())
    rows = [(k, t + ERA, kind) for (k, t), kind in rows]
    machine = ordered.Retriggers(rest_s=90, most=3, fail_s=400)
    schema = "key bigint, ts_s bigint, kind int"
    parts = [*shuffled_parts(rows, 200, 5, rng), later([(99, 20_000, 1)]), later([(99, 20_001, 1)])]
    got = run(ordered.streamed(machine, stream(spark, tmp_path / "e", parts, schema).withWatermark("ts", "300 seconds")), "randomly", tmp_path)
    twin = sorted(map(tuple, ordered.replayed(machine, spark.createDataFrame(rows, schema)).collect()))
    assert got == twin and len(got) > 30


def test_silence_by_heartbeats(spark, tmp_path):
    published = [0, 50, 90, 150, 260, 1000, 1080]
    beats = list(range(0, 2001, 40))
    schema = "ts_s bigint, kind int"
    rows = later(sorted([(t, 0) for t in published] + [(t, 1) for t in beats]), 0)
    parts = [rows[k : k + 20] for k in range(0, len(rows), 20)] + [later([(2040, 1)], 0)]
    events = stream(spark, tmp_path / "e", parts, schema)
    got = run(ordered.silence(events.where("kind = 0"), events.where("kind = 1"), 100, "1 second"), "silent", tmp_path)
    # Gaps of over 100 seconds, at the first second beyond; one of exactly 100 is none.
    assert got == [("all", ERA + at, ERA + since) for at, since in ((251, 150), (361, 260), (1181, 1080))]


@pytest.mark.parametrize("zone", [0, 8])
def test_days_and_late_rows(spark, tmp_path, zone):
    day = 86400
    first = ERA // day * day - zone * 3600  # a local midnight
    at = lambda d, s: (first + d * day + s, 0)
    parts = [
        [at(0, 5), at(0, 6), at(1, 7)],
        [at(0, 8), at(2, 9)],  # day 0 is open still: the watermark is an hour behind the batch before
        [at(2, 10), at(0, 11), at(1, 12), at(0, 13)],  # day 0 is over, day 1 for an hour not yet
        [at(5, 1)],
        [at(2, 2), at(5, 3), at(9, 0)],
        [at(9, 1)],
    ]
    got = run(ordered.daily_counts_with_late(stream(spark, tmp_path / "e", parts, "ts_s bigint, kind int"), "1 hour", zone), f"late{zone}", tmp_path)
    days = {}
    for d, n, late in got:
        days.setdefault(late, {}).setdefault((d - first) // day, 0)
        days[late][(d - first) // day] += n
    assert days[False] == {0: 3, 1: 2, 2: 2, 5: 2} and days[True] == {0: 2, 2: 1}
    assert sum(n for _, n, _ in got) == sum(map(len, parts)) - 2  # day 9 is open
