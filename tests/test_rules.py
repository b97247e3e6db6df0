"""Folds and errors that SQL does not show: plain loops over small tables, and literal cases."""

import random
import re

import pytest
from cuemill.operators import feeds as P
from cuemill.operators import release as R
from cuemill.operators import transcript as W
from pyspark.sql import functions as F

MARKS = "。，！？、；,.!?;"


def plain_cues(tokens, least, most, terms):
    """tokens in order to [(start, end, text)]."""
    out, open_ = [], []
    for tok, start, end in tokens:
        open_.append((tok, start, end))
        text = "".join(t for t, *_ in open_)
        if (tok[-1:] in MARKS and tok and len(text) >= least) or len(text) >= most:
            out.append(open_)
            open_ = []
    cues = []
    for part in [*out, open_] if open_ else out:
        text = re.sub("^[ 。，！？、；,.!?;]+", "", "".join(t for t, *_ in part))
        for a, b in terms:
            text = text.replace(a, b)
        if text and not all(ch in W.FILLERS for ch in text):
            cues.append((part[0][1], part[-1][2], text))
    return cues


def test_tokens_to_cues(spark):
    rng = random.Random(4)
    words = ["啊", "嗯", "呢", "投资", "很", "重要", "，", "。", "abc", "", "一家好公司", "!", "安牛"]
    rows, want = [], []
    for video in range(30):
        tokens = [(rng.choice(words), 10 * i, 10 * i + 7) for i in range(rng.choice([0, 1, 3, 50]))]
        rows += [(video, i, *t) for i, t in enumerate(tokens)]
        want += [(video, *c) for c in plain_cues(tokens, 6, 18, [("安牛", "安宫")])]
    tokens = spark.createDataFrame([(v, i, t, s, e) for v, i, t, s, e in rows], "video_id int, seq int, tok string, start_ms bigint, end_ms bigint")
    got = W.tokens_to_cues(tokens, terms=[("安牛", "安宫")]).select("video_id", "start_ms", "end_ms", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert "哈" in W.FILLERS and len(W.FILLERS) == 16


def test_spacing_of_long_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(400_000)) for _ in range(30_000)] + [("c", None), ("d", 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    got = sorted(((r["k"], r["t"]) for r in P.min_interval(spark.createDataFrame(rows, "k string, t bigint"), 900, "k", "t").collect()), key=str)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for key in ("a", "b", None, "d"):
        last = None
        for t in sorted({t for k, t in rows if k == key and t is not None}):
            if last is None or t - last >= 900:
                want.append((key, t))
                last = t
    assert got == sorted(want, key=str)


def test_spacing_without_a_time_between(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 5), ("c", None)], "k string, t bigint")
    for seconds in (0, -5):
        assert sorted(map(tuple, P.min_interval(rows, seconds, "k", "t").collect()), key=str) == sorted([("a", 1), ("a", 2), ("b", 1), (None, 5)], key=str)


def test_upsert_takes_all_fields(spark):
    items = spark.createDataFrame([("a", "s", "t", "u", 1, 1, 1), ("b", "s", "t", "u", 1, 1, 1)], "id string, source string, title string, url string, publish_s int, created_at int, updated_at int")
    batch = spark.createDataFrame([("a", "x", "t2", None, 5, 1), ("c", "x", "first", "u", 2, 2), ("c", "y", "last", "v", 3, 3)], "id string, source string, title string, url string, publish_s int, pos int")
    after, new = P.upsert_items(items, batch, F.lit(9))
    assert sorted(map(tuple, after.collect())) == [("a", "s", "t2", None, 5, 1, 9), ("b", "s", "t", "u", 1, 1, 1), ("c", "y", "last", "v", 3, 9, 9)]
    assert [tuple(r) for r in new.collect()] == [("c", "x", "first", "u", 2, 2)]
    assert P.upsert_items(items, batch.where("pos < 0"), F.lit(9))[0].count() == 2 and P.upsert_items(items.where("publish_s > 9"), batch, F.lit(9))[0].count() == 2


def test_index_of_batches(spark):
    index = spark.createDataFrame([("old", "ep01", "2024-01-01"), ("mid", "ep01", "2024-02-01"), ("none", "ep01", None)], "slug string, id string, batch_at string")
    queue = spark.createDataFrame([("new", None, "2024-03-01", "ep01", "t"), ("mid", "S", "2024-03-01", "ep01", "t")], "slug string, speaker string, generated_at string, id string, title string")
    merged = R.merge_index(index, queue)
    rows = {(r["slug"], r["id"]): r for r in merged.collect()}
    assert len(rows) == 4 and rows["mid", "ep01"]["batch_at"] == "2024-03-01" and rows["mid", "ep01"]["release_tag"] == "clips-mid"
    assert rows["new", "ep01"]["speaker"] == "" and rows["old", "ep01"]["title"] is None
    kept, dropped = R.prune_batches(merged, 3)
    assert {r["slug"] for r in kept.collect()} == {"new", "mid", "old"} and {r["slug"] for r in dropped.collect()} == {"none"}
    for bad, what in ((queue.withColumn("slug", F.lit("")), "no slug"), (queue.withColumn("generated_at", F.lit(None).cast("string")), "no generated_at")):
        with pytest.raises(Exception, match=what):
            R.merge_index(index, bad).collect()
    with pytest.raises(ValueError):
        R.prune_batches(index, 0)
    with pytest.raises(Exception, match="without|no slug"):
        R.prune_batches(index.withColumn("slug", F.lit(None).cast("string")), 1)[0].collect()


def test_overlaps_and_nearest_boundaries(spark):
    rng = random.Random(3)
    rows = [(v, i, s := rng.randrange(300), s + rng.randrange(1, 40)) for v in range(12) for i in range(rng.randrange(1, 14))]
    clips = spark.createDataFrame(rows, "video_id int, para_id int, start_ms bigint, end_ms bigint")
    got = {(r["video_id"], r["para_id"]): r["hit"] for r in W.overlaps_any(clips).collect()}
    assert got == {(v, i): any(w == v and j != i and f > s and t < e for w, j, t, f in rows) for v, i, s, e in rows}
    cues = spark.createDataFrame([(v, k, 50 * k + v, 50 * k + 50 + v, "x") for v in range(12) for k in range(rng.randrange(1, 5))], "video_id int, cue_index int, start_ms bigint, end_ms bigint, text string")
    bounds = {}
    for r in cues.collect():
        bounds.setdefault(r["video_id"], {0}).update((r["start_ms"],))
    total = {v: max(r["end_ms"] for r in cues.collect() if r["video_id"] == v) for v in bounds}
    near = lambda v, t: min(bounds[v] | {total[v]}, key=lambda b: (abs(b - t), b))
    want = {(v, i): (a := near(v, s), b if (b := near(v, e)) > a else min(total[v], a + 30)) for v, i, s, e in rows}
    assert {(r["video_id"], r["para_id"]): (r["start_ms"], r["end_ms"]) for r in W.snap_to_nearest(clips, cues, 30).collect()} == want


def plain_episodes(clips, episodes, segments, min_clip, min_total):
    """{para_id: group} of one video's clips (rank, para_id, start, end), or the reason that there are none."""
    good = sorted(c for c in clips if c[3] - c[2] >= min_clip)
    groups = []
    for g in range(episodes):
        own, taken = [], [x for part in groups for x in part]
        for c in good:
            apart = all(c[3] <= x[2] or c[2] >= x[3] for x in taken + own)
            if len(own) < segments and c not in taken and (g == 0 or apart):
                own.append(c)
        groups.append(own)
    for g, own in enumerate(groups, 1):
        if len(own) < segments:
            return f"insufficient_quotes:{g}"
        if sum(e - s for _, _, s, e in own) < min_total:
            return f"insufficient_duration:{g}"
    return {c[1]: g for g, own in enumerate(groups, 1) for c in own}


def test_episodes_of_random_clips(spark):
    rng = random.Random(8)
    videos = {v: [(rng.randrange(9), i, s := rng.randrange(400), s + rng.randrange(5, 60)) for i in range(rng.randrange(0, 25))] for v in range(60)}
    rows = [(v, i, r, s, e) for v, own in videos.items() for r, i, s, e in own]
    clips = spark.createDataFrame(rows, "video_id int, para_id int, rank int, start_ms bigint, end_ms bigint")
    kinds = set()
    for episodes, segments in ((1, 3), (3, 3), (2, 1)):
        got = {}
        for r in W.pack_episodes(clips, episodes, segments, 15, 90).collect():
            if r["reason"]:
                got[r["video_id"]] = r["reason"]
            else:
                got.setdefault(r["video_id"], {})[r["para_id"]] = r["episode"]
        want = {v: plain_episodes(own, episodes, segments, 15, 90) for v, own in videos.items() if any(e - s >= 15 for *_, s, e in own)}
        assert got == want
        kinds |= {x[:15] if isinstance(x, str) else "episodes" for x in want.values()}
    assert len(kinds) == 3
