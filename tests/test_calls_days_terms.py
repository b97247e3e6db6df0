"""Model calls with a cache, items by day, many terms, and joins of intervals."""

import math
import random

import pytest
from cuemill.operators import model_calls as M
from cuemill.operators import quality as Q
from cuemill.operators import transcript as W
from cuemill.sources import item_days
from pyspark.sql import functions as F


def echo(lines):
    return [None if "bad" in t else f"<{t}>" for t in lines]


@pytest.mark.parametrize("n", [1, 2, 16, 20, 64])
def test_one_bad_line_costs_few_calls(n):
    for bad in {0, n // 2, n - 1}:
        texts = [f"t{k}" if k != bad else "bad" for k in range(n)]
        got = list(M.ask(texts, echo))
        assert sorted(k for k, *_ in got) == list(range(n))
        assert all(reply == f"<{texts[k]}>" for k, reply, reason, _ in got if k != bad)
        assert [(reply, reason) for k, reply, reason, _ in got if k == bad] == [(None, "no reply")]
        assert sum(calls for *_, calls in got) <= 1 + 2 * math.ceil(math.log2(n)) if n > 1 else len(got) == 1
    assert sum(c for *_, c in M.ask([f"t{k}" for k in range(n)], echo)) == 1
    assert {r for _, _, r, _ in M.ask(["a", "b"], lambda t: ["x"] * 3)} == {"3 replies for 1 lines"}

    def down(lines):
        raise TimeoutError("slow")

    assert [(k, r) for k, _, r, _ in M.ask(["a", "b"], down)] == [(0, "TimeoutError: slow"), (1, "TimeoutError: slow")]


def test_a_second_run_makes_no_call(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [(f"k{k}", f"t{k}" if k % 20 else "bad one", k) for k in range(100)] + [("k1", "t1", 100), (None, "x", 101), ("blank", " ", 102), ("null", None, 103)]
    asked = spark.createDataFrame(rows, "key string, text string, n int")
    first = M.call_model(asked, cache, echo, 1)
    got = {r["n"]: r for r in first.rows.collect()}
    assert len(got) == len(rows) and first.calls >= 6
    assert all(got[k]["response"] == f"<t{k}>" and got[k]["outcome"] == "called" for k in range(100) if k % 20)
    assert got[100]["response"] == "<t1>" and {got[k]["outcome"] for k in (0, 20, 40, 60, 80, 101, 102, 103)} == {"rejected"}
    second = M.call_model(asked, cache, echo, 2)
    again = {r["n"]: r for r in second.rows.collect()}
    assert second.calls == 0 and again[1]["outcome"] == "hit" and again[0]["outcome"] == "known_bad" and again[101]["outcome"] == "rejected"
    assert {(r["key"], r["reason"], r["attempt"]) for r in M.rejected_rows(spark, cache).collect()} == {(f"k{k}", "no reply", 1) for k in range(0, 100, 20)}
    # Rejected ones may be tried again, by a model that knows them; new ones are called for alone.
    more = asked.unionByName(spark.createDataFrame([("new", "t", 104)], asked.schema))
    third = M.call_model(more, cache, lambda lines: [t.upper() for t in lines], 3, again=True)
    last = {r["n"]: r for r in third.rows.collect()}
    assert last[0]["response"] == "BAD ONE" and last[104]["response"] == "T" and last[1]["response"] == "<t1>" and last[1]["outcome"] == "hit"
    assert M.rejected_rows(spark, cache).count() == 0
    assert {p.name for p in (tmp_path / "cache" / "replies").glob("prefix=*")} <= {f"prefix={k:x}" for k in range(16)}


def filters(df):
    """What a scan prunes folders by."""
    return df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_days_are_folders_that_reads_prune(spark, tmp_path):
    target, day = str(tmp_path / "days"), 86400
    items = spark.range(4000).select(F.col("id").alias("n"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), (F.lit(1_700_000_000) + F.col("id") * 600).alias("publish_s"))
    item_days.write_days(items, target)
    as_of = 1_700_000_000 + 3999 * 600
    got = item_days.recent_items(spark, target, as_of, 2, ["s1", "s3"])
    want = items.where(f"publish_s > {as_of - 2 * day} AND source IN ('s1', 's3')")
    assert sorted(r["n"] for r in got.collect()) == sorted(r["n"] for r in want.collect())
    assert "day#" in filters(got) and "source#" in filters(got)
    some = item_days.read_days(spark, target, ["s1", "s3"], as_of - 2 * day).select(F.input_file_name().alias("f")).distinct().count()
    folders = len(list((tmp_path / "days").glob("source=*/day=*")))
    assert some <= 6 and folders > 100
    newest = item_days.newest_of_sources(spark, target)
    assert {r["source"]: r["updated_s"] for r in newest.collect()} == {f"s{k}": 1_700_000_000 + (3996 + k) * 600 for k in range(4)}
    assert "day#" in filters(newest)


def test_many_terms(spark):
    rng = random.Random(3)
    letters = "abcdeé好🙂 "
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(300)] + [None, ""]
    terms = ["".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(2000)] + ["", "a", "a"]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "k int, body string, terms string")
    for some in (terms, terms[:3], [""] * 20, []):
        got = {r["k"]: r["terms"] for r in Q.match_terms(df, some, "body").collect()}
        assert got == {k: [] if t is None else [x for x in some if x in t] for k, t in enumerate(texts)}


def test_intervals_meet_once(spark):
    rng = random.Random(4)
    span = lambda most: (s := rng.randrange(4_000_000), s + rng.choice([0, 1, 900, 50_000, most]))
    cues = [(v, k, *span(1_500_000), "t") for v in range(3) for k in range(150)] + [(0, 999, 500, 400, "back"), (1, 998, None, 5, "null"), (2, 997, 60_000, 120_000, "edge")]
    clips = [(v, k, *span(400_000)) for v in (0, 1, 5) for k in range(40)] + [(2, 1, 120_000, 180_000), (2, 2, 0, 60_000), (2, 3, 60_000, 60_001), (2, 4, 9, 3)]
    c = spark.createDataFrame(cues, "video_id int, cue_index int, start_ms bigint, end_ms bigint, text string")
    k = spark.createDataFrame(clips, "video_id int, para_id int, start_ms bigint, end_ms bigint")
    good = [x for x in cues if x[2] is not None]
    pairs = [(v, p, i) for v, i, s, e, _ in good for w, p, a, b in clips if v == w and e > a and s < b]
    assert sorted((r["video_id"], r["para_id"], r["orig_index"]) for r in W.clip_cues(c, k).collect()) == sorted(pairs)
    assert sorted((r["video_id"], r["cue_index"]) for r in W.cues_in_windows(c, k).collect()) == sorted({(v, i) for v, _, i in pairs})
    inside = [(v, p, i) for v, i, s, e, _ in good for w, p, a, b in clips if v == w and s <= e and s >= a - 50 and e <= b + 50]
    assert sorted(map(tuple, W.cues_contained(c, k).collect())) == sorted(inside)


def test_a_video_of_a_million_cues(spark):
    """One key of the shuffle is a minute of it."""
    n = 1_000_000
    cues = spark.range(n).select(F.lit(1).alias("video_id"), F.col("id").alias("cue_index"), (F.col("id") * 2000).alias("start_ms"), (F.col("id") * 2000 + 1900).alias("end_ms"), F.lit("t").alias("text"))
    clips = spark.range(2000).select(F.lit(1).alias("video_id"), F.col("id").cast("int").alias("para_id"), (F.col("id") * 1_000_000).alias("start_ms"), (F.col("id") * 1_000_000 + 90_000).alias("end_ms"))
    assert W.cues_in_windows(cues, clips).count() == 2000 * 45 == W.clip_cues(cues, clips).count()
