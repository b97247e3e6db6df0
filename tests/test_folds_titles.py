"""Folds and the walk over titles against plain loops."""

import random

import numpy as np
import pytest
from cuemill.operators import feeds as P
from cuemill.operators import transcript as W
from cuemill.operators.components import components
from cuemill.operators.folds import fold_sorted
from cuemill.operators.near_titles import KeptTitles
from pyspark.sql import functions as F


def like(a, b):
    a, b = a[:20], b[:20]
    return sum(ch in b for ch in a) / max(len(a), len(b)) if a and b else 0.0


def walked_plainly(rows, threshold):
    """rows(block, pos, title, has_url, duration) in order to {(block, pos): place}."""
    kept = {}
    for block, pos, title, url, duration in sorted(rows, key=lambda r: (r[1], r[2] or "")):
        own, worth = kept.setdefault(block, []), int(url) + (duration or 0) / 10000
        for k, (_, t, w) in enumerate(own):
            if like(title or "", t) >= threshold:
                if worth > w:
                    own[k] = (pos, title or "", worth)
                break
        else:
            own.append((pos, title or "", worth))
    return {(block, pos): k for block, own in kept.items() for k, (pos, _, _) in enumerate(own)}


@pytest.mark.parametrize("threshold, most_pairs", [(0.6, 200), (0.6, 3), (0.9, 200), (0.0, 200)])
def test_titles_equal_the_plain_walk(spark, threshold, most_pairs):
    rng = random.Random(8)
    wide, narrow = [chr(0x4E00 + k) for k in range(400)], list("abcdefg ")
    rows = []
    for pos in range(700):
        block = rng.choice(["wide", "narrow", "mixed", None])
        letters = wide if block == "wide" else narrow if block == "narrow" else wide + narrow
        title = "".join(rng.choices(letters, k=rng.choice([0, 1, 3, 8, 15, 20, 30])))
        if rows and rng.random() < 0.3:  # a near copy of another one
            old = list(rng.choice(rows)[2] or "x")
            rng.shuffle(old)
            title = "".join(old[: rng.randrange(1, 25)]) + rng.choice(letters)
        rows.append((block, pos, title if rng.random() < 0.98 else None, rng.random() < 0.5, rng.choice([None, 0, 5, 600])))
    df = spark.createDataFrame([(*r, "more", 7) for r in rows], "block string, pos int, title string, has_url boolean, duration int, __bag string, place int").repartition(3)
    got = P.dedup_titles(df, threshold, most_pairs)
    assert got.columns == ["block", "pos", "title", "has_url", "duration", "place"]
    assert {(r["block"], r["pos"]): r["place"] for r in got.collect()} == walked_plainly(rows, threshold)
    assert P.dedup_titles(df.limit(0), threshold).collect() == []


def test_kept_titles_grow_and_change_places():
    kept, plain, rng = KeptTitles(), [], random.Random(2)
    for _ in range(300):
        head = "".join(rng.choices("abcdefgh", k=rng.randrange(0, 6)))
        want = next((k for k, t in enumerate(plain) if like(head, t) >= 0.7), -1)
        assert kept.like(head, 0.7) == want
        place = want if want >= 0 and rng.random() < 0.5 else len(plain)
        kept.put(place, head)
        plain[place : place + 1] = [head]


def test_a_block_of_many_titles(spark):
    """Ten thousand titles of one block: as the plain walk over those that near copies link."""
    rng = np.random.default_rng(5)
    titles = ["".join(chr(0x4E00 + c) for c in row) for row in rng.zipf(1.25, (9000, 18)) % 3000]
    titles += [titles[int(k)][:17] + "新" for k in rng.integers(0, 9000, 1000)]
    rows = [("b", k, t, bool(k % 3), k % 700) for k, t in enumerate(titles)]
    got = {(r["block"], r["pos"]): r["place"] for r in P.dedup_titles(spark.createDataFrame(rows, "block string, pos int, title string, has_url boolean, duration int")).collect()}
    kept, best, worth = KeptTitles(), [], []
    for _, pos, t, url, d in rows:
        place = kept.like(t[:20], 0.6)
        if place < 0:
            place = len(best)
            best.append(pos)
            worth.append(int(url) + d / 10000)
        elif int(url) + d / 10000 > worth[place]:
            best[place], worth[place] = pos, int(url) + d / 10000
        else:
            continue
        kept.put(place, t[:20])
    assert got == {("b", pos): k for k, pos in enumerate(best)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(5, 5), (1, 2), (2, 1), (1, 2)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["part"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_folds_stream_through_one_long_key(spark):
    """A key's rows pass in many batches, and the fold sees them one at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    n = 400_000

    def fold(rows):
        last, count = None, 0
        for t, _ in rows:
            assert last is None or t >= last
            last, count = t, count + 1
            if count % 100_000 == 0:
                yield count, t

    rows = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 7919 % n).alias("t"), F.lit("x").alias("w")).unionByName(spark.createDataFrame([(None, 3, "y")], "key string, t bigint, w string"))
    got = fold_sorted(rows, ["key"], ["t"], fold, "n bigint, t bigint").collect()
    cues = rows.select(F.lit(1).alias("video_id"), F.col("t").alias("cue_index"), (F.col("t") * 100).alias("start_ms"), (F.col("t") * 100 + 90).alias("end_ms"), F.lit("w.").alias("text"))
    merged = W.merge_paragraphs(cues.where(f"t < {n}"), 3000, 9_990).agg(F.count("*").alias("p"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in got] == [("k", k * 100_000, k * 100_000 - 1) for k in (1, 2, 3, 4)]
    assert tuple(merged) == (4000, n + 1, 101)


def test_paragraphs_with_null_texts(spark):
    rows = [(1, 1, 0, 10, " a "), (1, 2, 10, 20, None), (1, 3, 20, 30, "b"), (1, 4, 9000, 9001, None), (2, 1, 0, 1, "x")]
    got = W.merge_paragraphs(spark.createDataFrame(rows, "video_id int, cue_index int, start_ms bigint, end_ms bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 30, 3, "a b"), (1, 2, 9000, 9001, 1, ""), (2, 1, 0, 1, 1, "x")]
