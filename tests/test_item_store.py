import random

import pytest
from cuemill.operators import feeds as P
from cuemill.sources import item_store
from pyspark.sql import functions as F

BATCH = "id string, source string, title string, n bigint, pos int"


def some_batch(rng, ids, size, number):
    return [(f"k{rng.randrange(ids)}", f"s{number}", f"t{number}.{i}" if rng.random() < 0.9 else None, i, i) for i in range(size)] + [(None, "s", "no id", 0, 0)]


def applied(items, batch, now):
    """Upsert in plain Python: id -> (source, created_at, title, n, updated_at)."""
    last = {}
    for i, source, title, n, _pos in batch:
        if i is not None:
            last[i] = (source, title, n)
    new = {i for i in last if i not in items}
    for i, (source, title, n) in last.items():
        old = items.get(i, (source, now))
        items[i] = (old[0], old[1], title, n, now)
    return new


def rows_of(df):
    return {r["id"]: (r["source"], r["created_at"], r["title"], r["n"], r["updated_at"]) for r in df.collect()}


def test_batches_equal_plain_upserts(spark, tmp_path):
    rng, target, want, sizes = random.Random(5), str(tmp_path / "t"), {}, []
    how = {"bucket_rows": 60, "share": 0.25, "least_pending": 12, "fan": 3}
    for number in range(10):
        batch = some_batch(rng, 400, 5 if number % 3 else 120, number)
        new = applied(want, batch, 100 + number)
        item_store.write_batch(spark.createDataFrame(batch, BATCH), target, number, F.lit(100 + number), **how)
        assert rows_of(item_store.read_items(spark, target)) == want
        assert {r["id"] for r in item_store.new_items_of(spark, target).collect()} == new
        state = item_store.snapshot(spark, target)
        sizes.append(sum(d[1] for d in state.deltas))
        assert len(state.deltas) <= 8 and state.version == number
    assert max(b.depth for b in state.buckets) > 1 and max(b.rows for b in state.buckets) <= 120  # cut in two, more than once
    assert sorted(set(range(1 << 8)) - {s for b in state.buckets for s in range((b.slot << (8 - b.depth)) + 128, ((b.slot + 1) << (8 - b.depth)) + 128)}) == []
    assert max(sizes) < 400
    # Only what the last two lists name is left.
    named = {f for v in (8, 9) for f in item_store.snapshot(spark, target, v).folders()}
    left = {str(p.relative_to(target)) for kind in ("delta/*", "base/*/b=*") for p in (tmp_path / "t").glob(kind)}
    assert left == named
    assert rows_of(item_store.read_items(spark, target, 8)) != want
    with pytest.raises(ValueError):
        item_store.read_items(spark, target, 3)
    with pytest.raises(ValueError):
        item_store.read_items(spark, str(tmp_path / "none"))
    # The rule is the batch operator's.
    old = spark.createDataFrame([(i, *v) for i, v in want.items()], "id string, source string, created_at bigint, title string, n bigint, updated_at bigint")
    batch = some_batch(rng, 500, 50, 10)
    after, _ = P.upsert_items(old, spark.createDataFrame(batch, BATCH).where("id IS NOT NULL"), F.lit(110).cast("bigint"))
    item_store.write_batch(spark.createDataFrame(batch, BATCH), target, 10, F.lit(110), **how)
    assert rows_of(item_store.read_items(spark, target)) == rows_of(after)


def test_a_batch_that_breaks_off_or_comes_again(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), BATCH)
    how = {"least_pending": 2, "fan": 2}
    item_store.write_batch(df(("a", "s", "one", 1, 0), ("b", "s", "x", 1, 1), ("c", "s", "x", 1, 1)), target, 0, F.lit(1), **how)
    before = rows_of(item_store.read_items(spark, target))

    def broken(*_):
        raise OSError("gone")

    second = df(("a", "other", "two", 2, 0), ("d", "s", "new", 2, 1), ("b", "s", "two", 2, 2), ("c", "s", "two", 2, 2))
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(item_store, "_finish", broken)  # all data written, the list not
        item_store.write_batch(second, target, 1, F.lit(2), **how)
    assert rows_of(item_store.read_items(spark, target)) == before
    item_store.write_batch(second, target, 1, F.lit(3), **how)
    after = rows_of(item_store.read_items(spark, target))
    assert after["a"] == ("s", 1, "two", 2, 3) and after["d"] == ("s", 3, "new", 2, 3) and len(after) == 4
    item_store.write_batch(df(("a", "s", "again", 9, 0)), target, 1, F.lit(9), **how)  # finished already
    item_store.write_batch(df(("a", "s", "older", 9, 0)), target, 0, F.lit(9), **how)
    assert rows_of(item_store.read_items(spark, target)) == after
    item_store.write_batch(df(("a", "s", "x", 1, 0)).limit(0), target, 2, F.lit(4), **how)  # nothing in it
    assert rows_of(item_store.read_items(spark, target)) == after and item_store.new_items_of(spark, target).count() == 0
    more = spark.createDataFrame([("e", "s", "t", 1, 0, "extra")], BATCH + ", further string")  # a field that was not there before
    item_store.write_batch(more, target, 3, F.lit(5), **how)
    got = {r["id"]: r["further"] for r in item_store.read_items(spark, target).collect()}
    assert got["e"] == "extra" and got["a"] is None and len(got) == 5


def test_a_small_batch_writes_little(spark, tmp_path):
    target = str(tmp_path / "t")
    big = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("s").alias("source"), F.lit("t").alias("title"), F.col("id").alias("n"), F.lit(0).alias("pos"))
    item_store.write_batch(big, target, 0, F.lit(1), bucket_rows=100_000)
    first = item_store.snapshot(spark, target)
    assert not first.deltas and sum(b.rows for b in first.buckets) == 300_000 and all(b.depth == 2 for b in first.buckets)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet"))
    whole = size()
    item_store.write_batch(big.where("n % 300 = 7").withColumn("title", F.lit("new")), target, 1, F.lit(2), bucket_rows=100_000)
    second = item_store.snapshot(spark, target)
    assert [d[1] for d in second.deltas] == [1000] and [b.folder() for b in second.buckets] == [b.folder() for b in first.buckets]
    assert size() - whole < whole / 100
    assert item_store.read_items(spark, target).groupBy("title").count().where("title = 'new' AND count = 1000").count() == 1
