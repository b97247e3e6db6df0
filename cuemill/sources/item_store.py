"""A table of items that is written by deltas and read merged, for streams of upserts.

A batch writes its own rows and nothing else. Reading takes, of all rows of an id, the fields of the newest batch and the source
and creation time of the first, which is what upserting batch after batch gives; the rule does not mind rows that are seen twice
or in another order, so files can be put together at any time.

    delta/v=<batch>       rows of a batch, one an id, by hash
    delta/m=<batch>       several deltas made one
    base/v=<batch>/b=<k>  rows of a bucket, one an id
    list/v=<batch>        what the table is made of: one row, written last

Buckets are ranges of the id's hash. A bucket whose share of delta rows has grown is written anew without them, and cut in two, or
more, where it has become too large. Small deltas are put together in tiers, so their number grows with the logarithm of what is not
in the base. Every row is thus rewritten a bounded number of times, and a batch costs in proportion to its own size."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import finished_versions, remove

LIST = "buckets array<struct<depth:int,slot:bigint,base:bigint,rows:bigint,pending:bigint>>, deltas array<struct<name:string,rows:bigint,upto:bigint>>"
KEEPS = ("source", "created_at")
#: Columns of our own: the first and the newest batch that a row stands for, and the hash of its id.
FIRST, LAST, HASH = "__first", "__last", "__hash"


@dataclass
class Bucket:
    """Rows whose hash has `slot` in its first `depth` bits; base: the batch up to which its files have all, -1 before any."""

    depth: int
    slot: int
    base: int = -1
    rows: int = 0
    pending: int = 0  # delta rows that its base does not have

    @property
    def name(self) -> str:
        return f"d{self.depth}s{self.slot}"

    def folder(self) -> list[str]:
        return [f"base/v={self.base}/b={self.name}"] if self.rows else []


@dataclass
class Snapshot:
    version: int
    buckets: list[Bucket]
    deltas: list[tuple[str, int, int]] = field(default_factory=list)  # folder, rows, its newest batch

    def folders(self) -> list[str]:
        return [*(f for b in self.buckets for f in b.folder()), *(f"delta/{n}" for n, _, _ in self.deltas)]


def snapshot(spark: SparkSession, target: str, version: int | None = None) -> Snapshot | None:
    """The table as of a batch, of the newest one if not said; None before the first. The last two batches are kept."""
    known = finished_versions(spark, f"{target}/list")
    at = max(known, default=None) if version is None else version
    if at is None:
        return None
    if at not in known:
        raise ValueError(f"{target} has no list of batch {at}")
    row = spark.read.schema(LIST).parquet(f"{target}/list/v={at}").first()
    return Snapshot(at, [Bucket(*b) for b in row["buckets"]], [tuple(d) for d in row["deltas"]])


def _merged(rows: DataFrame) -> DataFrame:
    """One row an id."""
    fields = [c for c in rows.columns if c not in ("id", *KEEPS, FIRST, LAST, HASH, "b")]
    keys = [c for c in ("b", "id", HASH) if c in rows.columns]
    old, new = F.min_by(F.struct(*KEEPS, FIRST), FIRST), F.max_by(F.struct(*fields, LAST), LAST)
    one = rows.groupBy(*keys).agg(old.alias("__o"), new.alias("__n"))
    return one.select(*keys, "__o.*", "__n.*")


def _read(spark: SparkSession, target: str, folders: list[str]) -> DataFrame:
    """Rows of some folders; fields that only some of them have are null in the others."""
    parts = [spark.read.option("mergeSchema", True).parquet(*[f"{target}/{f}" for f in some]) for some in ([f for f in folders if f.startswith(kind)] for kind in ("base", "delta")) if some]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_items(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The items as of a batch that is kept, of the newest one if not said."""
    found = snapshot(spark, target, version)
    if found is None:
        raise ValueError(f"{target} has no finished batch")
    return _merged(_read(spark, target, found.folders()).drop("b")).drop(FIRST, LAST, HASH)


def new_items_of(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The items that a kept batch, the newest one if not said, was the first to have."""
    found = snapshot(spark, target, version)
    if found is None:
        raise ValueError(f"{target} has no finished batch")
    return _merged(_read(spark, target, found.folders()).drop("b")).where(F.col(FIRST) == found.version).drop(FIRST, LAST, HASH)


def _slot(depth: int) -> Column:
    return F.shiftright(F.col(HASH), 64 - depth)


def _directory(spark: SparkSession, buckets: list[Bucket], rows: list[tuple], schema: str) -> tuple[DataFrame, int]:
    """(slot, ...) of all slots at the depth of the deepest bucket: rows has a tuple for each bucket. One row a bucket or a few."""
    deepest = max(b.depth for b in buckets)
    out = []
    for b, row in zip(buckets, rows, strict=True):
        first = b.slot << (deepest - b.depth)
        out += [(s, *row) for s in range(first, first + (1 << (deepest - b.depth)))]
    return spark.createDataFrame(out, f"slot bigint, {schema}"), deepest


def write_batch(
    batch: DataFrame, target: str, number: int, now: Column, order: str = "pos", *, bucket_rows: int = 2_000_000, share: float = 0.25, least_pending: int = 100_000, fan: int = 8
) -> None:
    """Upsert batch(id, source, fields, `order`) as batch `number`, later than all before; rows are stamped with now.

    Of an id that the batch repeats, the last row by `order` counts; rows without an id are left out. A number that is finished
    already is a repetition, and nothing is done; one that was broken off writes the same folders again. Readers see a batch
    when its list is written, whole or not at all. One writer at a time.

    A bucket is written anew when its delta rows are `least_pending` and `share` of its rows; it is cut to `bucket_rows` rows or
    so. `fan` deltas of much the same size become one. What only older lists than the last two name is removed."""
    from cuemill.operators.feeds import last_wins

    spark = batch.sparkSession
    before = snapshot(spark, target)
    if before is not None and number <= before.version:
        return
    state = before or Snapshot(-1, [Bucket(1, -1), Bucket(1, 0)])
    fields = [c for c in batch.columns if c not in ("id", "source", order)]
    stamp = now.cast("bigint")
    rows = last_wins(batch.where("id IS NOT NULL"), "id", order).select(
        "id", "source", stamp.alias("created_at"), F.lit(number).cast("bigint").alias(FIRST), *fields, stamp.alias("updated_at"), F.lit(number).cast("bigint").alias(LAST), F.xxhash64("id").alias(HASH)
    )
    _write(rows, f"{target}/delta/v={number}")
    state = _count(spark, target, state, number)
    state = _compact(spark, target, state, number, bucket_rows, share, least_pending)
    state = _put_together(spark, target, state, number, fan)
    _finish(spark, target, state, number)


def _write(rows: DataFrame, folder: str) -> None:
    """Files of a good size each, in the order of the hash, so that a bucket's rows are a stretch of few files."""
    rows.hint("rebalance").sortWithinPartitions(HASH).write.mode("overwrite").parquet(folder)


def _count(spark: SparkSession, target: str, state: Snapshot, number: int) -> Snapshot:
    """state with the new delta, counted by bucket."""
    directory, depth = _directory(spark, state.buckets, [(b.name,) for b in state.buckets], "name string")
    slots = spark.read.parquet(f"{target}/delta/v={number}").groupBy(_slot(depth).alias("slot")).count()
    counted = {r["name"]: r["n"] for r in slots.join(F.broadcast(directory), "slot").groupBy("name").agg(F.sum("count").alias("n")).collect()}
    buckets = [Bucket(b.depth, b.slot, b.base, b.rows, b.pending + counted.get(b.name, 0)) for b in state.buckets]
    total = sum(counted.values())
    return Snapshot(number, buckets, [*state.deltas, (f"v={number}", total, number)] if total or not state.deltas else state.deltas)


def _compact(spark: SparkSession, target: str, state: Snapshot, number: int, bucket_rows: int, share: float, least: int) -> Snapshot:
    """state after the buckets with many delta rows are written anew, by one job."""
    full = [b for b in state.buckets if b.pending >= max(least, share * b.rows)]
    if not full:
        return state
    # A bucket gets as many bits more as make its rows fit. Buckets that stay get no row of the directory below.
    deeper = {b.name: min(62, b.depth + max(0, math.ceil(math.log2((b.rows + b.pending) / bucket_rows)))) for b in full}
    directory, depth = _directory(spark, state.buckets, [(deeper.get(b.name),) for b in state.buckets], "bits int")
    folders = [*(f for b in full for f in b.folder()), *(f"delta/{n}" for n, _, _ in state.deltas)]
    rows = _read(spark, target, folders).drop("b").withColumn("slot", _slot(depth)).join(F.broadcast(directory.where("bits IS NOT NULL")), "slot")
    placed = rows.withColumn("b", F.expr(f"concat('d', bits, 's', shiftright({HASH}, 64 - bits))")).drop("slot", "bits")
    _merged(placed.repartition("b")).sortWithinPartitions("b", HASH).write.mode("overwrite").partitionBy("b").parquet(f"{target}/base/v={number}")
    made = {r["b"]: r["n"] for r in spark.read.parquet(f"{target}/base/v={number}").groupBy("b").agg(F.count("*").alias("n")).collect()}
    buckets = [b for b in state.buckets if b.name not in deeper]
    for b in full:
        bits = deeper[b.name]
        first = b.slot << (bits - b.depth)
        for slot in range(first, first + (1 << (bits - b.depth))):
            n = made.get(Bucket(bits, slot).name, 0)
            buckets.append(Bucket(bits, slot, number, n))
    # A delta goes once no bucket lacks rows of it.
    lacking = min((b.base for b in buckets if b.pending), default=number)
    return Snapshot(number, buckets, [d for d in state.deltas if d[2] > lacking])


def _put_together(spark: SparkSession, target: str, state: Snapshot, number: int, fan: int) -> Snapshot:
    """state with `fan` deltas of a size made one, and those of the next size if they have become so many."""
    tiers: dict[int, list] = {}
    for d in state.deltas:
        tiers.setdefault(int(math.log(max(d[1], 1), fan)), []).append(d)
    chosen, tier = [], min(tiers, default=0)
    while len(tiers.get(tier, [])) + bool(chosen) >= fan:
        chosen += tiers[tier]
        tier += 1
    if not chosen:
        return state
    # Rows that their bucket's base has already are left out.
    directory, depth = _directory(spark, state.buckets, [(b.base,) for b in state.buckets], "has bigint")
    rows = _read(spark, target, [f"delta/{n}" for n, _, _ in chosen]).withColumn("slot", _slot(depth)).join(F.broadcast(directory), "slot")
    _write(_merged(rows.where(F.col(LAST) > F.col("has")).drop("slot", "has")), f"{target}/delta/m={number}")
    made = (f"m={number}", spark.read.parquet(f"{target}/delta/m={number}").count(), max(d[2] for d in chosen))
    return Snapshot(number, state.buckets, [*(d for d in state.deltas if d not in chosen), made])


def _finish(spark: SparkSession, target: str, state: Snapshot, number: int) -> None:
    """Write the list, which makes the batch part of the table; then remove what only older lists name."""
    row = ([(b.depth, b.slot, b.base, b.rows, b.pending) for b in state.buckets], state.deltas)
    spark.createDataFrame([row], LIST).coalesce(1).write.mode("overwrite").parquet(f"{target}/list/v={number}")
    known = sorted(finished_versions(spark, f"{target}/list"))
    kept = {f for v in known[-2:] for f in snapshot(spark, target, v).folders()}
    for v in known[:-2]:
        remove(spark, [f"{target}/{f}" for f in snapshot(spark, target, v).folders() if f not in kept])
        remove(spark, [f"{target}/list/v={v}"])
    # Deltas that were written and put together within this batch are in no list.
    if f"delta/v={number}" not in kept:
        remove(spark, [f"{target}/delta/v={number}"])
