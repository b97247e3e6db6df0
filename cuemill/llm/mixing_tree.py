"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents that a block holds on average.
BLOCK_DOCS = 256
#: Blocks of a shard that are shuffled among one another.
PIECE_BLOCKS = 16
#: Sources whose quotas are split at once, shards at most, and rows or numbers of a plan that are broadcast at most: a plan of more
#: is joined by a shuffle.
GROUP, MOST_SHARDS, BROADCAST = 4096, 1024, 1 << 18
#: A source's blocks are permuted by one of these primes: those after 2^30, as many as wanted.
PRIMES = 16


def split_quotas(quotas: np.ndarray, shards: int, seed: int, totals: np.ndarray | None = None) -> np.ndarray:
    """Counts (shards, sources) that deal the block quotas out: the shards are halved again and again, and a half's
    blocks are a draw without replacement (multivariate hypergeometric) from those of the node, as many as the half
    has of the shards, or as its shards' `totals` add up to. Columns add up to the quotas; without totals, rows differ by a
    block at most for a power of two."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        rng = np.random.default_rng((seed, lo, hi))
        want = total * (mid - lo) // (hi - lo) if totals is None else int(totals[lo:mid].sum())
        first = rng.multivariate_hypergeometric(have, want, method="marginals") if total else have * 0
        stack += [(lo, mid, first), (mid, hi, have - first)]
    return out


def split_in_groups(quotas: np.ndarray, totals: np.ndarray, seed: int, group: int = GROUP) -> Iterator[np.ndarray]:
    """split_quotas() for shards of these totals, `group` sources at a time: what groups get is drawn before what their sources
    get, which is the same draw."""
    if len(quotas) <= group:
        yield split_quotas(quotas, len(totals), seed, totals)
        return
    parts = np.array_split(quotas, group)
    for k, (own, part) in enumerate(zip(split_quotas(np.array([p.sum() for p in parts]), len(totals), seed, totals).T, parts, strict=True)):
        yield from split_in_groups(part, own, seed * group + k + 1, group)


@dataclass(frozen=True)
class MixPlan:
    """One row a source (table), whether it may be broadcast, and the seed, shards and pieces that the rows were made for."""

    table: DataFrame
    small: bool
    seed: int
    shards: int
    pieces: int


def _hash(seed: int, key: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key])


def _block(h: Column, p: str) -> Column:
    return F.pmod(h, F.col(f"{p}.blocks"))


def _place(block: Column, p: str) -> Column:
    """Place of a block in its source's permutation: mul and blocks have no common divisor."""
    return (F.col(f"{p}.mul") % F.col(f"{p}.blocks") * block + F.col(f"{p}.add")) % F.col(f"{p}.blocks")


@functools.cache
def _primes() -> tuple[int, ...]:
    found, n = [], (1 << 30) + 1
    while len(found) < PRIMES:
        if all(n % d for d in range(3, math.isqrt(n) + 1, 2)):
            found.append(n)
        n += 2
    return tuple(found)


def _in_order(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0: by code point, null last. They are sorted by range; only the ranges' counts reach the driver."""
    parts = common.cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, [(-1, 0)]
    for r in sorted(parts.groupBy("part").count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    side = sources.sparkSession.createDataFrame(offsets, "part int, before bigint")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("place", place).join(F.broadcast(side), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "before", "place")


def water_level(sources: DataFrame, budget: float) -> float:
    """The level to which sources(room, weight) are filled: each gets the smaller of its room and its weight times the level, and
    all together the budget; infinity if that is over all rooms.

    Sources are sorted by the level at which they are full, by range. Sums of ranges tell the range in which the budget is
    reached, and running sums within it the place."""
    full = F.col("room") / F.col("weight")
    parts = common.cut(sources.where("room > 0").select("room", "weight", full.alias("full")).repartitionByRange("full").withColumn("part", F.spark_partition_id()))
    ranges = parts.groupBy("part").agg(F.sum("room").alias("room"), F.sum("weight").alias("weight"), F.max("full").alias("full")).orderBy("part").collect()
    room, weight = 0.0, sum(r["weight"] for r in ranges)  # of the sources full before, and of the others
    for r in ranges:
        if room + r["room"] + r["full"] * (weight - r["weight"]) >= budget:
            upto = Window.orderBy("full").rowsBetween(Window.unboundedPreceding, -1)
            before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0))
            rows = parts.where(F.col("part") == r["part"]).select("full", (before("room") + room).alias("room"), (F.lit(weight) - before("weight")).alias("weight"))
            at = rows.where(F.col("room") + F.col("full") * F.col("weight") >= budget).orderBy("full", "room").limit(1).collect()
            if at:
                return (budget - at[0]["room"]) / at[0]["weight"]
        room, weight = room + r["room"], weight - r["weight"]
    return math.inf


def plan_mix(
    sized: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    shards: int | None = None,
    seed: int = 9,
    block_docs: int = BLOCK_DOCS,
    weights: tuple = WEIGHTS,
    key: tuple = ("doc_id", "size"),
) -> MixPlan:
    """What is drawn of sized(source, size, key...), which is read four times: give a table that is written.

    Targets share the budget, `share` of all sizes, by weight, none above `most` times its source's size; what that leaves goes
    to the others by weight; see water_level(). A source's documents fall into blocks by a seeded hash of the key columns, and the
    blocks have a seeded permutation. A source is gone through whole as often as its target holds its size; of the last pass the
    first blocks of the permutation are drawn, and of the block that the target falls into the first documents in the order of
    their hashes, so that the words drawn differ from the target by half a document at most. That place is sought by sums of runs
    of blocks, then of the run's blocks, then of the block's documents: no step orders a whole source. The drawn blocks are a
    source's exact quota; the splitting tree deals all quotas out among the shards, first those of groups of sources, then within
    each group, in tasks.

    Sources are rows of tables throughout, of any number. To the driver come sums: of ranges and groups of sources. `shards` grows
    with the drawn blocks if it is None, to MOST_SHARDS."""
    spark = sized.sparkSession
    sources = common.cut(sized.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("source_size")))
    stat = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("size")).first()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = _in_order(sources).withColumn("weight", weight).withColumn("room", F.lit(float(most)) * F.col("source_size"))
    level = water_level(ranked, share * float(stat["size"]))
    target = F.when(F.col("source_size") <= 0, 0.0).otherwise(F.col("room") if math.isinf(level) else F.least("room", F.lit(level) * F.col("weight")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_docs)).cast("bigint")
    drawn = lambda k: F.xxhash64(F.lit(seed + k), "rank", F.col("source"))
    fit = F.filter(F.array(*[F.lit(q).cast("bigint") for q in _primes()]), lambda q: F.col("blocks") % q != 0)
    plan = ranked.withColumn("target", target).withColumn("blocks", blocks).withColumn("mul", F.element_at(fit, (F.pmod(drawn(100), F.size(fit)) + 1).cast("int")))
    plan = plan.withColumn("add", F.pmod(drawn(101), F.col("blocks"))).withColumn("whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int"))
    plan = common.cut(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).select("source", "rank", "source_size", "target", "blocks", "mul", "add", "whole", "rest"))
    few = stat["n"] <= BROADCAST
    plan = plan.join(_edges(sized, plan, few, seed, list(key)), "rank", "left")
    # Without a last pass nothing more is drawn; one that nothing ends takes all blocks.
    plan = plan.withColumn("edge_place", F.coalesce("edge_place", F.when(F.col("rest") > 0, F.col("blocks")).otherwise(0)))
    plan = plan.withColumn("more", F.col("edge_place") + F.col("edge_hash").isNotNull().cast("int"))
    group = max(GROUP, -(-stat["n"] // GROUP))
    plan = common.cut(plan.withColumn("quota", F.col("blocks") * F.col("whole") + F.col("more")).withColumn("grp", F.floor(F.col("rank") / group)))
    totals = {r["grp"]: r["quota"] for r in plan.groupBy("grp").agg(F.sum("quota").alias("quota")).collect()}  # GROUP rows at most
    total = sum(totals.values())
    if shards is None:
        shards = min(MOST_SHARDS, 1 << max(4, (total // 64).bit_length() - 1))
    by_group = split_quotas(np.array([totals[g] for g in sorted(totals)], np.int64), shards, seed)
    shared = spark.sparkContext.broadcast({g: by_group[:, i].copy() for i, g in enumerate(sorted(totals))})
    schema = "rank bigint, ends array<bigint>, owners array<int>"
    arrow = common.arrow_schema(schema)

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        g = table.column("grp")[0].as_py()
        ends, owners = [], []
        for counts in split_in_groups(table.column("quota").to_numpy(), shared.value[g], seed + 1 + g):
            for own in counts.T:
                # A source's blocks by shard: where each shard's end, or, of few blocks, the shard of each.
                many = own.sum() >= len(own)
                ends.append(np.cumsum(own) if many else None)
                owners.append(None if many else np.repeat(np.arange(len(own)), own))
        return pa.Table.from_arrays([table.column("rank"), pa.array(ends, arrow.field(1).type), pa.array(owners, arrow.field(2).type)], schema=arrow)

    dealt = common.cut(plan.select("rank", "grp", "quota").groupBy("grp").applyInArrow(deal, schema))
    held = dealt.agg(F.coalesce(F.sum(F.coalesce(F.size("ends"), F.lit(0)) + F.coalesce(F.size("owners"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    pieces = max(1, -(-total // (shards * PIECE_BLOCKS)))
    return MixPlan(plan.drop("grp").join(dealt, "rank"), few and held <= BROADCAST, seed, shards, pieces)


def _planned(docs: DataFrame, table: DataFrame, p: str, small: bool) -> DataFrame:
    """docs with the row of their source as struct p. A small table is broadcast; a large one is joined by a shuffle, in which a
    frequent source is split as other skewed keys are."""
    side = table.select(F.col("source").alias(f"{p}_source"), F.struct(*table.columns).alias(p))
    return docs.join(F.broadcast(side) if small else side, docs.source.eqNullSafe(side[f"{p}_source"])).drop(f"{p}_source")


def _edges(sized: DataFrame, table: DataFrame, small: bool, seed: int, key: list[str]) -> DataFrame:
    """(rank, edge_place, edge_hash) of sources with a last pass: the place of the block that it ends in, and the hash of the last
    document that is drawn of that block, null if none is."""
    p = common.hidden_name(sized, "plan")
    h, place, run = (common.hidden_name(sized, n) for n in ("hash", "place", "run"))
    docs = _planned(sized.where("size > 0"), table.where("rest > 0"), p, small).withColumn(h, _hash(seed, key))
    docs = docs.withColumn(place, _place(_block(F.col(h), p), p))
    docs = docs.withColumn(run, F.floor(F.col(place) / F.ceil(F.sqrt(f"{p}.blocks"))))
    docs = docs.select(F.col(f"{p}.rank").alias("rank"), F.col(f"{p}.rest").alias("rest"), "size", *[F.col(c).alias(n) for c, n in ((h, "h"), (place, "place"), (run, "run"))])

    def end(rows: DataFrame, by: str) -> DataFrame:
        """(rank, by, b): the value of `by` at which the sum of sizes passes `rest`, and the sum before it. One row a source."""
        sums = rows.groupBy("rank", by).agg(F.sum("size").alias("w"), F.first("rest").alias("rest"))
        upto = F.sum("w").over(Window.partitionBy("rank").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        at = sums.withColumn("b", (upto - F.col("w")).cast("double")).where((F.col("b") <= F.col("rest")) & (F.col("b") + F.col("w") > F.col("rest")))
        return common.cut(at.select("rank", by, "b"))

    def within(rows: DataFrame, by: str, found: DataFrame) -> DataFrame:
        side = F.broadcast(found) if small else found
        return rows.join(side, ["rank", by]).withColumn("rest", F.col("rest") - F.col("b")).drop("b")

    in_run = within(docs, "run", end(docs, "run"))
    places = end(in_run, "place")
    rows = within(in_run, "place", places)
    sums = rows.groupBy("rank", "h").agg(F.sum("size").alias("w"), F.first("rest").alias("rest"))
    upto = F.sum("w").over(Window.partitionBy("rank").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    drawn = sums.withColumn("mid", upto - F.col("w") / 2.0).where("mid <= rest").groupBy("rank").agg(F.max("h").alias("edge_hash"))
    return places.select("rank", F.col("place").alias("edge_place")).join(drawn, "rank", "left")


def _draws(plan: MixPlan, p: str, h: Column) -> tuple[Column, Column]:
    """(passes, at): how often a document is drawn, and the shard of each draw."""
    place = _place(_block(h, p), p)
    edge = (place == F.col(f"{p}.edge_place")) & (h <= F.col(f"{p}.edge_hash"))
    extra = F.coalesce((F.col(f"{p}.rest") > 0) & ((place < F.col(f"{p}.edge_place")) | edge), F.lit(False))
    passes = F.col(f"{p}.whole") + extra.cast("int")
    first = place * F.col(f"{p}.whole") + F.least(place, F.col(f"{p}.more"))
    draws = F.when(passes > 0, F.sequence(first, first + passes - 1)).otherwise(F.array().cast("array<bigint>"))
    ends, owners = F.col(f"{p}.ends"), F.col(f"{p}.owners")
    by_ends = lambda d: F.size(F.filter(ends, lambda e: e <= d))
    return passes, F.transform(draws, lambda d: F.when(ends.isNotNull(), by_ends(d)).otherwise(F.try_element_at(owners, (d + 1).cast("int"))))


def draw_mix(docs: DataFrame, key: tuple = ("doc_id", "size"), **how) -> DataFrame:
    """Draw a mix of docs(doc_id, source, size): its rows with source_size, target, passes (how often a row is drawn) and
    at (the shard of each draw). See plan_mix(), which takes the other parameters.

    key: columns whose hash deals documents into blocks; rows that are alike in them are drawn alike. Other columns pass
    through, unless a new one has their name. Null sources are a source of their own, the last; a source of size 0 gives
    nothing. Repeated rows are drawn alike. An empty table gives an empty mix."""
    plan = plan_mix(docs, key=key, **how)
    p = common.hidden_name(docs, "plan")
    passes, at = _draws(plan, p, _hash(plan.seed, list(key)))
    new = ["source_size", "target", "passes", "at"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return _planned(docs, plan.table, p, plan.small).select(
        *kept, F.col(f"{p}.source_size").alias("source_size"), F.col(f"{p}.target").alias("target"), passes.alias("passes"), at.alias("at")
    )


def _sized(docs: DataFrame) -> DataFrame:
    """Written (doc_id, source, size, key) of docs; key tells texts of one or no doc_id apart."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("bigint")
    return common.cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("key")))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' columns and rows, each as often as drawn, dealt out by shard and shuffled within pieces of it.

    Draws are worked out on ids and sizes; the texts are shuffled once, to their places. Null texts have size 0."""
    plan = plan_mix(_sized(docs), key=("key",), **how)
    p, key, shard, piece = (common.hidden_name(docs, n) for n in ("plan", "key", "shard", "piece"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    h = _hash(plan.seed, [key])
    out = _planned(keyed, plan.table, p, plan.small).withColumn(shard, F.explode(_draws(plan, p, h)[1]))
    # A piece of a shard takes some of its blocks of every source.
    dealt = F.pmod(F.xxhash64(F.lit(plan.seed + 1), F.col(f"{p}.rank"), _block(h, p)), F.lit(plan.pieces))
    out = out.withColumn(piece, dealt).select(*[F.col(f"`{c}`") for c in docs.columns], key, shard, piece)
    out = out.repartition(F.col(shard), F.col(piece)).sortWithinPartitions(shard, piece, F.xxhash64(F.lit(plan.seed + 2), key, shard))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents as (doc_id, size, source_size, target, taken, at); see draw_mix()."""
    mixed = draw_mix(_sized(common.table(spark, sf_dir, "documents")), key=("key",))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"), "at"
    )
