"""Feed items, dispatch and publishing. `as_of` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as X

from .near_titles import dedup_titles  # noqa: F401

# Daily publishing slots in minutes of the local day (UTC+8).
SLOTS = (660, 750, 900, 1080, 1260)
LOCAL_S = 8 * 3600


def unify_items(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def _pick_row(rows: DataFrame, key: Column, chosen: Column) -> DataFrame:
    """One row a key; an aggregate, so that a frequent key is reduced before it is shuffled."""
    return rows.groupBy(key.alias("__k")).agg(chosen.alias("__r")).select("__r.*")


def last_wins(batch: DataFrame, key: str, order: str) -> DataFrame:
    return _pick_row(batch, F.col(key), F.max_by(F.struct(*batch.columns), order))


def first_wins(batch: DataFrame, key: Column, order: str) -> DataFrame:
    return _pick_row(batch, key, F.min_by(F.struct(*batch.columns), order))


def upsert_items(items: DataFrame, batch: DataFrame, now: Column, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(items afterwards, new rows of the batch). items has id, source, created_at, updated_at and any fields besides, which
    batch(id, source, fields, `order`) has too. Known ids take all of the batch's fields, nulls included, and the time, and keep
    source and created_at; of an id that the batch repeats, the last row counts, and the first is the one listed as new."""
    fields = [c for c in items.columns if c not in ("id", "source", "created_at", "updated_at")]
    last = last_wins(batch.where("id IS NOT NULL"), "id", order).select(F.col("id").alias("__id"), F.struct("source", *fields).alias("__b"))
    j = items.join(last, F.col("id") == F.col("__id"), "full")
    fresh, known = F.col("__id").isNotNull(), F.col("id").isNotNull()
    new = {
        "id": F.coalesce("id", "__id"), "source": F.when(known, F.col("source")).otherwise(F.col("__b.source")), "created_at": F.when(known, F.col("created_at")).otherwise(now),
        "updated_at": F.when(fresh, now).otherwise(F.col("updated_at")), **{c: F.when(fresh, F.col(f"__b.{c}")).otherwise(F.col(c)) for c in fields},
    }
    return j.select(*[new[c].alias(c) for c in items.columns]), new_items(batch, items, order)


def new_items(batch: DataFrame, items: DataFrame, order: str = "pos") -> DataFrame:
    """First occurrences of the batch's ids that items do not have."""
    return first_wins(batch, F.col("id"), order).join(items.select("id"), "id", "left_anti")


def update_extra(items: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    p = patch.select("id", F.col("extra").alias("__e"))
    return items.join(p, "id", "left").withColumn("updated_at", F.when(F.col("__e").isNotNull(), now).otherwise(F.col("updated_at"))).withColumn(
        "extra", F.coalesce("__e", "extra")
    ).drop("__e")


def export_items(items: DataFrame) -> DataFrame:
    """Newest first, extra as JSON text; unreadable extras become {}."""
    good = F.when(F.try_parse_json("extra").isNotNull(), F.col("extra")).otherwise(F.lit("{}"))
    return items.withColumn("extra", good).orderBy(F.desc("publish_s"), F.desc("created_at"))


def merge_seeds(pool: DataFrame, raw: DataFrame) -> DataFrame:
    """raw(pos, line) with seed_id and outcome: invalid without a 15- to 25-digit id, skipped if known or seen before,
    else added."""
    sid = X.blank_to_null(F.regexp_extract(F.regexp_replace("line", "['\"]", ""), r"(\d{15,25})", 1))
    known = pool.select(F.col("seed_id"), F.lit(True).alias("known")).distinct()
    r = raw.withColumn("seed_id", sid)
    good = r.where("seed_id IS NOT NULL")
    first = good.groupBy("seed_id").agg(F.min("pos").alias("first"))
    j = good.join(first, "seed_id").join(known, "seed_id", "left")
    outcome = F.when(F.col("known") | (F.col("pos") > F.col("first")), "skipped").otherwise("added")
    judged = j.withColumn("outcome", outcome).select(*r.columns, "outcome")
    return judged.unionByName(r.where("seed_id IS NULL").withColumn("outcome", F.lit("invalid")))


def seed_stats(pool: DataFrame) -> DataFrame:
    return pool.groupBy("kind").agg(F.count("*").alias("n"), F.max("updated_at").alias("last"))


def append_log(log: DataFrame, events: DataFrame, keep: int = 200) -> DataFrame:
    cut = events.withColumn("msg", F.substring("msg", 1, 120)).withColumn("detail", F.substring("detail", 1, 200))
    newest = Window.partitionBy(F.lit(1)).orderBy(F.desc("ts"), F.desc("seq"))
    # Only `keep` rows of each input can be among the last `keep`: a sort with a limit, not a window over all.
    rows = log.unionByName(cut).orderBy(F.desc("ts"), F.desc("seq")).limit(keep)
    return rows.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= keep).drop("__r")


def tail(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def catalogue_upsert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """By key, a later season overwrites."""
    return last_wins(store.unionByName(rows), "key", "season")


def noise_with_rescue(text: Column, noise: str, signal: str) -> Column:
    return ~(text.rlike(noise) & ~text.rlike(signal))


def noise_drop(text: Column, *patterns: str) -> Column:
    out = ~text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out & ~text.rlike(p)
    return out


def has_playable(video_url: Column, extra: Column, page_url: Column, platforms: str = r"bilibili\.com/video|douyin\.com/video") -> Column:
    direct = F.length(F.coalesce(video_url, F.get_json_object(extra, "$.video_url"), F.lit(""))) > 0
    return direct | F.coalesce(page_url.rlike(platforms), F.lit(False)) | (F.coalesce(F.get_json_object(extra, "$.has_video"), F.lit("")) == "true")


def duration_band(sec: Column, lo: int = 60, hi: int = 1800) -> Column:
    s = F.coalesce(sec.try_cast("double"), F.lit(0.0))
    return (s == 0) | s.between(lo, hi)


def within_days(publish_s: Column, ts: Column, as_of_s: int, days: int) -> Column:
    return F.coalesce(publish_s, ts) > as_of_s - days * 86400


def exclude_handled(cands: DataFrame, dispatched: DataFrame, rejected: DataFrame, ready: DataFrame, published: DataFrame, now_s: int, cool_s: int = 48 * 3600) -> DataFrame:
    """cands(key, video_id) without keys handled, videos cooling or rejected, unless ready for a retry, and without
    published videos."""
    keys = dispatched.select("key").unionByName(rejected.select("key")).join(ready.select("key"), "key", "left_anti")
    videos = dispatched.where(F.lit(now_s) - F.col("ts") < cool_s).select("video_id").unionByName(rejected.select("video_id")).join(ready.select("video_id"), "video_id", "left_anti")
    return cands.join(keys, "key", "left_anti").join(videos, "video_id", "left_anti").join(published.select("video_id"), "video_id", "left_anti")


def prefix_dedupe(rows: DataFrame, n: int = 12, order: str = "pos") -> DataFrame:
    return first_wins(rows, F.substring("title", 1, n), order)


def title_repeat_flag(rows: DataFrame, batch: str = "batch", order: str = "pos") -> DataFrame:
    return rows.withColumn("repeats", F.row_number().over(Window.partitionBy(batch, "title").orderBy(order)) > 1)


def feed_cap(rows: DataFrame, n: int, source: str = "source", order: str = "pos") -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(source).orderBy(order))).where(F.col("__r") <= n).drop("__r")


def pick(items: DataFrame, handled: DataFrame, keyword: str, noise: str, as_of_s: int, n: int) -> DataFrame:
    """Candidates(key, title, source, publish_s, duration, pos): noise and unlikely lengths dropped, handled keys left
    out, one a title prefix, by score and then place, the best n."""
    good = items.where(noise_drop(F.col("title"), noise) & F.contains(F.lower("title"), F.lit(keyword.lower())) & duration_band(F.col("duration")))
    left = prefix_dedupe(good.join(handled.select("key").distinct(), "key", "left_anti"))
    score = (
        X.source_score(F.col("source")) + X.title_score(F.col("title"), keyword) + X.freshness_score((F.lit(as_of_s) - F.col("publish_s")) / 3600) + X.duration_score(F.col("duration"))
    )
    return left.withColumn("score", score).orderBy(F.desc("score"), "pos").limit(n)


def pick_newest(items: DataFrame, handled: DataFrame, n: int) -> DataFrame:
    good = items.where(F.col("bytes") > 0).join(handled.select("key").distinct(), "key", "left_anti")
    return good.orderBy(F.desc("publish_s"), "pos").limit(n)


def published_guard(pending: DataFrame, published: DataFrame) -> DataFrame:
    """Slugs of pending(slug, source_url, title) that published has under another slug: by link, title, or the first 15
    characters of titles that long."""
    q = published.select(F.col("slug").alias("s2"), F.col("source_url").alias("u2"), F.col("title").alias("t2"))
    other = F.col("slug") != F.col("s2")
    by_url = pending.where("source_url <> ''").join(q, (F.col("source_url") == F.col("u2")) & other, "left_semi")
    by_title = pending.join(q, (F.col("title") == F.col("t2")) & other, "left_semi")
    long = pending.where(F.length("title") >= 15)
    by_prefix = long.join(q.where(F.length("t2") >= 15), (F.substring("title", 1, 15) == F.substring("t2", 1, 15)) & other, "left_semi")
    return by_url.unionByName(by_title).unionByName(by_prefix).select("slug").distinct()


def slot_times(days: DataFrame, slots: tuple = SLOTS) -> DataFrame:
    """days(day) with each day's slots as epoch seconds, slot_s; day counts from 1970 in local time."""
    return days.select("day", F.explode(F.array(*[F.lit(m) for m in slots])).alias("m")).select("day", (F.col("day") * 86400 + F.col("m") * 60 - LOCAL_S).alias("slot_s"))


def next_free_slot(nows: DataFrame, reserved: DataFrame, slots: tuple = SLOTS) -> DataFrame:
    """nows(now_s) with slot_s: the first slot of today or tomorrow after now that is not reserved(ts); if all are, the
    first."""
    days = nows.withColumn("day", F.explode(F.array(F.floor((F.col("now_s") + LOCAL_S) / 86400), F.floor((F.col("now_s") + LOCAL_S) / 86400) + 1)))
    all_ = days.select("now_s", "day", F.explode(F.array(*[F.lit(m) for m in slots])).alias("m")).select("now_s", (F.col("day") * 86400 + F.col("m") * 60 - LOCAL_S).alias("slot_s")).where("slot_s > now_s")
    taken = reserved.select(F.col("ts").alias("slot_s"), F.lit(True).alias("taken")).distinct()
    j = all_.join(taken, "slot_s", "left")
    return j.groupBy("now_s").agg(F.coalesce(F.min(F.when(F.col("taken").isNull(), F.col("slot_s"))), F.min("slot_s")).alias("slot_s"))


def slot_delay_hours(nows: DataFrame, i: int, slots: tuple = SLOTS) -> DataFrame:
    """Whole hours from now to the i-th slot of today and tomorrow after it, 1 to 24; beyond the last, the last."""
    days = nows.withColumn("day", F.explode(F.array(F.floor((F.col("now_s") + LOCAL_S) / 86400), F.floor((F.col("now_s") + LOCAL_S) / 86400) + 1)))
    all_ = days.select("now_s", "day", F.explode(F.array(*[F.lit(m) for m in slots])).alias("m")).select("now_s", (F.col("day") * 86400 + F.col("m") * 60 - LOCAL_S).alias("slot_s")).where("slot_s > now_s")
    at = F.sort_array(F.collect_list("slot_s"))
    s = all_.groupBy("now_s").agg(at.alias("a")).select("now_s", F.element_at("a", F.least(F.lit(i + 1), F.size("a"))).alias("slot_s"))
    return s.select("now_s", F.greatest(F.lit(1), F.least(F.lit(24), F.ceil((F.col("slot_s") - F.col("now_s")) / 3600))).alias("hours"))


def assign_slots(queue: DataFrame, free: DataFrame) -> DataFrame:
    """Items in order take the free slots in order. Both are short lists, a day's."""
    q = queue.withColumn("r", F.row_number().over(Window.partitionBy("batch").orderBy("pos")))
    s = free.withColumn("r", F.row_number().over(Window.partitionBy("batch").orderBy("slot_s")))
    return q.join(s, ["batch", "r"]).drop("r")


def fresh_skip(seeds: DataFrame, items: DataFrame, as_of_s: int, days: int = 7) -> DataFrame:
    fresh = items.where((F.col("has_link")) & (F.lit(as_of_s) - F.col("updated_s") < days * 86400)).select("key")
    return seeds.join(fresh, "key", "left_anti")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests(key) with outcome hit, miss or corrupt; corrupt replies are no JSON and count as misses."""
    j = requests.join(cache.select("key", "response"), "key", "left")
    good = F.try_parse_json("response").isNotNull()
    return j.withColumn("outcome", F.when(F.col("response").isNull(), "miss").when(good, "hit").otherwise("corrupt")).withColumn("response", F.when(good, F.col("response")))


def cache_stats(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome") != "hit").alias("misses"))


def pending_status(dispatched: DataFrame, published: DataFrame, artifacts: DataFrame, now_s: int) -> DataFrame:
    """dispatched(slug, ts, retries, last_retry, uploading) that are not published, with their next step."""
    p = dispatched.join(published.select("slug"), "slug", "left_anti").join(artifacts.select("slug", F.lit(True).alias("ready")).distinct(), "slug", "left")
    idle = F.lit(now_s) - F.greatest("ts", F.coalesce("last_retry", F.lit(0)))
    step = (
        F.when(F.col("uploading"), "verify").when(F.col("ready"), "ready").when(F.lit(now_s) - F.col("ts") > 12 * 3600, "failed")
        .when((F.coalesce("retries", F.lit(0)) < 2) & (idle > 6 * 3600), "retry").otherwise("wait")
    )
    return p.select("slug", "ts", step.alias("step"))


def missing_models(wanted: DataFrame, available: DataFrame) -> DataFrame:
    return wanted.join(available.select("model"), "model", "left_anti")


def company_match(announcements: DataFrame, stocks: DataFrame) -> DataFrame:
    """Announcements of a code, unless both names are there and neither holds the other."""
    j = announcements.join(stocks.withColumnRenamed("name", "stock_name"), "code")
    both = (F.length(F.coalesce("name", F.lit(""))) > 0) & (F.length(F.coalesce("stock_name", F.lit(""))) > 0)
    return j.where(~both | F.contains("name", F.col("stock_name")) | F.contains("stock_name", F.col("name")))


def unique_slug(rows: DataFrame, base: str = "slug", order: str = "pos") -> DataFrame:
    """Collisions get -2, -3 in order."""
    r = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("__r", r).withColumn("unique_slug", F.when(F.col("__r") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("__r").cast("string")))).drop("__r")


def producible(items: DataFrame, handled: DataFrame, least_bytes: int = 8 << 20, least_sec: int = 480) -> DataFrame:
    """items(id, bytes, duration) large and long enough to be worth producing, of unknown length included, not handled yet."""
    good = items.where((F.col("bytes") >= least_bytes) & ((F.col("duration") >= least_sec) | (F.coalesce("duration", F.lit(0)) == 0)))
    return good.join(handled.select("id").distinct(), "id", "left_anti")


def select_items(items: DataFrame, source: str | None = None, meetings: bool = False, n: int | None = None, order: str = "pos") -> DataFrame:
    """Items to fetch: of a source, or notices of meetings, or all; the first n."""
    if meetings:
        source = "shareholder_meeting"
    some = items if source is None else items.where(F.col("source") == source)
    return some if n is None else some.orderBy(order).limit(n)


def production_order(items: DataFrame, group: str = "source") -> DataFrame:
    """items(priority, bytes, id) with pos within the group: by priority, then size, largest first."""
    w = Window.partitionBy(group).orderBy("priority", F.desc("bytes"), "id")
    return items.withColumn("pos", F.row_number().over(w))


def min_duration(items: DataFrame, least_sec: int = 1200) -> DataFrame:
    """items(duration, id) of that length at least, longest first."""
    return items.where(F.col("duration") >= least_sec).orderBy(F.desc("duration"), "id")


def must_contain(text: Column, keyword: str) -> Column:
    return F.contains(text, F.lit(keyword))


def daily_quota(rows: DataFrame, ok_most: int = 5, tried_most: int = 10, day: str = "day", order: str = "pos") -> DataFrame:
    """Attempts of each day that are made: the first tried_most, while fewer than ok_most before them succeeded."""
    w = Window.partitionBy(day).orderBy(order)
    before = F.coalesce(F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__n", F.row_number().over(w)).withColumn("__b", before).where((F.col("__n") <= tried_most) & (F.col("__b") < ok_most)).drop("__n", "__b")


# ---- batch twins of the streaming rules


def min_interval(rows: DataFrame, seconds: int, key: str = "source", ts: str = "ts") -> DataFrame:
    """(key, ts) of rows at least `seconds` after the last accepted one of their key; times count once, null times not. Each
    key's times pass in order, a batch at a time, so a key may be of any length."""
    import numpy as np
    import pandas as pd

    one = rows.select(key, F.col(ts).cast("bigint").alias(ts)).where(F.col(ts).isNotNull()).distinct()
    if seconds <= 0:
        return one

    def accept(parts):
        own, last = None, None
        for part in parts:
            keys, times = part[key], part[ts].to_numpy()
            other = keys.ne(keys.shift()) & ~(keys.isna() & keys.shift().isna())
            edges = [0, *(np.flatnonzero(other.to_numpy()[1:]) + 1).tolist(), len(times)] if len(times) else [0]
            taken: list[int] = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                k = None if pd.isna(keys.iloc[lo]) else keys.iloc[lo]
                if lo or last is None or k != own:
                    own, last = k, None
                t, at = times[lo:hi], 0
                while last is None or (at := int(np.searchsorted(t, last + seconds))) < len(t):
                    taken.append(lo + at)
                    last = t[at]
            yield part.iloc[taken]

    return one.repartition(key).sortWithinPartitions(key, ts).mapInPandas(accept, one.schema)


def retry_state(failures: DataFrame, now_s: int, back_off_s: int = 1800, most: int = 3) -> DataFrame:
    """failures(key, ts) to (key, retries, state): rejected at the third, else backing off for half an hour, then ready."""
    s = failures.groupBy("key").agg(F.count("*").alias("retries"), F.max("ts").alias("last"))
    state = F.when(F.col("retries") >= most, "rejected").when(F.lit(now_s) - F.col("last") >= back_off_s, "ready").otherwise("backing_off")
    return s.select("key", "retries", state.alias("state"))

