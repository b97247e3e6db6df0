"""Queries of the feed, dispatch and publishing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.operators import feeds as P
from cuemill.operators import model_calls as M
from cuemill.operators import quality as Q
from cuemill.sources import item_days
from cuemill.sources.files import shared_folder

from .catalog import query

c = F.col
NOW = 1706600000
STORE = "s AS (SELECT id, source, concat('old ', id) AS title, 'u' AS url, 7 AS publish_s, id AS author, '{}' AS extra, 1 AS created_at, 2 AS updated_at FROM (SELECT DISTINCT id, source FROM items WHERE key < 300))"
BATCH = "b AS (SELECT id, source, concat('new ', CAST(event_id AS STRING)) AS title, CASE WHEN event_id % 3 > 0 THEN concat('u', CAST(key AS STRING)) END AS url, publish_s, author, extra, event_id AS pos FROM items WHERE key >= 200)"


def store(v):
    return v.items.where("key < 300").select("id", "source").distinct().select("id", "source", F.concat(F.lit("old "), "id").alias("title"), F.lit("u").alias("url"), F.lit(7).cast("bigint").alias("publish_s"), c("id").alias("author"), F.lit("{}").alias("extra"), F.lit(1).alias("created_at"), F.lit(2).alias("updated_at"))


def batch(v):
    return v.items.where("key >= 200").select("id", "source", F.concat(F.lit("new "), c("event_id").cast("string")).alias("title"), F.when(c("event_id") % 3 > 0, F.concat(F.lit("u"), c("key").cast("string"))).alias("url"), "publish_s", "author", "extra", c("event_id").alias("pos"))


def handled(v, kind):
    return v.items.where(c("source") == kind)


query("s14_unify_items", "SELECT id, source, author, NULL::INTEGER AS duration FROM items WHERE source = 'click' UNION ALL SELECT id, source, NULL, duration FROM items WHERE source = 'view'")(
    lambda v: P.unify_items(v.items.where("source = 'click'").select("id", "source", "author"), v.items.where("source = 'view'").select("id", "source", "duration")))
query("u03_new_items", "SELECT id, min(pos) AS pos FROM b WHERE id NOT IN (SELECT id FROM s) GROUP BY id", ctes=f"{STORE}, {BATCH}")(lambda v: P.new_items(batch(v), store(v)).select("id", "pos"))
query("s17_export_items", "SELECT event_id, CASE WHEN key % 2 = 0 THEN extra ELSE '{}' END AS extra FROM items")(
    lambda v: P.export_items(v.items.select("event_id", F.when(c("key") % 2 == 0, c("extra")).otherwise(F.lit("{bad")).alias("extra"), "publish_s", c("event_id").alias("created_at"))).select("event_id", "extra"))
query("s18_merge_seeds", "SELECT event_id AS pos, CASE WHEN key % 5 > 0 THEN concat('1000000000000000', CAST(key AS STRING)) END AS seed_id, CASE WHEN key % 5 = 0 THEN 'invalid' WHEN key < 100 OR row_number() OVER (PARTITION BY key ORDER BY event_id) > 1 THEN 'skipped' ELSE 'added' END AS outcome FROM items")(
    lambda v: P.merge_seeds(v.items.where("key < 100").select(F.concat(F.lit("1000000000000000"), c("key").cast("string")).alias("seed_id")), v.items.select(c("event_id").alias("pos"), F.when(c("key") % 5 > 0, F.concat(F.lit('"x/1000000000000000'), c("key").cast("string"), F.lit('"'))).otherwise(F.lit("none")).alias("line"))).select("pos", "seed_id", "outcome"))
query("s19_seed_stats", "SELECT source AS kind, count(*) AS n, max(publish_s) AS last FROM items GROUP BY source")(lambda v: P.seed_stats(v.items.select(c("source").alias("kind"), c("publish_s").alias("updated_at"))))
query("s22_append_log", "SELECT ts, seq, substring(kind, 1, 120) AS kind FROM (SELECT publish_s AS ts, event_id AS seq, source AS kind FROM items ORDER BY publish_s DESC, event_id DESC LIMIT 200)")(
    lambda v: P.append_log(*[v.items.where(f"key % 2 = {k}").select(c("publish_s").alias("ts"), c("event_id").alias("seq"), c("source").alias("kind"), F.lit("m").alias("msg"), F.lit("d").alias("detail")) for k in (0, 1)]).select("ts", "seq", "kind"))
query("t11_tail", "SELECT event_id FROM items ORDER BY publish_s DESC, event_id DESC LIMIT 40")(lambda v: P.tail(v.items, [F.desc("publish_s"), F.desc("event_id")], 40).select("event_id"))
query("s29_catalogue_upsert", "SELECT key, max(source) AS season FROM items GROUP BY key")(
    lambda v: P.catalogue_upsert(v.items.where("event_id % 2 = 0").select("key", c("source").alias("season")), v.items.where("event_id % 2 = 1").select("key", c("source").alias("season"))))
query("f01_noise_with_rescue", "SELECT doc_id FROM titles WHERE NOT (regexp_matches(title, 'the|der') AND NOT regexp_matches(title, 'ing|sch'))")(lambda v: v.titles.where(P.noise_with_rescue(c("title"), "the|der", "ing|sch")).select("doc_id"))
query("f02_noise_drop", "SELECT doc_id FROM titles WHERE NOT regexp_matches(title, 'ea') AND NOT regexp_matches(title, '^T.e')")(lambda v: v.titles.where(P.noise_drop(c("title"), "ea", "^T.e")).select("doc_id"))
query("f04_has_playable", "SELECT event_id, key % 4 IN (0, 1, 2) AS playable FROM items")(
    lambda v: v.items.select("event_id", P.has_playable(F.when(c("key") % 4 == 0, F.lit("http://v")), F.when(c("key") % 4 == 1, F.lit('{"has_video":true}')).otherwise(c("extra")), F.when(c("key") % 4 == 2, F.lit("https://www.bilibili.com/video/BV1"))).alias("playable")))
query("f05_duration_band", "SELECT event_id FROM items WHERE key % 5 = 0 OR duration = 0 OR duration BETWEEN 60 AND 1800")(
    lambda v: v.items.where(P.duration_band(F.when(c("key") % 5 == 0, F.lit("n/a")).otherwise(c("duration").cast("string")))).select("event_id"))
query("f14_within_days", f"SELECT event_id FROM items WHERE publish_s > {NOW} - 3 * 86400")(lambda v: v.items.where(P.within_days(F.when(c("key") % 2 == 0, c("publish_s")), c("publish_s"), NOW, 3)).select("event_id"))
HAND = "d AS (SELECT key, author AS video_id, publish_s AS ts FROM items WHERE source = 'purchase' AND key < 350), x AS (SELECT key, author AS video_id FROM items WHERE source = 'error' AND key % 9 = 0 AND CAST(author AS INT) < 20), rd AS (SELECT key, author AS video_id FROM items WHERE key % 7 = 0 AND CAST(author AS INT) < 60), pb AS (SELECT author AS video_id FROM items WHERE source = 'signup' AND CAST(author AS INT) < 30)"
query("j10_exclude_handled", f"SELECT event_id FROM items WHERE key NOT IN (SELECT key FROM (SELECT key FROM d UNION SELECT key FROM x) WHERE key NOT IN (SELECT key FROM rd)) AND author NOT IN (SELECT video_id FROM (SELECT video_id FROM d WHERE {NOW} - ts < 172800 UNION SELECT video_id FROM x) WHERE video_id NOT IN (SELECT video_id FROM rd)) AND author NOT IN (SELECT video_id FROM pb)", ctes=HAND)(
    lambda v: P.exclude_handled(v.items.select("event_id", "key", c("author").alias("video_id")), v.items.where("source = 'purchase' AND key < 350").select("key", c("author").alias("video_id"), c("publish_s").alias("ts")),
        v.items.where("source = 'error' AND key % 9 = 0 AND CAST(author AS INT) < 20").select("key", c("author").alias("video_id")), v.items.where("key % 7 = 0 AND CAST(author AS INT) < 60").select("key", c("author").alias("video_id")),
        v.items.where("source = 'signup' AND CAST(author AS INT) < 30").select(c("author").alias("video_id")), NOW).select("event_id"))
query("w17_prefix_dedupe", "SELECT min(doc_id) AS doc_id FROM titles GROUP BY substring(title, 1, 12)")(lambda v: P.prefix_dedupe(v.titles, 12, "doc_id").select("doc_id"))
query("w18_title_repeat_flag", "SELECT doc_id, row_number() OVER (PARTITION BY batch, title ORDER BY doc_id) > 1 AS repeats FROM titles")(lambda v: P.title_repeat_flag(v.titles, "batch", "doc_id").select("doc_id", "repeats"))
query("t21_feed_cap", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) AS r FROM items) WHERE r <= 60")(lambda v: P.feed_cap(v.items, 60, "source", "event_id").select("event_id"))
query("t07_pick", "SELECT event_id FROM (SELECT event_id, CASE WHEN age < 0 THEN 20 WHEN age <= 86400 THEN 15 WHEN age <= 259200 THEN 10 WHEN age <= 604800 THEN 5 ELSE 0 END + CASE WHEN duration BETWEEN 120 AND 600 THEN 10 WHEN duration > 600 AND duration <= 1200 THEN 8 WHEN duration BETWEEN 60 AND 119 THEN 2 ELSE 0 END AS score FROM "
      f"(SELECT *, {NOW} - publish_s AS age, row_number() OVER (PARTITION BY substring(concat('talk ', id), 1, 12) ORDER BY event_id) AS r FROM items WHERE NOT regexp_matches(id, 'error') AND (duration = 0 OR duration BETWEEN 60 AND 1800) AND key NOT IN (SELECT key FROM items WHERE source = 'purchase' AND key < 600)) WHERE r = 1) ORDER BY score DESC, event_id LIMIT 10")(
    lambda v: P.pick(v.items.select("event_id", c("event_id").alias("pos"), "key", F.concat(F.lit("talk "), "id").alias("title"), "source", "publish_s", "duration"), v.items.where("source = 'purchase' AND key < 600"), "talk", "error", NOW, 10).select("event_id"))
query("t08_pick_newest", "SELECT event_id FROM items WHERE duration > 0 AND key NOT IN (SELECT key FROM items WHERE source = 'purchase') ORDER BY publish_s DESC, event_id LIMIT 10")(
    lambda v: P.pick_newest(v.items.select("event_id", c("event_id").alias("pos"), "key", c("duration").alias("bytes"), "publish_s"), handled(v, "purchase"), 10).select("event_id"))
PUB = "p AS (SELECT doc_id AS slug, CASE WHEN doc_id % 4 = 0 THEN batch ELSE '' END AS source_url, title FROM titles WHERE doc_id % 2 = 0), q AS (SELECT doc_id AS slug, CASE WHEN doc_id % 15 = 0 THEN batch ELSE '-' END AS source_url, title FROM titles WHERE doc_id % 3 = 0)"
query("j15_published_guard", "SELECT DISTINCT p.slug FROM p JOIN q ON p.slug <> q.slug AND ((p.source_url <> '' AND p.source_url = q.source_url) OR p.title = q.title OR (length(p.title) >= 15 AND length(q.title) >= 15 AND substring(p.title, 1, 15) = substring(q.title, 1, 15)))", ctes=PUB)(
    lambda v: P.published_guard(v.titles.where("doc_id % 2 = 0").select(c("doc_id").alias("slug"), F.when(c("doc_id") % 4 == 0, c("batch")).otherwise(F.lit("")).alias("source_url"), "title"),
                                v.titles.where("doc_id % 3 = 0").select(c("doc_id").alias("slug"), F.when(c("doc_id") % 15 == 0, c("batch")).otherwise(F.lit("-")).alias("source_url"), "title")))
SLOTS = "n AS (SELECT DISTINCT publish_s AS now_s FROM items), a AS (SELECT now_s, ((now_s + 28800)//86400 + d) * 86400 + m * 60 - 28800 AS slot_s FROM n, (SELECT unnest([0, 1]) AS d), (SELECT unnest([660, 750, 900, 1080, 1260]) AS m)), f AS (SELECT * FROM a WHERE slot_s > now_s), res AS (SELECT slot_s FROM a WHERE slot_s % 7 < 4)"
query("j16_next_free_slot", "SELECT now_s, coalesce(min(CASE WHEN slot_s NOT IN (SELECT slot_s FROM res) THEN slot_s END), min(slot_s)) AS slot_s FROM f GROUP BY now_s", ctes=SLOTS)(
    lambda v: (lambda n: P.next_free_slot(n, P.slot_times(n.select(F.explode(F.array(*[F.floor((c("now_s") + 28800) / 86400) + d for d in (0, 1)])).alias("day")).distinct()).where("slot_s % 7 < 4").select(c("slot_s").alias("ts"))))(v.items.select(c("publish_s").alias("now_s")).distinct()))
query("j17_slot_delay_hours", "SELECT now_s, CAST(greatest(1, least(24, ceil((l[least(3, len(l))] - now_s) / 3600.0))) AS BIGINT) AS hours FROM (SELECT now_s, list(slot_s ORDER BY slot_s) AS l FROM f GROUP BY now_s)", ctes=SLOTS)(
    lambda v: P.slot_delay_hours(v.items.select(c("publish_s").alias("now_s")).distinct(), 2))
query("g05_assign_slots", "SELECT a.event_id, b.slot_s FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) AS r FROM items WHERE key % 3 = 0) a JOIN (SELECT source, publish_s AS slot_s, row_number() OVER (PARTITION BY source ORDER BY publish_s, event_id) AS r FROM items WHERE key % 3 = 1) b ON a.source = b.source AND a.r = b.r")(
    lambda v: P.assign_slots(v.items.where("key % 3 = 0").select(c("source").alias("batch"), c("event_id").alias("pos"), "event_id"), v.items.where("key % 3 = 1").select(c("source").alias("batch"), c("publish_s").alias("slot_s"))).select("event_id", "slot_s"))
query("j19_fresh_skip", f"SELECT DISTINCT key FROM items WHERE key NOT IN (SELECT key FROM items WHERE source = 'view' AND {NOW} - publish_s < 604800)")(
    lambda v: P.fresh_skip(v.items.select("key").distinct(), v.items.select("key", (c("source") == "view").alias("has_link"), c("publish_s").alias("updated_s")), NOW))
query("j20_cache_lookup", "SELECT event_id, CASE WHEN source <> 'view' THEN 'miss' WHEN event_id % 3 = 0 THEN 'corrupt' ELSE 'hit' END AS outcome FROM items")(
    lambda v: P.cache_lookup(v.items.select("event_id", c("event_id").alias("key")), v.items.where("source = 'view'").select(c("event_id").alias("key"), F.when(c("event_id") % 3 == 0, F.lit("{oops")).otherwise(c("extra")).alias("response"))).select("event_id", "outcome"))
query("a24_cache_stats", "SELECT count(*) FILTER (WHERE source = 'view') AS hits, count(*) FILTER (WHERE source <> 'view') AS misses FROM items")(
    lambda v: P.cache_stats(P.cache_lookup(v.items.select(c("event_id").alias("key")), v.items.where("source = 'view'").select(c("event_id").alias("key"), c("extra").alias("response")))))
query("j21_pending_status", f"SELECT event_id AS slug, CASE WHEN event_id % 11 = 0 THEN 'verify' WHEN event_id % 5 = 0 THEN 'ready' WHEN {NOW} - publish_s > 43200 THEN 'failed' WHEN key % 3 < 2 AND {NOW} - greatest(publish_s, CASE WHEN key % 2 = 0 THEN publish_s + 7200 ELSE 0 END) > 21600 THEN 'retry' ELSE 'wait' END AS step FROM items WHERE source <> 'signup'")(
    lambda v: P.pending_status(v.items.select(c("event_id").alias("slug"), c("publish_s").alias("ts"), (c("key") % 3).alias("retries"), F.when(c("key") % 2 == 0, c("publish_s") + 7200).alias("last_retry"), (c("event_id") % 11 == 0).alias("uploading")),
        handled(v, "signup").select(c("event_id").alias("slug")), v.items.where("event_id % 5 = 0").select(c("event_id").alias("slug")), NOW).select("slug", "step"))
query("j22_missing_models", "SELECT DISTINCT author AS model FROM items WHERE author NOT IN (SELECT author FROM items WHERE source = 'error')")(lambda v: P.missing_models(v.items.select(c("author").alias("model")).distinct(), handled(v, "error").select(c("author").alias("model"))))
query("j23_company_match", "SELECT c.c_custkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey % 3 <> 1")(
    lambda v: P.company_match(v.customer.join(v.nation.select(c("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_custkey", c("c_nationkey").alias("code"), F.when(c("c_custkey") % 3 == 0, F.lit("")).when(c("c_custkey") % 3 == 1, F.lit("??")).otherwise(F.concat(c("n_name"), F.lit(" AG"))).alias("name")),
                              v.nation.select(c("n_nationkey").alias("code"), c("n_name").alias("name"))).select("c_custkey"))
query("g06_unique_slug", "SELECT event_id, CASE WHEN r = 1 THEN id ELSE concat(id, '-', CAST(r AS STRING)) END AS unique_slug FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS r FROM items)")(lambda v: P.unique_slug(v.items, "id", "event_id").select("event_id", "unique_slug"))
query("g07_daily_quota", "SELECT event_id FROM (SELECT *, row_number() OVER w AS n, coalesce(sum(CASE WHEN key % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY publish_s//86400 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM items WINDOW w AS (PARTITION BY publish_s//86400 ORDER BY event_id)) WHERE n <= 10 AND b < 5")(
    lambda v: P.daily_quota(v.items.select("event_id", F.floor(c("publish_s") / 86400).alias("day"), (c("key") % 2 == 0).alias("ok")), 5, 10, "day", "event_id").select("event_id"))
query("r03_min_interval", "SELECT source, publish_s AS ts FROM f", ctes="o AS (SELECT source, publish_s, row_number() OVER (PARTITION BY source ORDER BY publish_s) AS i FROM (SELECT DISTINCT source, publish_s FROM items)), "
      "g AS (SELECT source, publish_s, i, publish_s AS last, true AS ok FROM o WHERE i = 1 UNION ALL SELECT o.source, o.publish_s, o.i, CASE WHEN o.publish_s - g.last >= 1800 THEN o.publish_s ELSE g.last END, o.publish_s - g.last >= 1800 FROM g JOIN o ON o.source = g.source AND o.i = g.i + 1), f AS (SELECT * FROM g WHERE ok)")(
    lambda v: P.min_interval(v.items.select("source", c("publish_s").alias("ts")), 1800))
query("r05_retry_machine", f"SELECT key, count(*) AS retries, CASE WHEN count(*) >= 3 THEN 'rejected' WHEN {NOW} - max(publish_s) >= 1800 THEN 'ready' ELSE 'backing_off' END AS state FROM items WHERE source = 'error' GROUP BY key")(
    lambda v: P.retry_state(handled(v, "error").select("key", c("publish_s").alias("ts")), NOW))


def upside_down(lines):
    """A model that knows no line with a q, and is down for one with a z, and whose replies are lines back to front."""
    if any("z" in t for t in lines):
        raise OSError("down")
    return [None if "q" in t else t[::-1] for t in lines]


def called_twice(v):
    """All titles asked for, in two runs; the second makes no call."""
    cache, asked = shared_folder(v.spark, "replies"), v.titles.select(c("doc_id").cast("string").alias("key"), c("title").alias("text"))
    first = M.call_model(asked, cache, upside_down, 1, batch=16)
    second = M.call_model(asked, cache, upside_down, 2, batch=16)
    calls = F.lit(min(first.calls, 1) + 2 * second.calls)
    reasons = M.rejected_rows(v.spark, cache).select("key", "reason")
    return second.rows.join(reasons, "key", "left").select("key", "response", "outcome", "reason", calls.cast("bigint").alias("calls"))


query("j20_model_calls", "SELECT CAST(doc_id AS STRING) AS key, CASE WHEN NOT (b OR z OR q) THEN reverse(title) END AS response, CASE WHEN b THEN 'rejected' WHEN z OR q THEN 'known_bad' ELSE 'hit' END AS outcome, CASE WHEN b THEN NULL WHEN z THEN 'OSError: down' WHEN q THEN 'no reply' END AS reason, CAST(1 AS BIGINT) AS calls "
      "FROM (SELECT *, trim(title) = '' AS b, contains(title, 'z') AS z, contains(title, 'q') AS q FROM titles)")(called_twice)


def by_days(v):
    """All items in folders by source and day."""
    target = shared_folder(v.spark, "days")
    item_days.write_days(v.items.select("event_id", "source", "publish_s"), target)
    return target


query("f14_recent_of_days", f"SELECT event_id, source FROM items WHERE publish_s > {NOW} - 3 * 86400 AND source IN ('view', 'click')")(
    lambda v: item_days.recent_items(v.spark, by_days(v), NOW, 3, ["view", "click"]).select("event_id", "source"))
query("a05_freshness_of_days", "SELECT source, (1706800000 - max(publish_s))//3600 AS hours, 1706800000 - max(publish_s) > 172800 AS stale FROM items GROUP BY source")(
    lambda v: Q.freshness(item_days.newest_of_sources(v.spark, by_days(v)), 1706800000))
