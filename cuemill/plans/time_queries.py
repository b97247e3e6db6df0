"""Queries of the time rules, in batch; tests hold the streams against these twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions.timecode import link_expiry
from cuemill.operators import feeds as P
from cuemill.operators import times as R
from cuemill.sources import item_store
from cuemill.sources.files import shared_folder
from cuemill.streaming import ordered

from .catalog import query

c = F.col


def timed(v):
    return v.items.select("key", "source", c("publish_s").alias("ts"))


def stored(v):
    """All items, written in three batches by the hour of the event, and the last of each id as the store reads it."""
    target = shared_folder(v.spark, "items")
    rows = v.items.select("event_id", "id", "source", "author", "publish_s", c("extra").alias("title"), F.floor(c("publish_s") / 3600 % 3).alias("part"))
    for number in range(3):
        item_store.write_batch(rows.where(c("part") == number).drop("part"), target, number, F.lit(100 + number), "event_id", least_pending=200, fan=2)
    return item_store.read_items(v.spark, target)


query("r01_item_store", "SELECT id, max_by(source, -part) AS source, 100 + min(part) AS created_at, max_by(author, part) AS author, max_by(publish_s, part) AS publish_s, max_by(title, part) AS title, 100 + max(part) AS updated_at FROM l GROUP BY id",
      ctes="l AS (SELECT id, (publish_s // 3600) % 3 AS part, max_by(source, event_id) AS source, max_by(author, event_id) AS author, max_by(publish_s, event_id) AS publish_s, max_by(extra, event_id) AS title FROM items GROUP BY 1, 2)")(stored)
query("r02_dedupe_within", "SELECT key, ts FROM (SELECT key, ts, lag(ts) OVER (PARTITION BY key ORDER BY ts) AS b FROM (SELECT DISTINCT key, publish_s AS ts FROM items)) WHERE b IS NULL OR ts - b >= 172800")(lambda v: R.dedupe_within(timed(v), 172800, "key"))
query("r04_same_video_cooldown", "SELECT key, publish_s AS ts FROM g WHERE ok", ctes="o AS (SELECT key, publish_s, row_number() OVER (PARTITION BY key ORDER BY publish_s) AS i FROM (SELECT DISTINCT key, publish_s FROM items WHERE source = 'purchase')), "
      "g AS (SELECT key, publish_s, i, publish_s AS last, true AS ok FROM o WHERE i = 1 UNION ALL SELECT o.key, o.publish_s, o.i, CASE WHEN o.publish_s - g.last >= 172800 THEN o.publish_s ELSE g.last END, o.publish_s - g.last >= 172800 FROM g JOIN o ON o.key = g.key AND o.i = g.i + 1)")(
    lambda v: P.min_interval(timed(v).where("source = 'purchase'"), 172800, "key"))
query("r06_publish_timeout", "SELECT key, ts + 43200 AS failed_at FROM (SELECT key, min(publish_s) AS ts FROM items WHERE source = 'purchase' GROUP BY key) d WHERE NOT EXISTS (SELECT 1 FROM items p WHERE p.source = 'signup' AND p.key = d.key AND p.publish_s BETWEEN ts AND ts + 43200)")(
    lambda v: R.timed_out(timed(v).where("source = 'purchase'"), timed(v).where("source = 'signup'")))
query("r07_link_expiry", "SELECT page_id, 1700000000 + page_id * 3600 - 600 AS refresh_s FROM urls")(lambda v: v.urls.select("page_id", (link_expiry(c("media_url")) - 600).alias("refresh_s")))
query("r08_daily_counts", "SELECT (publish_s + 28800)//86400 AS day, count(*) AS n FROM items GROUP BY 1")(lambda v: R.daily_counts(timed(v)))
query("r09_activity_sessions", "SELECT source, min(publish_s) AS first, max(publish_s) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY publish_s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN publish_s - lag(publish_s) OVER (PARTITION BY source ORDER BY publish_s, event_id) < 600 THEN 0 ELSE 1 END AS new FROM items)) GROUP BY source, run")(
    lambda v: R.sessions(timed(v), "source", 600))
query("r10_freshness_alert", "SELECT source, ts AS since, until FROM (SELECT source, ts, lead(ts) OVER (PARTITION BY source ORDER BY ts) AS until FROM (SELECT DISTINCT source, publish_s AS ts FROM items)) WHERE until - ts > 3600")(lambda v: R.quiet_spells(timed(v), "source", 1))


def dispatches(v):
    """Each purchase a dispatch; it is published by the next sign-up of its key, but for every third."""
    sent = v.items.where("source = 'purchase'").select(c("event_id").alias("key"), c("key").alias("video"), c("publish_s").alias("ts_s"))
    seen = v.items.where("source = 'signup'").select(c("key").alias("video"), c("publish_s").alias("at"))
    done = sent.where("key % 3 > 0").join(seen, "video").where("at > ts_s").groupBy("key").agg(F.min("at").alias("ts_s"))
    return sent.select("key", "ts_s", F.lit(0).alias("kind")).unionByName(done.select("key", "ts_s", F.lit(1).alias("kind")))


query("r06_retriggers", "SELECT key, ts_s, step FROM (SELECT key, done, t + 21601 * k AS ts_s, CASE WHEN k = 2 THEN 'failed' ELSE 'retry' END AS step FROM p, (SELECT unnest([1, 2]) AS k)) WHERE step = 'retry' AND (done IS NULL OR ts_s < done) UNION ALL SELECT key, t + 43201, 'failed' FROM p WHERE done IS NULL OR t + 43201 < done",
      ctes="p AS (SELECT s.event_id AS key, s.publish_s AS t, min(d.publish_s) AS done FROM (SELECT * FROM items WHERE source = 'purchase') s LEFT JOIN (SELECT * FROM items WHERE source = 'signup') d ON d.key = s.key AND d.publish_s > s.publish_s AND s.event_id % 3 > 0 GROUP BY 1, 2)")(
    lambda v: ordered.replayed(ordered.Retriggers(), dispatches(v)))
query("r07_link_refresh", "SELECT key, greatest(t, e - 600) AS ts_s, url FROM (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t) AS nxt FROM l) WHERE e > 0 AND (nxt IS NULL OR greatest(t, e - 600) < nxt)",
      ctes="l AS (SELECT key, publish_s AS t, max(concat(source, CAST(event_id AS STRING))) AS url, max(CASE WHEN key % 7 = 0 THEN 0 ELSE publish_s + 3600 * (key % 90) END) AS e FROM items GROUP BY 1, 2)")(
    lambda v: ordered.replayed(ordered.LinkRefresh(), v.items.groupBy("key", c("publish_s").alias("ts_s")).agg(F.max(F.concat("source", c("event_id").cast("string"))).alias("url"), F.max(F.when(c("key") % 7 == 0, 0).otherwise(c("publish_s") + 3600 * (c("key") % 90))).alias("expires_s"))))
query("r10_silence", "SELECT key, t + 1801 AS ts_s, t AS since_s FROM (SELECT key % 5 AS key, publish_s AS t, lead(publish_s) OVER (PARTITION BY key % 5 ORDER BY publish_s) AS nxt FROM items WHERE source <> 'error') WHERE nxt IS NULL OR t + 1801 < nxt")(
    lambda v: ordered.replayed(ordered.Silence(1800), v.items.select((c("key") % 5).alias("key"), c("publish_s").alias("ts_s"), (c("source") == "error").cast("int").alias("kind"))))
