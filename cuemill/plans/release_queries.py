"""Queries of the release, audit and frame operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.operators import frames as V
from cuemill.operators import quality as Q
from cuemill.operators import release as R

from .catalog import query

c = F.col
DAY = "DATE '1970-01-01'"

query("s23_build_queue", "SELECT slug, concat('ep', lpad(CAST(r AS STRING), 2, '0')) AS id, CAST(DATE '2024-05-01' + CAST(r - 1 AS INTEGER) AS DATE) AS scheduled_date, concat(status, '|x') AS tags, concat('u/', CAST(slug AS STRING), '/', CAST(slug AS STRING), '-ep', lpad(CAST(r AS STRING), 2, '0'), '.mp4') AS url FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY id) AS r FROM queue)")(
    lambda v: R.build_queue(v.queue.select("slug", F.lit("t").alias("title"), c("status").alias("speaker"), c("id").alias("ordinal")), F.lit("2024-05-01").cast("date"), "u", ["x"]).select("slug", "id", "scheduled_date", F.array_join("tags", "|").alias("tags"), "url"))
query("s25_release_inventory", "SELECT tag, CAST(coalesce(sum(coalesce(size, 0)), 0) AS BIGINT) AS bytes FROM releases GROUP BY tag")(lambda v: R.release_inventory(v.releases, v.releases))
query("s26_plan_assets", "SELECT slug, id, kind, concat(CAST(slug AS STRING), '-', CAST(id AS STRING), ext) AS asset FROM queue, (VALUES ('video', '.mp4'), ('cover_16x9', '-16x9.jpg'), ('cover_9x16', '-9x16.jpg')) t(kind, ext)")(lambda v: R.plan_assets(v.queue))
query("s28_merge_spec", "SELECT video_id AS doc, cue_index AS pos, replace(text, 'the', 'a') AS text, concat('zh ', substring(text, 1, 12)) AS translation FROM cues WHERE video_id % 4 > 0")(
    lambda v: R.merge_spec(v.cues.select(c("video_id").alias("doc"), c("cue_index").alias("pos"), "text"), v.cues.where("video_id % 4 > 0 OR cue_index > 1").select(c("video_id").alias("doc"), c("cue_index").alias("pos"), F.concat(F.lit("zh "), F.substring("text", 1, 12)).alias("translation")), [("the", "a")]).select("doc", "pos", "text", "translation"))
MAN = "rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, para_id) AS rank FROM clips)"
query("s32_build_manifest", "SELECT video_id, CAST(rank AS INTEGER) AS rank, concat(lpad(CAST(rank AS STRING), 2, '0'), '_t', CAST(para_id AS STRING), '.mp4') AS file, CASE WHEN score % 2 = 0 THEN start_ms + 5 ELSE start_ms END AS start_ms FROM rk", ctes=MAN)(
    lambda v: (lambda k: R.build_manifest(k.select("video_id", "rank", "start_ms", "end_ms", F.when(c("score") % 2 == 0, c("start_ms") + 5).alias("clip_start_ms"), F.lit(None).cast("bigint").alias("clip_end_ms")), k.select("video_id", "rank", F.concat(F.lit("t"), c("para_id").cast("string")).alias("title"))))(
        v.clips.selectExpr("*", "row_number() OVER (PARTITION BY video_id ORDER BY score DESC, para_id) AS rank")).select("video_id", "rank", "file", "start_ms"))
query("s31_build_meta", "SELECT video_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms, count(*) AS n_segments, string_agg(CAST(start_ms AS STRING), ',' ORDER BY start_ms, end_ms, para_id) AS starts FROM clips GROUP BY video_id")(
    lambda v: R.build_meta(v.clips, "m").select("video_id", "duration_ms", "n_segments", F.array_join(F.transform("segments", lambda s: s["start_ms"].cast("string")), ",").alias("starts")))
query("a11_batch_recency", "SELECT slug, max(batch_at) AS batch_at FROM idx GROUP BY slug")(lambda v: R.batch_recency(v.idx))
query("u02_prune_batches", "SELECT slug, id FROM idx WHERE slug IN (SELECT slug FROM (SELECT slug, max(batch_at) AS m FROM idx GROUP BY slug ORDER BY m DESC, slug DESC LIMIT 30))")(lambda v: R.prune_batches(v.idx, 30)[0].select("slug", "id"))
query("t10_keep_newest_assets", "SELECT tag FROM (SELECT tag, row_number() OVER (PARTITION BY tag % 9 ORDER BY created_at DESC, tag) AS r FROM releases) WHERE r > 10")(
    lambda v: R.keep_newest(v.releases.select("tag", c("tag").alias("id"), (c("tag") % 9).alias("g"), "created_at"), 10, "g").select("tag"))
EPS = "e AS (SELECT slug % 20 AS batch, slug, id, CASE WHEN n > 0 THEN CAST(DATE '1970-01-01' + CAST(batch_at//86400 AS INTEGER) AS DATE) END AS date, status = 'F' AS published FROM queue)"


def episodes(v):
    day = F.when(c("n") > 0, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c("batch_at") / 86400).cast("int")))
    return v.queue.select((c("slug") % 20).alias("batch"), "slug", "id", day.alias("date"), (c("status") == "F").alias("published"))


def today():
    return F.lit("1997-01-01").cast("date")


HERO = "h AS (SELECT batch, id FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN date = DATE '1997-01-01' THEN 0 WHEN date > DATE '1997-01-01' THEN 1 WHEN date IS NOT NULL THEN 2 ELSE 3 END, coalesce(abs(date_diff('day', DATE '1997-01-01', date)), 0), id) AS r FROM e WHERE NOT published) WHERE r = 1)"
query("t12_sort_episodes", "SELECT batch, id, CAST(row_number() OVER (PARTITION BY batch ORDER BY date ASC NULLS LAST, slug, id) AS INTEGER) AS pos FROM e", ctes=EPS)(lambda v: R.sort_episodes(episodes(v)).select("batch", "id", "pos"))
query("t13_hero_pick", "SELECT batch, id FROM h", ctes=f"{EPS}, {HERO}")(lambda v: R.hero_pick(episodes(v), today()))
query("t14_past_upcoming", "SELECT e.batch, e.id, CASE WHEN date < DATE '1997-01-01' THEN 'past' ELSE 'upcoming' END AS part FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.batch = e.batch AND h.id = e.id)", ctes=f"{EPS}, {HERO}")(
    lambda v: R.past_upcoming(episodes(v), today(), R.hero_pick(episodes(v), today())).select("batch", "id", "part"))

query("a01_count_by", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")(lambda v: Q.count_by(v.documents, "source", "lang"))
query("a02_link_health", "SELECT source, count(*) AS total, count(*) FILTER (WHERE key % 3 > 0) AS n_ok, CAST(coalesce(sum(CASE WHEN key % 3 > 0 THEN duration END), 0) AS BIGINT) AS ok_bytes FROM items GROUP BY ROLLUP (source)")(
    lambda v: Q.link_health(v.items.select("source", (c("key") % 3 > 0).alias("ok"), c("duration").alias("bytes"))))
query("a03_link_status", "SELECT event_id, key % 4 < 2 OR key * 1000 > 200000 AS ok, CAST(key * 1000 AS BIGINT) AS bytes FROM items")(
    lambda v: v.items.select("event_id", Q.link_status(F.when(c("key") % 4 == 0, F.lit("video/mp4")), F.concat(F.lit("bytes 0-1/"), (c("key") * 1000).cast("string")), F.lit(5), F.when(c("key") % 4 == 1, 3)).alias("s")).select("event_id", "s.ok", "s.bytes"))
query("a05_freshness", "SELECT source, (1706800000 - max(publish_s))//3600 AS hours, 1706800000 - max(publish_s) > 172800 AS stale FROM items GROUP BY source")(lambda v: Q.freshness(v.items.select("source", c("publish_s").alias("updated_s")), 1706800000))
query("a06_capacity", "SELECT CAST(sum(duration) AS BIGINT) AS bytes, sum(duration) > 1000000 AS over FROM items")(lambda v: Q.capacity(v.items.select(c("duration").alias("bytes")), 1000000))
query("a07_seed_staleness", "SELECT source AS kind, count(*) AS n, 19800 - max(publish_s//86400) > 45 AS stale FROM items GROUP BY source")(lambda v: Q.seed_staleness(v.items.select(c("source").alias("kind"), F.floor(c("publish_s") / 86400).alias("day")), 19800))
query("a08_health_report", "SELECT coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 3 = 0 AND n_regionkey < 2), '') AS fail, coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 3 = 0 AND n_regionkey >= 2), '') AS warn FROM nation")(
    lambda v: Q.health_report(v.nation.select(c("n_name").alias("name"), (c("n_nationkey") % 3 > 0).alias("ok"), F.when(c("n_regionkey") < 2, "fail").otherwise("warn").alias("level"))))
LEAD = "l AS (SELECT a.id AS key, min(v.day) AS first, a.day, count(*) AS hits, min(v.day) - a.day AS lead FROM announce a JOIN up_videos v ON v.id = a.id AND v.day - a.day BETWEEN 0 AND 14 GROUP BY a.id, a.day)"


def leads(v):
    return Q.lead_time(v.announce.select(c("id").alias("key"), "day"), v.up_videos.select(c("id").alias("key"), "day"))


query("j12_lead_time", "SELECT * FROM l", ctes=LEAD)(leads)
query("a12_lead_summary", "SELECT count(*) FILTER (WHERE lead > 0) AS wins, count(*) AS n, CAST(sum(lead) AS BIGINT) AS total_lead FROM l", ctes=LEAD)(lambda v: Q.lead_summary(leads(v)))
query("j14_topic_coverage", "SELECT topic, theirs, ours, ours >= 0.15 * theirs AS ok FROM (SELECT author AS topic, count(*) FILTER (WHERE source <> 'view') AS theirs, count(*) FILTER (WHERE source = 'view' AND key < 200) AS ours FROM items GROUP BY author) WHERE theirs >= 8")(
    lambda v: Q.topic_coverage(v.items.where("source <> 'view'").select(c("author").alias("topic")), v.items.where("source = 'view' AND key < 200").select(c("author").alias("topic"))))
query("a13_longform_coverage", "SELECT count(DISTINCT CASE WHEN id IN (SELECT id FROM items WHERE key < 100) THEN id END) AS hit, count(DISTINCT id) AS total FROM items WHERE duration >= 1200")(lambda v: Q.longform_coverage(v.items.select("id", c("duration").alias("sec")), v.items.where("key < 100")))
query("a26_publish_dashboard", "SELECT count(*) FILTER (WHERE source = 'signup') AS published, count(*) FILTER (WHERE source = 'signup' AND 1706800000 - publish_s < 604800) AS recent, 1706800000 - max(CASE WHEN source = 'signup' THEN publish_s END) > 21600 AS quiet, count(*) FILTER (WHERE source = 'purchase') AS pending, "
      "count(*) FILTER (WHERE source = 'purchase' AND 1706800000 - publish_s > 21600) AS stuck, count(*) FILTER (WHERE source = 'purchase' AND 1706800000 - publish_s > 86400) AS alarm FROM items")(
    lambda v: Q.publish_dashboard(v.items.where("source = 'signup'").select(c("publish_s").alias("ts")), v.items.where("source = 'purchase'").select(c("publish_s").alias("ts")), 1706800000))
query("a30_deliverable_status", "SELECT tag % 50 AS slug, round(CAST(sum(size) AS DOUBLE) / 1048576, 1) AS mb, count(*) AS segments FROM releases GROUP BY tag % 50")(lambda v: Q.deliverable_status(v.releases.select((c("tag") % 50).alias("slug"), c("size").alias("bytes"))))
query("a29_glossary_flatten", "SELECT en, zh, CAST(row_number() OVER (ORDER BY length(en) DESC, en) AS INTEGER) AS pos FROM (SELECT n_name AS en, arg_max(CAST(s_suppkey AS STRING), s_suppkey) AS zh FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)")(
    lambda v: Q.glossary_flatten(v.supplier.join(v.nation, c("s_nationkey") == c("n_nationkey")).select(c("s_suppkey").alias("ord"), c("n_name").alias("en"), c("s_suppkey").cast("string").alias("zh"))))
query("a14_band_stats", "SELECT video_id, y, round(avg(energy), 3) AS mean, round(stddev_pop(energy), 3) AS std FROM row_profile GROUP BY video_id, y")(lambda v: V.band_stats(v.row_profile).select("video_id", "y", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std")))
SCORE = "st AS (SELECT video_id, y, avg(energy) AS mean, stddev_pop(energy) AS std FROM row_profile GROUP BY video_id, y), sc AS (SELECT video_id, y, coalesce((mean - min(mean) OVER w) / nullif(max(mean) OVER w - min(mean) OVER w, 0) * ((std - min(std) OVER w) / nullif(max(std) OVER w - min(std) OVER w, 0)), 0) AS score FROM st WINDOW w AS (PARTITION BY video_id))"
query("a15_locate_band", "SELECT video_id, first AS top, last AS bottom, n FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, first DESC) AS k FROM (SELECT video_id, i, min(y) AS first, max(y) AS last, count(*) AS n FROM b GROUP BY video_id, i)) WHERE k = 1 AND first >= 35.2 AND last - first + 1 <= 19.2",
      ctes=SCORE + ", lo AS (SELECT * FROM sc WHERE y >= 38), cu AS (SELECT video_id, greatest(0.12, avg(score) + stddev_pop(score)) AS cut FROM lo GROUP BY video_id), hi AS (SELECT lo.video_id, y FROM lo JOIN cu USING (video_id) WHERE score >= cut), l AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY video_id ORDER BY y) <= 2 THEN 0 ELSE 1 END AS new FROM hi), b AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY y) AS i FROM l)")(
    lambda v: V.locate_band(V.band_score(V.band_stats(v.row_profile)), 64))
query("a16_band_textness", "SELECT video_id, y, round(coalesce(sum(energy % 50) / nullif(sum(energy % 100), 0), 0), 6) AS textness, round(coalesce(sum(energy % 7) / nullif(sum(energy % 100), 0), 0), 6) AS whiteness FROM row_profile GROUP BY video_id, y")(
    lambda v: V.band_textness(v.row_profile.select("video_id", "y", (c("energy") % 100).alias("bright"), (c("energy") % 50).alias("trans"), (c("energy") % 7).alias("white"), F.lit(0).alias("chroma")), "video_id", "y").select("video_id", "y", F.round("textness", 6).alias("textness"), F.round("whiteness", 6).alias("whiteness")))
query("a18_cue_band", "SELECT frame_no % 200 AS cue, min(CASE WHEN frame_no % 200 < 150 AND sharpness % 2 = 0 THEN blue END) AS top, CASE WHEN min(CASE WHEN frame_no % 200 < 150 AND sharpness % 2 = 0 THEN blue END) IS NULL THEN string_agg(DISTINCT person, ',' ORDER BY person) END AS reasons FROM frames GROUP BY frame_no % 200")(
    lambda v: V.cue_band(v.frames.select((c("frame_no") % 200).alias("cue"), F.when((c("frame_no") % 200 < 150) & (c("sharpness") % 2 == 0), c("blue")).alias("top"), c("person").alias("reason"))))
query("a19_margin_plan", "SELECT frame_no, CASE WHEN blue = 0 THEN 96 WHEN blue * 40 * 2 >= 480 THEN 480 - blue * 40 + 24 END AS margin FROM frames")(lambda v: v.frames.select("frame_no", V.margin_plan(F.when(c("blue") > 0, c("blue") * 40), F.lit(480)).alias("margin")))
TOP2 = "t2 AS (SELECT video_id, frame_no, min(2 * x + w) AS left_x, max(2 * x + w) AS right_x, CAST(sum(w * h) AS BIGINT) AS area FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_no ORDER BY w * h DESC, x, y, w) AS r FROM faces) WHERE r <= 2 GROUP BY video_id, frame_no HAVING count(*) = 2)"
query("t20_top2_faces", "SELECT * FROM t2", ctes=TOP2)(lambda v: V.top2_faces(v.faces))
query("a20_split_screen", "SELECT v.video_id, coalesce(paired, 0) AS paired, CASE WHEN coalesce(paired, 0) < 4 OR jl >= 1100.8 OR jr >= 1100.8 THEN 'not_split' WHEN ls >= 1.3 * rs THEN 'left' WHEN rs >= 1.3 * ls THEN 'right' ELSE 'indeterminate' END AS verdict FROM (SELECT DISTINCT video_id FROM faces) v LEFT JOIN stt USING (video_id) LEFT JOIN sd USING (video_id)",
      ctes=TOP2 + ", pr AS (SELECT * FROM t2 WHERE right_x - left_x >= 1024), stt AS (SELECT video_id, count(*) AS paired, max(left_x) - min(left_x) AS jl, max(right_x) - min(right_x) AS jr, quantile_cont(left_x, 0.5) AS ml, quantile_cont(right_x, 0.5) AS mr FROM pr GROUP BY video_id), "
      "fx AS (SELECT f.video_id, frame_no, 2 * x + w AS cx, w * h AS area, ml, mr FROM faces f JOIN stt USING (video_id)), nr AS (SELECT *, abs(cx - ml) <= abs(cx - mr) AS l FROM fx WHERE least(abs(cx - ml), abs(cx - mr)) <= 512), "
      "sd AS (SELECT video_id, coalesce(sum(CASE WHEN l THEN area END), 0) * count(DISTINCT CASE WHEN l THEN frame_no END) AS ls, coalesce(sum(CASE WHEN NOT l THEN area END), 0) * count(DISTINCT CASE WHEN NOT l THEN frame_no END) AS rs FROM nr GROUP BY video_id)")(
    lambda v: V.split_screen(v.faces, jitter=0.43))
query("a21_crop_margin", "SELECT video_id, m - m % 2 AS margin FROM (SELECT video_id, least(min(least(blue * 10, cover_score * 9)), min(gray + 3), 120) AS m FROM frames GROUP BY video_id)")(
    lambda v: V.crop_margin(v.frames.select("video_id", (c("blue") * 10).alias("top"), (c("cover_score") * 9).alias("bottom"), (c("gray") + 3).alias("face_room")), 480))
query("a22_vote_frames", "SELECT video_id, count(*) >= 2 AND count(*) FILTER (WHERE blue = 1) >= 2 AS found FROM frames GROUP BY video_id")(lambda v: V.vote_frames(v.frames.select("video_id", (c("blue") == 1).alias("hit"))))
query("a23_color_class", "SELECT frame_no, CASE WHEN blue >= 6 AND gray >= 35 THEN 'two' WHEN blue >= 6 THEN 'host' WHEN gray >= 35 THEN 'speaker' ELSE 'unsure' END AS kind FROM frames")(lambda v: v.frames.select("frame_no", V.color_class(c("blue"), c("gray"), 6, 35).alias("kind")))
query("a27_rejection_summary", "SELECT video_id, count(*) FILTER (WHERE cover_score < 9) AS rejected, max(CASE WHEN cover_score < 9 THEN cover_score END) AS best, count(*) FILTER (WHERE cover_score < 9) > 5 AND count(*) FILTER (WHERE cover_score >= 9) = 0 AS give_up FROM frames GROUP BY video_id")(
    lambda v: V.rejection_summary(v.frames.select("video_id", (c("cover_score") >= 9).alias("passed"), c("cover_score").alias("score"))))
query("f09_brightness_band", "SELECT frame_no FROM frames WHERE brightness BETWEEN 40 AND 230")(lambda v: V.brightness_band(v.frames).select("frame_no"))
query("t15_best_frame_geometric", "SELECT video_id, frame_no FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sharpness DESC, frame_no) AS r FROM frames WHERE blue % 2 = 0 AND brightness BETWEEN 40 AND 230) WHERE r = 1")(
    lambda v: V.best_frame_geometric(v.frames.withColumn("face_ok", c("blue") % 2 == 0)))
query("t16_face_prefilter", "SELECT frame_no FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY (blue = 1) DESC, cover_score DESC, frame_no) AS r, count(*) FILTER (WHERE blue = 1) OVER (PARTITION BY video_id) AS n, max(cover_score) OVER (PARTITION BY video_id) AS big FROM frames) WHERE big <= 0 OR blue = 1 OR (n < 8 AND r <= 8)")(
    lambda v: V.face_prefilter(v.frames.select("video_id", "frame_no", c("cover_score").alias("face_area"), (c("blue") == 1).alias("passing"))).select("frame_no"))
query("t17_best_frame_scored", "SELECT video_id, frame_no FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cover_score * 5000 + sharpness DESC, frame_no) AS r FROM frames WHERE person = (SELECT min(person) FROM frames) AND cover_score >= 6) WHERE r = 1")(
    lambda v: (lambda m: V.best_frame_scored(v.frames.join(F.broadcast(m), "person").withColumn("person", F.lit("x")), "x"))(v.frames.agg(F.min("person").alias("person"))))
query("t18_best_portrait", "SELECT video_id, coalesce(arg_max(frame_no, CASE WHEN blue > 0 THEN (least(blue * 25, 220) * 20 + least(sharpness, 900)) * 100000 - frame_no END), max(CASE WHEN r = n//2 + 1 THEN frame_no END)) AS frame_no FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_no) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM frames) GROUP BY video_id")(
    lambda v: V.best_portrait(v.frames.select("video_id", "frame_no", (c("blue") * 25).alias("area_pm"), "sharpness")))
