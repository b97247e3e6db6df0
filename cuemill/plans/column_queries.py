"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.functions import timecode as T

from .catalog import columns, query

c = F.col
HMS = "concat(lpad(CAST(floor(start_ms/3600000) AS STRING),2,'0'),':',lpad(CAST(floor(start_ms/60000)%60 AS STRING),2,'0'),':',lpad(CAST(floor(start_ms/1000)%60 AS STRING),2,'0')"
HMS_D = "concat(lpad(CAST(start_ms//3600000 AS STRING),2,'0'),':',lpad(CAST((start_ms//60000)%60 AS STRING),2,'0'),':',lpad(CAST((start_ms//1000)%60 AS STRING),2,'0')"

query("p01_hms_to_ms", "SELECT video_id, cue_index, start_ms AS ms FROM cues")(
    lambda v: v.cues.select("video_id", "cue_index", T.hms_to_ms(T.ms_to_srt(c("start_ms"))).alias("ms"))
)
columns("p02_ms_to_srt", "cues", "video_id cue_index", lambda: {"hms": T.ms_to_hms(c("start_ms")), "srt": T.ms_to_srt(c("start_ms"))},
        f"{HMS_D}) AS hms, {HMS_D},',',lpad(CAST(start_ms%1000 AS STRING),3,'0')) AS srt")
query("p03_duration_to_sec", "SELECT event_id, CAST(CASE key % 4 WHEN 0 THEN duration WHEN 1 THEN duration % 60 WHEN 2 THEN duration + 3600 ELSE 0 END AS BIGINT) AS sec FROM items")(
    lambda v: v.items.select("event_id", T.duration_to_sec(
        F.when(c("key") % 4 == 0, F.format_string("%d:%02d", (c("duration") / 60).cast("int"), c("duration") % 60))
        .when(c("key") % 4 == 1, (c("duration") % 60).cast("string"))
        .when(c("key") % 4 == 2, F.format_string("%d:%02d:%02d", (c("duration") / 3600).cast("int") + 1, (c("duration") / 60).cast("int") % 60, c("duration") % 60))
        .otherwise(F.lit("n/a"))).alias("sec")))
columns("p04_fmt_duration", "items", "event_id", lambda: {"d": T.fmt_duration(c("duration")), "page": T.fmt_duration_page(c("duration"))},
        "CASE WHEN duration <= 0 THEN '—' ELSE concat(CAST(duration//60 AS STRING),':',lpad(CAST(duration%60 AS STRING),2,'0')) END AS d, "
        "CASE WHEN duration >= 3600 THEN concat(CAST(duration//3600 AS STRING),':',lpad(CAST((duration//60)%60 AS STRING),2,'0'),':',lpad(CAST(duration%60 AS STRING),2,'0')) "
        "ELSE concat(lpad(CAST(duration//60 AS STRING),2,'0'),':',lpad(CAST(duration%60 AS STRING),2,'0')) END AS page")
query("p05_parse_view_count", "SELECT event_id, CASE WHEN key % 2 = 0 THEN CAST(duration * 1000 AS BIGINT) ELSE CAST(duration AS BIGINT) END AS views FROM items")(
    lambda v: v.items.select("event_id", T.parse_view_count(
        F.when(c("key") % 2 == 0, F.concat((c("duration") / 10).cast("decimal(12,1)").cast("string"), F.lit("万"))).otherwise(c("duration").cast("string"))).alias("views")))
query("p06_resolve_relative_date",
      "SELECT event_id, CASE key % 4 WHEN 0 THEN DATE '2024-03-10' WHEN 1 THEN DATE '2024-03-09' WHEN 2 THEN DATE '2024-02-05' ELSE DATE '2023-11-07' END AS day FROM items")(
    lambda v: v.items.select("event_id", T.resolve_relative_date(
        F.when(c("key") % 4 == 0, F.lit("今天")).when(c("key") % 4 == 1, F.lit("昨天")).when(c("key") % 4 == 2, F.lit("2-05")).otherwise(F.lit("2023-11-07")),
        F.lit("2024-03-10").cast("date")).alias("day")))
columns("p07_strip_tags", "urls", "page_id", lambda: {"text_sha": F.sha2(X.strip_tags(c("html")), 256)}, "sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_sha")
columns("p08_extract_id", "urls", "page_id", lambda: {"bv": X.extract_id(c("media_url"), "bv"), "video": X.extract_id(c("media_url"), "video")},
        "nullif(regexp_extract(media_url, '(BV\\w+)', 1), '') AS bv, nullif(regexp_extract(media_url, '/video/([^/?#]+)', 1), '') AS video")
columns("p09_video_id_of", "urls", "page_id", lambda: {"vid": X.video_id_of(F.when(c("page_id") % 2 == 0, c("media_url")), F.when(c("page_id") % 3 == 0, c("url")), c("page_id").cast("string"))},
        "coalesce(CASE WHEN page_id % 2 = 0 THEN nullif(regexp_extract(media_url, '(BV\\w+)', 1), '') END, CASE WHEN page_id % 3 = 0 THEN split_part(url, '?', 1) END, "
        "CASE WHEN page_id % 2 = 0 THEN media_url END, CAST(page_id AS STRING)) AS vid")
columns("p10_platform_of", "items", "event_id", lambda: {"platform": X.platform_of(F.when(c("key") % 3 == 0, F.lit("Bilibili_Search")).when(c("key") % 3 == 1, F.lit("")).otherwise(c("source")))},
        "CASE key % 3 WHEN 0 THEN 'bilibili' WHEN 1 THEN 'unknown' ELSE source END AS platform")
columns("p11_stable_id", "items", "event_id", lambda: {"sid": X.stable_id(c("id")), "short": X.stable_id(c("id"), 6)}, "substring(md5(id),1,16) AS sid, substring(md5(id),1,6) AS short")
columns("p12_make_slug", "urls", "page_id", lambda: {"slug": X.make_slug(F.lit("ly"), F.lit("talk"), F.lit("web"), F.when(c("page_id") % 2 == 0, c("media_url")).otherwise(c("url")))},
        "concat('ly-talk-web-', CASE WHEN page_id % 2 = 0 THEN regexp_extract(media_url, '(BV\\w+)', 1) "
        "WHEN length(regexp_replace(url, '\\D', '', 'g')) >= 10 THEN right(regexp_replace(url, '\\D', '', 'g'), 10) ELSE substring(md5(url),1,8) END) AS slug")
columns("p13_safe_filename", "titles", "doc_id", lambda: {"name": X.safe_filename(F.concat(c("title"), F.lit('?/:*')))},
        "coalesce(nullif(trim(substring(trim(regexp_replace(regexp_replace(concat(title, '?/:*'), '[\\\\/:*?\"<>|\\x00-\\x1f]', '', 'g'), '\\s+', ' ', 'g')), 1, 40)), ''), 'video') AS name")
columns("p15_link_expiry", "urls", "page_id", lambda: {"expires": T.link_expiry(c("media_url")), "expired": T.link_expiry(c("media_url")) < 1700300000},
        "CAST(1700000000 + page_id * 3600 AS BIGINT) AS expires, 1700000000 + page_id * 3600 < 1700300000 AS expired")
columns("p16_clean_feed_title", "urls", "page_id", lambda: {"title": X.clean_feed_title(F.regexp_extract(c("html"), "<title>([^<]*)</title>", 1))},
        "trim(regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '^[^,_|]*')) AS title")
query("p18_days_until", "SELECT id, CAST(day - 19800 AS INT) AS days, day - 19800 BETWEEN 0 AND 30 AS upcoming FROM announce")(
    lambda v: v.announce.select("id", T.days_until(F.date_add(F.lit("1970-01-01").cast("date"), c("day").cast("int")), F.date_add(F.lit("1970-01-01").cast("date"), 19800)).alias("days"),
                                T.is_upcoming(F.date_add(F.lit("1970-01-01").cast("date"), c("day").cast("int")), F.date_add(F.lit("1970-01-01").cast("date"), 19800)).alias("upcoming")))
query("p26_parse_reply_array", "SELECT doc_id, quality AS score, toxic AS ratio FROM labels")(
    lambda v: v.labels.select("doc_id", F.inline(X.reply_array(
        F.when(c("doc_id") % 2 == 0, F.format_string('noise [{"score": %d, "ratio": %d}] end', "quality", "toxic"))
        .otherwise(F.format_string("x [{score: %d, 'ratio': %d,},] y", "quality", "toxic")), "array<struct<score:int,ratio:int>>"))))
query("p28_cache_key", "SELECT event_id, sha256(concat('m', chr(10), 'u', chr(10), 'a=', id, '&b=', author)) AS k FROM items")(
    lambda v: v.items.select("event_id", X.cache_key(F.lit("m"), F.lit("u"), F.when(c("key") % 2 == 0, F.create_map(F.lit("b"), "author", F.lit("a"), "id")).otherwise(F.create_map(F.lit("a"), "id", F.lit("b"), "author"))).alias("k")))
columns("p32_title_has_speaker", "titles", "doc_id", lambda: {"has": X.title_has_speaker(c("title"), F.lit("Ray·the"))}, "(title LIKE '%Ray·the%' OR title LIKE '%Ray%' OR title LIKE '%the%') AS has")
query("p33_truncate_words", "SELECT doc_id, CASE WHEN length(title) <= 24 THEN title ELSE coalesce(nullif(regexp_replace(f.t, '[\\s,，、:：;；\\-]+$', ''), ''), substring(title, 1, 24)) END AS short FROM titles LEFT JOIN f USING (doc_id)",
      ctes="w AS (SELECT doc_id, unnest(string_split(title, ' ')) AS w, generate_subscripts(string_split(title, ' '), 1) AS i FROM titles), "
      "r AS (SELECT doc_id, i, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, w FROM w), "
      "f AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM r WHERE n <= 24 GROUP BY doc_id)")(
    lambda v: v.titles.select("doc_id", X.truncate_words(c("title"), 24).alias("short")))
query("p36_build_desc", "SELECT doc_id, concat(CASE WHEN length(title) > 25 THEN concat(title, chr(10), chr(10)) ELSE '' END, "
      "CASE WHEN 250 - (CASE WHEN length(title) > 25 THEN length(title) + 2 ELSE 0 END) - length(batch) - 15 - 2 > 0 THEN concat(substring(text, 1, 250 - (CASE WHEN length(title) > 25 THEN length(title) + 2 ELSE 0 END) - length(batch) - 15 - 2), chr(10), chr(10)) ELSE '' END, "
      "'1:00', chr(10), chr(10), batch, chr(10), chr(10), 'no adv.') AS descr FROM titles WHERE text <> ''")(
    lambda v: v.titles.where("text <> ''").select("doc_id", X.build_desc(c("text"), c("batch"), c("title"), F.lit("1:00"), "no adv.").alias("descr")))
columns("p37_assign_partition", "titles", "doc_id", lambda: {"tid": X.assign_partition(F.when(c("doc_id") % 3 == 0, F.lit("芯片")).when(c("doc_id") % 3 == 1, F.lit("科技与股票")), c("lang"))}, "CASE WHEN doc_id % 3 = 0 THEN 188 ELSE 207 END AS tid")
columns("p38_classify_media", "titles", "doc_id", lambda: {"kind": X.classify_media(c("title"), c("doc_id") * 20000, [("ing", "talk"), ("sch", "de")])},
        "CASE WHEN title LIKE '%ing%' THEN 'talk' WHEN title LIKE '%sch%' THEN 'de' WHEN doc_id * 20000 < 5242880 THEN 'short' ELSE 'other' END AS kind")
columns("p39_ends_sentence", "cues", "video_id cue_index", lambda: {"ends": X.ends_sentence(F.concat(c("text"), F.lit('" ')))}, "regexp_matches(regexp_replace(text, '[\"'' )\\]}]+$', ''), '[.!?;。！？；、]$') AS ends")
columns("p40_human_size", "items", "event_id", lambda: {"size": T.human_size(c("key") * 1024)}, "CASE WHEN key = 0 THEN '0.0 B' ELSE concat(CAST(key AS STRING), '.0 KB') END AS size")
columns("p42_content_hash", "titles", "doc_id", lambda: {"h": X.content_hash(F.when(c("doc_id") % 4 > 0, c("text")))}, "CASE WHEN doc_id % 4 > 0 THEN sha256(text) ELSE '' END AS h")
columns("p43_has_digit_or_percent", "titles", "doc_id", lambda: {"d": X.has_digit_or_percent(c("title"))}, "regexp_matches(title, '[0-9%]') AS d")
query("p45_normalize_episode", "SELECT event_id, CASE WHEN key % 3 = 0 THEN 'untitled' ELSE id END AS title, CASE WHEN key % 2 = 0 THEN 'pending' ELSE 'done' END AS status, source AS tags, CASE WHEN key % 2 = 0 THEN '2024-01-02' END AS date FROM items")(
    lambda v: v.items.select("event_id", X.normalize_episode(F.when(c("key") % 3 == 0, F.lit("  ")).otherwise(c("id")), F.when(c("key") % 2 == 0, F.lit("")).otherwise(F.lit(" done")), F.array(F.lit(" "), c("source")),
        F.when(c("key") % 2 == 0, F.lit("2024-01-02")).otherwise(F.lit("soon"))).alias("e")).select("event_id", "e.title", "e.status", F.array_join("e.tags", ",").alias("tags"), "e.date"))
columns("p46_classify_failure", "items", "event_id", lambda: {"kind": X.classify_failure(F.when(c("key") % 5 == 0, 404).when(c("key") % 5 == 1, 403).when(c("key") % 5 == 2, 429).cast("int"), F.when(c("key") % 5 == 3, F.lit("please Sign in")))},
        "CASE key % 5 WHEN 0 THEN 'fatal_gone' WHEN 1 THEN 'fatal_request' WHEN 2 THEN 'retryable' WHEN 3 THEN 'login_wall' ELSE 'retryable_unknown' END AS kind")
columns("p49_brand_title", "titles", "doc_id", lambda: {"t": X.brand_title(c("title"), "Talks")}, "concat(substring(title, 1, 40), '｜Talks') AS t")
columns("f15_subtitle_plan", "items", "event_id", lambda: {"action": X.subtitle_plan(c("key") % 2 == 0, c("key") % 3 > 0, c("key") % 5 > 0, F.when(c("key") % 4 == 0, F.array(F.lit("English"))).otherwise(F.array(F.lit("中文"))), c("key") % 7 > 0, F.lit(0.8))["action"]},
        "CASE WHEN key % 2 <> 0 OR key % 3 = 0 OR key % 5 = 0 OR key % 7 = 0 THEN 'burn_bilingual' WHEN key % 4 = 0 THEN 'burn_zh_only' ELSE 'skip_subtitle' END AS action")
columns("f17_video_compliance", "items", "event_id", lambda: {"warn": F.array_join(X.video_compliance(c("duration"), c("key") * 2, F.when(c("key") % 3 > 0, c("key") + 200)), ",")},
        "concat_ws(',', CASE WHEN duration > 900 THEN 'warn:long' END, CASE WHEN key % 3 = 0 OR key + 200 < 360 THEN 'reject:height' END, "
        "CASE WHEN (key % 3 = 0 AND key * 2 < 720) OR (key % 3 > 0 AND least(key * 2, key + 200) < 720) THEN 'warn:resolution' END) AS warn")
columns("t03_source_score", "items", "event_id", lambda: {"score": X.source_score(F.when(c("key") % 3 == 0, F.lit("xueqiu_a")).when(c("key") % 3 == 1, F.lit("bilibili_search")).otherwise(c("source")))}, "CASE key % 3 WHEN 0 THEN 30 WHEN 1 THEN 15 ELSE 10 END AS score")
columns("t04_title_score", "titles", "doc_id", lambda: {"score": X.title_score(c("title"), "The", ("ing", "tion"), ("en", "ER"), ("sch",))},
        "CASE WHEN lower(title) LIKE '%ing%' OR lower(title) LIKE '%tion%' THEN 10 ELSE 0 END + CASE WHEN regexp_matches(title, '\\d') THEN 8 ELSE 0 END + CASE WHEN lower(title) LIKE '%en%' THEN 4 ELSE 0 END "
        "+ CASE WHEN lower(title) LIKE '%er%' THEN 4 ELSE 0 END + CASE WHEN lower(title) LIKE 'the%' THEN 5 ELSE 0 END - CASE WHEN lower(title) LIKE '%sch%' THEN 15 ELSE 0 END AS score")
columns("t05_freshness_score", "items", "event_id", lambda: {"score": X.freshness_score(F.when(c("key") % 9 > 0, (F.lit(1706000000) - c("publish_s")) / 3600))},
        "CASE WHEN key % 9 = 0 THEN 5 WHEN 1706000000 < publish_s THEN 20 WHEN 1706000000 - publish_s <= 86400 THEN 15 WHEN 1706000000 - publish_s <= 259200 THEN 10 WHEN 1706000000 - publish_s <= 604800 THEN 5 ELSE 0 END AS score")
columns("t06_duration_score", "items", "event_id", lambda: {"score": X.duration_score(c("duration"))},
        "CASE WHEN duration BETWEEN 120 AND 600 THEN 10 WHEN duration > 600 AND duration <= 1200 THEN 8 WHEN duration >= 60 AND duration < 120 THEN 2 ELSE 0 END AS score")
query("g03_title_similarity", "SELECT doc_id, round(CASE WHEN a = '' OR b IS NULL OR b = '' THEN 0 ELSE len(list_filter(string_split(a, ''), lambda x: contains(b, x))) / greatest(length(a), length(b)) END, 6) AS sim FROM "
      "(SELECT doc_id, substring(title, 1, 20) AS a, substring(lag(title) OVER (PARTITION BY batch ORDER BY doc_id), 1, 20) AS b FROM titles)")(
    lambda v: v.titles.selectExpr("doc_id", "title", "lag(title) OVER (PARTITION BY batch ORDER BY doc_id) AS b").select("doc_id", F.round(X.title_similarity(c("title"), c("b")), 6).alias("sim")))
