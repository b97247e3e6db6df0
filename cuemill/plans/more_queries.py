"""Queries of sources, Chinese rules and the remaining folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.operators import frames as V
from cuemill.operators import transcript as P
from cuemill.sources import feeds as S

from .catalog import columns, query
from .transcript_queries import OVER

c = F.col

columns("p14_strip_relative_prefix", "titles", "doc_id", lambda: {"t": X.strip_relative_prefix(F.concat(F.lit("abc 5分钟前 "), c("title")))}, "CASE WHEN trim(title) = '' THEN concat('abc 5分钟前 ', title) ELSE trim(title) END AS t")
query("p17_meeting_fields", "SELECT id, d AS meeting_date, concat(CAST(year(d) AS STRING), '年', CAST(month(d) AS STRING), '月', CAST(day(d) AS STRING), '日14点30分') AS meeting_time, concat('hall', CAST(id AS STRING)) AS place, CASE WHEN id % 2 = 0 THEN '价值在线,视频直播' ELSE '视频直播' END AS platforms, CASE WHEN id % 3 = 0 THEN concat('https://live.x/', CAST(id AS STRING)) ELSE '' END AS urls "
      "FROM (SELECT id, CAST(DATE '1970-01-01' + CAST(day AS INTEGER) AS DATE) AS d FROM announce)")(
    lambda v: v.announce.withColumn("d", F.date_add(F.lit("1970-01-01").cast("date"), c("day").cast("int"))).select("id", S.meeting_fields(F.concat(
        F.date_format("d", "'召开的日期时间：' yyyy年M月d日 '14点' '30分'"), F.lit("\n召开地点： hall "), c("id").cast("string"), F.lit("\n"), F.when(c("id") % 2 == 0, F.lit("价值在线")).otherwise(F.lit("")), F.lit(" 视频直播、视频直播 http://www.sse.com.cn/x "),
        F.when(c("id") % 3 == 0, F.concat(F.lit("https://live.x/"), c("id").cast("string"))).otherwise(F.lit("https://cninfo.x/1")))).alias("m"))
    .select("id", "m.meeting_date", "m.meeting_time", "m.place", F.array_join("m.platforms", ",").alias("platforms"), F.array_join("m.live_urls", ",").alias("urls")))
query("p27_parse_copy_reply", "SELECT doc_id, concat('t', CAST(doc_id AS STRING)) AS title, CASE WHEN doc_id % 2 = 0 THEN 'd' ELSE 'say \"no\"' END AS descr, 'a,b' AS tags FROM titles WHERE doc_id % 5 > 0")(
    lambda v: v.titles.select("doc_id", X.copy_reply(F.concat(F.lit('x {"title": "'), F.when(c("doc_id") % 5 > 0, F.concat(F.lit("t"), c("doc_id").cast("string"))).otherwise(F.lit("")), F.lit('", "desc": "'),
        F.when(c("doc_id") % 2 == 0, F.lit("d")).otherwise(F.lit('say "no"')), F.lit('", "tags": ["a", "b"]} y'))).alias("r")).where("r IS NOT NULL").select("doc_id", "r.title", "r.descr", F.array_join("r.tags", ",").alias("tags")))
query("s03_items_from_space_api", "SELECT concat('bilibili_api:', id) AS id, publish_s, author FROM items WHERE key % 5 > 0")(
    lambda v: S.from_space_api(v.items.select(F.to_json(F.struct(F.when(c("key") % 5 > 0, 0).otherwise(-1).alias("code"), F.struct(F.struct(F.array(F.struct(c("id").alias("bvid"), c("publish_s").alias("created"), "author")).alias("vlist")).alias("list")).alias("data"))).alias("payload"), F.lit(1).alias("fetched_s"))).select("id", "publish_s", "author"))
query("t19_best_stream", "SELECT video_id, person AS kind, frame_no AS url FROM (SELECT *, row_number() OVER (PARTITION BY video_id, person ORDER BY sharpness DESC, frame_no DESC) AS r FROM frames) WHERE r = 1")(
    lambda v: S.best_stream(v.frames.select("video_id", c("person").alias("kind"), c("sharpness").alias("bandwidth"), c("frame_no").alias("url"))))
query("g04_resolve_overlaps", "SELECT video_id, CAST(para_id AS INTEGER) AS para_id, start2, end2 FROM done", ctes="src AS (SELECT video_id, para_id, start_ms * 2 AS start2, end_ms * 2 + 30000 AS end2 FROM clips), " + OVER.format(m=10000))(
    lambda v: P.resolve_overlaps(v.clips.select("video_id", "para_id", (c("start_ms") * 2).alias("start2"), (c("end_ms") * 2 + 30000).alias("end2")), 5000))
query("w08_chunk_time_allocation", "SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY chunk, i) AS INTEGER) AS n, least(lo + r - d, hi) AS start_ms, least(lo + r, hi) AS end_ms, trim(x) AS text FROM z",
      ctes="ch AS (SELECT video_id, cue_index - 1 AS chunk, replace(text, chr(10), ' ') AS text, CAST(count(*) OVER (PARTITION BY video_id) * 20000 - 7000 AS BIGINT) AS total FROM cues), "
      "sp AS (SELECT *, list_filter(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+$'), lambda q: trim(q) <> '') AS l FROM ch), y AS (SELECT video_id, chunk, chunk * 20000 AS lo, least((chunk + 1) * 20000, total) AS hi, CAST(list_sum(list_transform(l, lambda q: length(q))) AS BIGINT) AS chars, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM sp), "
      "u AS (SELECT *, greatest(500, ((hi - lo) * length(x))//chars) AS d FROM y), z AS (SELECT *, CAST(sum(d) OVER (PARTITION BY video_id, chunk ORDER BY i) AS BIGINT) AS r FROM u)")(
    lambda v: P.chunk_time_allocation(v.cues.selectExpr("video_id", "CAST(cue_index - 1 AS BIGINT) AS chunk", "replace(text, '\n', ' ') AS text", "CAST(count(*) OVER (PARTITION BY video_id) * 20000 - 7000 AS BIGINT) AS total_ms"), 20000))
BAND = ("p AS (SELECT video_id, frame_no, y, 200 AS width, 64 AS height, CAST(energy % 40 AS INTEGER) AS bright, CAST(energy % 23 AS INTEGER) AS trans, CAST(energy % 40 AS INTEGER) AS white, CAST((energy % 40) * (frame_no % 3) * 5 AS INTEGER) AS chroma FROM row_profile), "
        "lw AS (SELECT *, bright / 200.0 BETWEEN 0.01 AND 0.9 AS lit FROM p WHERE y >= 32), hi AS (SELECT *, lit AND coalesce(trans / nullif(bright, 0), 0) >= 0.25 AS hit FROM lw), "
        "n1 AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY video_id, frame_no ORDER BY y) <= 6 THEN 0 ELSE 1 END AS new FROM hi WHERE hit), n2 AS (SELECT *, sum(new) OVER (PARTITION BY video_id, frame_no ORDER BY y) AS band FROM n1), "
        "bs AS (SELECT video_id, frame_no, band, min(y) AS f, max(y) AS l FROM n2 GROUP BY video_id, frame_no, band HAVING count(*) >= 3), "
        "wh AS (SELECT b.video_id, b.frame_no, band, f, l, coalesce(sum(white) / nullif(sum(bright), 0), 0) AS w, coalesce(sum(chroma) / nullif(sum(bright), 0), 0) AS c, coalesce(sum(trans) / nullif(sum(bright), 0), 0) AS t FROM bs b JOIN hi ON hi.video_id = b.video_id AND hi.frame_no = b.frame_no AND y BETWEEN f AND l WHERE l - f + 1 <= 12 GROUP BY b.video_id, b.frame_no, band, f, l), "
        "vd AS (SELECT *, CASE WHEN w < 0.99 OR c >= 8 THEN 'band_not_white' WHEN t < 0.25 THEN 'band_not_texty' WHEN f <= 32 THEN 'band_above_midline' ELSE '' END AS v FROM wh), "
        "pk AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_no ORDER BY CASE WHEN v IN ('', 'band_above_midline') THEN 0 ELSE 1 END, CASE WHEN v IN ('', 'band_above_midline') THEN -l ELSE l END) AS k FROM vd)")
query("a17_scan_band", "SELECT s.video_id, s.frame_no, CASE WHEN pk.v = '' THEN pk.f END AS top, CASE WHEN NOT lit THEN 'no_bright_rows' WHEN NOT hit THEN 'no_text_rows' WHEN nb IS NULL THEN 'no_band' WHEN pk.v IS NULL THEN 'band_too_thick' ELSE nullif(pk.v, '') END AS reason "
      "FROM (SELECT video_id, frame_no, bool_or(lit) AS lit, bool_or(hit) AS hit FROM hi GROUP BY video_id, frame_no) s LEFT JOIN (SELECT video_id, frame_no, count(*) AS nb FROM bs GROUP BY video_id, frame_no) q ON q.video_id = s.video_id AND q.frame_no = s.frame_no LEFT JOIN pk ON pk.video_id = s.video_id AND pk.frame_no = s.frame_no AND k = 1", ctes=BAND)(
    lambda v: V.scan_band(v.row_profile.selectExpr("video_id", "frame_no", "y", "200 AS width", "64 AS height", "CAST(energy % 40 AS INT) AS bright", "CAST(energy % 23 AS INT) AS trans", "CAST(energy % 40 AS INT) AS white", "CAST((energy % 40) * (frame_no % 3) * 5 AS INT) AS chroma")))
