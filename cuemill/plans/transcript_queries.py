"""Queries of the transcript operators. Videos of the driver's tables are short, so thresholds are smaller here."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.operators import transcript as P

from .catalog import query

c = F.col
ENDS = "regexp_matches(regexp_replace(text, '[\"'' )\\]}]+$', ''), '[.!?;]$')"
FIRST = "SELECT video_id, cue_index, 1 AS p, start_ms AS s, end_ms AS e, length(text) AS t, text AS x FROM cues WHERE cue_index = 1"


def _fold(new: str) -> str:
    return (
        f"r AS ({FIRST} UNION ALL SELECT n.video_id, n.cue_index, CASE WHEN {new} THEN r.p + 1 ELSE r.p END, CASE WHEN {new} THEN n.start_ms ELSE r.s END, "
        f"n.end_ms, CASE WHEN {new} THEN length(n.text) ELSE r.t + length(n.text) END, n.text FROM r JOIN cues n ON n.video_id = r.video_id AND n.cue_index = r.cue_index + 1)"
    )


MERGED = "SELECT r.video_id, r.p AS para_id, min(q.start_ms) AS start_ms, max(q.end_ms) AS end_ms, count(*) AS n, string_agg(trim(q.text), ' ' ORDER BY q.cue_index) AS text FROM r JOIN cues q ON q.video_id = r.video_id AND q.cue_index = r.cue_index GROUP BY r.video_id, r.p"

query("w01_merge_paragraphs", MERGED, _fold("n.start_ms - r.e > 3000 OR n.end_ms - r.s > 30000"))(lambda v: P.merge_paragraphs(v.cues, 3000, 30000))
query("w02_merge_sentence_cues", MERGED, _fold("regexp_matches(rtrim(r.x), '[.!?]$') OR r.e - r.s >= 20000 OR r.t >= 400"))(lambda v: P.merge_sentence_cues(v.cues, 20000, 400))
query("w05_merge_close_cues", "SELECT video_id, p AS para_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, string_agg(trim(text), ' ' ORDER BY cue_index) AS text FROM m GROUP BY video_id, p",
      ctes="l AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY cue_index) < 1500 THEN 0 ELSE 1 END AS new FROM cues), m AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id ORDER BY cue_index) AS BIGINT) AS p FROM l)")(
    lambda v: P.merge_close_cues(v.cues, 1500))
query("w07_islands", "SELECT video_id, i AS island, min(y) AS first, max(y) AS last, count(*) AS n FROM m GROUP BY video_id, i",
      ctes="h AS (SELECT DISTINCT video_id, frame_no AS y FROM row_profile WHERE y = 0 AND energy % 3 = 0), l AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY video_id ORDER BY y) <= 12 THEN 0 ELSE 1 END AS new FROM h), m AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id ORDER BY y) AS BIGINT) AS i FROM l)")(
    lambda v: P.islands(v.row_profile.where("y = 0 AND energy % 3 = 0").select("video_id", c("frame_no").alias("y")).distinct(), ["video_id"], "y", 12))
query("j01_cues_in_windows", "SELECT video_id, cue_index FROM cues c WHERE EXISTS (SELECT 1 FROM clips k WHERE k.video_id = c.video_id AND c.end_ms > k.start_ms AND c.start_ms < k.end_ms)")(
    lambda v: P.cues_in_windows(v.cues, v.clips).select("video_id", "cue_index"))
query("j02_clip_cues", "SELECT c.video_id, k.para_id, CAST(row_number() OVER (PARTITION BY c.video_id, k.para_id ORDER BY c.start_ms, c.cue_index) AS INTEGER) AS seq, c.cue_index AS orig_index, greatest(c.start_ms, k.start_ms) - k.start_ms AS rel_start_ms, "
      "least(c.end_ms, k.end_ms) - k.start_ms AS rel_end_ms, c.text FROM cues c JOIN clips k ON k.video_id = c.video_id AND c.end_ms > k.start_ms AND c.start_ms < k.end_ms")(lambda v: P.clip_cues(v.cues, v.clips))
query("j03_cues_contained", "SELECT c.video_id, k.para_id, c.cue_index FROM cues c JOIN clips k ON k.video_id = c.video_id AND c.start_ms >= k.start_ms - 50 AND c.end_ms <= k.end_ms + 50")(lambda v: P.cues_contained(v.cues, v.clips))
query("j04_snap_start", "SELECT video_id, para_id, coalesce((SELECT arg_max(m.n, m.end_ms) FROM m WHERE m.video_id = k.video_id AND m.end_ms <= k.start_ms AND m.end_ms >= k.start_ms - 8000), start_ms) AS snapped_start FROM clips k",
      ctes=f"n AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY cue_index), end_ms) AS n FROM cues), m AS (SELECT * FROM n WHERE {ENDS})")(
    lambda v: P.snap_starts(v.clips, v.cues).select("video_id", "para_id", "snapped_start"))
query("j05_snap_end", f"SELECT video_id, para_id, coalesce((SELECT min(end_ms) FROM cues c WHERE {ENDS} AND c.video_id = k.video_id AND c.end_ms >= k.end_ms AND c.end_ms <= k.end_ms + 8000), end_ms) AS snapped_end FROM clips k")(
    lambda v: P.snap_ends(v.clips, v.cues).select("video_id", "para_id", "snapped_end"))
BOUNDS = "tot AS (SELECT video_id, max(end_ms) AS total FROM cues GROUP BY video_id), b AS (SELECT video_id, start_ms AS t FROM cues UNION SELECT video_id, 0 FROM tot UNION SELECT video_id, total FROM tot)"
query("j06_snap_to_nearest", "SELECT video_id, para_id, s AS start_ms, CASE WHEN e <= s THEN least(total, s + 30000) ELSE e END AS end_ms FROM x",
      ctes=BOUNDS + ", x AS (SELECT k.video_id, k.para_id, total, (SELECT t FROM b WHERE b.video_id = k.video_id ORDER BY abs(t - k.start_ms), t LIMIT 1) AS s, (SELECT t FROM b WHERE b.video_id = k.video_id ORDER BY abs(t - k.end_ms), t LIMIT 1) AS e FROM clips k JOIN tot USING (video_id))")(
    lambda v: P.snap_to_nearest(v.clips, v.cues))
query("u06_boundary_union", "SELECT b.video_id, t, total FROM b JOIN tot USING (video_id)", ctes=BOUNDS)(lambda v: P.boundaries(v.cues))
query("j07_attach_translation", "SELECT video_id, cue_index, coalesce(nullif((SELECT max(zh) FROM bi b WHERE b.video_id = c.video_id AND b.cue_index = c.cue_index), ''), "
      "nullif((SELECT arg_max(zh, cue_index) FROM bi b WHERE b.video_id = c.video_id AND (b.start_ms + 50)//100 = (c.start_ms + 50)//100), ''), "
      "nullif((SELECT zh FROM bi b WHERE b.video_id = c.video_id AND abs(b.start_ms - c.start_ms) < 2000 ORDER BY abs(b.start_ms - c.start_ms), b.start_ms LIMIT 1), ''), '') AS zh FROM cues c")(
    lambda v: P.attach_translation(v.cues, v.bi).select("video_id", "cue_index", "zh"))
query("j08_zh_by_index", "SELECT c.video_id, c.cue_index, coalesce(b.zh, '') AS zh FROM cues c LEFT JOIN bi b ON b.video_id = c.video_id AND b.cue_index = c.cue_index")(
    lambda v: P.zh_by_index(v.cues, v.bi).select("video_id", "cue_index", "zh"))
query("j09_scores_to_paragraphs", "SELECT video_id, para_id, coalesce(CASE WHEN score % 4 > 0 THEN score END, 0) AS score, CASE WHEN score % 3 > 0 THEN ratio10 / 10 ELSE 0.5 END AS speaker_ratio FROM clips")(
    lambda v: P.scores_to_paragraphs(v.clips.select("video_id", "para_id"), v.clips.select("video_id", c("para_id") , F.when(c("score") % 4 > 0, c("score")).alias("score"), F.when(c("score") % 3 > 0, c("ratio10") / 10).alias("speaker_ratio"))
                                     .unionByName(v.clips.selectExpr("video_id", "para_id + 100000 AS para_id", "score", "0.1D AS speaker_ratio"))))
query("w09_chain_chapters", "SELECT video_id, para_id, s AS start_ms, e AS end_ms, e - s AS duration_ms FROM x",
      ctes="tot AS (SELECT video_id, max(end_ms) AS total FROM cues GROUP BY video_id), x AS (SELECT k.video_id, para_id, coalesce(lag(end_ms) OVER w, 0) AS s, CASE WHEN lead(para_id) OVER w IS NULL THEN total ELSE end_ms END AS e FROM clips k JOIN tot USING (video_id) WINDOW w AS (PARTITION BY k.video_id ORDER BY para_id))")(
    lambda v: P.chain_chapters(v.clips, v.cues))
query("w10_renumber", "SELECT video_id, para_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, para_id) AS INTEGER) AS seq FROM clips")(
    lambda v: P.renumber(v.clips, ["video_id"], [F.desc("score"), "para_id"]).select("video_id", "para_id", "seq"))
OVER = """o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start2, para_id) AS i FROM src),
 f AS (SELECT video_id, i, 0 AS pi, CAST(NULL AS BIGINT) AS ps, CAST(NULL AS BIGINT) AS pe, para_id, start2 AS s, end2 AS e, CAST(NULL AS BIGINT) AS pid FROM o WHERE i = 1
  UNION ALL SELECT o.video_id, o.i, f.i, f.s, CASE WHEN f.e <= o.start2 THEN f.e ELSE greatest(f.s, k.cut) END, o.para_id, CASE WHEN f.e <= o.start2 THEN o.start2 ELSE least(o.end2, k.cut) END, o.end2, f.para_id
  FROM f JOIN o ON o.video_id = f.video_id AND o.i = f.i + 1, LATERAL (SELECT CASE WHEN o.end2 - (f.e + o.start2)//2 < {m} THEN least(greatest(f.s + {m}, least((f.e + o.start2)//2, o.end2 - {m})), f.e) ELSE (f.e + o.start2)//2 END AS cut) k),
 done AS (SELECT video_id, pid AS para_id, ps AS start2, pe AS end2 FROM f WHERE pid IS NOT NULL UNION ALL SELECT f.video_id, f.para_id, f.s, f.e FROM f WHERE i = (SELECT max(i) FROM f g WHERE g.video_id = f.video_id))"""
query("w11_resolve_overlaps", "SELECT video_id, CAST(para_id AS INTEGER) AS para_id, start2, end2 FROM done", ctes="src AS (SELECT video_id, para_id, start_ms * 2 AS start2, end_ms * 2 + 24000 AS end2 FROM clips), " + OVER.format(m=20000))(
    lambda v: P.resolve_overlaps(v.clips.select("video_id", "para_id", (c("start_ms") * 2).alias("start2"), (c("end_ms") * 2 + 24000).alias("end2")), 10000))
query("w12_align_clips", "SELECT video_id, CAST(para_id AS INTEGER) AS para_id, start2 AS clip_start2, end2 AS clip_end2 FROM done",
      ctes=f"n AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY cue_index), end_ms) AS n FROM cues), m AS (SELECT * FROM n WHERE {ENDS}), tot AS (SELECT video_id, max(end_ms) AS total FROM cues GROUP BY video_id), "
      "a1 AS (SELECT k.video_id, para_id, total, coalesce((SELECT arg_max(m.n, m.end_ms) FROM m WHERE m.video_id = k.video_id AND m.end_ms <= k.start_ms AND m.end_ms >= k.start_ms - 8000), start_ms) AS s, "
      "coalesce((SELECT min(m.end_ms) FROM m WHERE m.video_id = k.video_id AND m.end_ms >= k.end_ms AND m.end_ms <= k.end_ms + 8000), end_ms) AS e FROM clips k JOIN tot USING (video_id)), "
      "a2 AS (SELECT *, greatest(0, least(s - 300, total)) AS s2, greatest(greatest(0, least(s - 300, total)), least(e + 300, total)) AS e2 FROM a1), "
      "a3 AS (SELECT *, CASE WHEN e2 - s2 < 20000 THEN least(total, s2 + 20000) ELSE e2 END AS e3 FROM a2), a4 AS (SELECT *, CASE WHEN e3 - s2 < 20000 THEN greatest(0, e3 - 20000) ELSE s2 END AS s4 FROM a3), "
      "src AS (SELECT video_id, para_id, s4 * 2 AS start2, least(e3, s4 + 180000) * 2 AS end2 FROM a4), " + OVER.format(m=40000))(
    lambda v: P.align_clips(v.clips, v.cues).select("video_id", "para_id", "clip_start2", "clip_end2"))
query("w13_sample_cues", "SELECT video_id, cue_index FROM (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY cue_index) - 1) AS n, greatest(ceil(sum(length(text)) OVER (PARTITION BY video_id) / 800), 1) AS step FROM cues) WHERE n % step = 0")(
    lambda v: P.sample_cues(v.cues, 800).select("video_id", "cue_index"))
query("w14_batch_no", "SELECT video_id, cue_index, CAST((row_number() OVER (PARTITION BY video_id ORDER BY cue_index) - 1)//3 AS BIGINT) AS batch_no FROM cues")(
    lambda v: P.batch_no(v.cues, ["video_id"], ["cue_index"], 3).select("video_id", "cue_index", "batch_no"))
query("w15_sample_times", "SELECT video_id, para_id, s.k AS k, start_ms + m + ((2*s.k+1)*(end_ms-start_ms-2*m))//10 AS t FROM (SELECT *, CASE WHEN end_ms - start_ms < 8000 THEN (end_ms-start_ms)//10 ELSE 2000 END AS m FROM clips), (SELECT CAST(unnest(range(5)) AS INTEGER) AS k) s")(
    lambda v: v.clips.select("video_id", "para_id", F.posexplode(P.sample_times(c("start_ms"), c("end_ms"), 5, 2000)).alias("k", "t")))
query("w16_single_chapter_rule", "SELECT video_id, CASE WHEN max(end_ms) * 2 < 120000 THEN 1 ELSE greatest(2, max(end_ms)//40000) END AS chapters FROM cues GROUP BY video_id")(
    lambda v: v.cues.groupBy("video_id").agg(F.max("end_ms").alias("t")).select("video_id", P.chapter_count(c("t"), 40000).alias("chapters")))
query("w03_pause_punctuation", "SELECT video_id, seq, part, tok, start_ms, end_ms FROM (SELECT video_id, cue_index AS seq, 1 AS part, text AS tok, start_ms, end_ms FROM cues UNION ALL SELECT video_id, cue_index, 0, CASE WHEN start_ms - b > 2500 THEN '。' ELSE '，' END, b, b FROM l WHERE start_ms - b > 1500)",
      ctes="l AS (SELECT *, lag(end_ms) OVER (PARTITION BY video_id ORDER BY cue_index) AS b FROM cues)")(
    lambda v: P.pause_punctuation(v.cues.select("video_id", c("cue_index").alias("seq"), c("text").alias("tok"), "start_ms", "end_ms"), 2500, 1500))
query("f06_speaker_ratio_filter", "SELECT video_id, para_id FROM (SELECT *, max(CASE WHEN ratio10 >= 7 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS m FROM clips) WHERE ratio10 >= 7 OR m = 0")(
    lambda v: P.speaker_ratio_filter(v.clips, 7, "ratio10").select("video_id", "para_id"))
query("f07_host_filter", "SELECT video_id, para_id FROM (SELECT *, max(ok) OVER (PARTITION BY video_id) AS m FROM x) WHERE ok = 1 OR m = 0",
      ctes="y AS (SELECT *, lower(concat(text, CASE WHEN para_id % 2 = 0 THEN ' your you you?' ELSE ' my ' END, CASE WHEN video_id % 7 = 0 THEN 'welcome to' ELSE '' END)) AS t FROM clips), "
      "z AS (SELECT *, (length(t) - length(replace(t, ' you', '')))//4 + (length(t) - length(replace(t, 'your ', '')))//5 AS you, (length(t) - length(replace(t, ' i ', '')))//3 + (length(t) - length(replace(t, 'my ', '')))//3 AS me FROM y), "
      "x AS (SELECT *, CASE WHEN t LIKE '%welcome to%' OR (t LIKE '%?%' AND you >= 2 AND you > 2 * me) THEN 0 ELSE 1 END AS ok FROM z)")(
    lambda v: P.host_filter(v.clips.withColumn("text", F.concat("text", F.when(c("para_id") % 2 == 0, " your you you?").otherwise(" my "), F.when(c("video_id") % 7 == 0, "welcome to").otherwise("")))).select("video_id", "para_id"))
query("f13_drop_fillers", "SELECT video_id, i, tok FROM w WHERE lower(trim(tok)) NOT IN ('the', 'de', 'of', 'und')",
      ctes="w AS (SELECT video_id, cue_index * 1000 + generate_subscripts(string_split(text, ' '), 1) - 1 AS i, unnest(string_split(text, ' ')) AS tok FROM cues)")(
    lambda v: P.drop_fillers(v.cues.select("video_id", "cue_index", F.posexplode(F.split("text", " ")).alias("p", "tok")).select("video_id", (c("cue_index") * 1000 + c("p")).cast("bigint").alias("i"), "tok"), ["the", "de", "of", "und"]))
query("f16_valid_ranges", "SELECT video_id, para_id - 2 AS a, score % 9 AS b FROM clips k WHERE para_id - 2 >= 0 AND para_id - 2 <= score % 9 AND score % 9 < (SELECT count(*) FROM cues c WHERE c.video_id = k.video_id)")(
    lambda v: P.valid_ranges(v.clips.select("video_id", (c("para_id") - 2).alias("a"), (c("score") % 9).alias("b")), v.cues))
query("t01_top_highlights", "SELECT video_id, para_id, score, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, para_id) AS INTEGER) AS r FROM clips) WHERE r <= 2")(
    lambda v: P.top_highlights(v.clips, 2).select("video_id", "para_id", "score", "rank"))
query("t02_first_by_rank", "SELECT video_id, para_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, para_id) AS r FROM clips) WHERE r <= 1")(
    lambda v: P.top_highlights(v.clips, 1).select("video_id", "para_id"))
RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, para_id) AS rank FROM clips)"
query("a09_quality_gate", "SELECT v.video_id, coalesce(n, 0) AS n, coalesce(t, 0) AS total_ms, coalesce(n, 0) >= 2 AND coalesce(t, 0) >= 30000 AS ok, CASE WHEN coalesce(n, 0) < 2 THEN 'insufficient_quotes' WHEN coalesce(t, 0) < 30000 THEN 'insufficient_duration' END AS reason "
      "FROM (SELECT DISTINCT video_id FROM clips) v LEFT JOIN (SELECT video_id, count(*) AS n, CAST(sum(CASE WHEN r <= 2 THEN end_ms - start_ms END) AS BIGINT) AS t FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank) AS r FROM rk WHERE end_ms - start_ms >= 9000) GROUP BY video_id) s USING (video_id)", ctes=RANKED)(
    lambda v: P.quality_gate(P.top_highlights(v.clips, 99), 9000, 2, 30000, 2))
query("a10_episode_summary", "SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS cue_count FROM cues GROUP BY video_id")(lambda v: P.episode_summary(v.cues))
query("a25_selected_duration", "SELECT video_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM cues c WHERE EXISTS (SELECT 1 FROM clips k WHERE k.video_id = c.video_id AND c.cue_index - 1 BETWEEN k.para_id - 1 AND k.para_id + 1) GROUP BY video_id")(
    lambda v: P.selected_duration(v.cues, v.clips.select("video_id", (c("para_id") - 1).alias("a"), (c("para_id") + 1).alias("b"))))
query("a28_prompt_rows", "SELECT video_id, string_agg(concat(CAST(cue_index AS STRING), '. ', text), chr(10) ORDER BY cue_index) AS prompt FROM cues GROUP BY video_id")(lambda v: P.prompt_rows(v.cues, ["video_id"], "cue_index", "text"))
query("g01_pack_episodes")(lambda v: P.pack_episodes(P.top_highlights(v.clips, 99), 2, 1, 5000, 5000))
