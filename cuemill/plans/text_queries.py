"""Queries of the text rules over whole texts, Chinese and Latin, and of landed payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import cjk
from cuemill.functions import text as X
from cuemill.operators import feeds as P
from cuemill.operators import frames as V
from cuemill.operators import quality as Q
from cuemill.operators import release as R
from cuemill.operators import transcript as W
from cuemill.sources import feeds as S

from . import feed_queries as feeds_
from .catalog import query

c = F.col
CJK = cjk.CJK
BLANK = "[\\s\x0b\x85\xa0  　]"


# ---- punctuation


def _all(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, '{pattern}', '{to}', 'g')"


def punctuated(view: str, keys: str, text: str = "text") -> str:
    """CTEs that end in `put(keys, t)`: the rules' SQL for texts without links, addresses or curly quotes. Spans that rules
    leave alone hold nothing that they would change here: marks in them have no Chinese beside them."""
    full = "t"
    for half, to in cjk.HALF_TO_FULL.items():
        h = f"\\{half}" if half in "()?" else half
        full = _all(_all(full, f"([{CJK}]){h}", f"\\1{to}"), f"{h}([{CJK}])", f"{to}\\1")
    last = "t"
    for half in ",;:?!":
        last = _all(last, ("\\?" if half == "?" else half) + "$", cjk.HALF_TO_FULL[half])
    fold = _all(_all("t", "。{3,}|\\.{3,}|、{3,}", "……"), "…{2,}", "……")
    for mark in "！？，；：。":
        fold = _all(fold, mark + "{2,}", mark)
    fold = _all(_all(_all(fold, "!{2,}", "！"), "\\?{2,}", "？"), "([！？])[！？!?]+", "\\1")
    space = _all(_all("t", "[ \t]+([，。！？；：、）」』])", "\\1"), "([，。！？；：、（「『])[ \t]+", "\\1")
    space = _all(_all(_all(space, f"([{CJK}])[ \t]+([A-Za-z0-9])", "\\1 \\2"), f"([A-Za-z0-9])[ \t]+([{CJK}])", "\\1 \\2"), "[ \t]{2,}", " ")
    pair = "array_to_string(list_transform(string_split(t, '\"'), lambda x, i: CASE WHEN i = 1 THEN x WHEN i % 2 = 0 THEN concat('「', x) ELSE concat('」', x) END), '')"
    steps = [
        ("q", f"CASE WHEN regexp_matches(t, '[{CJK}]') AND (length(t) - length(replace(t, '\"', ''))) % 2 = 0 THEN {pair} ELSE t END"), ("w", full),
        ("e", f"CASE WHEN regexp_matches(t, '[{CJK}]') THEN {last} ELSE t END"), ("o", fold), ("a", space), ("put", _all("t", f"^{BLANK}+|{BLANK}+$", "")),
    ]
    out, before = [f"p0 AS (SELECT {keys}, {text} AS t FROM {view})"], "p0"
    for name, sql in steps:
        name = name if name == "put" else f"p_{name}"
        out.append(f"{name} AS (SELECT {keys}, {sql} AS t FROM {before})")
        before = name
    return ", ".join(out)


query("p21_normalize_cjk_punct", "SELECT doc_id, length(t) AS n, sha256(t) AS h FROM put", ctes=punctuated("zh", "doc_id"))(
    lambda v: v.zh.select("doc_id", cjk.normalize_cjk_punct(c("text")).alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("h")))
query("p22_normalize_cues", "SELECT put.video_id, put.cue_index, t AS text, t <> replace(zcues.text, '生', '國') AS changed FROM put JOIN zcues ON put.video_id = zcues.video_id AND put.cue_index = zcues.cue_index", ctes=punctuated("zcues", "video_id, cue_index"))(
    lambda v: cjk.normalize_cues(v.zcues.withColumn("text", F.replace("text", F.lit("生"), F.lit("國"))), {"國": "生"}).select("video_id", "cue_index", "text", "changed"))
query("p34_clean_title", "SELECT doc_id, substring(s, 1, 80) AS title2, CASE WHEN length(s) > 80 THEN 'truncated' WHEN length(s) > 25 THEN 'long' WHEN s = '' THEN 'empty' ELSE '' END AS warned FROM s",
      ctes=punctuated("titles", "doc_id", "concat(title, '  ', title)") + f", s AS (SELECT doc_id, {_all('t', BLANK + '+', ' ')} AS s FROM put)")(
    lambda v: v.titles.select("doc_id", X.clean_title(F.concat("title", F.lit("  "), "title")).alias("t")).select("doc_id", c("t.title").alias("title2"), F.array_join("t.warnings", ",").alias("warned")))
query("s30_build_upload_list", "SELECT doc_id AS rank, concat(CAST(doc_id AS STRING), '. ', substring(s, 1, 80)) AS line, CASE WHEN length(s) > 80 THEN 'truncated' WHEN length(s) > 25 THEN 'long' WHEN s = '' THEN 'empty' ELSE '' END AS warned FROM s WHERE doc_id % 3 = 0",
      ctes=punctuated("titles", "doc_id", "title") + f", s AS (SELECT doc_id, {_all('t', BLANK + '+', ' ')} AS s FROM put)")(
    lambda v: R.build_upload_list(v.titles.select(c("batch").alias("video_id"), c("doc_id").alias("rank"), c("doc_id").cast("string").alias("file"), "title"), v.titles.where("doc_id % 3 = 0").select(c("doc_id").cast("string").alias("file"))).select("rank", "line", F.array_join("warnings", ",").alias("warned")))
query("p20_convert_script", "SELECT doc_id, sha256(replace(replace(replace(replace(text, 'the', chr(57344)), 'e', 'E'), 'h', 'H'), chr(57344), 'the')) AS h FROM documents")(
    lambda v: v.documents.select("doc_id", F.sha2(cjk.convert_script(c("text"), {"e": "E", "h": "H"}, ("the",)), 256).alias("h")))
query("p19_detect_lang", "SELECT k.video_id, CASE WHEN n IS NULL THEN '' WHEN zh >= greatest(4, (n - 1) * 0.05) THEN 'zh' ELSE 'en' END AS lang FROM (SELECT DISTINCT video_id FROM langs) k LEFT JOIN (SELECT video_id, sum(length(head)) AS n, sum(length(regexp_replace(head, '[^一-鿿]', '', 'g'))) AS zh FROM h GROUP BY video_id) USING (video_id)",
      ctes="langs AS (SELECT video_id, cue_index, CASE video_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', '的') WHEN 2 THEN replace(text, 'qu', '的') ELSE ' ' END AS text FROM cues), "
      "h AS (SELECT video_id, substring(concat(text, chr(10)), 1, CAST(greatest(0, 20000 - coalesce(sum(length(text) + 1) OVER (PARTITION BY video_id ORDER BY cue_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS INTEGER)) AS head FROM langs WHERE length(trim(text)) > 0)")(
    lambda v: cjk.detect_lang(v.cues.withColumn("text", F.when(c("video_id") % 4 == 0, c("text")).when(c("video_id") % 4 == 1, F.replace("text", F.lit("e"), F.lit("的"))).when(c("video_id") % 4 == 2, F.replace("text", F.lit("qu"), F.lit("的"))).otherwise(F.lit(" ")))))

# ---- numbers

NUM = "concat('涨', cn, '倍又', CAST(duration AS STRING), '元，占百分之', cn, '，', cn, '万人')"
AS_TOKEN = "concat('{k}:', CAST(CAST({x} AS DOUBLE) AS STRING))"
TOKENS = ", ".join(AS_TOKEN.format(k=k, x=x) for k, x in (("X", "key"), ("N", "duration"), ("PCT", "key"), ("N", "key * 10000")))


def numerals(v):
    return v.numerals.withColumn("t", F.concat(F.lit("涨"), "cn", F.lit("倍又"), c("duration").cast("string"), F.lit("元，占百分之"), "cn", F.lit("，"), "cn", F.lit("万人")))


def token(kind: str):
    return F.concat(F.lit(f"{kind}:"), c("key").cast("double").cast("string"))


query("p29_number_tokens", f"SELECT event_id, array_to_string(list_sort(list_distinct([{TOKENS}])), '|') AS tokens FROM numerals")(
    lambda v: numerals(v).select("event_id", F.array_join(cjk.number_tokens(c("t")), "|").alias("tokens")))
query("p29_number_tokens_cjk", "SELECT event_id, concat('PCT:', CAST(CAST(key AS DOUBLE) AS STRING), '|X:3.0') AS tokens FROM items")(
    lambda v: v.items.select("event_id", F.array_join(cjk.number_tokens(F.format_string("%d%%，涨了三倍", "key")), "|").alias("tokens")))
query("p30_strip_tokens", "SELECT event_id, CASE WHEN key % 2 = 0 THEN concat('涨', cn, '倍又', CAST(duration AS STRING), '元，占，', cn, '万人') ELSE concat('涨又', CAST(duration AS STRING), '元，占百分之', cn, '，', cn, '万人') END AS t FROM numerals")(
    lambda v: numerals(v).select("event_id", cjk.strip_tokens(c("t"), F.array(F.when(c("key") % 2 == 0, token("PCT")).otherwise(token("X")))).alias("t")))
query("j18_untraceable_numbers", "SELECT event_id, CASE WHEN key % 3 = 0 THEN '' ELSE concat('PCT:', CAST(CAST(key AS DOUBLE) AS STRING)) END AS bad FROM numerals")(
    lambda v: v.numerals.select("event_id", F.array_join(cjk.untraceable_numbers(F.format_string("占%d%%", "key"), F.when(c("key") % 3 == 0, F.concat(F.lit("约百分之"), "cn")).otherwise(c("cn"))), ",").alias("bad")))
query("p48_finalize_title", "SELECT event_id, CASE WHEN key % 3 = 0 THEN concat('Ray：涨', cn, '倍') WHEN key % 3 = 1 THEN 'Ray：回报涨' WHEN key % 2 = 0 THEN 'Ray：长期耐心' ELSE 'Ray谈投资' END AS final_title FROM numerals")(
    lambda v: cjk.finalize_titles(v.numerals.select(
        "event_id", F.when(c("key") % 3 == 1, F.concat(F.lit("回报涨"), "cn", F.lit("倍"))).otherwise(F.concat(F.lit("涨"), "cn", F.lit("倍"))).alias("title"), F.lit("Ray").alias("speaker"),
        F.when(c("key") % 3 == 0, F.format_string("拿到%d倍", "key")).otherwise(F.lit("没有")).alias("source"), F.when(c("key") % 2 == 0, F.lit("长期耐心")).otherwise(F.lit("「%")).alias("suggestion")), "谈投资").select("event_id", "final_title"))
ENDINGS = ("", "，", "「", "（）", "的", " (x", "''", '"', "：", "，，b", "『』", "【x】", "和平")
PAIRS = ("「」", "『』", "（）", "()", "《》", "【】", "“”", "‘’")
_n = lambda mark: f"(length(t) - length(replace(t, '{mark}', '')))"
BAD = " OR ".join(
    ["regexp_matches(t, '[的与和及、，,：:；;]$')", "regexp_matches(t, '，，|,,|、、|；；|;;|：：|::')", *[f"contains(t, '{p}') OR {_n(p[0])} <> {_n(p[1])}" for p in PAIRS],
     "contains(t, '\"\"') OR contains(t, '''''')", f"{_n(chr(34))} % 2 <> 0", f"{_n(chr(39) * 2)} % 2 <> 0"])
query("p31_title_residue_ok", f"SELECT doc_id, NOT ({BAD}) AND length(regexp_replace(replace(t, 'the', ''), '[「」『』（）()《》【】\"''“”‘’，,。.！!？?、；;：:\\s\xa0]', '', 'g')) >= 2 AS ok FROM t",
      ctes="t AS (SELECT doc_id, concat(title, ['" + "', '".join(e.replace("'", "''") for e in ENDINGS) + "'][CAST(doc_id % 13 AS INTEGER) + 1]) AS t FROM titles)")(
    lambda v: v.titles.select("doc_id", X.title_residue_ok(F.concat("title", F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (c("doc_id") % 13).cast("int") + 1)), F.lit("the")).alias("ok")))
query("p35_clean_tags", "SELECT event_id, CASE WHEN key % 5 = 0 THEN '财经' WHEN source = author THEN source ELSE concat(source, '|', author) END AS tags, CASE WHEN key % 5 = 0 THEN 'empty' ELSE '' END AS warned FROM items")(
    lambda v: v.items.select("event_id", X.clean_tags(F.when(c("key") % 5 == 0, F.array(F.lit(" "), F.lit(","))).otherwise(F.array(F.concat(F.lit(" "), "source"), F.concat("author", F.lit(",")), "source"))).alias("t"))
    .select("event_id", F.array_join("t.tags", "|").alias("tags"), F.array_join("t.warnings", ",").alias("warned")))

# ---- whole texts and replies

query("p23_fix_terms", "SELECT doc_id, sha256(replace(replace(replace(text, 'the', 'a'), 'er', 'ER'), 'a ', 'an ')) AS fixed FROM documents")(
    lambda v: v.documents.select("doc_id", F.sha2(X.fix_terms(c("text"), [("the", "a"), ("er", "ER"), ("a ", "an ")]), 256).alias("fixed")))
query("p24_clean_reply", "SELECT doc_id, sha256(trim(regexp_replace(text, '^\\s+', ''))) AS reply FROM documents")(
    lambda v: v.documents.select("doc_id", F.sha2(X.clean_reply(F.concat(F.lit("<think>hm\nhm</think>\n```json\n"), "text", F.lit("\n```"))), 256).alias("reply")))
query("p41_strip_asr_tags", "SELECT doc_id, sha256(regexp_replace(concat('<|zh|>', text, '<|end|>'), '<\\|[^|]*\\|>', '', 'g')) AS t FROM documents")(
    lambda v: v.documents.select("doc_id", F.sha2(X.strip_asr_tags(F.concat(F.lit("<|zh|>"), "text", F.lit("<|end|>"))), 256).alias("t")))
query("p47_redact_record_lines", "SELECT doc_id, length(log) AS n, sha256(array_to_string(list_transform(string_split(log, chr(10)), lambda l: CASE WHEN length(l) - length(replace(l, chr(9), '')) + (length(l) - length(replace(l, '\\t', '')))//2 >= 5 THEN '[redacted]' ELSE l END), chr(10))) AS h FROM r",
      ctes="r AS (SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', chr(9)) ELSE text END, chr(10), 'k', chr(9), 'a', chr(9), 'b\\tc', chr(9), 'd', chr(9), 'e', chr(10), 'z') AS log FROM documents)")(
    lambda v: v.documents.select("doc_id", F.concat(F.when(c("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("\t"))).otherwise(c("text")), F.lit("\nk\ta\tb\\tc\td\te\nz")).alias("log"))
    .select("doc_id", F.length("log").cast("bigint").alias("n"), F.sha2(X.redact_record_lines(c("log")), 256).alias("h")))
query("j13_many_terms", "SELECT doc_id, term FROM documents, (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM benchmark) WHERE length(term) >= 4 AND contains(text, term)")(
    lambda v: Q.match_terms(v.documents.select("doc_id", "text"), sorted(r["w"] for r in v.benchmark.select(F.explode(F.split("text", " ")).alias("w")).where("length(w) >= 4").distinct().collect())).select("doc_id", F.explode("terms").alias("term")))
query("j13_match_terms", "SELECT doc_id, concat_ws(',', CASE WHEN text LIKE '%the%' THEN 'the' END, CASE WHEN text LIKE '%ing%' THEN 'ing' END, CASE WHEN text LIKE '%sch%' THEN 'sch' END) AS terms FROM documents")(
    lambda v: Q.match_terms(v.documents, ["the", "ing", "sch"]).select("doc_id", F.array_join("terms", ",").alias("terms")))
query("u04_token_except", "SELECT doc_id, len(l) AS n, sha256(array_to_string(l, ' ')) AS rest FROM (SELECT doc_id, list_sort(list_filter(list_distinct(string_split(text, ' ')), lambda w: NOT list_contains(string_split(title, ' '), w))) AS l FROM titles WHERE text IS NOT NULL)")(
    lambda v: v.titles.where("text IS NOT NULL").select("doc_id", F.array_sort(Q.token_except(c("text"), c("title"))).alias("l")).select("doc_id", F.size("l").cast("bigint").alias("n"), F.sha2(F.array_join("l", " "), 256).alias("rest")))
query("u05_ordered_distinct", "SELECT doc_id, sha256(coalesce(string_agg(w, ' ' ORDER BY i), '')) AS words FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY doc_id, w) GROUP BY doc_id")(
    lambda v: v.documents.where("text IS NOT NULL").select("doc_id", F.sha2(F.array_join(Q.ordered_distinct(F.split("text", " ")), " "), 256).alias("words")))
query("u07_coverage_intersect", "SELECT id FROM items WHERE duration >= 1200 INTERSECT SELECT id FROM items WHERE key < 100")(lambda v: Q.coverage_intersect(v.items.where("duration >= 1200"), v.items.where("key < 100")))
query("p25_parse_numbered_lines", "SELECT video_id, n, arg_max(line, pos) AS line FROM (SELECT video_id, pos, CAST(regexp_extract(l, '^\\s*(\\d+)[.、)]\\s*(.+)', 1) AS INTEGER) AS n, trim(regexp_extract(l, '^\\s*(\\d+)[.、)]\\s*(.+)', 2)) AS line FROM l WHERE regexp_matches(l, '^\\s*\\d+[.、)]\\s*.+')) GROUP BY video_id, n",
      ctes="r AS (SELECT video_id, string_agg(concat(CAST(cue_index % 7 AS STRING), CASE cue_index % 3 WHEN 0 THEN '. ' WHEN 1 THEN '、' ELSE ') ' END, text), chr(10) ORDER BY cue_index) AS reply FROM cues GROUP BY video_id), l AS (SELECT video_id, unnest(string_split(reply, chr(10))) AS l, generate_subscripts(string_split(reply, chr(10)), 1) AS pos FROM r)")(
    lambda v: W.parse_numbered_lines(v.cues.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_index", F.concat((c("cue_index") % 7).cast("string"), F.when(c("cue_index") % 3 == 0, ". ").when(c("cue_index") % 3 == 1, "、").otherwise(") "), "text").alias("l")))), lambda x: x["l"]), "\n").alias("reply")), "video_id"))
query("p44_format_provenance", "SELECT slug, concat('# S · ', CAST(slug AS STRING), chr(10), chr(10), '共 ', CAST(count(*) AS STRING), ' 集，生成于 G，commit `c`。', chr(10), chr(10), string_agg(concat('## ', CAST(id AS STRING), ' ', status, chr(10), '- 时长：', CAST(n * 37 // 60 AS STRING), ' 分 ', lpad(CAST(n * 37 % 60 AS STRING), 2, '0'), ' 秒', chr(10), "
      "'- 建议发布日：', CAST(batch_at AS STRING), chr(10), '- 视频：v', chr(10), '- 封面 16:9：', chr(10), '- 封面 9:16：w', chr(10)), chr(10) ORDER BY id)) AS notes FROM queue GROUP BY slug")(
    lambda v: R.release_notes(v.queue.select("slug", F.lit("S").alias("speaker"), F.lit("G").alias("generated_at"), F.lit("c").alias("commit"), c("id").alias("pos"), "id", c("status").alias("title"), (c("n") * 37).alias("duration_sec"), c("batch_at").alias("scheduled_date"), F.lit("v").alias("video"), F.lit(None).cast("string").alias("cover_16x9"), F.lit("w").alias("cover_9x16"))))

# ---- cues, clips and tokens

query("f08_min_quote_sec", "SELECT video_id, para_id FROM clips WHERE end_ms - start_ms >= 15000")(lambda v: W.min_quote(v.clips).select("video_id", "para_id"))
query("j24_missing_lines", "SELECT c.video_id, c.cue_index FROM cues c WHERE NOT EXISTS (SELECT 1 FROM bi b WHERE b.video_id = c.video_id AND b.cue_index = c.cue_index AND b.start_ms % 3 > 0)")(
    lambda v: W.missing_lines(v.cues, v.bi.withColumn("zh", F.when(c("start_ms") % 3 == 0, F.lit(" ")).otherwise(c("zh")))).select("video_id", "cue_index"))
query("j25_overlaps_any", "SELECT video_id, para_id, EXISTS (SELECT 1 FROM clips o WHERE o.video_id = k.video_id AND o.para_id <> k.para_id AND o.end_ms > k.start_ms AND o.start_ms < k.end_ms) AS hit FROM clips k")(
    lambda v: W.overlaps_any(v.clips).select("video_id", "para_id", "hit"))
query("w04_tokens_to_cues")(lambda v: W.tokens_to_cues(v.cues.select("video_id", "cue_index", F.posexplode(F.split("text", " ")).alias("j", "tok")).selectExpr("video_id", "tok", "CAST(cue_index * 100000 + j AS BIGINT) AS seq").selectExpr("*", "seq AS start_ms", "seq AS end_ms")))
PIECES = "regexp_extract_all(text, '[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+$')"
query("w06_split_long_cue", "SELECT video_id, cue_index, CAST(i - 1 AS INTEGER) AS part, start_ms + CAST(floor((end_ms - start_ms) * coalesce(b, 0) / t) AS BIGINT) AS start_ms, start_ms + CAST(floor((end_ms - start_ms) * (coalesce(b, 0) + length(x)) / t) AS BIGINT) AS end_ms, x AS text FROM z",
      ctes=f"s AS (SELECT *, CASE WHEN length(text) <= 60 OR len({PIECES}) = 0 THEN [text] ELSE string_split(list_reduce({PIECES}, lambda a, x: CASE WHEN length(regexp_extract(a, '[^\x01]*$')) + length(x) <= 60 THEN concat(a, x) ELSE concat(a, chr(1), x) END), chr(1)) END AS p FROM cues), "
      "u AS (SELECT video_id, cue_index, start_ms, end_ms, unnest(p) AS x, generate_subscripts(p, 1) AS i, greatest(1, list_sum(list_transform(p, lambda q: length(q)))) AS t FROM s), "
      "z AS (SELECT *, sum(length(x)) OVER (PARTITION BY video_id, cue_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM u)")(
    lambda v: W.split_long_cue(v.cues, 60))

query("a16_row_textness", "SELECT frame_no, y, round(coalesce((energy % 50) / nullif(energy % 100, 0), 0), 6) AS textness FROM row_profile")(
    lambda v: v.row_profile.select("frame_no", "y", F.round(V.row_textness(c("energy") % 50, c("energy") % 100), 6).alias("textness")))

# ---- feeds and releases

query("s15_upsert_items", "SELECT coalesce(s.id, l.id) AS id, coalesce(s.source, l.source) AS source, CASE WHEN l.id IS NULL THEN s.title ELSE l.title END AS title, CASE WHEN l.id IS NULL THEN s.url ELSE l.url END AS url, CASE WHEN l.id IS NULL THEN s.publish_s ELSE l.publish_s END AS publish_s, CASE WHEN l.id IS NULL THEN s.author ELSE l.author END AS author, "
      "CASE WHEN l.id IS NULL THEN s.extra ELSE l.extra END AS extra, coalesce(s.created_at, 9) AS created_at, CASE WHEN l.id IS NOT NULL THEN 9 ELSE s.updated_at END AS updated_at FROM s FULL JOIN l ON s.id = l.id",
      ctes=f"{feeds_.STORE}, {feeds_.BATCH}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS r FROM b) WHERE r = 1)")(lambda v: P.upsert_items(feeds_.store(v), feeds_.batch(v), F.lit(9))[0])
query("s15_new_rows", "SELECT id, title, url, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM b WHERE id NOT IN (SELECT id FROM s)) WHERE r = 1", ctes=f"{feeds_.STORE}, {feeds_.BATCH}")(
    lambda v: P.upsert_items(feeds_.store(v), feeds_.batch(v), F.lit(9))[1].select("id", "title", "url", "pos"))
query("s16_update_extra", "SELECT id, CASE WHEN key % 3 = 0 THEN '{\"p\":1}' ELSE extra END AS extra, CASE WHEN key % 3 = 0 THEN 9 ELSE 2 END AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS r FROM items) WHERE r = 1")(
    lambda v: P.update_extra(P.last_wins(v.items.select("id", "event_id", "extra", F.lit(2).alias("updated_at")), "id", "event_id"), v.items.where("key % 3 = 0").select("id", F.lit('{"p":1}').alias("extra")).distinct(), F.lit(9)).select("id", "extra", "updated_at"))
query("f03_must_contain", "SELECT doc_id FROM documents WHERE text LIKE '%the%'")(lambda v: v.documents.where(P.must_contain(c("text"), "the")).select("doc_id"))
query("f10_min_duration", "SELECT event_id, duration FROM items WHERE duration >= 1200")(lambda v: P.min_duration(v.items).select("event_id", "duration"))
query("f11_producible", "SELECT event_id FROM items WHERE key * 100000 >= 8388608 AND (duration >= 480 OR duration = 0 OR key % 7 = 0) AND id NOT IN (SELECT id FROM items WHERE source = 'signup')")(
    lambda v: P.producible(v.items.select("event_id", "id", (c("key") * 100000).alias("bytes"), F.when(c("key") % 7 > 0, c("duration")).alias("duration")), v.items.where("source = 'signup'")).select("event_id"))
query("f12_select_items", "SELECT event_id, part FROM (SELECT event_id, 'some' AS part, row_number() OVER (ORDER BY event_id) AS r FROM items WHERE source = 'view') WHERE r <= 50 UNION ALL SELECT event_id, 'meetings' FROM items WHERE source = 'error' UNION ALL SELECT event_id, 'all' FROM items")(
    lambda v: P.select_items(v.items, "view", n=50, order="event_id").select("event_id", F.lit("some").alias("part")).unionByName(P.select_items(v.items.withColumn("source", F.when(c("source") == "error", F.lit("shareholder_meeting")).otherwise(c("source"))), meetings=True).select("event_id", F.lit("meetings").alias("part")))
    .unionByName(P.select_items(v.items).select("event_id", F.lit("all").alias("part"))))
query("t09_production_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY source ORDER BY key % 3, duration DESC, event_id) AS INTEGER) AS pos FROM items")(
    lambda v: P.production_order(v.items.select("source", "event_id", c("event_id").alias("id"), (c("key") % 3).alias("priority"), c("duration").alias("bytes"))).select("event_id", "pos"))
LIKE = "len(list_filter(string_split(n.a, ''), lambda q: contains(k.a, q))) / greatest(length(n.a), length(k.a))"
query("g02_dedup_titles", "SELECT batch, day, t.pos, CAST(t.place AS BIGINT) AS place FROM (SELECT batch, day, unnest(kept) AS t FROM f WHERE i = most)",
      ctes="o AS (SELECT batch, doc_id // 40 AS day, doc_id AS pos, substring(title, 1, 20) AS a, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 50 END / 10000.0 AS w, row_number() OVER (PARTITION BY batch, doc_id // 40 ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY batch, doc_id // 40) AS most FROM titles), "
      "f AS (SELECT batch, day, i, most, [{'pos': pos, 'place': 0, 'a': a, 'w': CAST(w AS DOUBLE)}] AS kept FROM o WHERE i = 1 UNION ALL SELECT n.batch, n.day, n.i, n.most, CASE WHEN hit IS NULL THEN list_append(kept, {'pos': n.pos, 'place': len(kept), 'a': n.a, 'w': CAST(n.w AS DOUBLE)}) "
      "ELSE list_transform(kept, lambda z: CASE WHEN z.place = hit AND n.w > z.w THEN {'pos': n.pos, 'place': z.place, 'a': n.a, 'w': CAST(n.w AS DOUBLE)} ELSE z END) END FROM (SELECT n.*, f.kept, (SELECT min(k.place) FROM (SELECT unnest(f.kept, recursive := true)) k WHERE length(n.a) > 0 AND length(k.a) > 0 AND "
      + LIKE + " >= 0.6) AS hit FROM f JOIN o n ON n.batch = f.batch AND n.day = f.day AND n.i = f.i + 1) n)")(
    lambda v: P.dedup_titles(v.titles.select("batch", F.floor(c("doc_id") / 40).alias("day"), F.struct("batch", F.floor(c("doc_id") / 40)).alias("block"), c("doc_id").alias("pos"), "title", (c("doc_id") % 3 == 0).alias("has_url"), F.when(c("doc_id") % 5 > 0, c("doc_id") % 50).cast("int").alias("duration"))).select("batch", "day", "pos", "place"))
query("u01_merge_index", "SELECT slug, id, n, status, batch_at, NULL AS release_tag FROM idx WHERE id % 4 > 0 UNION ALL SELECT slug, id, n + 100, 'sp', batch_at + 7, concat('clips-', CAST(slug AS STRING)) FROM queue WHERE id % 4 = 0")(
    lambda v: R.merge_index(v.idx.select("slug", "id", "n", c("status").alias("speaker"), "batch_at"), v.queue.where("id % 4 = 0").select("slug", F.lit("sp").alias("speaker"), (c("batch_at") + 7).alias("generated_at"), "id", (c("n") + 100).alias("n"))).withColumnRenamed("speaker", "status").select("slug", "id", "n", "status", "batch_at", "release_tag"))
query("j11_orphans", "SELECT tag, 'orphan' AS what FROM releases WHERE tag % 3 > 0 AND tag NOT IN (SELECT slug FROM idx) UNION ALL SELECT DISTINCT slug, 'no_release' FROM idx WHERE slug NOT IN (SELECT tag FROM releases WHERE tag % 3 > 0)")(
    lambda v: (lambda o: o[1].select("tag", F.lit("orphan").alias("what")).unionByName(o[0].select("tag", F.lit("no_release").alias("what"))))(R.orphans(v.releases.where("tag % 3 > 0"), v.idx.select(c("slug").alias("tag")))))
query("a04_feed_yield", "SELECT n_name AS feed, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND n_regionkey > 0) AS n FROM nation")(
    lambda v: Q.feed_yield(v.customer.join(v.nation.where("n_regionkey > 0"), c("c_nationkey") == c("n_nationkey")).select(c("n_name").alias("feed")), v.nation.select(c("n_name").alias("feed"))))

# ---- payloads


def landed(df, payload, *keep):
    return df.select(*keep, F.to_json(payload).alias("payload"), F.lit(1_700_000_000).cast("bigint").alias("fetched_s"))


STRIPPED = "regexp_replace(title, '<[^>]+>', '', 'g')"
query("s04_items_from_search", f"SELECT concat('bilibili_search:BV', CAST(doc_id AS STRING)) AS id, {STRIPPED} AS title, CAST(1699920000 AS BIGINT) AS publish_s, CAST(doc_id * 10 AS STRING) AS views FROM titles WHERE doc_id % 5 > 0")(
    lambda v: S.from_search(landed(v.titles, F.struct(F.struct(F.array(F.struct(F.when(c("doc_id") % 5 > 0, F.concat(F.lit("BV"), c("doc_id").cast("string"))).otherwise(F.lit("")).alias("bvid"), "title", (c("doc_id") * 10).cast("string").alias("play"))).alias("result")).alias("data")))).select("id", "title", "publish_s", F.get_json_object("extra", "$.view_count").alias("views")))
query("s05_items_from_space", "SELECT concat('bilibili_space:', CAST(doc_id AS STRING)) AS id, title, CAST(CASE WHEN doc_id % 2 = 0 THEN 1699833600 ELSE 1699920000 END AS BIGINT) AS publish_s FROM titles")(
    lambda v: S.from_space_page(landed(v.titles, F.array(F.struct(c("doc_id").cast("string").alias("bvid"), "title", F.when(c("doc_id") % 2 == 0, F.lit("昨天")).otherwise(F.lit("今天")).alias("dateText"))))).select("id", "title", "publish_s"))
query("s06_items_from_forum", "SELECT concat('xueqiu_search:', substring(md5(concat('h', CAST(doc_id // 2 AS STRING))), 1, 16)) AS id, min(doc_id) % 2 AS odd FROM titles WHERE text LIKE '%the%' GROUP BY doc_id // 2")(
    lambda v: S.from_forum(landed(v.titles, F.array(F.struct("text", F.concat(F.lit("h"), F.floor(c("doc_id") / 2).cast("string")).alias("href"), c("doc_id").cast("string").alias("author"))), "doc_id").withColumn("fetched_s", c("doc_id")), "the").select("id", (c("publish_s") % 2).alias("odd")))
POST = f"trim({_all('text', '<[^>]+>', '')})"
query("s07_items_from_microblog", f"SELECT concat('weibo_search:', CAST(doc_id AS STRING)) AS id, substring({POST}, 1, 300) AS title FROM documents WHERE length({POST}) >= 5 AND NOT (regexp_matches({POST}, 'ing ') AND NOT regexp_matches({POST}, 'tion|the'))")(
    lambda v: S.from_microblog(landed(v.documents, F.struct(F.array(F.struct(c("doc_id").cast("string").alias("mid"), "text")).alias("statuses"))), "ing ", "tion|the").select("id", "title"))
query("s08_items_from_news", "SELECT concat('tencent_live:', CAST(doc_id AS STRING)) AS id, title, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 1700000000 END AS publish_s, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS has_video FROM titles WHERE title LIKE '%e%'")(
    lambda v: S.from_news(landed(v.titles, F.array(F.struct(c("doc_id").cast("string").alias("id"), "title"))), "e", v.titles.where("doc_id % 2 = 0").select(c("doc_id").cast("string").alias("article_id"), F.lit("v").alias("vid"), F.lit("1:00").alias("duration"), c("doc_id").alias("published_s"))).select("id", "title", "publish_s", F.get_json_object("extra", "$.has_video").alias("has_video")))
query("s09_items_from_short_video", "SELECT concat('douyin_video:', CAST(event_id AS STRING)) AS id, CASE WHEN key % 3 = 0 THEN concat('抖音视频 ', CAST(event_id AS STRING)) ELSE author END AS title, publish_s, CAST(duration AS STRING) AS sec, concat('x/play/', source) AS mp4 FROM items")(
    lambda v: S.from_short_video(landed(v.items, F.struct(c("event_id").cast("string").alias("video_id"), F.create_map(F.lit("a"), F.struct(F.struct(F.array(F.struct(F.when(c("key") % 3 == 0, F.lit("")).otherwise(c("author")).alias("desc"), c("publish_s").alias("create_time"), F.struct((c("duration") * 1000).alias("duration"), F.struct(F.array(F.concat(F.lit("x/playwm/"), "source")).alias("url_list")).alias("play_addr")).alias("video"))).alias("item_list")).alias("videoInfoRes"))).alias("loaderData"))))
    .select("id", "title", "publish_s", F.get_json_object("extra", "$.duration").alias("sec"), F.get_json_object("extra", "$.mp4_url").alias("mp4")))
query("s10_items_from_video_page", "SELECT concat('haokan_video:', CAST(page_id AS STRING)) AS id, trim(regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '^[^,]*')) AS title, 1600000000 + page_id AS publish_s FROM pages")(
    lambda v: S.from_video_page(v.pages.select(c("page_id").cast("string").alias("vid"), F.concat("html", F.lit('"https://a/hd/1.mp4" "publish_time":"'), (c("page_id") + 1600000000).cast("string"), F.lit('"')).alias("payload"), F.lit(1).cast("bigint").alias("fetched_s"))).select("id", "title", "publish_s"))
query("s10_video_page", "SELECT page_id, trim(regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '^[^,]*')) AS title, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))), ' ') AS links FROM pages")(
    lambda v: v.pages.select("page_id", S.page_title(c("html")).alias("title"), F.array_join(F.array_sort(S.page_links(c("html"))), " ").alias("links")))
query("s11_items_from_announcements", "SELECT concat('shareholder_meeting:', CAST(o_orderkey AS STRING)) AS id, o_orderkey AS publish_s, CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END AS notice FROM orders WHERE o_orderstatus <> 'P'")(
    lambda v: S.from_announcements(landed(v.orders, F.struct(F.array(F.struct(F.concat(F.lit("<em>x</em>"), F.when(c("o_orderkey") % 3 == 0, F.lit("通知")).otherwise(F.lit("决议"))).alias("announcementTitle"), c("o_orderkey").cast("string").alias("announcementId"), F.when(c("o_orderstatus") == "P", F.lit("other")).when(c("o_orderstatus") == "O", F.lit("")).otherwise(F.lit("Co")).alias("secName"), (c("o_orderkey") * 1000).alias("announcementTime"))).alias("announcements"))), "1", "The Co")
    .select("id", "publish_s", F.get_json_object("extra", "$.is_meeting_notice").alias("notice")))
ANCHOR = "trim(regexp_replace(title, '[<>\"]', '', 'g'))"
query("s12_items_from_portal", f"SELECT concat('netease_video:V', CAST(doc_id AS STRING)) AS id, regexp_replace({ANCHOR}, '[_|].*$', '') AS title FROM titles WHERE {ANCHOR} LIKE '%the%'")(
    lambda v: S.from_portal(v.titles.select(F.concat(F.lit('<a href="/v/video/V'), c("doc_id").cast("string"), F.lit('.html">'), F.regexp_replace("title", '[<>"]', ""), F.lit("</a>")).alias("payload"), F.lit(1).alias("fetched_s")), "the").select("id", "title"))
query("s13_items_from_short_video_search", "SELECT concat('douyin_search:', CAST(key AS STRING)) AS id, min(event_id) AS at FROM items GROUP BY key")(
    lambda v: S.from_short_video_search(landed(v.items, F.array(F.struct(F.concat(F.lit("/video/"), c("key").cast("string"), F.lit("?x=1")).alias("href"), c("author").alias("title"))), "event_id").withColumn("fetched_s", c("event_id"))).select("id", c("publish_s").alias("at")))
