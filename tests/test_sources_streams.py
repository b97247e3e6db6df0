import json

import pandas as pd
import pytest
from cuemill.operators import feeds as P
from cuemill.operators import transcript as W
from cuemill.sources import feeds, files, media_headers
from cuemill.streaming import rules
from pyspark.sql import functions as F


def raw(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p), 1_700_000_000) for p in payloads], "payload string, fetched_s bigint")


def one(df):
    r = df.collect()
    assert len(r) == 1
    return r[0].asDict() | {"extra": json.loads(r[0]["extra"])}


def test_payloads(spark):
    api = raw(spark, {"code": 0, "data": {"list": {"vlist": [{"bvid": "BV1", "title": "t", "created": 5, "play": 7}]}}}, {"code": -1}, "no json")
    got = one(feeds.from_space_api(api))
    assert (got["id"], got["publish_s"], got["extra"]["view_count"]) == ("bilibili_api:BV1", 5, 7)
    assert feeds.bad_batches(api).count() == 2
    got = one(feeds.from_search(raw(spark, {"data": {"result": [{"bvid": "BV2", "title": "<em>a</em>b", "viewText": "1.5万"}, {"title": "none"}]}})))
    assert (got["title"], got["publish_s"], got["extra"]["view_count"]) == ("ab", 1_699_920_000, 15000)
    got = one(feeds.from_space_page(raw(spark, [{"bvid": "BV3", "title": "t", "dateText": "昨天"}])))
    assert got["publish_s"] == 1_699_833_600
    got = one(feeds.from_forum(raw(spark, [{"text": "甲 5分钟前 林园说", "href": "h"}, {"text": "林园", "href": "h"}, {"text": "other", "href": "g"}]), "林园"))
    assert got["title"] == "林园说"
    posts = [{"mid": "1", "text": "<b>林园谈投资</b>", "page_info": {"media_info": {"stream_url": "u?Expires=9"}}}, {"mid": "1", "text": "again again"}, {"mid": "2", "text": "东北虎林园真好玩"}, {"mid": "3", "text": "ab"}]
    got = one(feeds.from_microblog(raw(spark, {"statuses": posts})))
    assert got["extra"] == {"mid": "1", "has_video": True, "video_url": "u?Expires=9", "video_expires_at": 9}
    details = spark.createDataFrame([("a", "v1", "60", 77)], "article_id string, vid string, duration string, published_s bigint")
    got = one(feeds.from_news(raw(spark, [{"id": "a", "title": "林园"}, {"id": "a", "title": "林园2"}, {"id": "b", "title": "x"}]), "林园", details))
    assert got["publish_s"] == 77 and got["extra"]["vid"] == "v1" and got["id"] == "tencent_live:a" and got["source"] == "tencent_live" and got["title"] == "林园"
    many = [[{"id": f"{k}x{i}", "title": "林园"} for i in range(40)] for k in "ab"]
    assert feeds.from_news(raw(spark, *many), "林园").count() == 60
    odd = [{"title": "林园", "url": "/rain/b/1"}, {"title": "林园", "url": "javascript:x"}, {"title": "林园"}]
    got = one(feeds.from_news(raw(spark, odd), "林园"))
    assert got["url"] == "https://news.qq.com/rain/b/1" and len(got["id"]) == len("tencent_live:") + 16
    item = {"desc": "", "create_time": 3, "video": {"duration": 61499, "play_addr": {"url_list": ["x/playwm/y"]}}}
    got = one(feeds.from_short_video(raw(spark, {"video_id": "9", "loaderData": {"a": None, "b": {"videoInfoRes": {"item_list": [item]}}}})))
    assert got["extra"]["mp4_url"] == "x/play/y" and got["extra"]["duration"] == 61 and got["title"] == "抖音视频 9"
    hits = feeds.from_short_video_search(raw(spark, [{"href": "/video/12?x=1", "title": "a"}, {"href": "/video/12?x=1", "title": "b"}, {"href": "http://q", "title": "c"}])).collect()
    assert sorted(r["title"] for r in hits) == ["a", "c"] and {r["id"] for r in hits} >= {"douyin_search:12"}
    page = '<title>片名,好看视频</title> "https:\\/\\/a\\/sd\\/1.mp4" "https://a/hd/2.mp4" "publish_time":"1600000000","duration":"95"'
    got = one(feeds.from_video_page(raw(spark, page).withColumn("vid", F.lit("k"))))
    assert (got["title"], got["publish_s"], got["extra"]["mp4_url"], got["extra"]["mp4_sd"], got["extra"]["duration"]) == ("片名", 1_600_000_000, "https://a/hd/2.mp4", "https://a/sd/1.mp4", 95)
    ann = {"announcements": [{"announcementTitle": "<em>股东</em>大会通知", "announcementId": "7", "secName": "茅台", "announcementTime": 5000}, {"announcementTitle": "x", "announcementId": "8", "secName": "别家"}]}
    got = one(feeds.from_announcements(raw(spark, ann), "600519", "贵州茅台"))
    assert got["publish_s"] == 5 and got["extra"]["is_meeting_notice"] and not got["extra"]["is_resolution"]
    html = '<a href="https://www.163.com/v/video/VAB1.html">林园谈股_网易</a><a href="/v/video/VAB1.html">林园</a><a href="/v/video/VX.html">x</a>'
    assert one(feeds.from_portal(raw(spark, html), "林园"))["title"] == "林园谈股"
    text = "召开的日期时间： 2024 年 5月6 日 14 点 30 分\n召开地点：某 酒店 会议厅\n http://cninfo.com/a http://www.sse.com/b https://live.x/1， https://live.x/1 网络文字互动 价值在线 网络文字互动"
    got = spark.range(1).select(feeds.meeting_fields(F.lit(text)).alias("m")).first()["m"]
    assert (str(got["meeting_date"]), got["meeting_time"], got["place"]) == ("2024-05-06", "2024年5月6日14点30分", "某酒店会议厅")
    assert got["platforms"] == ["网络文字互动", "价值在线"] and got["live_urls"] == ["https://live.x/1"]
    got = spark.range(1).select(feeds.meeting_fields(F.lit("无")).alias("m")).first()["m"]
    assert got["meeting_date"] is None and got["place"] is None and got["platforms"] == [] == got["live_urls"]
    best = feeds.best_stream(spark.createDataFrame([(1, "v", 5, "a"), (1, "v", 9, "b")], "video_id int, kind string, bandwidth int, url string")).collect()
    assert [r["url"] for r in best] == ["b"]


def test_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nHello\n there\n\nbroken\n\n2\n00:00:03,000 --> 00:00:04,000\nBye")
    cues = files.scan_srt(spark, str(tmp_path / "a.srt")).orderBy("cue_index").collect()
    assert [tuple(c) for c in cues] == [("a", 1, 1000, 2500, "Hello there"), ("a", 2, 3000, 4000, "Bye")]
    (tmp_path / "q.txt").write_text("# c\n\nhttp://a\n")
    assert [r["url"] for r in files.scan_url_queue(spark, str(tmp_path / "q.txt")).collect()] == ["http://a"]
    state = {"dispatched": [{"key": "k", "ts": 1}], "rejected": ["old", {"key": "n", "video_id": "v", "ts": 2}], "pending_retry": [], "published": {"s": {"bvid": "B", "ts": 3}}}
    (tmp_path / "s.json").write_text(json.dumps(state))
    t = files.load_state(spark, str(tmp_path / "s.json"))
    assert sorted(tuple(r) for r in t["rejected"].collect()) == [("n", "v", 2), ("old", "old", 0)]
    assert t["published"].first()["bvid"] == "B" and t["dispatched"].count() == 1 and t["pending_retry"].count() == 0
    index = spark.createDataFrame([("s", "ep01", "t", 1.5)], "slug string, id string, title string, duration_sec double")
    files.write_index(index, str(tmp_path / "index"), "now")
    assert files.scan_index(spark, str(tmp_path / "index")).first()["slug"] == "s"
    (tmp_path / "bad.json").write_text('{"schema": 1}')
    with pytest.raises(Exception, match="no list of episodes"):
        files.scan_index(spark, str(tmp_path / "bad.json")).collect()
    assert files.scan_index(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.mp4").write_bytes(b"\0\0\0\x18ftypmp42" + b"\0" * 20000)
    (tmp_path / "m" / "y.mp4").write_bytes(b"oops")
    assert tuple(files.media_inventory(spark, str(tmp_path / "m")).first()) == (2, 20016, 1, 1)


def test_media_headers_are_read_by_range(spark, tmp_path):
    for k in range(7):
        (tmp_path / f"f{k}.mp4").write_bytes(b"\0\0\0\x18ftypmp42" + bytes([k]) * k)
    (tmp_path / "note.txt").write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "g.mp4").write_bytes(b"")
    with open(tmp_path / "huge.mp4", "wb") as file:  # three gigabytes, of which the disk holds a block
        file.write(b"\0\0\0\x18ftypisom")
        file.truncate(3 << 30)
    heads = media_headers.media_headers(spark, str(tmp_path), filesPerTask=3)
    assert heads.schema.simpleString() == "struct<path:string,length:bigint,modified:timestamp,head:binary>" and heads.rdd.getNumPartitions() == 3
    got = {r["path"].split("/")[-1]: r for r in heads.collect()}
    assert set(got) == {*(f"f{k}.mp4" for k in range(7)), "huge.mp4"} and got["huge.mp4"]["length"] == 3 << 30
    assert bytes(got["f3.mp4"]["head"]) == b"\0\0\0\x18ftypmp42\3\3\3" and len(got["huge.mp4"]["head"]) == 64 and got["f3.mp4"]["modified"] is not None
    assert tuple(files.media_inventory(spark, "file://" + str(tmp_path)).first()) == (8, sum(12 + k for k in range(7)) + (3 << 30), 7, 0)
    deep = media_headers.media_headers(spark, str(tmp_path), recursiveFileLookup="true", bytes=4).collect()
    assert len(deep) == 9 and max(len(r["head"]) for r in deep) == 4
    assert media_headers.media_headers(spark, str(tmp_path), "*.none").count() == 0
    with pytest.raises(Exception, match="bytes"):
        media_headers.media_headers(spark, str(tmp_path), bytes=-1).collect()


def test_snaps_of_the_six_cues(spark):
    cues = spark.createDataFrame([("v", i + 1, 3000 * i, 3000 * i + 3000, "a." if i % 2 == 0 else "a") for i in range(6)], "video_id string, cue_index int, start_ms bigint, end_ms bigint, text string")
    clips = spark.createDataFrame([("v", 1, 4500, 7000)], "video_id string, para_id int, start_ms bigint, end_ms bigint")
    assert W.snap_starts(clips, cues).first()["snapped_start"] == 3000
    assert W.snap_ends(clips, cues).first()["snapped_end"] == 9000
    pairs = spark.createDataFrame([("v", 1, 0, 60000), ("v", 2, 40000, 100000), ("v", 3, 200000, 240000)], "video_id string, para_id int, start2 bigint, end2 bigint")
    got = sorted(tuple(r) for r in W.resolve_overlaps(pairs, 10000).collect())
    assert got == [("v", 1, 0, 50000), ("v", 2, 50000, 100000), ("v", 3, 200000, 240000)]


def test_packing_is_all_or_nothing(spark):
    rows = [("v", i, i, 20000 * i, 20000 * i + 60000 * (i == 2) + 18000) for i in range(1, 8)] + [("w", 1, 1, 0, 20000)]
    clips = spark.createDataFrame(rows, "video_id string, para_id int, rank int, start_ms bigint, end_ms bigint")
    got = sorted(tuple(r) for r in W.pack_episodes(clips, 2, 2, 15000, 30000).collect())
    assert got == [("v", 1, 1, None), ("v", 1, 2, None), ("v", 2, 6, None), ("v", 2, 7, None), ("w", None, None, "insufficient_quotes:1")]


def test_titles_keep_the_better_in_place(spark):
    rows = [("b", 1, "abcdef", False, 5), ("b", 2, "abcdeg", True, 5), ("b", 3, "zzz", False, None), ("b", 4, "", False, 1), ("c", 1, "abcdef", False, 5)]
    got = P.dedup_titles(spark.createDataFrame(rows, "block string, pos int, title string, has_url boolean, duration int")).collect()
    assert sorted((r["block"], r["place"], r["pos"]) for r in got) == [("b", 0, 2), ("b", 1, 3), ("b", 2, 4), ("c", 0, 1)]


def events(spark, folder, parts):
    schema = "key bigint, kind int, ts_s bigint"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return stream.withColumn("ts", F.timestamp_seconds("ts_s"))


def run(df, name, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / ("c" + name))).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


PARTS = [[(1, 0, 100), (1, 0, 200), (2, 0, 150)], [(1, 0, 1900), (2, 0, 2000), (2, 0, 2100)], [(1, 0, 4000), (1, 1, 4100), (3, 0, 90000)]]


def test_spacing_equals_its_batch_twin(spark, tmp_path):
    stream = events(spark, tmp_path / "e", PARTS)
    got = run(rules.min_interval(stream.withWatermark("ts", "1 day"), 1800), "spaced", tmp_path)
    assert got.columns == stream.columns and got.where("kind IS NULL OR ts IS NULL").count() == 0
    got = got.select("key", "ts_s")
    flat = spark.createDataFrame([r for p in PARTS for r in p], "key bigint, kind int, ts_s bigint")
    twin = P.min_interval(flat, 1800, "key", "ts_s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))


def test_retries_and_timeouts(spark, tmp_path):
    stream = events(spark, tmp_path / "e", PARTS)
    got = run(rules.retry_machine(stream.select("key", "ts_s", "ts").withWatermark("ts", "1 day")), "retried", tmp_path)
    assert sorted(map(tuple, got.collect())) == [(1, -1), (1, 1900), (1, 2000), (2, -1), (2, 1950), (2, 3800), (3, 91800)]
    late = rules.publish_timeout(stream.withWatermark("ts", "1 second"), 3600)
    got = run(late, "timed", tmp_path)
    assert (2, 3750) in set(map(tuple, got.collect())) and not any(r["key"] == 3 for r in got.collect())


def test_windows_and_dedupe(spark, tmp_path):
    stream = events(spark, tmp_path / "e", PARTS)
    got = run(rules.activity_sessions(stream, "key", "500 seconds", "1 second"), "sessions", tmp_path)
    assert {(r["key"], r["n"]) for r in got.collect()} >= {(1, 2), (2, 1), (2, 2)}
    got = run(rules.daily_counts(stream, "1 second", 0), "days", tmp_path)
    assert [r["n"] for r in got.collect()] == [8]
    got = run(rules.stream_dedupe(stream, "key", "10 minutes"), "deduped", tmp_path)
    times = {}
    for r in got.orderBy("ts_s").collect():
        times.setdefault(r["key"], []).append(r["ts_s"])
    assert all(b - a >= 600 for t in times.values() for a, b in zip(t, t[1:], strict=False))


def test_stale_sources_and_forgotten_state(spark, tmp_path):
    stream = events(spark, tmp_path / "e", PARTS)
    stale = rules.freshness_alerts(stream.select(F.col("key").cast("string").alias("key"), "ts_s", "ts").withWatermark("ts", "1 second"), 0.5)
    got = {tuple(r) for r in run(stale, "stale", tmp_path).collect()}
    assert ("2", 2100, 3900) in got and ("1", 4100, 5900) in got and not any(k == "3" for k, *_ in got)
    # A key's failures are forgotten, and its last accepted row too, once the watermark is far beyond them.
    parts = [[(1, 0, 100), (1, 0, 200)], [(2, 0, 90_000)], [(2, 0, 90_001)], [(1, 0, 91_000)], [(1, 0, 92_000)]]
    later = events(spark, tmp_path / "f", parts).withWatermark("ts", "1 second")
    got = run(rules.retry_machine(later.select("key", "ts_s", "ts"), 3, 10, 3600), "again", tmp_path)
    assert sorted(r["ts_s"] for r in got.collect() if r["key"] == 1) == [110, 210, 91_010, 92_010]
    got = run(rules.min_interval(later, 1800), "spaced_again", tmp_path)
    assert sorted(r["ts_s"] for r in got.collect() if r["key"] == 1) == [100, 91_000]


def test_upserts_and_log(spark, tmp_path):
    payloads = [{"code": 0, "data": {"list": {"vlist": [{"bvid": "BV1", "title": t, "created": n}, {"bvid": f"BV{n}", "title": "x", "created": n}]}}} for n, t in ((5, "old"), (6, "new"))]
    for i, p in enumerate(payloads):
        raw(spark, p).coalesce(1).write.parquet(str(tmp_path / "raw" / f"f{i}"))
    stream = spark.readStream.schema("payload string, fetched_s bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "raw" / "*"))
    rules.stream_items(stream, feeds.from_space_api, str(tmp_path / "items"), str(tmp_path / "ck"), F.lit(77)).awaitTermination()
    got = {r["id"]: r for r in rules.read_items(spark, str(tmp_path / "items")).collect()}
    assert got["bilibili_api:BV1"]["title"] == "new" and len(got) == 3 and {r["created_at"] for r in got.values()} == {77}
    more = raw(spark, {"code": 0, "data": {"list": {"vlist": [{"bvid": "BV5", "title": "y", "created": 9}]}}})
    more.coalesce(1).write.parquet(str(tmp_path / "raw" / "f2"))
    rules.stream_items(stream, feeds.from_space_api, str(tmp_path / "items"), str(tmp_path / "ck"), F.lit(99)).awaitTermination()
    got = {r["id"]: r for r in rules.read_items(spark, str(tmp_path / "items")).collect()}
    assert len(got) == 3 and (got["bilibili_api:BV5"]["title"], got["bilibili_api:BV5"]["created_at"], got["bilibili_api:BV5"]["updated_at"]) == ("y", 77, 99)
    assert got["bilibili_api:BV1"]["updated_at"] == 77 and len(list((tmp_path / "items" / "list").glob("v=*"))) == 2
    log = events(spark, tmp_path / "e", PARTS).select("ts_s", F.col("ts_s").alias("seq"), F.lit("k").alias("kind"), F.lit("m").alias("msg"), F.lit("d").alias("detail")).withColumnRenamed("ts_s", "ts")
    rules.log_sink(log, str(tmp_path / "log"), str(tmp_path / "ck2"), 3).awaitTermination()
    assert sorted(r["ts"] for r in rules.read_log(spark, str(tmp_path / "log")).collect()) == [4000, 4100, 90000]
    links = spark.createDataFrame([("a?Expires=1000",), ("b",)], "url string")
    assert rules.link_expiry_stream(links).count() == 1 and isinstance(pd.DataFrame(), pd.DataFrame)
