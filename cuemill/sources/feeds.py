"""Landed feed payloads to items. Input: (payload STRING, fetched_s BIGINT); output: the columns of ITEM.

An item's own time is used where the payload has one, else the time of the fetch. Payloads that can't be read give no
items; bad_batches() lists them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.operators.feeds import noise_with_rescue

ITEM = "id string, source string, title string, url string, publish_s bigint, author string, extra string"
# Namesakes of the keyword, and words that vouch for a post all the same.
NOISE = "东北虎林园|虎林园|华林园|林园酒店|林园饭店|林园景区|橘子林园|林园小区|动物园|互评群|壁垒"
SIGNAL = "投资|股|市值|仓|私募|基金|财经|估值|分红|茅台|片仔癉|价值|巴菲特|毛利|企业|消费|医药|中药|A股|牛市|买入|持有"


def _item(df: DataFrame, id_: Column, source: str, title: Column, url: Column, publish: Column, author: Column, **extra: Column) -> DataFrame:
    packed = F.to_json(F.struct(*[v.alias(k) for k, v in extra.items()])) if extra else F.lit("{}")
    return df.select(
        id_.alias("id"), F.lit(source).alias("source"), title.alias("title"), url.alias("url"), publish.cast("bigint").alias("publish_s"),
        F.coalesce(author, F.lit("")).alias("author"), packed.alias("extra"),
    )


def _first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key; an aggregate, so that a frequent key is reduced before it is shuffled."""
    return df.groupBy(key.alias("__k")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__r")).select("__r.*")


def bad_batches(raw: DataFrame) -> DataFrame:
    """Payloads that are no JSON or whose code is not 0."""
    return raw.where(F.try_parse_json("payload").isNull() | (F.coalesce(F.get_json_object("payload", "$.code"), F.lit("0")) != "0"))


def from_space_api(raw: DataFrame) -> DataFrame:
    """Videos of a creator's list."""
    v = "bvid:string,title:string,created:bigint,author:string,play:bigint,length:string,is_charging_arc:boolean,pic:string,comment:bigint"
    rows = raw.select("fetched_s", F.from_json("payload", f"struct<code:int,data:struct<list:struct<vlist:array<struct<{v}>>>>>").alias("p"))
    one = rows.where("p.code = 0").select("fetched_s", F.explode("p.data.list.vlist").alias("v"))
    page = F.concat(F.lit("https://www.bilibili.com/video/"), F.col("v.bvid"))
    return _item(
        one, F.concat(F.lit("bilibili_api:"), F.col("v.bvid")), "bilibili_api", F.coalesce("v.title", F.lit("")), page, F.coalesce("v.created", F.lit(0)), F.col("v.author"),
        bvid=F.col("v.bvid"), view_count=F.coalesce("v.play", F.lit(0)), duration=F.coalesce("v.length", F.lit("")), is_charging=F.coalesce("v.is_charging_arc", F.lit(False)),
    )


def from_search(raw: DataFrame) -> DataFrame:
    """Search hits with an id, marks of the search taken out of titles, dated the day of the fetch."""
    rows = raw.select("fetched_s", F.from_json("payload", "struct<data:struct<result:array<struct<bvid:string,title:string,author:string,play:string,viewText:string>>>>").alias("p"))
    one = rows.select("fetched_s", F.explode("p.data.result").alias("v")).where("v.bvid <> ''")
    from cuemill.functions.timecode import parse_view_count

    views = F.coalesce(F.col("v.play").try_cast("bigint"), parse_view_count(F.col("v.viewText")), F.lit(0))
    return _item(
        one, F.concat(F.lit("bilibili_search:"), F.col("v.bvid")), "bilibili_search", X.strip_tags(F.coalesce("v.title", F.lit(""))), F.concat(F.lit("https://www.bilibili.com/video/"), F.col("v.bvid")),
        F.floor(F.col("fetched_s") / 86400) * 86400, F.col("v.author"), bvid=F.col("v.bvid"), view_count=views,
    )


def from_space_page(raw: DataFrame) -> DataFrame:
    """Cards of a creator's page, with relative dates."""
    from cuemill.functions.timecode import resolve_relative_date

    rows = raw.select("fetched_s", F.from_json("payload", "array<struct<bvid:string,title:string,dateText:string,duration:string>>").alias("p"))
    one = rows.select("fetched_s", F.explode("p").alias("v")).where("v.bvid <> ''")
    day = resolve_relative_date(F.coalesce("v.dateText", F.lit("")), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("fetched_s") / 86400).cast("int")))
    return _item(
        one, F.concat(F.lit("bilibili_space:"), F.col("v.bvid")), "bilibili_space", F.coalesce("v.title", F.lit("")), F.concat(F.lit("https://www.bilibili.com/video/"), F.col("v.bvid")),
        F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400, F.lit(""), bvid=F.col("v.bvid"), duration=F.col("v.duration"),
    )


def from_forum(raw: DataFrame, keyword: str) -> DataFrame:
    """Posts that hold the keyword, one for each link, or beginning of a text without one."""
    rows = raw.select("fetched_s", F.from_json("payload", "array<struct<text:string,href:string,author:string>>").alias("p"))
    one = rows.select("fetched_s", F.posexplode("p").alias("pos", "v")).where(F.contains("v.text", F.lit(keyword)))
    key = F.coalesce(X.blank_to_null(F.col("v.href")), F.substring("v.text", 1, 50))
    one = _first(one.withColumn("key", key), F.col("key"), "fetched_s", "pos")
    title = F.substring(X.strip_relative_prefix(F.col("v.text")), 1, 200)
    return _item(one, F.concat(F.lit("xueqiu_search:"), X.stable_id(F.col("key"))), "xueqiu_search", title, F.coalesce("v.href", F.lit("")), F.col("fetched_s"), F.col("v.author"))


def from_microblog(raw: DataFrame, noise: str = NOISE, signal: str = SIGNAL) -> DataFrame:
    """Posts of five characters and more, one for each mid, without namesakes; the first stream there is."""
    from cuemill.functions.timecode import link_expiry

    media = "stream_url_hd:string,stream_url:string,mp4_hd_url:string,mp4_sd_url:string"
    s = f"mid:string,text_raw:string,text:string,user:struct<screen_name:string>,page_info:struct<media_info:struct<{media}>>,reposts_count:bigint,comments_count:bigint"
    rows = raw.select("fetched_s", F.from_json("payload", f"struct<statuses:array<struct<{s}>>>").alias("p"))
    one = rows.select("fetched_s", F.posexplode("p.statuses").alias("pos", "v"))
    one = one.withColumn("t", F.trim(X.strip_tags(F.coalesce(X.blank_to_null(F.col("v.text_raw")), F.col("v.text"), F.lit("")))))
    one = one.where((F.col("v.mid") != "") & (F.length("t") >= 5) & noise_with_rescue(F.col("t"), noise, signal))
    one = _first(one.withColumn("mid", F.col("v.mid")), F.col("mid"), "fetched_s", "pos")
    m = [X.blank_to_null(F.col(f"v.page_info.media_info.{k}")) for k in ("stream_url_hd", "stream_url", "mp4_hd_url", "mp4_sd_url")]
    video = F.coalesce(*m, F.lit(""))
    return _item(
        one, F.concat(F.lit("weibo_search:"), "mid"), "weibo_search", F.substring("t", 1, 300), F.concat(F.lit("https://m.weibo.cn/detail/"), "mid"), F.col("fetched_s"), F.col("v.user.screen_name"),
        mid=F.col("mid"), has_video=video != "", video_url=video, video_expires_at=link_expiry(video),
    )


def from_news(raw: DataFrame, keyword: str, details: DataFrame | None = None, most: int = 30) -> DataFrame:
    """Articles whose titles hold the keyword, one for each link, the first `most` of each payload, which is one fetch. The id is
    the article's, of its link, else of the link's hash; details(article_id, vid, duration, published_s) are joined to it."""
    rows = raw.select("fetched_s", F.from_json("payload", "array<struct<id:string,title:string,url:string>>").alias("p"))
    hits = F.filter("p", lambda x: F.contains(x["title"], F.lit(keyword)))
    one = rows.select("fetched_s", F.posexplode(F.slice(hits, 1, most)).alias("pos", "v"))
    page = F.concat(F.lit("https://news.qq.com/rain/a/"), X.blank_to_null(F.col("v.id")))
    link = F.coalesce(X.blank_to_null(F.col("v.url")), page)
    link = F.when(link.startswith("http"), link).otherwise(F.concat(F.lit("https://news.qq.com"), link))
    one = _first(one.withColumn("href", link).where("href IS NOT NULL AND coalesce(v.url, '') NOT LIKE 'javascript%'"), F.col("href"), "fetched_s", "pos")
    one = one.withColumn("article_id", X.blank_to_null(F.regexp_extract("href", r"/rain/a/([A-Za-z0-9]+)", 1)))
    if details is None:
        details = one.sparkSession.createDataFrame([], "article_id string, vid string, duration string, published_s bigint")
    one = one.join(details, "article_id", "left")
    return _item(
        one, F.concat(F.lit("tencent_live:"), F.coalesce("article_id", X.stable_id(F.col("href")))), "tencent_live", F.substring("v.title", 1, 200), F.col("href"), F.coalesce("published_s", "fetched_s"),
        F.lit("腾讯新闻"), article_url=F.col("href"), vid=F.col("vid"), duration=F.col("duration"), has_video=F.col("vid").isNotNull(),
    )


def from_short_video(raw: DataFrame) -> DataFrame:
    """The first item of the first loader that has items; links without the watermark, milliseconds to seconds."""
    item = (
        "desc:string,aweme_id:string,create_time:bigint,duration:bigint,author:struct<nickname:string>,statistics:struct<digg_count:bigint,comment_count:bigint>,"
        "video:struct<duration:bigint,play_addr:struct<url_list:array<string>>,cover:struct<url_list:array<string>>>"
    )
    shape = f"struct<video_id:string,loaderData:map<string,struct<videoInfoRes:struct<item_list:array<struct<{item}>>>>>>"
    rows = raw.select("fetched_s", F.from_json("payload", shape).alias("p"))
    lists = F.filter(F.map_values("p.loaderData"), lambda x: F.size(x["videoInfoRes"]["item_list"]) > 0)
    one = rows.select("fetched_s", "p.video_id", F.get(F.get(lists, F.lit(0))["videoInfoRes"]["item_list"], F.lit(0)).alias("v")).where("size(v.video.play_addr.url_list) > 0")
    vid = F.coalesce(F.col("video_id"), F.col("v.aweme_id"))
    title = F.coalesce(X.blank_to_null(F.col("v.desc")), F.concat(F.lit("抖音视频 "), vid))
    ms = F.coalesce(F.nullif("v.video.duration", F.lit(0)), F.nullif("v.duration", F.lit(0)), F.lit(0))
    return _item(
        one, F.concat(F.lit("douyin_video:"), vid), "douyin_video", F.substring(title, 1, 300), F.concat(F.lit("https://www.douyin.com/video/"), vid), F.coalesce(F.nullif("v.create_time", F.lit(0)), F.col("fetched_s")),
        F.coalesce(X.blank_to_null(F.col("v.author.nickname")), F.lit("抖音")), video_id=vid, mp4_url=F.replace(F.get("v.video.play_addr.url_list", F.lit(0)), F.lit("/playwm/"), F.lit("/play/")),
        digg_count=F.coalesce("v.statistics.digg_count", F.lit(0)), duration=F.round(ms / 1000).cast("bigint"),
    )


def from_short_video_search(raw: DataFrame, most: int = 20) -> DataFrame:
    """Hits with whole links, one for each; the id is of the path, else of the link's hash."""
    rows = raw.select("fetched_s", F.from_json("payload", "array<struct<href:string,title:string>>").alias("p"))
    one = rows.select("fetched_s", F.posexplode(F.slice("p", 1, most)).alias("pos", "v"))
    one = one.withColumn("href", F.when(F.col("v.href").startswith("http"), F.col("v.href")).otherwise(F.concat(F.lit("https://www.douyin.com"), F.col("v.href"))))
    one = _first(one, F.col("href"), "fetched_s", "pos")
    vid = X.extract_id(F.col("href"), "video")
    return _item(one, F.concat(F.lit("douyin_search:"), F.coalesce(vid, X.stable_id(F.col("href")))), "douyin_search", F.substring("v.title", 1, 200), F.col("href"), F.col("fetched_s"), F.lit("抖音"), video_id=vid)


def video_links(html: Column, extension: str = "mp4") -> Column:
    """Distinct links of the kind in order, escaped slashes undone."""
    found = F.regexp_extract_all(html, F.lit(rf"(https?:\\?/\\?/[^\s\"'<>]+?\.{extension}[^\s\"'<>]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.replace(u, F.lit("\\/"), F.lit("/"))))


def page_title(html: Column) -> Column:
    """The title up to its first comma."""
    return F.trim(F.get(F.split(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), ","), F.lit(0)))


def page_links(html: Column) -> Column:
    """Distinct targets of the page's anchors, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))


def from_video_page(raw: DataFrame) -> DataFrame:
    """Pages (vid, payload, fetched_s): title without suffixes, links with /hd/ first, poster, time, length."""
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", r"(?s)<title>(.*?)</title>", 1), r"[,_]好看视频$", ""))
    rows = raw.withColumn("links", video_links(F.col("payload"))).where("size(links) > 0")
    hd = F.get(F.filter("links", lambda u: F.contains(u, F.lit("/hd/"))), F.lit(0))
    sd = F.get(F.filter("links", lambda u: ~F.contains(u, F.lit("/hd/"))), F.lit(0))
    number = lambda p: F.regexp_extract("payload", p, 1).try_cast("bigint")
    return _item(
        rows, F.concat(F.lit("haokan_video:"), "vid"), "haokan_video", F.trim(F.get(F.split(title, ","), F.lit(0))), F.concat(F.lit("https://haokan.baidu.com/v?vid="), "vid"),
        F.coalesce(number(r'"publish_time"\s*:\s*"?(\d{10})"?'), F.col("fetched_s")), F.lit(""), vid=F.col("vid"), mp4_url=F.coalesce(hd, sd), mp4_sd=sd, stream_count=F.size("links"),
        poster=F.replace(F.regexp_extract("payload", r'"poster"\s*:\s*"([^"]+)"', 1), F.lit("\\/"), F.lit("/")), duration=F.coalesce(number(r'"duration"\s*:\s*"?(\d{2,5})"?'), F.lit(0)),
    )


# How notices name the time, place, links and platforms of a meeting.
MEETING_TIME = r"召开的日期时间[：:\s]*([0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日(?:\s*[0-9]{1,2}\s*点\s*[0-9]{1,2}\s*分)?)"
MEETING_PLACE = r"召开地点[：:\s]*([^\n]{4,60})"
MEETING_LINK = r"(https?://[^\s）)。，,]{6,80})"
MEETING_PLATFORM = "(全景路演|上证路演中心|价值在线|网络文字互动|视频直播|电话会议)"


def meeting_fields(text: Column) -> Column:
    """(meeting_time, meeting_date, place, platforms, live_urls) of a notice; blanks go from time and place."""
    unblank = lambda c: X.blank_to_null(F.regexp_replace(c, r"(?U)\s+", ""))
    when = unblank(F.regexp_extract(text, f"(?U){MEETING_TIME}", 1))
    day = F.try_to_date(F.regexp_replace(F.regexp_extract(when, r"^\d+年\d+月\d+", 0), "[年月]", "-"), "yyyy-M-d")
    place = F.substring(unblank(F.regexp_extract(text, f"(?U){MEETING_PLACE}", 1)), 1, 60)
    platforms = F.array_distinct(F.regexp_extract_all(text, F.lit(MEETING_PLATFORM), F.lit(1)))
    urls = F.filter(F.regexp_extract_all(text, F.lit(f"(?U){MEETING_LINK}"), F.lit(1)), lambda u: ~(u.startswith("http://www.sse") | F.contains(u, F.lit("cninfo"))))
    live = F.slice(F.array_distinct(urls), 1, 3)
    return F.struct(when.alias("meeting_time"), day.alias("meeting_date"), place.alias("place"), platforms.alias("platforms"), live.alias("live_urls"))


def from_announcements(raw: DataFrame, code: str, name: str) -> DataFrame:
    """Announcements of a stock, unless the company's name contradicts; notices and resolutions are marked."""
    a = "announcementTitle:string,announcementId:string,adjunctUrl:string,secName:string,announcementTime:bigint"
    one = raw.select("fetched_s", F.from_json("payload", f"struct<announcements:array<struct<{a}>>>").alias("p")).select("fetched_s", F.explode("p.announcements").alias("v"))
    title = F.regexp_replace(F.coalesce("v.announcementTitle", F.lit("")), "</?em>", "")
    sec = F.coalesce("v.secName", F.lit(""))
    fits = (sec == "") | F.lit(name == "") | F.contains(sec, F.lit(name)) | F.contains(F.lit(name), sec)
    one = one.withColumn("t", title).where((F.col("v.announcementId") != "") & (F.col("t") != "") & fits)
    return _item(
        one, F.concat(F.lit("shareholder_meeting:"), F.col("v.announcementId")), "shareholder_meeting", F.col("t"), F.coalesce("v.adjunctUrl", F.lit("")),
        F.coalesce(F.floor(F.col("v.announcementTime") / 1000), F.col("fetched_s")), F.coalesce(X.blank_to_null(sec), F.lit(name)), stock_code=F.lit(code), company=F.coalesce(X.blank_to_null(sec), F.lit(name)),
        announcement_id=F.col("v.announcementId"), is_meeting_notice=F.col("t").rlike("通知|提示性"), is_resolution=F.contains("t", F.lit("决议")),
    )


def from_portal(raw: DataFrame, keyword: str, noise: str = NOISE, signal: str = SIGNAL) -> DataFrame:
    """Video anchors of a search page that hold the keyword; a code's first text counts."""
    anchor = r"<a[^>]+href=\"[^\"]*?/v/video/(V\w+)\.html[^\"]*\"[^>]*>([^<]+)</a>"
    at = lambda i: F.regexp_extract_all("payload", F.lit(anchor), F.lit(i))
    one = raw.select("fetched_s", F.posexplode(F.arrays_zip(at(1).alias("code"), at(2).alias("text"))).alias("pos", "v"))
    one = one.select("fetched_s", "pos", F.col("v.code").alias("code"), F.trim("v.text").alias("text")).where(F.contains("text", F.lit(keyword)))
    one = _first(one.where(noise_with_rescue(F.col("text"), noise, signal)), F.col("code"), "fetched_s", "pos")
    return _item(one, F.concat(F.lit("netease_video:"), "code"), "netease_video", F.regexp_replace("text", r"[_|].*$", ""), F.concat(F.lit("https://www.163.com/v/video/"), "code", F.lit(".html")), F.col("fetched_s"), F.lit(""), vid=F.col("code"))


def best_stream(streams: DataFrame) -> DataFrame:
    """streams(video_id, kind, bandwidth, url): the widest of each kind; of equal ones the last url."""
    return streams.groupBy("video_id", "kind").agg(F.max_by("url", F.struct("bandwidth", "url")).alias("url"))


#: Registry of sources by name; each makes items of a landed payload.
SOURCES = {
    "bilibili_api": from_space_api, "bilibili_search": from_search, "bilibili_space": from_space_page, "weibo_search": from_microblog,
    "douyin_video": from_short_video, "douyin_search": from_short_video_search, "haokan_video": from_video_page,
}
