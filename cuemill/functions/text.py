"""Texts, titles, tags, ids and model replies as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feeds' platforms: source prefix and platform.
PLATFORMS = (
    ("bilibili", "bilibili"), ("weibo", "weibo"), ("xueqiu", "xueqiu"), ("douyin", "douyin"), ("tencent", "tencent"),
    ("haokan", "haokan"), ("netease", "netease"), ("shareholder", "cninfo"),
)
# Weights of sources by prefix.
SOURCE_WEIGHTS = (
    ("xueqiu", 30), ("tencent", 28), ("bilibili_api", 25), ("bilibili_space", 25), ("weibo", 20), ("bilibili_search", 15),
    ("douyin", 12), ("netease", 10),
)
# Words that raise or lower a title's score.
HIGH_WORDS = ("完整版", "完整", "访谈", "路演", "直播回放", "最新采访", "最新发声", "全集", "最新", "股东大会")
TOPIC_WORDS = ("投资", "医药", "消费", "茅台", "垄断", "ai", "风险", "回报")
LOW_WORDS = ("精华版", "剪辑", "混剪", "恶搞", "鬼畜", "吐槽", "reaction")
# Phrases of hosts.
HOST_PHRASES = (
    "thank you for joining", "welcome to", "my question is", "i want to ask you", "could you tell us", "let me ask you",
    "my next question", "i'd like to ask", "can you talk about", "so my question", "and my question", "question for you",
)
HOST_PHRASES_ZH = ("请问您", "我想问您", "能请您", "感谢您", "谢谢您的")
# Partition rules, first hit wins, and the default.
PARTITIONS = (
    (("投资", "股票", "巴菲特", "芒格", "价值", "基金", "港股", "A股", "股市", "财报", "估值", "帕伯莱", "李录"), 207),
    (("财经", "经济", "GDP", "通胀", "美联储", "利率", "衰退", "汇率", "商业", "创业", "企业家", "CEO"), 207),
    (("科技", "AI", "人工智能", "芯片", "新能源"), 188),
)
DEFAULT_PARTITION = 207
CLOSERS = "\"'」』）)》】]}”’ "


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once a row however often `use` names it. A column named twice is written, and
    worked out, twice, so rules on top of each other would take time by the product of their uses."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def strip_asr_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|[^|]*\|>", "")


def extract_id(url: Column, kind: str) -> Column:
    """Null without one. Kinds: bv, digits, rain, video."""
    pattern = {
        "bv": r"(BV\w+)", "digits": r"(\d{15,25})", "rain": r"/rain/a/([^/?#]+)", "video": r"/video/([^/?#]+)",
    }[kind]
    return blank_to_null(F.regexp_extract(url, pattern, 1))


def video_id_of(page_url: Column, video_url: Column, key: Column) -> Column:
    """BV id of the page, else the direct link without its query, else the page, else the key."""
    direct = blank_to_null(F.substring_index(video_url, "?", 1))
    return F.coalesce(extract_id(page_url, "bv"), direct, blank_to_null(page_url), key)


def platform_of(source: Column) -> Column:
    low = F.lower(F.trim(source))
    out = F.when(F.coalesce(low, F.lit("")) == "", F.lit("unknown"))
    for prefix, name in PLATFORMS:
        out = out.when(low.startswith(prefix), F.lit(name))
    return out.otherwise(low)


def stable_id(key: Column, n: int = 16) -> Column:
    return F.substring(F.md5(key), 1, n)


def make_slug(prefix: Column, tag: Column, platform: Column, url: Column) -> Column:
    """prefix-tag-platform-id; the id is a BV id, else the last ten digits of the link, else eight of its hash."""
    digits = F.regexp_replace(url, r"\D", "")
    last = F.when(F.length(digits) >= 10, F.substring(digits, -10, 10))
    return F.concat_ws("-", prefix, tag, platform, F.coalesce(extract_id(url, "bv"), last, stable_id(url, 8)))


def safe_filename(s: Column, n: int = 40) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(s, r'[\\/:*?"<>|\x00-\x1f]', ""), r"\s+", " "))
    return F.coalesce(blank_to_null(F.trim(F.substring(clean, 1, n))), F.lit("video"))


def strip_relative_prefix(s: Column) -> Column:
    """Without a leading author and age, such as `name 3分钟前`; the text itself if nothing is left."""
    rest = F.trim(F.regexp_replace(s, r"^\S{0,20}\s*\d+\s*(?:秒|分钟|小时|天)前\s*(?:来自\S+)?", ""))
    return F.coalesce(blank_to_null(rest), s)


def clean_feed_title(s: Column, suffixes: str = r"[-_|,]\s*(?:好看视频|网易视频|百度|视频)\s*$") -> Column:
    return F.trim(F.get(F.split(F.regexp_replace(s, suffixes, ""), r"[,_|]"), F.lit(0)))


def fix_terms(text: Column, terms: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    for wrong, right in terms:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def clean_reply(raw: Column) -> Column:
    """A model's reply without its thoughts and code fence."""
    out = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?s)^.*</think>", "")
    out = F.regexp_replace(F.trim(out), r"^\s*```[a-zA-Z]*\s*\n?", "")
    return F.trim(F.regexp_replace(out, r"\n?```\s*$", ""))


def reply_array(raw: Column, schema: str) -> Column:
    """The JSON array between the first [ and the last ], strictly, else with bare keys, single quotes and trailing
    commas mended; null if neither reads."""
    body = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    mended = F.regexp_replace(body, r",\s*([\]}])", "$1")
    mended = F.regexp_replace(mended, r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":')
    mended = F.regexp_replace(mended, r'"(\w+):(\d+)"', '"$1":$2')
    mended = F.regexp_replace(mended, "'", '"')
    strict = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    usable = lambda a: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a)
    return F.coalesce(usable(F.when(F.get_json_object(body, "$").isNotNull(), strict)), usable(F.from_json(mended, schema)))


def cache_key(model: Column, url: Column, body: Column) -> Column:
    """sha256 of model, url and the body map with sorted keys."""
    canonical = F.array_join(
        F.transform(F.array_sort(F.map_entries(body)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&"
    )
    return F.sha2(F.concat_ws("\n", model, url, canonical), 256)


def has_digit_or_percent(t: Column) -> Column:
    return t.rlike(r"[0-9０-９%％]")


# Pairs of marks, words and marks that a title does not end with, and marks that say nothing by themselves.
_PAIRS = ("「」", "『』", "（）", "()", "《》", "【】", "“”", "‘’")
_DANGLING = "[的与和及、，,：:；;]$"
_DOUBLED = r"([，,、；;：:])\1"
_SILENT = r"(?U)[「」『』（）()《》【】\"'“”‘’，,。.！!？?、；;：:\s]"


def title_residue_ok(title: Column, speaker: Column) -> Column:
    """Whether what is left of a title reads as one: no empty or open pair, no odd or empty straight quotes, no dangling or
    doubled mark, and two characters at least besides the speaker and marks. Empty titles do not."""
    return once(F.coalesce(title, F.lit("")), lambda t: _residue_ok(t, speaker))


def _residue_ok(title: Column, speaker: Column) -> Column:
    count = lambda mark: F.regexp_count(title, F.lit("\\" + mark if mark in "()" else mark))
    bad = title.rlike(_DANGLING) | title.rlike(_DOUBLED)
    for pair in _PAIRS:
        bad = bad | F.contains(title, F.lit(pair)) | (count(pair[0]) != count(pair[1]))
    for quote in "\"'":
        bad = bad | F.contains(title, F.lit(2 * quote)) | (count(quote) % 2 != 0)
    names = F.filter(F.split(speaker, r"(?U)[·・\s]+"), lambda p: F.length(p) > 0)
    rest = F.aggregate(F.concat(F.array(speaker), names), title, lambda t, name: F.replace(t, name, F.lit("")))
    rest = F.coalesce(rest, title)  # without a speaker
    return ~bad & (F.length(F.regexp_replace(rest, _SILENT, "")) >= 2)


def title_has_speaker(title: Column, speaker: Column) -> Column:
    """Whether a title names the speaker, or a part of the name. Without a speaker, it does."""
    speaker = F.coalesce(speaker, F.lit(""))
    parts = F.filter(F.split(speaker, r"(?U)[·・\s]+"), lambda p: F.length(p) > 0)
    return once(title, lambda t: F.contains(t, speaker) | F.exists(parts, lambda p: F.contains(t, p)))


def truncate_words(title: Column, n: int) -> Column:
    """Whole words while they fit n characters, without closing marks; a first word that is too long is cut."""
    words = F.split(title, " ")
    fits = F.aggregate(
        words,
        F.struct(F.lit("").alias("t"), F.lit(False).alias("full")),
        lambda a, w: F.when(
            ~a["full"] & (F.length(a["t"]) + F.length(w) + F.when(a["t"] == "", 0).otherwise(1) <= n),
            F.struct(F.when(a["t"] == "", w).otherwise(F.concat(a["t"], F.lit(" "), w)).alias("t"), F.lit(False).alias("full")),
        ).otherwise(F.struct(a["t"].alias("t"), F.lit(True).alias("full"))),
        lambda a: a["t"],
    )
    whole = F.regexp_replace(fits, r"[\s,，、:：;；\-]+$", "")
    return F.when(F.length(title) <= n, title).otherwise(F.coalesce(blank_to_null(whole), F.substring(title, 1, n)))


def clean_title(title: Column, platform: str = "bilibili", singles: dict[str, str] | None = None, soft: int = 25) -> Column:
    """(title, warnings): script and punctuation put right, spaces squeezed, cut at the platform's hard limit."""
    from cuemill.functions import cjk

    hard = 80 if platform == "bilibili" else 55
    t = cjk.normalize_cjk_punct(cjk.convert_script(cjk.trimmed(F.coalesce(title, F.lit(""))), singles or {}))

    def cut(t: Column) -> Column:
        warns = F.array(
            F.when(F.length(t) > hard, F.lit("truncated")),
            F.when((F.length(t) <= hard) & (F.length(t) > soft), F.lit("long")) if platform == "bilibili" else F.lit(None).cast("string"),
            F.when(t == "", F.lit("empty")),
        )
        return F.struct(F.substring(t, 1, hard).alias("title"), F.array_compact(warns).alias("warnings"))

    return once(F.regexp_replace(t, r"(?U)\s+", " "), cut)


def clean_tags(tags: Column, longest: int = 20, most: int = 10, default: str = "财经", singles: dict[str, str] | None = None) -> Column:
    """(tags, warnings): in the wanted script, trimmed, without commas and blanks, cut, distinct in order, the first ten; a
    default if none is left."""
    from cuemill.functions import cjk

    one = lambda t: F.trim(F.regexp_replace(cjk.convert_script(cjk.trimmed(t), singles or {}), "[,，]", ""))
    good = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), one), lambda t: F.length(t) > 0)
    distinct = F.array_distinct(F.transform(good, lambda t: F.substring(t, 1, longest)))
    warns = F.array(
        F.when(F.exists(good, lambda t: F.length(t) > longest), F.lit("cut")),
        F.when(F.size(distinct) > most, F.lit("too_many")),
        F.when(F.size(distinct) == 0, F.lit("empty")),
    )
    kept = F.when(F.size(distinct) > 0, F.slice(distinct, 1, most)).otherwise(F.array(F.lit(default)))
    return F.struct(kept.alias("tags"), F.array_compact(warns).alias("warnings"))


def build_desc(body: Column, source: Column, title: Column, span: Column, disclaimer: str, soft: int = 25, cap: int = 250) -> Column:
    """Long titles first, then body, span, source and disclaimer, a blank line between; over the cap the body is cut."""
    head = F.when(F.length(title) > soft, title)
    tail = F.concat_ws("\n\n", blank_to_null(span), blank_to_null(source), F.lit(disclaimer))
    rest = F.concat_ws("\n\n", head, tail)
    room = F.greatest(F.lit(cap) - F.length(rest) - 2, F.lit(0))
    return F.concat_ws("\n\n", head, blank_to_null(F.substring(body, F.lit(1), room.cast("int"))), tail)


def assign_partition(title: Column, desc: Column) -> Column:
    text = F.concat(F.coalesce(title, F.lit("")), F.coalesce(desc, F.lit("")))
    out = None
    for words, tid in PARTITIONS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, F.lit(tid)) if out is None else out.when(hit, F.lit(tid))
    return out.otherwise(F.lit(DEFAULT_PARTITION))


def classify_media(name: Column, size: Column, rules: list[tuple[str, str]], short: int = 5 << 20) -> Column:
    out = None
    for word, kind in rules:
        out = (F if out is None else out).when(name.contains(word), F.lit(kind))
    return out.when(size < short, F.lit("short")).otherwise(F.lit("other"))


def ends_sentence(text: Column) -> Column:
    closers = r"[\"'」』）)》】\]}”’ ]+$"
    return F.regexp_replace(text, closers, "").rlike(r"[。！？；、.!?;]$")


def content_hash(data: Column) -> Column:
    return F.coalesce(F.sha2(data, 256), F.lit(""))


def classify_failure(status: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(status.isin(400, 401, 402, 403), F.lit("fatal_request"))
        .when(status.isin(404, 410), F.lit("fatal_gone"))
        .when(low.rlike("unsupported|private"), F.lit("fatal_unsupported"))
        .when(low.rlike("log ?in|sign in|cookies"), F.lit("login_wall"))
        .when((status == 429) | status.between(500, 599) | low.rlike("timed? ?out"), F.lit("retryable"))
        .otherwise(F.lit("retryable_unknown"))
    )


def redact_record_lines(text: Column, marker: str = "[redacted]") -> Column:
    r"""Lines with five tab separators or more, tabs or written as \t, replaced by a marker."""
    one = lambda l: F.when(F.regexp_count(l, F.lit(r"\t|\\t")) >= 5, F.lit(marker)).otherwise(l)
    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def brand_title(title: Column, suffix: str, n: int = 40) -> Column:
    return F.when(title.contains("｜"), title).otherwise(F.concat(F.substring(title, 1, n), F.lit("｜" + suffix)))


def source_score(source: Column) -> Column:
    out = None
    for prefix, score in SOURCE_WEIGHTS:
        hit = source.startswith(prefix)
        out = F.when(hit, F.lit(score)) if out is None else out.when(hit, F.lit(score))
    return out.otherwise(F.lit(10))


def title_score(title: Column, keyword: str, high=HIGH_WORDS, topics=TOPIC_WORDS, low=LOW_WORDS) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    out = F.when(t.rlike("|".join(high)), 10).otherwise(0) + F.when(t.rlike(r"\d"), 8).otherwise(0)
    for w in topics:
        out = out + F.when(t.contains(w.lower()), 4).otherwise(0)
    out = out + F.when(t.startswith(keyword.lower()), 5).otherwise(0)
    for w in low:
        out = out - F.when(t.contains(w.lower()), 15).otherwise(0)
    return out


def freshness_score(age_hours: Column) -> Column:
    """By age in hours; null, of an unreadable time, counts 5."""
    return (
        F.when(age_hours.isNull(), 5).when(age_hours < 0, 20).when(age_hours <= 24, 15).when(age_hours <= 72, 10)
        .when(age_hours <= 168, 5).otherwise(0)
    )


def duration_score(sec: Column) -> Column:
    s = F.coalesce(sec, F.lit(0))
    return F.when(s.between(120, 600), 10).when((s > 600) & (s <= 1200), 8).when((s >= 60) & (s < 120), 2).otherwise(0)


def title_similarity(a: Column, b: Column, n: int = 20) -> Column:
    """Characters of a's first n that occur in b's first n, over the longer; not symmetric. Empty titles give 0."""
    x, y = F.substring(a, 1, n), F.substring(b, 1, n)
    common = F.size(F.filter(F.split(x, ""), lambda c: (F.length(c) > 0) & F.contains(y, c)))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(F.coalesce(F.length(x) * F.length(y), F.lit(0)) == 0, F.lit(0.0)).otherwise(common / longest)


def host_dominated(text: Column) -> Column:
    """Whether a paragraph is a host's rather than a speaker's."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda p: F.regexp_count(low, F.lit(p))
    you, me = count(" you") + count("your "), count(" i ") + count("my ")
    phrases = F.exists(F.array(*[F.lit(p) for p in HOST_PHRASES + HOST_PHRASES_ZH]), lambda p: F.contains(low, p))
    polite = F.contains(F.substring(low, 1, 30), F.lit("您")) & (count("我") < count("您"))
    return phrases | (F.contains(low, F.lit("?")) & (you >= 2) & (you > 2 * me)) | polite


def subtitle_plan(found: Column, seen: Column, is_subtitle: Column, langs: Column, legible: Column, top: Column) -> Column:
    """(action, avoid): what to burn beside subtitles that are in the picture already."""
    zh = F.exists(langs, lambda x: x.contains("中") | F.contains(F.lower(x), F.lit("zh")) | x.contains("Chinese"))
    en = F.exists(langs, lambda x: x.contains("英") | x.contains("English") | (F.lower(x) == "en"))
    both = F.lit("burn_bilingual")
    none = F.lit(None).cast("double")
    make = lambda a, t: F.struct(a.alias("action"), t.alias("avoid"))
    return (
        F.when(~found, make(both, none)).when(~seen, make(both, top)).when(~is_subtitle, make(both, none))
        .when(~F.coalesce(legible, F.lit(True)), make(both, top)).when(zh, make(F.lit("skip_subtitle"), top))
        .when(en, make(F.lit("burn_zh_only"), top)).otherwise(make(both, top))
    )


def video_compliance(sec: Column, width: Column, height: Column) -> Column:
    short = F.least(width, height)
    return F.array_compact(
        F.array(
            F.when(sec > 900, F.lit("warn:long")),
            F.when(height.isNull() | (height < 360), F.lit("reject:height")),
            F.when(short < 720, F.lit("warn:resolution")),
        )
    )


def normalize_episode(title: Column, status: Column, tags: Column, day: Column) -> Column:
    kept = F.filter(F.transform(F.coalesce(tags, F.array()), lambda t: F.trim(t)), lambda t: F.length(t) > 0)
    return F.struct(
        F.coalesce(blank_to_null(F.trim(title)), F.lit("untitled")).alias("title"),
        F.coalesce(blank_to_null(F.trim(status)), F.lit("pending")).alias("status"),
        kept.alias("tags"),
        F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).alias("date"),
    )


def copy_reply(raw: Column) -> Column:
    """(title, descr, tags) of a JSON object in a reply; if it doesn't read, by the names of the next keys. Null without a
    title."""
    blob = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    strict = F.from_json(blob, "struct<title:string,desc:string,tags:array<string>>")
    reads = F.try_parse_json(blob).isNotNull()
    field = lambda a, b: F.trim(F.regexp_extract(blob, rf'(?s)"{a}"\s*:\s*"(.*?)"\s*,\s*"{b}"\s*:', 1))
    tags = F.regexp_extract_all(F.regexp_extract(blob, r'(?s)"tags"\s*:\s*\[(.*?)\]', 1), F.lit('"([^"]+)"'), F.lit(1))
    title = F.when(reads, strict["title"]).otherwise(field("title", "desc"))
    out = F.struct(title.alias("title"), F.when(reads, strict["desc"]).otherwise(field("desc", "tags")).alias("descr"), F.when(reads, strict["tags"]).otherwise(tags).alias("tags"))
    return F.when(F.coalesce(title, F.lit("")) != "", out)
