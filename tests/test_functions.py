"""Literal inputs, expected values typed by hand."""

import datetime
import random

import pytest
from cuemill.functions import cjk
from cuemill.functions import text as X
from cuemill.functions import timecode as T
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_times(spark):
    v = lambda c: value(spark, c)
    assert v(T.hms_to_ms(F.lit("01:02:03,045"))) == 3723045 and v(T.hms_to_ms(F.lit("00:00:09"))) == 9000 and v(T.hms_to_ms(F.lit("x"))) is None
    assert v(T.ms_to_srt(F.lit(59999))) == "00:00:59,999" and v(T.ms_to_srt(F.lit(-5))) == "00:00:00,000"
    assert [v(T.duration_to_sec(F.lit(s))) for s in ("75", "1:15", "1:01:15", "--", "", "1:2:3:4")] == [75, 75, 3675, 0, 0, 0]
    assert v(T.fmt_duration(F.lit(0))) == "—" and v(T.fmt_duration(F.lit(61))) == "1:01" and v(T.fmt_duration_page(F.lit(3661))) == "1:01:01"
    assert v(T.parse_view_count(F.lit("3.2万"))) == 32000 and v(T.parse_view_count(F.lit("12"))) == 12 and v(T.parse_view_count(F.lit("n/a"))) is None
    day = F.lit("2024-03-10").cast("date")
    got = [v(T.resolve_relative_date(F.lit(t), day)) for t in ("今天 10:00", "昨天", "02-05", "2023-11-07", "?")]
    assert got == [datetime.date(2024, 3, 10), datetime.date(2024, 3, 9), datetime.date(2024, 2, 5), datetime.date(2023, 11, 7), datetime.date(2024, 3, 10)]
    assert v(T.days_until(day, day)) == 0 and v(T.is_upcoming(day, day)) is True
    assert v(T.link_expiry(F.lit("http://a/b?x=1&Expires=17"))) == 17 and v(T.link_expiry(F.lit("http://a"))) == 0
    assert v(T.human_size(F.lit(1536))) == "1.5 KB"


def test_titles(spark):
    v = lambda c: value(spark, c)
    ok = lambda t: v(X.title_residue_ok(F.lit(t), F.lit("")))
    assert ok("巴菲特谈投资") and not ok("他说（）好") and not ok("增长，") and not ok("a") and not ok('he said "hi') and not ok("好，，坏")
    assert v(X.title_has_speaker(F.lit("芒格说"), F.lit("查理·芒格"))) and not v(X.title_has_speaker(F.lit("x"), F.lit("查理·芒格")))
    assert v(X.truncate_words(F.lit("one two three"), 8)) == "one two" and v(X.truncate_words(F.lit("abcdefghij k"), 4)) == "abcd"
    assert v(X.assign_partition(F.lit("芯片"), F.lit(""))) == 188 and v(X.assign_partition(F.lit("?"), F.lit("AI与股票"))) == 207
    assert v(X.title_similarity(F.lit("abcd"), F.lit("abxy"))) == 0.5 and v(X.title_similarity(F.lit("aab"), F.lit("a"))) == pytest.approx(2 / 3)
    assert v(X.title_score(F.lit("林园最新访谈：2024茅台AI Reaction"), "林园")) == 10 + 8 + 4 + 4 + 5 - 15
    assert v(X.brand_title(F.lit("a｜b"), "C")) == "a｜b" and v(X.brand_title(F.lit("a"), "C")) == "a｜C"
    assert v(X.ends_sentence(F.lit("好。”"))) and not v(X.ends_sentence(F.lit("好")))
    assert v(X.strip_relative_prefix(F.lit("张三 3分钟前 你好"))) == "你好" and v(X.strip_relative_prefix(F.lit("3分钟前"))) == "3分钟前"
    assert v(X.clean_feed_title(F.lit("好片_网易视频"))) == "好片"


def test_replies(spark):
    v = lambda c: value(spark, c)
    assert v(X.clean_reply(F.lit("a</think>```json\n[1]\n```"))) == "[1]"
    schema = "array<struct<start:int,end:int>>"
    for raw in ('x [{"start":1,"end":2}] y', "[{start:1, 'end':2,},]", '[{"start":1,"end:2"}]'.replace('"end:2"', '"end:2')):
        assert [tuple(r) for r in v(X.reply_array(F.lit(raw), schema)) or []] in ([(1, 2)], [])
    assert v(X.reply_array(F.lit("nothing"), schema)) is None
    assert v(X.redact_record_lines(F.lit("ok\na\tb\tc\td\te\tf\nok"))) == "ok\n[redacted]\nok"
    assert v(X.classify_failure(F.lit(503), F.lit(""))) == "retryable" and v(X.classify_failure(F.lit(None).cast("int"), F.lit("Private video"))) == "fatal_unsupported"


@pytest.mark.parametrize(
    "found, seen, is_subtitle, langs, legible, action, avoid",
    [
        (False, True, True, ["zh"], True, "burn_bilingual", None), (True, False, True, [], True, "burn_bilingual", 0.8), (True, True, False, ["zh"], True, "burn_bilingual", None),
        (True, True, True, ["zh"], False, "burn_bilingual", 0.8), (True, True, True, ["中文", "en"], True, "skip_subtitle", 0.8), (True, True, True, ["English"], True, "burn_zh_only", 0.8),
        (True, True, True, ["?"], True, "burn_bilingual", 0.8),
    ],
)
def test_subtitle_plan(spark, found, seen, is_subtitle, langs, legible, action, avoid):
    array = F.array(*[F.lit(x) for x in langs]).cast("array<string>")
    got = value(spark, X.subtitle_plan(F.lit(found), F.lit(seen), F.lit(is_subtitle), array, F.lit(legible), F.lit(0.8)))
    assert tuple(got) == (action, avoid)


PUNCTUATION = [
    # curly quotes, nested, open, and single
    ("老师讲“慢就是快”这句话", "老师讲「慢就是快」这句话"), ("他讲“报上写着“破产”两字”", "他讲「报上写着『破产』两字」"), ("后半句”没了", "后半句”没了"), ("人称‘股王’", "人称「股王」"),
    # straight quotes: pairs beside Chinese, an odd one, English alone
    ('这叫"能力圈"。', "这叫「能力圈」。"), ('只剩半个"引号', '只剩半个"引号'), ('She said "yes" twice.', 'She said "yes" twice.'),
    # white brackets: outermost pairs change, inner ones and those that do not pair stay
    ("他回答『可以』", "他回答「可以」"), ("他讲「父亲常讲『等』」", "他讲「父亲常讲『等』」"), ("『前半』后半『", "「前半」后半『"), ("「甲『乙」丙』", "「甲『乙」丙』"), ("『一』和『二』", "「一」和「二」"),
    ("「耐心」与『纪律』", "「耐心」与「纪律」"),
    # width
    ("先想,再做;行吗?行!", "先想，再做；行吗？行！"), ("芒格(合伙人)讲过", "芒格（合伙人）讲过"), ("要点:少犯错", "要点：少犯错"),
    # spans that stay
    ("来源:https://a.example/v?t=9&k=2", "来源：https://a.example/v?t=9&k=2"), ("看 https://a.example/v?t=9&k=2,再读年报", "看 https://a.example/v?t=9&k=2，再读年报"),
    ("见 www.example.org/p?q=1,多谢", "见 www.example.org/p?q=1，多谢"), ("去 www.example.org 看", "去 www.example.org 看"), ("写信给 a.b+c@example.org 即可", "写信给 a.b+c@example.org 即可"),
    ("卖了7,654.32元", "卖了7,654.32元"), ("定在18:45见", "定在18:45见"), ("这家 Acme, Ltd 公司", "这家 Acme, Ltd 公司"), ("买了 ABC.D, XYZ 两只", "买了 ABC.D, XYZ 两只"),
    # repeats
    ("后来呢。。。", "后来呢……"), ("涨了!!", "涨了！"), ("跌了！！！", "跌了！"), ("当真??", "当真？"), ("怎么？！！", "怎么？"), ("再等………", "再等……"), ("等，，再说", "等，再说"),
    # blanks and line breaks
    ("他讲 ，要慢", "他讲，要慢"), ("持有 Acme 十年", "持有 Acme 十年"), ("持有    Acme    十年", "持有 Acme 十年"), ("上段。\n\n下段。", "上段。\n\n下段。"), ("  两边  ", "两边"),
    # a mark that ends a Chinese text behind a Latin word; English alone; links and numbers at the end
    ("今年算不算Bubble?", "今年算不算Bubble？"), ("作者Ann Lee,", "作者Ann Lee，"), ("Is it over?", "Is it over?"), ("参见 https://a.example/b?c=1", "参见 https://a.example/b?c=1"), ("涨了 4.5%", "涨了 4.5%"),
    # the placeholder itself, many spans, nothing
    ("甲\ue000乙 https://a.example/?x,乙", "甲\ue000乙 https://a.example/?x，乙"), ("价 " + "1,23 " * 7000 + "元,", "价 " + "1,23 " * 7000 + "元，"), ("", ""), (None, None),
]


def test_punctuation(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PUNCTUATION)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", cjk.normalize_cjk_punct(F.col("t")).alias("n")).collect()}
    assert {PUNCTUATION[i][0]: n for i, n in got.items()} == dict(PUNCTUATION)


def uses(df, name):
    """How often the optimized plan works with a column of the input."""
    import re

    return len(re.findall(rf"\b{name}#", df._jdf.queryExecution().optimizedPlan().toString()))


def test_punctuation_reads_its_text_once(spark):
    """A rule that names its text twice is worked out twice, and rules on top of each other by the product. Beside the scan's
    own, the plan has one use of the text, and of each span's rules one or two."""
    rows = spark.range(3).select(F.concat(F.lit("字,"), F.col("id").cast("string")).alias("raw")).localCheckpoint().toDF("raw")
    df = rows.select(cjk.normalize_cjk_punct(F.col("raw")).alias("t")).select(F.length("t").alias("n"), F.sha2("t", 256).alias("h"))
    assert uses(df, "raw") <= 3
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 20
    assert [r["n"] for r in df.collect()] == [3, 3, 3]


PASSED_OVER = [
    # rules whose marks a text lacks are passed over, those it has are not: tabs, breaks behind the end, mixed marks, dots
    ("字\tA", "字 A"), ("A\t字", "A 字"), ("A\tB", "A\tB"), ("A\t\tB", "A B"), ("字  ，  好", "字，好"), ("，\t。 x", "，。x"), ("字A?\r\nA", "字A?\r\nA"), ("字A.....b", "字A…….b"),
    ("字!？", "字！"), ("好。！？。。。", "好。！……"), ("a,b字,c", "a,b字，c"), ("1:2:3字:", "1:2:3字："), ("\u3000字\x85", "字"), ("\u2003", ""),
]


def test_rules_passed_over_have_no_match(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PASSED_OVER)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", cjk.normalize_cjk_punct(F.col("t")).alias("n")).collect()}
    assert {PASSED_OVER[i][0]: n for i, n in got.items()} == dict(PASSED_OVER)


def test_quotes_keep_their_number_and_settle(spark):
    """Over random texts: quote marks stay quote marks in their places, a second pass changes nothing more in texts whose marks
    pair, and links come back whole."""
    rng = random.Random(7)
    opens = {"“": "”", "「": "」", "『": "』", "‘": "’"}

    def nested(depth):
        q = rng.choice([*opens])
        return q + "".join(nested(depth - 1) if depth and rng.random() < 0.5 else rng.choice("甲乙丙") for _ in range(rng.randrange(1, 4))) + opens[q]

    texts = ["字" + "".join(nested(3) for _ in range(rng.randrange(1, 4))) + " https://a.example/“x”?k=" + str(k) for k in range(150)]
    texts += ["字" + "".join(rng.choices("“”「」『』‘’甲", k=rng.randrange(1, 15))) for _ in range(150)] + ["“" * 3000 + "中" + "”" * 3000]
    once = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", cjk.normalize_cjk_punct(F.col("t")).alias("n"))
    got = once.select("*", cjk.normalize_cjk_punct(F.col("n")).alias("again")).collect()
    mark = lambda t: [k for k, c in enumerate(t) if c in "“”「」『』‘’"]
    for r in got:
        assert mark(r["t"]) == mark(r["n"])
        if r["i"] < 150:
            assert f"?k={r['i']}" in r["n"]
            body = r["n"].split(" https")[0]
            assert not set(body) & set("“”‘’") and body.count("「") == body.count("」") and body.count("『") == body.count("』")
            assert r["again"] == r["n"]
    assert got[-1]["n"] == "「" + "『" * 2999 + "中" + "』" * 2999 + "」"


def test_numerals_by_groups(spark):
    digits = "零一二三四五六七八九"

    def named(n):  # below ten thousand
        out, gap = "", False
        for place, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
            d, n = divmod(n, place)
            out += ("零" if gap and d and out else "") + (digits[d] + unit if d else "")
            gap = not d
        return out

    rng = random.Random(3)
    numbers = [(a, b, c) for a, b, c in ((rng.randrange(10_000), rng.randrange(10_000), rng.randrange(10_000)) for _ in range(300))]
    rows = [(float(a * 10**8 + b * 10**4 + c), "".join((named(n) + u) if n else "" for n, u in ((a, "亿"), (b, "万"), (c, "")))) for a, b, c in numbers]
    rows += [(10.0, "十"), (10.0, "零十"), (0.0, "万"), (3.0, "一二三"), (60.0, "五六十"), (205.0, "两百〇五"), (12.5, "12.5")]
    got = spark.createDataFrame(rows, "v double, t string").select("v", "t", cjk._value(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in got] == [v for v, _ in rows]


def test_scripts(spark):
    v = lambda c: value(spark, c)
    table = {"說": "说", "書": "书", "後": "后"}
    assert v(cjk.convert_script(F.lit("他說讀書後\ue000(皇後)後"), table, ("皇後", "(皇"))) == "他说讀书后\ue000(皇后)后"
    assert v(cjk.convert_script(F.lit("皇後與後"), table, ("皇後",))) == "皇後與后" and v(cjk.convert_script(F.lit("後"), {}, ())) == "後"
    many = tuple(f"t{i}後" for i in range(7000))
    assert v(cjk.convert_script(F.lit("t6999後 後 t1後"), table, many)) == "t6999後 后 t1後"
    cues = spark.createDataFrame([(1, "他說,好", "x"), (2, "plain", "y")], "i int, text string, changed string")
    assert [tuple(r) for r in cjk.normalize_cues(cues, table).collect()] == [(1, "他说，好", True), (2, "plain", False)]


def test_language_of_cues(spark):
    rows = [(1, 1, "你好世界"), (2, 1, "hello 你好世"), (3, 1, " "), (3, 2, None), (4, 1, "x" * 19_990), (4, 2, "中" * 3000), (5, 1, "x" * 79 + "中" * 4), (6, 1, "x" * 77 + "中" * 4)]
    cues = spark.createDataFrame(rows, "video_id int, cue_index int, text string")
    assert {r[0]: r[1] for r in cjk.detect_lang(cues).collect()} == {1: "zh", 2: "en", 3: "", 4: "en", 5: "en", 6: "en"}
    assert {r[0]: r[1] for r in cjk.detect_lang(cues, 10**6).collect()}[4] == "zh"
    assert cjk.detect_lang(cues.where("video_id < 0")).count() == 0


NUMBERS = [
    ("收益250%", ["PCT:250.0"]), ("翻5倍", ["X:5.0"]), ("百分之三十五的股份", ["PCT:35.0"]), ("没有数", []), (None, []), ("一", ["N:1.0"]), ("两亿五千万", ["N:2.5E8"]), ("一百零五", ["N:105.0"]),
    ("十二年", ["N:12.0"]), ("12年", ["N:12.0"]), ("三倍与3倍", ["X:3.0"]), ("卖19.5美元", ["N:19.5"]), ("1,200", ["N:1.0", "N:200.0"]), ("百分之40和40％", ["PCT:40.0"]), ("一千二百三十四", ["N:1234.0"]), ("十万", ["N:100000.0"]),
]


def test_numbers(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NUMBERS)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", cjk.number_tokens(F.col("t")).alias("n")).collect()}
    assert {NUMBERS[i][0]: n for i, n in got.items()} == dict(NUMBERS)
    v = lambda c: value(spark, c)
    assert v(cjk.untraceable_numbers(F.lit("赚了300%"), F.lit("只谈机会"))) == ["PCT:300.0"] and v(cjk.untraceable_numbers(F.lit("占40%"), F.lit("约百分之四十"))) == []
    bad = lambda *t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    assert v(cjk.strip_tokens(F.lit("某人：回报超300%"), bad("PCT:300.0"))) == "某人：回报超"
    assert v(cjk.strip_tokens(F.lit("3倍，40%，甲，9年"), bad("X:3.0", "PCT:40.0", "N:9.0"))) == "甲"
    assert v(cjk.strip_tokens(F.lit("三倍与40%"), bad("PCT:40.0"))) == "三倍与" and v(cjk.strip_tokens(F.lit("x"), bad())) == "x"


RESIDUES = {
    True: ["某甲谈投资里的长期心态", "某甲：纪律的用处", "某甲谈投资里的『40%』之例", "某甲谈投资"],
    False: [
        *[f"某甲谈投资里的{e}与亏损" for e in ("「」", "『』", "（）", "()", "《》", "【】", '""', "''", "“”", "‘’")], "某甲谈投资里的「亏损", "某甲谈投资里的」亏损", "某甲谈投资（里的亏损", "某甲谈投资里的亏损）",
        '某甲说"行', "某甲谈投资里的与", "某甲谈投资里的亏损：", "某甲谈投资里的、", "某甲谈投资，，里的亏损", "某甲：", "某甲。", "", None,
    ],
}


def test_residues_of_titles(spark):
    rows = [(t, ok) for ok, titles in RESIDUES.items() for t in titles]
    got = spark.createDataFrame(rows, "t string, ok boolean").select("t", "ok", X.title_residue_ok(F.col("t"), F.lit("某甲")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == rows
    v = lambda c: value(spark, c)
    assert not v(X.title_residue_ok(F.lit("查理谈"), F.lit("查理·芒格"))) and v(X.title_residue_ok(F.lit("查理谈"), F.lit(None).cast("string")))


def test_final_titles(spark):
    rows = [
        ("甲谈投资里的『40%』与亏损", "甲", "通篇没有数字", "投资里的亏损", "甲：投资里的亏损"), ("甲谈300%的杠杆与信号", "甲", "谈的是纪律", "", "甲谈的杠杆与信号"),
        ("谈投资里的「40%」与亏损", "甲", "没有数字", "", "甲谈投资"), ("甲：40%的仓位", "甲", "仓位在百分之四十左右", "", "甲：40%的仓位"), ("甲谈『300%』", "甲", "没有", "「40%』的亏损", "甲谈投资"),
        ("谈耐心", "甲", "", "", "甲：谈耐心"), (None, "甲", "", "", "甲"), ("甲谈三倍回报", "甲", "拿到3倍", "", "甲谈三倍回报"),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, title string, speaker string, source string, suggestion string")
    got = cjk.finalize_titles(df, "谈投资").orderBy("i").collect()
    assert [r["final_title"] for r in got] == [r[4] for r in rows]


def test_titles_and_tags_with_warnings(spark):
    v = lambda c: tuple(value(spark, c))
    assert v(X.clean_title(F.lit(" 某甲:“护城河”是什麼? "), singles={"麼": "么"})) == ("某甲：「护城河」是什么？", [])
    assert v(X.clean_title(F.lit("字" * 81))) == ("字" * 80, ["truncated"]) and v(X.clean_title(F.lit("字" * 56), "douyin")) == ("字" * 55, ["truncated"])
    assert v(X.clean_title(F.lit("字" * 26))) == ("字" * 26, ["long"]) and v(X.clean_title(F.lit("字" * 26), "douyin")) == ("字" * 26, []) and v(X.clean_title(F.lit(None).cast("string"))) == ("", ["empty"])
    tags = lambda *t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    assert v(X.clean_tags(tags(" 財,經", "财经", "", "b，c"), singles={"財": "财", "經": "经"})) == (["财经", "bc"], [])
    assert v(X.clean_tags(tags(*[f"t{i}" for i in range(12)], "长" * 21))) == ([f"t{i}" for i in range(10)], ["cut", "too_many"])
    assert v(X.clean_tags(tags(" ", ","))) == (["财经"], ["empty"]) and v(X.clean_tags(F.lit(None).cast("array<string>"))) == (["财经"], ["empty"])


def test_titles_are_cleaned_once(spark):
    """Title and warnings come of one cleaning, not of one each."""
    rows = spark.range(3).select(F.concat(F.lit("字,"), F.col("id").cast("string")).alias("raw")).localCheckpoint().toDF("raw")
    df = rows.select(X.clean_title(F.col("raw")).alias("t")).select("t.title", F.array_join("t.warnings", ",").alias("w"))
    assert uses(df, "raw") <= 3
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 24
    assert [tuple(r) for r in df.collect()] == [(f"字，{i}", "") for i in range(3)]


def test_final_titles_work_out_each_step_once(spark):
    """A title's numbers, what is left of it and the suggestion are columns of their own, made where earlier ones fail."""
    rows = spark.range(3).select(F.concat(F.lit("涨三倍"), F.col("id").cast("string")).alias("title"), F.lit("甲").alias("speaker"), F.lit("没有").alias("source"), F.lit("谈，耐心").alias("suggestion")).localCheckpoint()
    df = cjk.finalize_titles(rows, "谈投资")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 30 and plan.count("regexp_extract_all") < 80
    assert [r["final_title"] for r in df.collect()] == ["甲：谈，耐心"] * 3
    assert uses(rows.select(X.title_residue_ok(F.col("title"), F.lit("甲"))), "title") <= 3
    assert uses(rows.select(cjk.strip_tokens(F.col("title"), F.array(F.lit("X:3.0")))), "title") <= 3
