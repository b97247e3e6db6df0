"""Rules for Chinese text, as columns in the JVM. Cutting long cues is the one rule that runs in Python."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.functions import text as X

# Scripts that count as Chinese context, half-width marks and their full-width forms.
CJK = "一-鿿㐀-䶿぀-ヿ"
HALF_TO_FULL = {",": "，", ";": "；", ":": "：", "?": "？", "!": "！", "(": "（", ")": "）"}
# What punctuation rules leave alone. Links end at Chinese, at full-width marks and before closing marks.
_LINK = rf"[^\s{CJK}，。！？；：、（）「」『』“”‘’]+(?<![,.;:!?])"
#: (whether a text may hold such spans, their pattern): most texts hold few kinds, and each costs time at every character.
_SPANS = (
    (lambda t: F.contains(t, F.lit("://")), rf"(?=[a-zA-Z])(?:(?<![a-zA-Z])|\G)[a-zA-Z][a-zA-Z0-9+.\-]*+://{_LINK}"),
    (lambda t: F.contains(t, F.lit("www.")), rf"www\.{_LINK}"),
    (lambda t: F.contains(t, F.lit("@")), r"(?:(?<![\w.\-+])|\G)[\w.\-+]++@[\w.\-]+\.\w+"),
    (lambda t: t.rlike(r"(?U)[,:.](?<=\d.)\d"), r"(?=\d)(?:(?<!\d)|\G)\d+(?:[,:.]\d+)+%?"),
    (lambda t: t.rlike(r"[,:;?!()](?<=[A-Za-z].)[ ]?[A-Za-z]"), r"(?=[A-Za-z])(?:(?<![A-Za-z])|\G)[A-Za-z]++(?:[,:;?!()][ ]?[A-Za-z]++)+"),
)
# Chinese digits, units within ten thousand, and greater units.
_DIGITS, _UNITS, _GREAT = "零〇一二两三四五六七八九", "十百千", "万亿"
# What counts as a number in a title, with its units.
_CORE = rf"(?:\d+(?:\.\d+)?|[{_DIGITS}{_UNITS}{_GREAT}]+)"
_NUMBER = rf"百分之{_CORE}|{_CORE}(?:%|％|倍|美元|元|万元|块钱|年|岁|次)?"
_QUOTE = "[“”‘’「」『』]"
_HAN = re.compile("[一-鿿]")
#: Stands for one span that is kept while the text around it changes.
_HOLD = "\ue000"


def _woven(free: Column, between: Column) -> Column:
    """free[0], between[0], free[1], ... as one text; free has one part more."""
    return F.array_join(F.zip_with(free, F.concat(between, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _around(text: Column, spans: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(text) but for the matches of spans(text), a pattern or an empty text. While it runs, each of them is one
    placeholder; one that the text has itself is a match too, so any number of spans and any text come back whole."""

    def changed(t: Column, pattern: Column) -> Column:
        some = (pattern != "") | F.contains(t, F.lit(_HOLD))
        pattern = F.concat(F.lit(f"(?U){_HOLD}"), pattern)
        held = F.when(some, F.regexp_replace(t, pattern, F.lit(_HOLD))).otherwise(t)
        kept = F.when(some, F.regexp_extract_all(t, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
        return _woven(F.split(change(held), _HOLD), kept)

    return X.once(text, lambda t: X.once(spans(t), lambda pattern: changed(t, pattern)))


def _by_rules(text: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """text after rules(needs, pattern, to) in order; one whose `needs` the text lacks has no match, and is passed over."""
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("needs", "pattern", "to"), r)]) for r in rules])
    return F.aggregate(table, text, lambda t, r: F.when(F.contains(t, r["needs"]), F.regexp_replace(t, r["pattern"], r["to"])).otherwise(t))


def convert_script(text: Column, singles: dict[str, str], protect: tuple[str, ...] = ()) -> Column:
    """Characters by the mapping, but for protected terms, longest first."""
    terms = [re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted(protect, key=lambda t: (-len(t), t)) if t]
    change = (lambda c: F.translate(c, "".join(singles), "".join(singles.values()))) if singles else (lambda c: c)
    return _around(text, lambda t: F.lit("".join(f"|{x}" for x in terms)), change) if terms else change(text)


def _paired_quotes(marks: Column) -> Column:
    """A text's quote marks in order as the text of the same length that takes their place: one pass in the JVM.

    State: how deep curly double quotes are nested, how many corner marks are open, where the outermost of these stands in
    the marks written so far, and these. Curly double quotes are corner marks, single ones outside and double ones inside;
    curly single quotes are double corner marks. A closing mark that closes the outermost of two double ones makes them
    single, in the marks written, too. What closes nothing stays as it is."""
    start = F.struct(F.lit(0).alias("curly"), F.lit(0).alias("open"), F.lit(0).alias("outer"), F.lit("").alias("out"))

    def step(a: Column, mark: Column) -> Column:
        inside = a["curly"] - F.when(mark == "”", 1).otherwise(0) > 0
        new = (
            F.when((mark == "“") | ((mark == "”") & (a["curly"] > 0)), F.translate(F.when(inside, F.translate(mark, "“”", "『』")).otherwise(mark), "“”", "「」"))
            .otherwise(F.translate(mark, "‘’", "『』"))
        )
        return X.once(new, lambda new: written(a, mark, new))

    def written(a: Column, mark: Column, new: Column) -> Column:
        opens, closes = new.isin("「", "『"), new.isin("」", "』") & (a["open"] > 0)
        whole = closes & (a["open"] == 1) & (new == "』") & (F.substring(a["out"], a["outer"], F.lit(1)) == "『")
        return F.struct(
            F.greatest(F.lit(0), a["curly"] + F.when(mark == "“", 1).when(mark == "”", -1).otherwise(0)).alias("curly"),
            (a["open"] + opens.cast("int") - closes.cast("int")).alias("open"),
            F.when(opens & (a["open"] == 0), F.length(a["out"]) + 1).otherwise(a["outer"]).alias("outer"),
            F.when(whole, F.concat(F.overlay(a["out"], F.lit("「"), a["outer"], F.lit(1)), F.lit("」"))).otherwise(F.concat(a["out"], new)).alias("out"),
        )

    return F.aggregate(marks, start, step, lambda a: a["out"])


def _corner_quotes(t: Column) -> Column:
    """Straight double quotes in pairs to corner marks, if the text is Chinese and their number is even; then the others."""
    turn = lambda pieces: F.transform(pieces, lambda x, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, "「").otherwise("」"), x))
    even = lambda t: X.once(F.split(t, '"'), lambda p: F.when(F.size(p) % 2 == 1, F.array_join(turn(p), "")).otherwise(t))
    straight = X.once(t, lambda t: F.when(F.contains(t, F.lit('"')) & t.rlike(f"[{CJK}]"), even(t)).otherwise(t))
    marks = lambda t: F.split(_paired_quotes(F.regexp_extract_all(t, F.lit(_QUOTE), F.lit(0))), "")
    # Single corner marks stay as they are where there are no others.
    return X.once(straight, lambda t: F.when(t.rlike("[‘-”『-』]"), _woven(F.split(t, _QUOTE), marks(t))).otherwise(t))


#: Marks beside Chinese.
_WIDTH = tuple((half, f"{re.escape(half)}(?:(?<=[{CJK}].)|(?=[{CJK}]))", full) for half, full in HALF_TO_FULL.items())
#: Repeated marks. Three stops or more are an ellipsis, others are one; of mixed ones the first stays.
_FOLDS = (
    ("。。。", "。。。+", "……"), ("...", r"\.\.\.+(?![a-zA-Z0-9/])", "……"), ("、、、", "、、、+", "……"), ("………", "………+", "……"),
    *((2 * m, f"{m}{m}+", m) for m in "！？，；：。"), ("!!", "!!+", "！"), ("??", r"\?\?+", "？"), ("！", "！[！？!?]+", "！"), ("？", "？[！？!?]+", "？"),
)
#: No blanks beside full-width marks, one between scripts; line breaks stay.
_SPACES = (
    ("", "[ \t](?:(?<=[，。！？；：、（「『].)[ \t]*+|[ \t]*+(?=[，。！？；：、）」』]))", ""), ("\t", f"(?<=[{CJK}])[ \t]+(?=[A-Za-z0-9])", " "),
    ("\t", f"(?<=[A-Za-z0-9])[ \t]+(?=[{CJK}])", " "), ("  ", "[ \t][ \t]+", " "), ("\t", "[ \t][ \t]+", " "),
)


def _full_width(t: Column) -> Column:
    """Marks beside Chinese, and one that ends a text with Chinese."""

    def ended(t: Column) -> Column:
        last = t
        for half in ",;:?!":
            last = F.regexp_replace(last, re.escape(half) + "$", HALF_TO_FULL[half])
        # A line break may come behind the end: two characters at most.
        return F.when(F.right(t, F.lit(3)).rlike("[,;:?!]$") & t.rlike(f"[{CJK}]"), last).otherwise(t)

    return X.once(_by_rules(t, _WIDTH), ended)


def trimmed(t: Column) -> Column:
    ends = lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    return X.once(t, lambda t: F.when(ends(t).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t))


def normalize_cjk_punct(text: Column) -> Column:
    """Corner quotes in pairs, full-width marks beside Chinese, runs folded, blanks put right. Links, addresses, numbers and
    English phrases are left alone, and so is what does not pair. Null stays null."""
    spans = lambda t: F.concat(*[F.when(may(t), f"|{pattern}").otherwise("") for may, pattern in _SPANS])
    return trimmed(_around(text, spans, lambda t: _by_rules(_full_width(_corner_quotes(t)), _FOLDS + _SPACES)))


def normalize_cues(cues: DataFrame, singles: dict[str, str] | None = None, protect: tuple[str, ...] = ()) -> DataFrame:
    """cues with text in the wanted script and its punctuation put right, and `changed`."""
    new = normalize_cjk_punct(convert_script(F.col("text"), singles or {}, protect))
    kept = [F.col(f"`{c}`") for c in cues.columns if c not in ("text", "changed")]
    place = [new.alias("text") if c == "text" else F.col(f"`{c}`") for c in cues.columns if c != "changed"]
    return cues.select(*place, (~new.eqNullSafe(F.col("text"))).alias("changed")) if kept else cues.select(*place)


def detect_lang(cues: DataFrame, most: int = 20_000) -> DataFrame:
    """(video_id, lang) by the first `most` characters of each video's cues, lines joined: zh with as many Chinese
    characters as a twentieth of them and four at least, else en; empty without text."""
    body = cues.where(F.length(F.trim("text")) > 0).select("video_id", "cue_index", "text")
    upto = Window.partitionBy("video_id").orderBy("cue_index").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.lit(most) - F.coalesce(F.sum(F.length("text") + 1).over(upto), F.lit(0)))
    head = body.withColumn("head", F.substring(F.concat("text", F.lit("\n")), F.lit(1), room.cast("int")))
    counts = head.groupBy("video_id").agg(F.sum(F.length("head")).alias("n"), F.sum(F.regexp_count("head", F.lit("[一-鿿]"))).alias("zh"))
    chinese = F.col("zh") >= F.greatest(F.lit(4), (F.col("n") - 1) * 0.05)
    lang = F.when(F.col("n").isNull(), "").when(chinese, "zh").otherwise("en")
    return cues.select("video_id").distinct().join(counts, "video_id", "left").select("video_id", lang.alias("lang"))


# ---- numbers


def _value(core: Column) -> Column:
    """Value of an Arabic number or a Chinese numeral. A numeral is cut after each greater unit, which multiplies the group
    before it; in a group each of ten, hundred and thousand counts as often as the digit right before it says, once without one
    or after a zero, and a digit that ends the group counts itself."""
    named = F.translate(core, "〇两", "零二")
    digit = lambda c: F.instr(F.lit("零一二三四五六七八九"), c) - 1
    add = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    def group(g: Column) -> Column:
        places = F.regexp_extract_all(g, F.lit(f"[{_DIGITS}]?[{_UNITS}]"), F.lit(0))
        counted = add(F.transform(places, lambda p: F.greatest(F.lit(1), digit(F.left(p, F.lit(1)))) * F.pow(F.lit(10.0), F.instr(F.lit(_UNITS), F.right(p, F.lit(1))))))
        rest = F.regexp_extract(g, f"([{_DIGITS}])[{_GREAT}]?$", 1)
        times = F.when(g.endswith("亿"), 1e8).when(g.endswith("万"), 1e4).otherwise(1.0)
        return (counted + X.once(rest, lambda r: F.when(r == "", 0).otherwise(digit(r)))) * times

    groups = F.regexp_extract_all(named, F.lit(f"[^{_GREAT}]*[{_GREAT}]|[^{_GREAT}]+$"), F.lit(0))
    return F.when(core.rlike(r"^\d"), core.try_cast("double")).otherwise(add(F.transform(groups, group)))


def _token(span: Column) -> Column:
    kind = F.when(span.startswith("百分之") | span.rlike("[%％]$"), "PCT:").when(span.endswith("倍"), "X:").otherwise("N:")
    core = F.regexp_extract(F.when(span.startswith("百分之"), F.substring(span, 4, 1 << 20)).otherwise(span), _CORE, 0)
    return F.concat(kind, X.once(core, _value).cast("string"))


def number_tokens(text: Column) -> Column:
    """Distinct tokens of a text's Arabic and Chinese numbers, sorted: PCT: percentages, X: multiples, N: all others, whose
    units do not count. Null has none."""
    spans = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(spans, _token)))


def untraceable_numbers(title: Column, source: Column) -> Column:
    """Number tokens of a title that its source does not have."""
    return F.array_except(number_tokens(title), number_tokens(source))


def strip_tokens(title: Column, bad: Column) -> Column:
    """title without the numbers whose tokens are in bad; marks and blanks that are left side by side become one comma, and
    go at the ends."""
    spans = lambda t: F.regexp_extract_all(t, F.lit(_NUMBER), F.lit(0))
    kept = lambda t: X.once(bad, lambda bad: F.transform(spans(t), lambda s: F.when(F.array_contains(bad, _token(s)), "").otherwise(s)))
    # Fixed values below: the marks that separate the parts of a title.
    out = F.regexp_replace(X.once(title, lambda t: _woven(F.split(t, _NUMBER), kept(t))), r"(?U)[，,、\s]{2,}", "，")
    return F.regexp_replace(out, r"(?U)^[，,、\s]+|[，,、\s]+$", "")


def finalize_titles(rows: DataFrame, safe: str, n: int = 24) -> DataFrame:
    """rows(title, speaker, source, suggestion) with final_title: the speaker first if absent. With numbers that the source
    lacks, what is left without them, if that reads as a title; else the suggestion in the same way; else speaker and the
    safe phrase. Then whole words of n characters."""
    speaker, blank = F.col("speaker"), F.lit("")
    has = lambda t: X.title_has_speaker(t, speaker)
    led = lambda t: X.once(t, lambda t: F.when(has(t), t).when(t == "", speaker).otherwise(F.concat(speaker, F.lit("："), t)))
    names = [f"__{k}" for k in ("known", "full", "bad", "cut", "other", "best")]
    known, full, bad, cut, other, best = map(F.col, names)
    lacks = lambda t: F.array_except(number_tokens(t), known)
    good = lambda t: X.once(t, lambda t: has(t) & (F.size(lacks(t)) == 0) & X.title_residue_ok(t, speaker))
    # Later steps are made for the rows that earlier ones leave open: they are null in others.
    r = rows.withColumn("__known", number_tokens(F.col("source"))).withColumn("__full", led(F.coalesce("title", blank)))
    r = r.withColumn("__bad", lacks(full))
    r = r.withColumn("__best", F.when(F.size(bad) == 0, full)).withColumn("__cut", F.when(best.isNull(), strip_tokens(full, bad)))
    r = r.withColumn("__best", F.when(best.isNull(), F.when(good(cut), cut)).otherwise(best))
    r = r.withColumn("__other", F.when(best.isNull(), normalize_cjk_punct(led(F.coalesce("suggestion", blank)))))
    r = r.withColumn("__other", F.when(best.isNull(), led(strip_tokens(other, lacks(other)))))
    r = r.withColumn("__best", F.when(best.isNotNull(), best).when(good(other), other).otherwise(F.concat(speaker, F.lit(safe))))
    return r.withColumn("final_title", X.truncate_words(best, n)).drop(*names)


def split_text(t: str, n: int = 24) -> list[str]:
    """A long text in parts of at most n characters, cut after sentences, then clauses; longer parts stay whole."""
    if len(t) <= n:
        return [t]
    parts: list[str] = []
    for s in re.split(r"(?<=[。！？!?])", t):
        parts += re.split(r"(?<=[，、；,;])", s) if len(s) > n else [s]
    out: list[str] = []
    for p in (p for p in parts if p):
        if out and len(out[-1]) + len(p) <= n:
            out[-1] += p
        else:
            out.append(p)
    return out


def split_long_cues(cues: DataFrame, n: int = 24) -> DataFrame:
    """cues cut into parts of at most n characters where they hold Chinese; time is shared by characters."""
    parts = F.pandas_udf(lambda s: s.map(lambda t: split_text(t, n) if t and _HAN.search(t) else [t]), T.ArrayType(T.StringType()))
    p = cues.withColumn("p", parts("text")).select("*", F.posexplode("p").alias("part", "piece"))
    before = F.aggregate(F.slice("p", 1, F.col("part")), F.lit(0), lambda a, x: a + F.length(x))
    span, size = F.col("end_ms") - F.col("start_ms"), F.greatest(F.length("text"), F.lit(1))
    lo = F.col("start_ms") + F.floor(span * before / size)
    hi = F.col("start_ms") + F.floor(span * (before + F.length("piece")) / size)
    return p.select("video_id", "cue_index", "part", lo.alias("lo"), hi.alias("hi"), "piece").withColumnsRenamed({"lo": "start_ms", "hi": "end_ms", "piece": "text"})
