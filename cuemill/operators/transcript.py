"""Cues, paragraphs, clips and chapters. Times are BIGINT milliseconds; every join carries an equality on video_id.

Rules whose state depends on the row before are folds over a video's rows in order; see fold_sorted()."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.text import ends_sentence, host_dominated

from .folds import fold_sorted
from .intervals import interval_join


# ---- windows and ranges


def _ranges(clips: DataFrame) -> DataFrame:
    return clips.select(F.col("video_id").alias("v"), "para_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


def cues_in_windows(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """Cues that overlap a clip of their video; touching is none."""
    k = _ranges(clips).drop("para_id")
    return interval_join(cues, k, (F.col("end_ms") > F.col("s")) & (F.col("start_ms") < F.col("e")), "left_semi")


def clip_cues(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """(video_id, para_id, seq, orig_index, rel_start_ms, rel_end_ms, text): each clip's cues, clamped to it, timed from
    its start and numbered."""
    j = interval_join(cues, _ranges(clips), (F.col("end_ms") > F.col("s")) & (F.col("start_ms") < F.col("e")))
    w = Window.partitionBy("video_id", "para_id").orderBy("start_ms", "cue_index")
    return j.select(
        "video_id", "para_id", F.row_number().over(w).alias("seq"), F.col("cue_index").alias("orig_index"),
        (F.greatest("start_ms", "s") - F.col("s")).alias("rel_start_ms"), (F.least("end_ms", "e") - F.col("s")).alias("rel_end_ms"), "text",
    )


def cues_contained(cues: DataFrame, clips: DataFrame, tolerance_ms: int = 50) -> DataFrame:
    """Cues that lie in a clip of their video, but for the tolerance at both ends. A cue that ends before it starts lies in none."""
    on = (F.col("start_ms") >= F.col("s") - tolerance_ms) & (F.col("end_ms") <= F.col("e") + tolerance_ms) & (F.col("start_ms") <= F.col("end_ms"))
    return interval_join(cues, _ranges(clips), on, slack_ms=tolerance_ms).select("video_id", "para_id", "cue_index")


def snap_starts(clips: DataFrame, cues: DataFrame, window_ms: int = 8000) -> DataFrame:
    """clips with snapped_start: after the latest cue that ends a sentence at or before the start, within the window,
    the next cue's start (the cue's own end if it is the last); else the start."""
    nxt = F.lead("start_ms").over(Window.partitionBy("video_id").orderBy("cue_index"))
    marks = cues.withColumn("n", F.coalesce(nxt, "end_ms")).where(ends_sentence(F.col("text"))).select(F.col("video_id").alias("v"), F.col("end_ms").alias("ce"), "n")
    on = (F.col("video_id") == F.col("v")) & (F.col("ce") <= F.col("start_ms")) & (F.col("ce") >= F.col("start_ms") - window_ms)
    best = clips.join(marks, on).groupBy("video_id", "para_id").agg(F.max_by("n", "ce").alias("n"))
    return clips.join(best, ["video_id", "para_id"], "left").withColumn("snapped_start", F.coalesce("n", "start_ms")).drop("n")


def snap_ends(clips: DataFrame, cues: DataFrame, window_ms: int = 8000) -> DataFrame:
    """clips with snapped_end: the end of the first cue that ends a sentence at or after the end, within the window."""
    marks = cues.where(ends_sentence(F.col("text"))).select(F.col("video_id").alias("v"), F.col("end_ms").alias("ce"))
    on = (F.col("video_id") == F.col("v")) & (F.col("ce") >= F.col("end_ms")) & (F.col("ce") <= F.col("end_ms") + window_ms)
    best = clips.join(marks, on).groupBy("video_id", "para_id").agg(F.min("ce").alias("n"))
    return clips.join(best, ["video_id", "para_id"], "left").withColumn("snapped_end", F.coalesce("n", "end_ms")).drop("n")


def boundaries(cues: DataFrame) -> DataFrame:
    """(video_id, t, total): cue starts, 0 and the end of the video."""
    total = cues.groupBy("video_id").agg(F.max("end_ms").alias("total"))
    ends = total.select("video_id", F.explode(F.array(F.lit(0).cast("bigint"), "total")).alias("t"))
    return cues.select("video_id", F.col("start_ms").alias("t")).unionByName(ends).distinct().join(total, "video_id")


def snap_to_nearest(chapters: DataFrame, cues: DataFrame, least_ms: int = 30000) -> DataFrame:
    """(video_id, para_id, start_ms, end_ms) of chapters at their nearest boundaries, ties to the smaller; an end not
    after its start becomes start + least_ms, within the video. Times and boundaries are sorted together, and each time
    looks at the boundary before it and the one after."""
    b = boundaries(cues)
    bound = b.select("video_id", "t", F.col("t").alias("b"), F.lit(None).cast("bigint").alias("para_id"), F.lit(None).cast("int").alias("which"))
    times = chapters.select("video_id", F.col("para_id").cast("bigint").alias("para_id"), F.posexplode(F.array("start_ms", "end_ms")).alias("which", "t"))
    both = bound.unionByName(times.withColumn("b", F.lit(None).cast("bigint")))
    order = Window.partitionBy("video_id").orderBy("t", F.col("b").isNull())
    back = F.last("b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy("video_id").orderBy(F.desc("t"), F.col("b").isNull())
    on = F.last("b", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("lo", back).withColumn("hi", on).where("which IS NOT NULL")
    near = F.when(F.col("lo").isNull() | (F.col("hi") - F.col("t") < F.col("t") - F.col("lo")), F.col("hi")).otherwise(F.col("lo"))
    at = lambda i: F.max(F.when(F.col("which") == i, near))
    out = found.groupBy("video_id", "para_id").agg(at(0).alias("start_ms"), at(1).alias("e2")).join(b.select("video_id", "total").distinct(), "video_id")
    end = F.when(F.col("e2") <= F.col("start_ms"), F.least("total", F.col("start_ms") + least_ms)).otherwise(F.col("e2"))
    return out.select("video_id", F.col("para_id").cast(chapters.schema["para_id"].dataType).alias("para_id"), "start_ms", end.alias("end_ms"))


def attach_translation(cues: DataFrame, bi: DataFrame, within_ms: int = 2000) -> DataFrame:
    """cues with zh: of the same index, else of the same start in tenths of a second, else of the nearest start less
    than within_ms away, which is sought in the bucket of that length and the two beside it."""
    tenth = lambda t: F.floor((F.col(t) + 50) / 100)
    by_index = bi.groupBy("video_id", "cue_index").agg(F.max("zh").alias("z1"))
    by_time = bi.groupBy("video_id", tenth("start_ms").alias("tenth")).agg(F.max_by("zh", "cue_index").alias("z2"))
    bucket = F.floor(F.col("start_ms") / within_ms)
    times = bi.select("video_id", F.col("start_ms").alias("bs"), "zh", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    off = F.abs(F.col("bs") - F.col("start_ms"))
    close = cues.select("video_id", "cue_index", "start_ms", bucket.alias("bucket")).join(times, ["video_id", "bucket"]).where(off < within_ms)
    nearest = close.groupBy("video_id", "cue_index").agg(F.min_by("zh", F.struct(off, "bs")).alias("z3"))
    out = cues.withColumn("tenth", tenth("start_ms")).join(by_index, ["video_id", "cue_index"], "left").join(by_time, ["video_id", "tenth"], "left").join(nearest, ["video_id", "cue_index"], "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return out.withColumn("zh", F.coalesce(some("z1"), some("z2"), some("z3"), F.lit(""))).drop("tenth", "z1", "z2", "z3")


def missing_lines(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows of expected(video_id, cue_index) without a translation zh that has text: those to ask for again."""
    return expected.join(parsed.where(F.trim("zh") != "").select("video_id", "cue_index"), ["video_id", "cue_index"], "left_anti")


def overlaps_any(clips: DataFrame) -> DataFrame:
    """clips(video_id, para_id, start_ms, end_ms) with hit: whether another clip of the video, of some length, overlaps it.
    Clips in the order of their starts: an earlier one that ends after the start, or a later one that starts before the end."""
    order = Window.partitionBy("video_id").orderBy("start_ms", "end_ms", "para_id")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start_ms")
    after = F.lead("start_ms").over(order) < F.col("end_ms")
    return clips.withColumn("hit", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


def min_quote(clips: DataFrame, least_ms: int = 15000) -> DataFrame:
    return clips.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def parse_numbered_lines(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """(key, n, line) of replies whose lines read `n. text`, `n、text` or `n) text`; of a number that is repeated, the last."""
    form = r"^\s*(\d+)[.、)]\s*(.+)"
    lines = replies.select(key, F.posexplode(F.split(reply, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("pos", "l")).where(F.col("l").rlike(form))
    part = lambda i: F.regexp_extract("l", form, i)
    numbered = lines.select(key, part(1).try_cast("int").alias("n"), F.trim(part(2)).alias("line"), "pos").where("n IS NOT NULL")
    return numbered.groupBy(key, "n").agg(F.max_by("line", "pos").alias("line"))


def zh_by_index(cues: DataFrame, bi: DataFrame) -> DataFrame:
    return cues.join(bi.select("video_id", "cue_index", "zh"), ["video_id", "cue_index"], "left").withColumn("zh", F.coalesce("zh", F.lit("")))


def scores_to_paragraphs(paragraphs: DataFrame, scores: DataFrame) -> DataFrame:
    """Paragraphs that scores(video_id, para_id, score, speaker_ratio) names; no score is 0, no ratio one half."""
    s = scores.withColumn("score", F.coalesce("score", F.lit(0))).withColumn("speaker_ratio", F.coalesce("speaker_ratio", F.lit(0.5)))
    return paragraphs.join(s, ["video_id", "para_id"])


# ---- folds


PARAGRAPH = "para_id int, start_ms bigint, end_ms bigint, n bigint, text string"


def _paragraphs(cues: DataFrame, starts_new: Callable[[int, int, int, bool, int, int], bool]) -> DataFrame:
    """(video_id, para_id, start_ms, end_ms, n, text) of runs of cues. A cue begins a run where starts_new holds of the run's
    start, its end so far, its characters and whether its last cue ends a sentence, and of the cue's start and end. Null texts
    have no characters and are left out of the run's. In memory is one run."""
    ends = F.coalesce(F.rtrim("text").rlike("[.!?]$"), F.lit(False))

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        number, start, end, first, size, closed, texts, n = 0, None, None, None, 0, False, [], 0
        for _, s, e, text, stop in rows:
            if number == 0 or starts_new(start, end, size, closed, s, e):
                if number:
                    yield number, first, end, n, " ".join(texts)
                number, start, first, size, texts, n = number + 1, s, s, 0, [], 0
            first, end, closed, n = min(first, s), e, stop, n + 1
            if text is not None:
                size += len(text)
                texts.append(text.strip(" "))
        if number:
            yield number, first, end, n, " ".join(texts)

    return fold_sorted(cues.select("video_id", "cue_index", "start_ms", "end_ms", "text", ends.alias("ends")), ["video_id"], ["cue_index", "start_ms", "end_ms", "text"], fold, PARAGRAPH)


def _merge(runs: DataFrame, sep: str = " ") -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_index", F.trim("text").alias("x")))), lambda s: s["x"]), sep)
    return runs.groupBy("video_id", F.col("run").alias("para_id")).agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "cue_index").alias("end_ms"), F.count("*").alias("n"), text.alias("text")
    )


def merge_paragraphs(cues: DataFrame, gap_ms: int = 3000, most_ms: int = 90000) -> DataFrame:
    """Runs of cues; a gap over gap_ms, or an end over most_ms after the paragraph's start, begins a new one."""
    return _paragraphs(cues, lambda start, end, size, closed, s, e: s - end > gap_ms or e - start > most_ms)


def merge_sentence_cues(cues: DataFrame, most_ms: int = 6500, most_chars: int = 110) -> DataFrame:
    """A cue closes its sentence if it ends one, or if the run has lasted most_ms or has most_chars."""
    return _paragraphs(cues, lambda start, end, size, closed, s, e: closed or end - start >= most_ms or size >= most_chars)


def merge_close_cues(cues: DataFrame, gap_ms: int = 300) -> DataFrame:
    """Neighbours less than gap_ms apart become one cue."""
    w = Window.partitionBy("video_id").orderBy("cue_index")
    new = F.coalesce((F.col("start_ms") - F.lag("end_ms").over(w) >= gap_ms).cast("int"), F.lit(1))
    return _merge(cues.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def islands(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """(keys, first, last, n) of runs of numbers whose steps are at most gap."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    numbered = rows.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def resolve_overlaps(clips: DataFrame, least_ms: int = 20000) -> DataFrame:
    """clips(video_id, para_id, start2, end2), in half-milliseconds: in order of start, neighbours that overlap are cut
    at the middle. If the later would be shorter than least_ms, the cut moves towards its start, not before the
    earlier one's start + least_ms, nor after its end. Each pair sees what the pair before left."""
    least = 2 * least_ms

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        before = None
        for start, end, para in rows:
            if before is not None:
                s, e, i = before
                if e > start:
                    cut = (e + start) // 2
                    if end - cut < least:
                        cut = min(max(s + least, min(cut, end - least)), e)
                    before, start = (s, max(s, cut), i), min(end, cut)
                yield before[2], before[0], before[1]
            before = start, end, para
        if before is not None:
            yield before[2], before[0], before[1]

    kind = clips.schema["para_id"].dataType.simpleString()
    return fold_sorted(clips.select("video_id", "start2", "end2", "para_id"), ["video_id"], ["start2", "para_id", "end2"], fold, f"para_id {kind}, start2 bigint, end2 bigint")


def align_clips(clips: DataFrame, cues: DataFrame, window_ms: int = 8000, margin_ms: int = 300, least_ms: int = 20000, most_ms: int = 180000) -> DataFrame:
    """clips with clip_start2 and clip_end2 in half-milliseconds: snapped to sentences, widened by the margin, kept in
    the video, made least_ms long forwards, then backwards, cut at most_ms, and freed of overlaps."""
    total = cues.groupBy("video_id").agg(F.max("end_ms").alias("total"))
    j = snap_ends(snap_starts(clips, cues, window_ms), cues, window_ms).join(total, "video_id")
    j = j.withColumn("s", F.greatest(F.lit(0), F.least(F.col("snapped_start") - margin_ms, "total")))
    j = j.withColumn("e", F.greatest("s", F.least(F.col("snapped_end") + margin_ms, "total")))
    j = j.withColumn("e", F.when(F.col("e") - F.col("s") < least_ms, F.least("total", F.col("s") + least_ms)).otherwise(F.col("e")))
    j = j.withColumn("s", F.when(F.col("e") - F.col("s") < least_ms, F.greatest(F.lit(0), F.col("e") - least_ms)).otherwise(F.col("s")))
    j = j.withColumn("e", F.least("e", F.col("s") + most_ms))
    done = resolve_overlaps(j.select("video_id", "para_id", (F.col("s") * 2).cast("bigint").alias("start2"), (F.col("e") * 2).cast("bigint").alias("end2")), least_ms)
    return clips.join(done.withColumnsRenamed({"start2": "clip_start2", "end2": "clip_end2"}), ["video_id", "para_id"])


def chain_chapters(chapters: DataFrame, cues: DataFrame) -> DataFrame:
    """Chapters without gaps: the first starts at 0, each where the one before ends, the last ends with the video."""
    total = cues.groupBy("video_id").agg(F.max("end_ms").alias("total"))
    w = Window.partitionBy("video_id").orderBy("para_id")
    start = F.coalesce(F.lag("end_ms").over(w), F.lit(0))
    last = F.lead("para_id").over(w).isNull()
    out = chapters.join(total, "video_id").select("video_id", "para_id", start.alias("start_ms"), F.when(last, F.col("total")).otherwise(F.col("end_ms")).alias("end_ms"))
    return out.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def sample_cues(cues: DataFrame, max_chars: int = 8000) -> DataFrame:
    """All cues of a video of at most max_chars, else each k-th, k being the characters over max_chars, rounded up."""
    w = Window.partitionBy("video_id")
    step = F.greatest(F.ceil(F.sum(F.length("text")).over(w) / max_chars), F.lit(1))
    n = F.row_number().over(w.orderBy("cue_index")) - 1
    return cues.withColumn("step", step).withColumn("n", n).where("n % step = 0").drop("step", "n")


def batch_no(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size))


def renumber(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def sample_times(start: Column, end: Column, n: int, margin_ms: int) -> Column:
    """Array of the midpoints of n cells between the margins, which are a tenth of the span if that is short."""
    m = F.when(end - start < 4 * margin_ms, F.floor((end - start) / 10)).otherwise(F.lit(margin_ms))
    lo, span = start + m, end - start - 2 * m
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: lo + F.floor((2 * k + 1) * span / (2 * n)))


def chapter_count(total_ms: Column, target_ms: int) -> Column:
    return F.when(total_ms * 2 < 3 * target_ms, F.lit(1)).otherwise(F.greatest(F.lit(2), F.floor(total_ms / target_ms)))


def pause_punctuation(tokens: DataFrame, stop_ms: int = 900, comma_ms: int = 550) -> DataFrame:
    """tokens(video_id, seq, tok, start_ms, end_ms) with marks of no length put in at the end before each long pause."""
    before = F.lag("end_ms").over(Window.partitionBy("video_id").orderBy("seq"))
    gap = F.col("start_ms") - before
    mark = F.when(gap > stop_ms, F.lit("。")).when(gap > comma_ms, F.lit("，"))
    rows = tokens.withColumn("m", mark).withColumn("b", before)
    token = F.struct(F.lit(1).alias("part"), F.col("tok").alias("tok"), F.col("start_ms").alias("start_ms"), F.col("end_ms").alias("end_ms"))
    put = F.struct(F.lit(0).alias("part"), F.col("m").alias("tok"), F.col("b").alias("start_ms"), F.col("b").alias("end_ms"))
    return rows.select("video_id", "seq", F.inline(F.when(F.col("m").isNull(), F.array(token)).otherwise(F.array(put, token))))


# ---- choice of clips


def keep_all_if_none(rows: DataFrame, key: str, flag: Column) -> DataFrame:
    """Rows of which the flag holds; all rows of a key of which it holds of none."""
    f = rows.withColumn("__f", F.coalesce(flag, F.lit(False)))
    any_ = f.withColumn("__any", F.max("__f").over(Window.partitionBy(key)))
    return any_.where("__f OR NOT __any").drop("__f", "__any")


def speaker_ratio_filter(rows: DataFrame, least: float = 0.5, ratio: str = "speaker_ratio") -> DataFrame:
    return keep_all_if_none(rows, "video_id", F.col(ratio) >= least)


def host_filter(rows: DataFrame) -> DataFrame:
    return keep_all_if_none(rows, "video_id", ~host_dominated(F.col("text")))


def top_highlights(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy(F.desc("score"), "para_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def valid_ranges(picks: DataFrame, cues: DataFrame) -> DataFrame:
    """picks(video_id, a, b) with 0 <= a <= b < the video's cues."""
    n = cues.groupBy("video_id").agg(F.count("*").alias("n"))
    return picks.join(n, "video_id").where("a >= 0 AND a <= b AND b < n").drop("n")


def quality_gate(clips: DataFrame, min_clip_ms: int = 15000, min_quotes: int = 3, min_total_ms: int = 150000, want: int = 3) -> DataFrame:
    """(video_id, ok, reason, n, total_ms): whether a video has clips enough. Short clips are dropped, the first `want`
    by rank taken."""
    w = Window.partitionBy("video_id").orderBy("rank", "para_id")
    d = clips.withColumn("d", F.col("end_ms") - F.col("start_ms"))
    good = d.where(F.col("d") >= min_clip_ms).withColumn("r", F.row_number().over(w))
    stat = good.groupBy("video_id").agg(F.count("*").alias("n"), F.sum(F.when((F.col("r") <= want) | (F.lit(want) == 0), F.col("d"))).alias("total_ms"))
    out = clips.select("video_id").distinct().join(stat, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total_ms", F.lit(0)).alias("total_ms"))
    reason = F.when(F.col("n") < min_quotes, "insufficient_quotes").when(F.col("total_ms") < min_total_ms, "insufficient_duration")
    return out.select("video_id", reason.isNull().alias("ok"), reason.alias("reason"), "n", "total_ms")


def pack_episodes(clips: DataFrame, episodes: int, segments: int = 3, min_clip_ms: int = 15000, min_total_ms: int = 150000) -> DataFrame:
    """(video_id, episode, para_id, reason): clips(video_id, para_id, rank, start_ms, end_ms) in groups.

    The first group is the first `segments` by rank; later ones take clips by rank that overlap nothing used so far.
    All or nothing: a video that can't fill every group, or whose group is shorter than min_total_ms, gives one row
    with the reason. A clip that a group passes over overlaps what is used, then and later, so one pass over the clips fills
    the groups one after another, with the clips used in memory."""
    good = clips.where(F.col("end_ms") - F.col("start_ms") >= min_clip_ms)

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        groups: list[list[tuple]] = [[]]
        for _, para, start, end in rows:
            if len(groups[-1]) == segments:
                if len(groups) == episodes:
                    break
                groups.append([])
            used = [c for g in groups for c in g]
            if len(groups) > 1 and (any(end > s and start < e for _, s, e in used) or any(para == i for g in groups[:-1] for i, _, _ in g)):
                continue
            groups[-1].append((para, start, end))
        groups += [[] for _ in range(episodes - len(groups))]
        for n, g in enumerate(groups, 1):
            short = "quotes" if len(g) < segments else "duration" if sum(e - s for _, s, e in g) < min_total_ms else None
            if short:
                yield None, None, f"insufficient_{short}:{n}"
                return
        yield from ((n, i, None) for n, g in enumerate(groups, 1) for i, _, _ in g)

    kind = clips.schema["para_id"].dataType.simpleString()
    return fold_sorted(good.select("video_id", "rank", "para_id", "start_ms", "end_ms"), ["video_id"], ["rank", "para_id", "start_ms", "end_ms"], fold, f"episode int, para_id {kind}, reason string")


def selected_duration(cues: DataFrame, picks: DataFrame) -> DataFrame:
    """Milliseconds of the distinct cues that the ranges picks(video_id, a, b) select, counted from 0."""
    i = picks.select("video_id", F.explode(F.sequence("a", "b")).alias("i")).distinct().select("video_id", (F.col("i") + 1).cast("int").alias("cue_index"))
    return cues.join(i, ["video_id", "cue_index"]).groupBy("video_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))


def episode_summary(segs: DataFrame) -> DataFrame:
    return segs.groupBy("video_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("cue_count"))


def prompt_rows(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Numbered lines of each key in order."""
    lines = F.array_sort(F.collect_list(F.struct(order, text)))
    joined = F.array_join(F.transform(lines, lambda x: F.concat(x[order].cast("string"), F.lit(". "), x[text])), "\n")
    return rows.groupBy(*keys).agg(joined.alias("prompt"))


def drop_fillers(tokens: DataFrame, fillers: list[str], tok: str = "tok") -> DataFrame:
    return tokens.where(~F.lower(F.trim(tok)).isin(fillers))


# Words of one character that say nothing.
FILLERS = "啊呀呐呢吧嘛哦噢哎唉哼嗯呃哈呵嘿"


def tokens_to_cues(tokens: DataFrame, least: int = 6, most: int = 18, fillers: str = FILLERS, terms: list[tuple[str, str]] | None = None) -> DataFrame:
    """(video_id, cue, start_ms, end_ms, text) of tokens(video_id, seq, tok, start_ms, end_ms): a cue closes after a token
    that ends in a mark, if it has `least` characters, or at `most`. Leading marks go, terms are put right in order; cues of
    fillers alone are left out. Tokens are words; there is no Chinese segmenter."""
    from cuemill.functions.text import fix_terms

    closing = F.coalesce(F.col("tok").rlike("[。，！？、；,.!?;]$"), F.lit(False))

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        number, text, start, end = 1, [], None, None
        size = 0
        for _, tok, s, e, closes in rows:
            start = start if text else s
            text.append(tok or "")
            size, end = size + len(text[-1]), e
            if (closes and size >= least) or size >= most:
                yield number, start, end, "".join(text)
                number, text, size = number + 1, [], 0
        if text:
            yield number, start, end, "".join(text)

    cues = fold_sorted(tokens.select("video_id", "seq", "tok", "start_ms", "end_ms", closing.alias("closes")), ["video_id"], ["seq", "tok"], fold, "cue int, start_ms bigint, end_ms bigint, text string")
    cues = cues.withColumn("text", fix_terms(F.regexp_replace("text", "^[ 。，！？、；,.!?;]+", ""), terms or []))
    return cues.where((F.col("text") != "") & ~F.col("text").rlike(f"^[{fillers}]+$"))


def split_long_cue(cues: DataFrame, n: int = 24) -> DataFrame:
    """(video_id, cue_index, part, start_ms, end_ms, text): texts over n characters cut after sentence marks; neighbours
    joined again while they fit n; time shared by characters."""
    pieces = F.regexp_extract_all("text", F.lit(r"([^.!?。！？]*[.!?。！？]+|[^.!?。！？]+$)"), F.lit(1))
    merged = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.length(F.element_at(a, -1)) + F.length(x) <= n), F.array_append(F.slice(a, 1, F.size(a) - 1), F.concat(F.element_at(a, -1), x))).otherwise(F.array_append(a, x)),
    )
    parts = F.when((F.length("text") <= n) | (F.size(pieces) == 0), F.array("text")).otherwise(merged)
    p = cues.withColumn("p", parts).select("*", F.posexplode("p").alias("part", "piece"))
    before = F.aggregate(F.slice("p", 1, F.col("part")), F.lit(0), lambda a, x: a + F.length(x))
    whole = F.greatest(F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)), F.lit(1))
    span = F.col("end_ms") - F.col("start_ms")
    lo = F.col("start_ms") + F.floor(span * before / whole)
    hi = F.col("start_ms") + F.floor(span * (before + F.length("piece")) / whole)
    return p.select("video_id", "cue_index", "part", lo.alias("s"), hi.alias("e"), F.col("piece").alias("text")).withColumnsRenamed({"s": "start_ms", "e": "end_ms"})


def chunk_time_allocation(chunks: DataFrame, chunk_ms: int = 60000, least_ms: int = 500) -> DataFrame:
    """(video_id, n, start_ms, end_ms, text) of chunks(video_id, chunk, text, total_ms): each chunk's sentences share its
    time by characters, half a second at least, never past the chunk's end; numbered over the video. Once a chunk's
    end is reached, later sentences have no length, so running sums cut at the end are right."""
    s = F.filter(F.regexp_extract_all("text", F.lit(r"([^.!?。！？]*[.!?。！？]+|[^.!?。！？]+$)"), F.lit(1)), lambda x: F.length(F.trim(x)) > 0)
    c = chunks.withColumn("lo", F.col("chunk") * chunk_ms).withColumn("hi", F.least((F.col("chunk") + 1) * chunk_ms, "total_ms"))
    c = c.withColumn("s", s).withColumn("chars", F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)))
    one = c.select("video_id", "chunk", "lo", "hi", "chars", F.posexplode("s").alias("i", "x"))
    d = F.greatest(F.lit(least_ms), F.floor((F.col("hi") - F.col("lo")) * F.length("x") / F.col("chars")))
    w = Window.partitionBy("video_id", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("d", d).withColumn("end_ms", F.least(F.col("lo") + F.sum("d").over(w), "hi"))
    start = F.least(F.col("lo") + F.sum("d").over(w) - F.col("d"), "hi")
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("chunk", "i"))
    return one.select("video_id", n.alias("n"), start.alias("start_ms"), "end_ms", F.trim("x").alias("text"))
