"""Frame statistics: subtitle bands, split screens, cover frames. One row a frame, face or image row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_stats(profile: DataFrame) -> DataFrame:
    """(video_id, y, mean, std): of each image row over the frames; std of the population."""
    return profile.groupBy("video_id", "y").agg(F.avg("energy").alias("mean"), F.stddev_pop("energy").alias("std"))


def band_score(stats: DataFrame) -> DataFrame:
    """stats with score: the product of mean and std, each scaled to 0..1 over the video's rows."""
    w = Window.partitionBy("video_id")
    unit = lambda c: (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))
    return stats.withColumn("score", F.coalesce(unit("mean") * unit("std"), F.lit(0.0)))


def locate_band(scores: DataFrame, height: int) -> DataFrame:
    """(video_id, top, bottom, n): the longest run of rows in the lower part whose score is over the threshold; none
    if it begins too high or is too tall."""
    low = scores.where(F.col("y") >= F.floor(F.lit(height) * 0.6))
    cut = low.groupBy("video_id").agg(F.greatest(F.lit(0.12), F.avg("score") + F.stddev_pop("score")).alias("cut"))
    hits = low.join(cut, "video_id").where("score >= cut").select("video_id", "y")
    from .transcript import islands

    runs = islands(hits, ["video_id"], "y", max(2, height // 100))
    best = runs.groupBy("video_id").agg(F.max_by(F.struct("first", "last", "n"), F.struct("n", "first")).alias("b"))
    return best.select("video_id", F.col("b.first").alias("top"), F.col("b.last").alias("bottom"), F.col("b.n").alias("n")).where((F.col("top") >= height * 0.55) & (F.col("bottom") - F.col("top") + 1 <= height * 0.3))


def band_textness(rows: DataFrame, *keys: str) -> DataFrame:
    """rows(bright, trans, white, chroma): transitions over bright pixels, and white share and mean chroma of them."""
    b = F.nullif(F.sum("bright"), F.lit(0))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum("trans") / b, F.lit(0.0)).alias("textness"), F.coalesce(F.sum("white") / b, F.lit(0.0)).alias("whiteness"), F.coalesce(F.sum("chroma") / b, F.lit(0.0)).alias("chroma")
    )


def cue_band(scans: DataFrame) -> DataFrame:
    """scans(cue, top, reason): the least top of a cue's frames, else the distinct reasons."""
    return scans.groupBy("cue").agg(F.min("top").alias("top"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons")).withColumn(
        "reasons", F.when(F.col("top").isNull(), F.col("reasons"))
    )


def margin_plan(top: Column, height: Column, gap: int = 24, default: int = 96) -> Column:
    """Lower margin of new subtitles, null (rejected) for a band over the middle."""
    return F.when(top.isNull(), F.lit(default)).when(top * 2 >= height, height - top + gap)


def top2_faces(faces: DataFrame) -> DataFrame:
    """(video_id, frame_no, left_x, right_x, area): centres of each frame's two largest faces, in half pixels."""
    area = F.col("w") * F.col("h")
    w = Window.partitionBy("video_id", "frame_no").orderBy(F.desc("area"), "x", "y", "w")
    two = faces.withColumn("area", area).withColumn("r", F.row_number().over(w)).where("r <= 2").withColumn("cx", 2 * F.col("x") + F.col("w"))
    return two.groupBy("video_id", "frame_no").agg(F.min("cx").alias("left_x"), F.max("cx").alias("right_x"), F.sum("area").alias("area"), F.count("*").alias("n")).where("n = 2").drop("n")


def split_screen(faces: DataFrame, width: int = 1280, gap: float = 0.4, jitter: float = 0.05, least: int = 4, lead: float = 1.3) -> DataFrame:
    """(video_id, paired, verdict): whether two people keep far apart and still, and which side's faces are larger."""
    pairs = top2_faces(faces).where(F.col("right_x") - F.col("left_x") >= 2 * gap * width)
    stat = pairs.groupBy("video_id").agg(
        F.count("*").alias("paired"), (F.max("left_x") - F.min("left_x")).alias("jl"), (F.max("right_x") - F.min("right_x")).alias("jr"),
        F.percentile("left_x", F.lit(0.5)).alias("ml"), F.percentile("right_x", F.lit(0.5)).alias("mr"),
    )
    still = (F.col("jl") < 2 * jitter * width) & (F.col("jr") < 2 * jitter * width)
    f = faces.select("video_id", "frame_no", (2 * F.col("x") + F.col("w")).alias("cx"), (F.col("w") * F.col("h")).alias("area")).join(stat, "video_id", "left")
    off = [F.abs(F.col("cx") - F.col(m)) for m in ("ml", "mr")]
    near = F.least(*off) <= 0.4 * width
    on = {"l": near & (off[0] <= off[1]), "r": near & (off[0] > off[1])}
    same = lambda *names: [F.first(c).alias(c) for c in names]
    # By frame, then by video: a frame counts once for a side, and what pairs say of the video goes along.
    frames = f.groupBy("video_id", "frame_no").agg(*[F.sum(F.when(c, F.col("area"))).alias(k) for k, c in on.items()], *same("paired", "jl", "jr"))
    sides = frames.groupBy("video_id").agg(*[(F.coalesce(F.sum(k), F.lit(0)) * F.count(k)).alias(f"{k}s") for k in on], *same("paired", "jl", "jr"))
    verdict = (
        F.when(F.coalesce("paired", F.lit(0)) < least, "not_split").when(~still, "not_split").when(F.col("ls") >= lead * F.col("rs"), "left").when(F.col("rs") >= lead * F.col("ls"), "right").otherwise("indeterminate")
    )
    return sides.select("video_id", F.coalesce("paired", F.lit(0)).alias("paired"), verdict.alias("verdict"))


def crop_margin(bars: DataFrame, height: int) -> DataFrame:
    """bars(video_id, top, bottom, face_room): the least bar over the frames, limited by faces and a quarter, even."""
    m = bars.groupBy("video_id").agg(F.least(F.min(F.least("top", "bottom")), F.min("face_room"), F.lit(height // 4)).alias("m"))
    return m.select("video_id", (F.col("m") - F.col("m") % 2).alias("margin"))


def vote_frames(hits: DataFrame) -> DataFrame:
    return hits.groupBy("video_id").agg(((F.count("*") >= 2) & (F.count_if("hit") >= 2)).alias("found"))


def color_class(blue: Column, gray: Column, blue_least: float = 0.06, gray_least: float = 0.35) -> Column:
    b, g = blue >= blue_least, gray >= gray_least
    return F.when(b & g, "two").when(b, "host").when(g, "speaker").otherwise("unsure")


def rejection_summary(frames: DataFrame) -> DataFrame:
    """frames(video_id, passed, score): rejected frames, their best score, and whether to give the video up."""
    s = frames.groupBy("video_id").agg(F.count_if(~F.col("passed")).alias("rejected"), F.max(F.when(~F.col("passed"), F.col("score"))).alias("best"), F.count_if("passed").alias("n"))
    return s.select("video_id", "rejected", "best", ((F.col("rejected") > 5) & (F.col("n") == 0)).alias("give_up"))


def brightness_band(frames: DataFrame, lo: int = 40, hi: int = 230) -> DataFrame:
    return frames.where(F.col("brightness").between(lo, hi))


def best_frame_geometric(frames: DataFrame, lo: int = 40, hi: int = 230) -> DataFrame:
    """(video_id, frame_no): of the frames whose face and brightness are right, the sharpest."""
    good = frames.where(F.col("face_ok") & F.col("brightness").between(lo, hi))
    return good.groupBy("video_id").agg(F.max_by("frame_no", F.struct("sharpness", -F.col("frame_no"))).alias("frame_no"))


def face_ok(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """Whether a face is five percent of the picture, centred in its upper 60 percent, and in no corner."""
    cx, cy = x + w / 2, y + h / 2
    corner = ((cx < 0.12 * width) | (cx > 0.88 * width)) & ((cy < 0.12 * height) | (cy > 0.88 * height))
    return (w * h >= 0.05 * width * height) & (cy <= 0.6 * height) & ~corner


def face_prefilter(frames: DataFrame, keep: int = 8) -> DataFrame:
    """frames(video_id, frame_no, face_area, passing): the passing ones; if there are fewer than `keep`, filled up by
    face size; without any face, all."""
    w = Window.partitionBy("video_id")
    by = F.row_number().over(w.orderBy(F.desc("passing"), F.desc("face_area"), "frame_no"))
    f = frames.withColumn("r", by).withColumn("n", F.count_if("passing").over(w)).withColumn("big", F.max("face_area").over(w))
    return f.where((F.col("big") <= 0) | F.col("passing") | ((F.col("n") < keep) & (F.col("r") <= keep))).drop("r", "n", "big")


def best_frame_scored(frames: DataFrame, person: str, least: int = 6) -> DataFrame:
    good = frames.where((F.col("person") == person) & (F.col("cover_score") >= least))
    value = F.col("cover_score") * 5000 + F.col("sharpness")
    return good.groupBy("video_id").agg(F.max_by("frame_no", F.struct(value, -F.col("frame_no"))).alias("frame_no"))


def best_portrait(frames: DataFrame) -> DataFrame:
    """frames(video_id, frame_no, area_pm, sharpness), area in thousandths: the best, else the middle frame."""
    value = F.least("area_pm", F.lit(220)) * 20 + F.least("sharpness", F.lit(900))
    w = Window.partitionBy("video_id")
    f = frames.withColumn("r", F.row_number().over(w.orderBy("frame_no"))).withColumn("n", F.count("*").over(w))
    return f.groupBy("video_id").agg(
        F.coalesce(F.max_by("frame_no", F.when(F.col("area_pm") > 0, F.struct(value, -F.col("frame_no")))), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("frame_no")))).alias("frame_no")
    )


def row_textness(trans: Column, bright: Column) -> Column:
    return F.coalesce(trans / F.nullif(bright, F.lit(0)), F.lit(0.0))


def scan_band(rows: DataFrame, least_text: float = 0.25, least_white: float = 0.99, most_chroma: float = 8.0) -> DataFrame:
    """(video_id, frame_no, top, reason) of each frame of rows(video_id, frame_no, y, width, height, bright, trans, white,
    chroma), one a row of the picture: the top of the lowest believable band of white text in the lower half, or why
    there is none.

    Rows that are bright over 1 to 90 percent of the width and texty enough are joined over small gaps; bands of some
    height, not too thick, are tried from the lowest up: they must be white and texty as wholes. A band that begins
    at or above the middle ends the search."""
    frame = ["video_id", "frame_no"]
    low = rows.where(F.col("y") >= F.floor(F.col("height") * 0.5))
    good = (F.col("bright") / F.col("width")).between(0.01, 0.9)
    low = low.withColumn("lit", good).withColumn("hit", good & (row_textness(F.col("trans"), F.col("bright")) >= least_text))
    seen = low.groupBy(*frame).agg(F.max("lit").alias("any_lit"), F.max("hit").alias("any_hit"), F.max("height").alias("h"))
    gap = F.greatest(F.lit(6), F.floor(F.col("height") * 0.07))
    w = Window.partitionBy(*frame).orderBy("y")
    hits = low.where("hit").withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(w) > gap).cast("int"), F.lit(1)))
    hits = hits.withColumn("band", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bands = hits.groupBy(*frame, "band").agg(F.min("y").alias("first"), F.max("y").alias("last"), F.count("*").alias("n"), F.max("height").alias("height"))
    bands = bands.where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("height") * 0.01)))
    bands = bands.withColumn("thin", F.col("last") - F.col("first") + 1 <= F.floor(F.col("height") * 0.2))
    inside = low.select(*frame, "y", "bright", "trans", "white", "chroma").join(bands.where("thin"), frame).where("y BETWEEN first AND last")
    b = F.nullif(F.sum("bright"), F.lit(0))
    whole = inside.groupBy(*frame, "band", "first", "last", "height").agg(
        F.coalesce(F.sum("white") / b, F.lit(0.0)).alias("w"), F.coalesce(F.sum("chroma") / b, F.lit(0.0)).alias("c"), F.coalesce(F.sum("trans") / b, F.lit(0.0)).alias("t")
    )
    verdict = (
        F.when((F.col("w") < least_white) | (F.col("c") >= most_chroma), "band_not_white").when(F.col("t") < least_text, "band_not_texty")
        .when(F.col("first") <= F.floor(F.col("height") / 2), "band_above_midline").otherwise("")
    )
    whole = whole.withColumn("v", verdict).withColumn("ends", F.col("v").isin("", "band_above_midline"))
    pick = F.struct((~F.col("ends")).alias("o"), F.when(F.col("ends"), -F.col("last")).otherwise(F.col("last")).alias("k"))
    best = whole.groupBy(*frame).agg(F.min_by(F.struct("v", "first"), pick).alias("r"))  # the lowest that ends it, else the last tried
    stat = bands.groupBy(*frame).agg(F.count("*").alias("n_bands"))
    out = seen.join(stat, frame, "left").join(best, frame, "left")
    reason = (
        F.when(~F.col("any_lit"), "no_bright_rows").when(~F.col("any_hit"), "no_text_rows").when(F.col("n_bands").isNull(), "no_band")
        .when(F.col("r").isNull(), "band_too_thick").otherwise(F.nullif(F.col("r.v"), F.lit("")))
    )
    return out.select(*frame, F.when(F.col("r.v") == "", F.col("r.first")).alias("top"), reason.alias("reason"))
