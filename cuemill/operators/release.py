"""Release queue, index and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_queue(episodes: DataFrame, generated_at: Column, base_url: str, base_tags: list[str]) -> DataFrame:
    """episodes(slug, title, speaker, ordinal) with id epNN, file names and links, tags, date and status."""
    n = F.row_number().over(Window.partitionBy("slug").orderBy("ordinal"))
    out = episodes.withColumn("n", n).withColumn("id", F.format_string("ep%02d", "n"))
    video = F.concat("slug", F.lit("-"), "id", F.lit(".mp4"))
    return out.select(
        "slug", "id", "title", video.alias("video"), F.concat(F.lit(base_url + "/"), "slug", F.lit("/"), video).alias("url"),
        F.array("speaker", *[F.lit(t) for t in base_tags]).alias("tags"), F.date_add(generated_at, (F.col("n") - 1).cast("int")).alias("scheduled_date"), F.lit("pending").alias("status"),
    )


def release_inventory(releases: DataFrame, assets: DataFrame) -> DataFrame:
    """(tag, bytes): releases with the sum of their assets, missing sizes 0."""
    total = assets.groupBy("tag").agg(F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    return releases.select("tag").distinct().join(total, "tag", "left").select("tag", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def plan_assets(queue: DataFrame) -> DataFrame:
    """(slug, id, kind, asset): three assets an episode. Queues without slug or id are an error of the caller's."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(e).alias("ext")) for k, e in (("video", ".mp4"), ("cover_16x9", "-16x9.jpg"), ("cover_9x16", "-9x16.jpg"))])
    return queue.select("slug", "id", F.inline(parts)).select("slug", "id", "kind", F.concat(F.col("slug").cast("string"), F.lit("-"), F.col("id").cast("string"), "ext").alias("asset"))


def _required(c: str, what: str) -> Column:
    return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.raise_error(F.lit(what))).otherwise(F.col(c))


def merge_index(index: DataFrame, queue: DataFrame, prefix: str = "clips-") -> DataFrame:
    """index with the queue's episodes put in by (slug, id). queue(slug, speaker, generated_at, id, fields of an episode) has
    a row an episode; each becomes a row with batch_at, of generated_at, and release_tag. A queue without slug or
    generated_at is an error; an index row that lacks a field has null there."""
    new = queue.withColumn("slug", _required("slug", "the queue has no slug")).withColumn("batch_at", _required("generated_at", "the queue has no generated_at"))
    new = new.drop("generated_at").withColumn("release_tag", F.concat(F.lit(prefix), F.col("slug").cast("string")))
    if "speaker" in new.columns:
        new = new.withColumn("speaker", F.coalesce("speaker", F.lit("")))
    return index.join(new.select("slug", "id"), ["slug", "id"], "left_anti").unionByName(new, allowMissingColumns=True)


def batch_recency(index: DataFrame) -> DataFrame:
    return index.groupBy("slug").agg(F.max("batch_at").alias("batch_at"))


def prune_batches(index: DataFrame, keep: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): whole batches, the newest `keep` by last batch_at and slug. A row without a slug is an error."""
    if keep < 1:
        raise ValueError(f"at least one batch is kept, not {keep}")
    index = index.withColumn("slug", _required("slug", "an index row has no slug"))
    newest = batch_recency(index).orderBy(F.desc("batch_at"), F.desc("slug")).limit(keep).select("slug")
    return index.join(newest, "slug", "left_semi"), index.join(newest, "slug", "left_anti")


def orphans(releases: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index tags without a release, releases without an index entry)."""
    tags = index.select("tag").distinct()
    return tags.join(releases.select("tag"), "tag", "left_anti"), releases.join(tags, "tag", "left_anti")


def keep_newest(assets: DataFrame, keep: int = 10, group: str = "tag") -> DataFrame:
    """Assets beyond the newest `keep` of each group: the list to delete."""
    w = Window.partitionBy(group).orderBy(F.desc("created_at"), "id")
    return assets.withColumn("__r", F.row_number().over(w)).where(F.col("__r") > keep).drop("__r")


def sort_episodes(episodes: DataFrame) -> DataFrame:
    """With `pos`: by date, undated last, then slug and id, within a batch."""
    w = Window.partitionBy("batch").orderBy(F.asc_nulls_last("date"), "slug", "id")
    return episodes.withColumn("pos", F.row_number().over(w))


def hero_pick(episodes: DataFrame, today: Column) -> DataFrame:
    """(batch, id): of the unpublished, today's first; else the nearest to come; else the latest overdue; else an
    undated one."""
    d = F.datediff("date", today)
    order = F.struct(
        F.when(d == 0, 0).when(d > 0, 1).when(d < 0, 2).otherwise(3).alias("kind"), F.coalesce(F.abs(d), F.lit(0)).alias("far"), F.col("id").alias("i")
    )
    return episodes.where("NOT published").groupBy("batch").agg(F.min_by("id", order).alias("id"))


def past_upcoming(episodes: DataFrame, today: Column, hero: DataFrame) -> DataFrame:
    rest = episodes.join(hero, ["batch", "id"], "left_anti")
    return rest.withColumn("part", F.when(F.datediff("date", today) < 0, "past").otherwise("upcoming"))


def merge_spec(cues: DataFrame, translations: DataFrame, fixes: list[tuple[str, str]]) -> DataFrame:
    """cues(doc, pos, text) mended, with the translation of the same place; (doc) whose counts differ are left out."""
    from cuemill.functions.text import fix_terms

    n = cues.groupBy("doc").agg(F.count("*").alias("n")).join(translations.groupBy("doc").agg(F.count("*").alias("m")), "doc").where("n = m").select("doc")
    return cues.join(n, "doc", "left_semi").withColumn("text", fix_terms(F.col("text"), fixes)).join(translations.select("doc", "pos", "translation"), ["doc", "pos"])


def build_manifest(clips: DataFrame, copy: DataFrame) -> DataFrame:
    """clips with their copy by rank, file name NN_title.mp4, and unaligned times where there are no aligned ones."""
    from cuemill.functions.text import safe_filename

    j = clips.join(copy, ["video_id", "rank"])
    name = F.concat(F.format_string("%02d_", "rank"), safe_filename(F.col("title")), F.lit(".mp4"))
    return j.select("video_id", "rank", "title", name.alias("file"), F.coalesce("clip_start_ms", "start_ms").alias("start_ms"), F.coalesce("clip_end_ms", "end_ms").alias("end_ms"))


def build_meta(segments: DataFrame, model: str) -> DataFrame:
    """(video_id, segments, duration_ms, cue_count, model): nested run records."""
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "para_id")))
    return segments.groupBy("video_id").agg(
        parts.alias("segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.count("*").alias("n_segments"), F.lit(model).alias("model")
    )


def build_upload_list(manifest: DataFrame, media: DataFrame) -> DataFrame:
    """Manifest rows whose file exists, with upload title, tags, partition and a report line by rank."""
    from cuemill.functions import text as X

    rows = manifest.join(media.select("file"), "file", "left_semi")
    t = X.clean_title(F.col("title"))
    return rows.select(
        "video_id", "rank", "file", t["title"].alias("upload_title"), t["warnings"].alias("warnings"), X.assign_partition(F.col("title"), F.lit("")).alias("tid"),
        F.concat(F.col("rank").cast("string"), F.lit(". "), t["title"]).alias("line"),
    )


def release_notes(episodes: DataFrame) -> DataFrame:
    """(slug, notes) of episodes(slug, speaker, generated_at, commit, pos, id, title, duration_sec, scheduled_date, video,
    cover_16x9, cover_9x16): a heading, then each episode's title, length, day and links in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sec = F.bround(F.coalesce(F.col("duration_sec").cast("double"), F.lit(0.0))).cast("bigint")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("## "), text("id"), F.lit(" "), text("title")), F.concat(F.lit("- 时长："), F.format_string("%d 分 %02d 秒", F.floor(sec / 60), sec % 60)),
        F.concat(F.lit("- 建议发布日："), text("scheduled_date")), F.concat(F.lit("- 视频："), text("video")), F.concat(F.lit("- 封面 16:9："), text("cover_16x9")),
        F.concat(F.lit("- 封面 9:16："), text("cover_9x16")), F.lit(""),
    )
    parts = episodes.select("slug", *[text(c).alias(c) for c in ("speaker", "generated_at", "commit")], "pos", lines.alias("l"))
    one = parts.groupBy("slug").agg(*[F.first(c).alias(c) for c in ("speaker", "generated_at", "commit")], F.array_sort(F.collect_list(F.struct("pos", "l"))).alias("e"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("# "), "speaker", F.lit(" · "), F.col("slug").cast("string")), F.lit(""),
        F.concat(F.lit("共 "), F.size("e").cast("string"), F.lit(" 集，生成于 "), "generated_at", F.lit("，commit `"), "commit", F.lit("`。")), F.lit(""),
    )
    return one.select("slug", F.concat_ws("\n", head, F.array_join("e.l", "\n")).alias("notes"))
