"""Files in and out: subtitles, JSON documents, lists, state, index, media folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.timecode import hms_to_ms

INDEX = (
    "schema int, updated_at string, episodes array<struct<slug:string,id:string,title:string,speaker:string,batch_at:string,release_tag:string,"
    "scheduled_date:string,status:string,tags:array<string>,duration_sec:double>>"
)
STATE = (
    "dispatched array<struct<key:string,video_id:string,slug:string,ts:bigint,title:string,retries:int>>, rejected array<string>,"
    "pending_retry array<struct<key:string,video_id:string,retries:int,ts:bigint>>, published map<string,struct<bvid:string,ts:bigint,title:string>>"
)


def scan_srt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """cues(video_id, cue_index, start_ms, end_ms, text) of subtitle files; blocks that don't read are left out."""
    whole = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.\w+)?$", 1).alias("video_id"), "value")
    blocks = whole.select("video_id", F.explode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("b"))
    form = r"(?s)^\s*(\d+)\s*\n\s*(\d+:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{3})[^\n]*\n(.+)$"
    part = lambda i: F.regexp_extract("b", form, i)
    text = F.array_join(F.filter(F.transform(F.split(part(4), "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    return blocks.where(F.col("b").rlike(form)).select("video_id", part(1).cast("int").alias("cue_index"), hms_to_ms(part(2)).alias("start_ms"), hms_to_ms(part(3)).alias("end_ms"), text.alias("text"))


def scan_json_docs(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths, multiLine=True)


def scan_url_queue(spark: SparkSession, path: str) -> DataFrame:
    """One link a line; blank lines and those that begin with # are none."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' AND NOT url LIKE '#%'")


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a state file. Rejected entries may be plain keys or objects; plain ones become {key, key, 0}."""
    doc = spark.read.schema(STATE).json(path, multiLine=True)
    entry = lambda c: F.from_json(c, "struct<key:string,video_id:string,ts:bigint>")
    rejected = doc.select(F.explode("rejected").alias("r")).select(
        F.when(F.col("r").startswith("{"), entry(F.col("r"))).otherwise(F.struct(F.col("r").alias("key"), F.col("r").alias("video_id"), F.lit(0).cast("bigint").alias("ts"))).alias("r")
    )
    return {
        "dispatched": doc.select(F.inline("dispatched")),
        "rejected": rejected.select("r.*"),
        "pending_retry": doc.select(F.inline("pending_retry")),
        "published": doc.select(F.explode("published").alias("slug", "p")).select("slug", "p.*"),
    }


def _exists(spark: SparkSession, path: str) -> bool:
    """By any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new folder's path that driver and executors share, in spark.checkpoint.dir. Only a local session may leave that unset."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{top or tempfile.mkdtemp(prefix='spark-')}/{stem}-{uuid.uuid4().hex}"


def finished_versions(spark: SparkSession, folder: str) -> list[int]:
    """n of the folders v=<n> that were written to the end, by any file system that Spark knows."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    path = path_of(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return [int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(path_of(p, "_SUCCESS"))]


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of an index. A missing file is an empty index; one without its list of episodes is an error."""
    doc = spark.read.schema(INDEX).json(path, multiLine=True) if _exists(spark, path) else spark.createDataFrame([], INDEX)
    checked = F.when(F.col("episodes").isNull(), F.raise_error(F.lit("the index has no list of episodes"))).otherwise(F.col("episodes"))
    return doc.select(F.inline(checked))


def write_index(episodes: DataFrame, path: str, updated_at: str) -> None:
    """One document: an index of a few batches, by contract of its retention."""
    body = episodes.agg(F.array_sort(F.collect_list(F.struct(*episodes.columns))).alias("episodes"))
    body.select(F.lit(1).alias("schema"), F.lit(updated_at).alias("updated_at"), "episodes").coalesce(1).write.mode("overwrite").json(path)


def media_inventory(spark: SparkSession, folder: str, small: int = 10 * 1024) -> DataFrame:
    """(n, bytes, n_small, n_bad): files, and those without the mark of an MP4 in their first 64 bytes, which are all that is
    read of them."""
    from .media_headers import media_headers

    return media_headers(spark, folder).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(F.col("length") < small).alias("n_small"),
        F.count_if(F.locate("66747970", F.lower(F.hex("head"))) == 0).alias("n_bad"),
    )
