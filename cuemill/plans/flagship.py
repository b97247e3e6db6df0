"""From cues to clips: paragraphs, the best of each video, and their cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.operators import transcript as P

from .catalog import Views, query


def clips_of_videos(v: Views, gap_ms: int = 3000, most_ms: int = 30000, best: int = 2) -> DataFrame:
    """(video_id, clips, cues, ms): of the paragraphs with the best scores."""
    paragraphs = P.merge_paragraphs(v.cues, gap_ms, most_ms).withColumn("score", (F.col("video_id") * 13 + F.col("para_id") * 7) % 100)
    top = P.top_highlights(paragraphs, best)
    cues = P.clip_cues(v.cues, top.select("video_id", "para_id", "start_ms", "end_ms"))
    return cues.groupBy("video_id").agg(
        F.count_distinct("para_id").alias("clips"), F.count("*").alias("cues"), F.sum(F.col("rel_end_ms") - F.col("rel_start_ms")).alias("ms")
    )


from .transcript_queries import MERGED, _fold  # noqa: E402

query(
    "flagship_clips",
    "SELECT c.video_id, count(DISTINCT para_id) AS clips, count(*) AS cues, CAST(sum(least(c.end_ms, t.end_ms) - greatest(c.start_ms, t.start_ms)) AS BIGINT) AS ms "
    "FROM t JOIN cues c ON c.video_id = t.video_id AND c.end_ms > t.start_ms AND c.start_ms < t.end_ms GROUP BY c.video_id",
    ctes=_fold("n.start_ms - r.e > 3000 OR n.end_ms - r.s > 30000") + f", g AS ({MERGED}), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY (video_id * 13 + para_id * 7) % 100 DESC, para_id) AS k FROM g) WHERE k <= 2)",
)(clips_of_videos)
