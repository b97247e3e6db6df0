"""Joins of intervals by cells of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the smallest cells, in milliseconds.
CELL_MS = 60_000


def interval_join(spans: DataFrame, ranges: DataFrame, on: Column, how: str = "inner", cell_ms: int = CELL_MS, slack_ms: int = 0) -> DataFrame:
    """spans(video_id, start_ms, end_ms, ...) joined with ranges(v, s, e, ...) of their video where `on` holds; how: inner or
    left_semi. `on` must be false where a span begins after e + slack_ms, or ends before s - slack_ms.

    A span lies in one cell, that of its start, in a grid whose cells are as long as it or longer: cell_ms times a power of two.
    A range lies, in the grids that its video's spans use, in the cells where a span that it meets can start: its length by that
    of the cells, and two or three more. So each pair meets once, in one cell; a long video is many keys of the shuffle and not
    one; and a few long spans do not widen the search for the others. Rows with null times meet nothing."""
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    grid = F.when(length <= cell_ms, 0).otherwise(F.ceil(F.log2(length / cell_ms))).cast("int")
    size = F.expr(f"shiftleft({cell_ms}L, __grid)")
    placed = spans.withColumn("__grid", grid).withColumn("__cell", F.floor(F.col("start_ms") / size))
    used = placed.select(F.col("video_id").alias("v"), "__grid").distinct()
    first, last = F.floor((F.col("s") - slack_ms) / size) - 1, F.floor((F.col("e") + slack_ms) / size)
    cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    spread = ranges.join(used, "v").withColumn("__at", F.explode(cells)).withColumnRenamed("__grid", "__of")
    same = (F.col("video_id") == F.col("v")) & (F.col("__grid") == F.col("__of")) & (F.col("__cell") == F.col("__at"))
    return placed.join(spread, same & on, how).drop("__grid", "__cell", "__of", "__at")
