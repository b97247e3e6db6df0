"""Items kept by source and day, for reads that look at a few days or sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators.feeds import LOCAL_S, within_days


def day_of(seconds: Column) -> Column:
    """Local days since 1970."""
    return F.floor((seconds + LOCAL_S) / 86400)


def write_days(items: DataFrame, target: str, when: Column | None = None, mode: str = "append") -> None:
    """items(source, publish_s, ...) in folders source=/day=, by the day of `when`, publish_s if not said. A source's day is one
    file, or some of a good size."""
    dated = items.withColumn("day", day_of(F.col("publish_s") if when is None else when))
    dated.hint("rebalance", "source", "day").write.mode(mode).partitionBy("source", "day").parquet(target)


def read_days(spark: SparkSession, target: str, sources: list[str] | None = None, since_s: int | None = None) -> DataFrame:
    """Items of some sources from the day of since_s on. Both are conditions on folders, so no other file is opened."""
    found = spark.read.parquet(target)
    if sources is not None:
        found = found.where(F.col("source").isin(sources))
    if since_s is not None:
        found = found.where(F.col("day") >= (since_s + LOCAL_S) // 86400)
    return found


def recent_items(spark: SparkSession, target: str, as_of_s: int, days: int, sources: list[str] | None = None) -> DataFrame:
    """Items published within `days` before as_of_s; see within_days()."""
    return read_days(spark, target, sources, as_of_s - days * 86400).where(within_days(F.col("publish_s"), F.lit(None).cast("bigint"), as_of_s, days))


def newest_of_sources(spark: SparkSession, target: str) -> DataFrame:
    """(source, updated_s): each source's newest row. The names of the folders tell each source's newest day, and folders of days
    that are no source's newest are not read; those days, at most as many as there are sources or days, pass through the driver."""
    rows = spark.read.parquet(target)
    newest = rows.select("source", "day").distinct().groupBy("source").agg(F.max("day").alias("day"))
    days = [r["day"] for r in newest.select("day").distinct().collect()]
    return rows.where(F.col("day").isin(days)).groupBy("source").agg(F.max("publish_s").alias("updated_s"))
