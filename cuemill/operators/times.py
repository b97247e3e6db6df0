"""Batch twins of the streaming rules, over ts in whole seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_within(rows: DataFrame, seconds: int, key: str, ts: str = "ts") -> DataFrame:
    """Rows whose key has no earlier row less than `seconds` before."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    return rows.select(key, ts).distinct().withColumn("__b", before).where(F.col("__b").isNull() | (F.col(ts) - F.col("__b") >= seconds)).drop("__b")


def daily_counts(rows: DataFrame, zone_hours: int = 8, ts: str = "ts") -> DataFrame:
    return rows.groupBy(F.floor((F.col(ts) + zone_hours * 3600) / 86400).alias("day")).agg(F.count("*").alias("n"))


def sessions(rows: DataFrame, key: str, gap_s: int, ts: str = "ts") -> DataFrame:
    """(key, first, last, n): runs whose steps are less than gap_s."""
    w = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(w) >= gap_s).cast("int"), F.lit(1))
    run = F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).groupBy(key, "run").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("run")


def timed_out(dispatched: DataFrame, published: DataFrame, seconds: int = 43200) -> DataFrame:
    """(key, failed_at) of each key's first dispatch that is not published within `seconds`."""
    d = dispatched.groupBy("key").agg(F.min("ts").alias("ts"))
    p = published.select(F.col("key").alias("k"), F.col("ts").alias("at"))
    done = d.join(p, (F.col("key") == F.col("k")) & F.col("at").between(F.col("ts"), F.col("ts") + seconds), "left_anti")
    return done.select("key", (F.col("ts") + seconds).alias("failed_at"))


def quiet_spells(rows: DataFrame, key: str, hours: int, ts: str = "ts") -> DataFrame:
    """(key, since, until): pauses of a source longer than `hours`."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    return rows.select(key, ts).distinct().withColumn("until", nxt).where(F.col("until") - F.col(ts) > hours * 3600).withColumnRenamed(ts, "since")
