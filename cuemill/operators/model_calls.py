"""Calls of a model for what a cache lacks: in batches, by halves where a reply falls short, kept by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.sources.files import _exists

ROW = "key string, response string, reason string, calls int, attempt bigint"


@dataclass
class Answers:
    """What a run gave: requests with response and outcome (hit, called, rejected or known_bad), and the calls it made."""

    rows: DataFrame
    calls: int


def ask(texts: list[str], model: Callable[[list[str]], list]) -> Iterator[tuple[int, str | None, str | None, int]]:
    """(place, reply, reason, calls) of each text. model gets some texts and gives a reply for each, null or blank for none. A
    batch that raises, or lacks a reply, is asked for again as two halves; a single text that does is rejected with the reason.
    So one bad line among n costs two calls for each halving. calls stands at the first text of each batch, else it is 0."""
    spans, made = [(0, len(texts))], 0
    while spans:
        lo, hi = spans.pop()
        made += 1
        try:
            replies, reason = list(model(texts[lo:hi])), "no reply"
            if len(replies) != hi - lo:
                replies, reason = [None] * (hi - lo), f"{len(replies)} replies for {hi - lo} lines"
        except Exception as e:  # noqa: BLE001 - what a model's client raises is its own
            replies, reason = [None] * (hi - lo), f"{type(e).__name__}: {e}"
        good = [isinstance(r, str) and r.strip() != "" for r in replies]
        if all(good) or hi - lo == 1:
            for k in range(lo, hi):
                yield k, replies[k - lo] if good[k - lo] else None, None if good[k - lo] else reason, made if k == lo else 0
            made = 0
        else:
            middle = (lo + hi) // 2
            spans += [(middle, hi), (lo, middle)]


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{ROW}, prefix string").parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], f"{ROW}, prefix string")


def cached_replies(spark: SparkSession, cache: str) -> DataFrame:
    """(key, response) of a cache; of a key that was written twice, the first."""
    return _kept(spark, f"{cache}/replies").groupBy("key").agg(F.min_by("response", "attempt").alias("response"))


def rejected_rows(spark: SparkSession, cache: str) -> DataFrame:
    """(key, reason, attempt): what the model gave no reply for, as of its last attempt, but for keys that have one now."""
    last = _kept(spark, f"{cache}/rejected").groupBy("key").agg(F.max_by("reason", "attempt").alias("reason"), F.max("attempt").alias("attempt"))
    return last.join(cached_replies(spark, cache).select("key"), "key", "left_anti")


def call_model(requests: DataFrame, cache: str, model: Callable[[list[str]], list], attempt: int, batch: int = 20, again: bool = False) -> Answers:
    """requests(key, text, ...) with the reply of each: from the cache, else from the model.

    Keys that the cache lacks go to the model, each once, in batches of `batch` within tasks; see ask(). Replies are
    appended to <cache>/replies and texts without one to <cache>/rejected, with the reason, both by the first character of the
    hash of the key; `attempt` numbers the run. A second run of the same requests makes no call: rejected ones are tried again only
    if `again` is set. A task that is lost is run again, and its calls are made again; what is written is committed once. Null
    keys, null and blank texts are rejected without a call."""
    spark = requests.sparkSession
    plain = requests.select("key", "text").where("key IS NOT NULL AND trim(text) <> ''").groupBy("key").agg(F.min("text").alias("text"))
    known = cached_replies(spark, cache).select("key")
    if not again:
        known = known.unionByName(rejected_rows(spark, cache).select("key"))
    misses = plain.join(known, "key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = pd.DataFrame({"key": [], "text": []})

        def asked(rows: pd.DataFrame) -> pd.DataFrame:
            keys, texts = rows["key"].tolist(), rows["text"].tolist()
            out = [(keys[k], reply, reason, calls, attempt) for k, reply, reason, calls in ask(texts, model)]
            return pd.DataFrame(out, columns=["key", "response", "reason", "calls", "attempt"])

        for part in parts:
            waiting = pd.concat([waiting, part], ignore_index=True)
            while len(waiting) >= batch:
                yield asked(waiting.iloc[:batch])
                waiting = waiting.iloc[batch:]
        if len(waiting):
            yield asked(waiting)

    # Written before they are dealt to the two tables, so that each call is made once.
    staged = f"{cache}/attempts/n={attempt}"
    misses.mapInPandas(run, ROW).write.mode("overwrite").parquet(staged)
    made = spark.read.schema(ROW).parquet(staged).withColumn("prefix", F.substring(F.sha2("key", 256), 1, 1))
    for name, which in (("replies", "response IS NOT NULL"), ("rejected", "response IS NULL")):
        made.where(which).hint("rebalance", "prefix").write.mode("append").partitionBy("prefix").parquet(f"{cache}/{name}")
    calls = made.agg(F.coalesce(F.sum("calls"), F.lit(0))).first()[0]
    now = made.select("key", F.lit(True).alias("__now")).distinct()
    out = requests.join(cached_replies(spark, cache), "key", "left").join(now, "key", "left")
    unfit = F.col("key").isNull() | (F.coalesce(F.trim("text"), F.lit("")) == "")
    has, new = F.col("response").isNotNull(), F.col("__now").isNotNull()
    outcome = F.when(unfit, "rejected").when(has & new, "called").when(has, "hit").when(new, "rejected").otherwise("known_bad")
    return Answers(out.withColumn("outcome", outcome).withColumn("response", F.when(~unfit, F.col("response"))).drop("__now"), calls)
