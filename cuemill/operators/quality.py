"""Audits: counts, links, freshness, coverage, lead time, dashboards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts with all totals (rollup); the most frequent first when shown."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"))


def link_status(content_type: Column, content_range: Column, content_length: Column, head_len: Column) -> Column:
    total = F.coalesce(F.element_at(F.split(content_range, "/"), -1).try_cast("bigint"), content_length)
    good = F.coalesce(content_type.rlike("video|octet"), F.lit(False)) | (F.coalesce(total, F.lit(0)) > 200000) | (F.coalesce(head_len, F.lit(0)) > 0)
    return F.struct(good.alias("ok"), total.alias("bytes"))


def link_health(results: DataFrame) -> DataFrame:
    """results(source, ok, bytes) by source and in all."""
    return results.rollup("source").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("n_ok"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias("ok_bytes")
    )


def feed_yield(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    n = raw.groupBy("feed").agg(F.count("*").alias("n"))
    return feeds.select("feed").join(n, "feed", "left").select("feed", F.coalesce("n", F.lit(0)).alias("n"))


def freshness(items: DataFrame, as_of_s: int, hours: int = 48) -> DataFrame:
    last = items.groupBy("source").agg(F.max("updated_s").alias("last_s"))
    return last.select("source", F.floor((F.lit(as_of_s) - F.col("last_s")) / 3600).alias("hours"), (F.lit(as_of_s) - F.col("last_s") > hours * 3600).alias("stale"))


def capacity(files: DataFrame, limit: int) -> DataFrame:
    return files.agg(F.sum("bytes").alias("bytes")).select("bytes", (F.col("bytes") > limit).alias("over"))


def seed_staleness(pool: DataFrame, as_of_day: int, days: int = 45) -> DataFrame:
    s = pool.groupBy("kind").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return s.select("kind", "n", F.coalesce(F.lit(as_of_day) - F.col("last") > days, F.lit(False)).alias("stale"))


def health_report(checks: DataFrame) -> DataFrame:
    """checks(name, ok, level): names that failed, by level."""
    bad = lambda level: F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok") & (F.col("level") == level), F.col("name")))), ",")
    return checks.agg(bad("fail").alias("fail"), bad("warn").alias("warn"))


def lead_time(announced: DataFrame, videos: DataFrame, within: int = 14) -> DataFrame:
    """announced(key, day) with the first video of the key at most `within` days later, lead days and hits."""
    v = videos.select(F.col("key").alias("vk"), F.col("day").alias("vd"))
    j = announced.join(v, (F.col("key") == F.col("vk")) & (F.col("vd") - F.col("day")).between(0, within))
    return j.groupBy("key").agg(F.min("vd").alias("first"), F.min("day").alias("day"), F.count("*").alias("hits")).withColumn("lead", F.col("first") - F.col("day"))


def lead_summary(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count_if(F.col("lead") > 0).alias("wins"), F.count("*").alias("n"), F.sum("lead").alias("total_lead"))


#: Terms up to which each is looked for by itself, in the JVM.
FEW_TERMS = 16


def match_terms(texts: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """texts with the array of terms that occur in them, in the order of `terms`; a null text has none, and an empty term is in
    every other. A few terms are looked for one by one; more are one automaton, made once a task, by which a text is read once
    however many they are. terms go to all tasks: a glossary or a list of topics, some million at most."""
    if len(terms) <= FEW_TERMS:
        return texts.withColumn("terms", F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col(text), t)) if terms else F.array().cast("array<string>"))
    shared = texts.sparkSession.sparkContext.broadcast(list(terms))
    kept = [f for f in texts.schema if f.name != "terms"]
    out = T.StructType([*kept, T.StructField("terms", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known, places = shared.value, {}
        for place, term in enumerate(known):
            places.setdefault(term, []).append(place)
        always = places.pop("", [])
        automaton = ahocorasick.Automaton()
        for term, own in places.items():
            automaton.add_word(term, own)
        if places:
            automaton.make_automaton()
        for batch in batches:
            found = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                hits = set() if t is None else {*always, *(p for _, own in (automaton.iter(t) if places else ()) for p in own)}
                found.append([known[p] for p in sorted(hits)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))], names=[f.name for f in out])

    return texts.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text")).mapInArrow(run, out)


def topic_coverage(theirs: DataFrame, ours: DataFrame, least: int = 8, share: float = 0.15) -> DataFrame:
    """Topics of theirs(topic) that occur `least` times, and whether ours(topic) has that share of them."""
    t, o = (d.groupBy("topic").agg(F.count("*").alias(n)) for d, n in ((theirs, "theirs"), (ours, "ours")))
    j = t.where(F.col("theirs") >= least).join(o, "topic", "left").withColumn("ours", F.coalesce("ours", F.lit(0)))
    return j.withColumn("ok", F.col("ours") >= share * F.col("theirs"))


def longform_coverage(theirs: DataFrame, ours: DataFrame, least_s: int = 1200) -> DataFrame:
    """Ids of long videos, and how many of them are ours."""
    long = theirs.where(F.col("sec") >= least_s).select("id").distinct()
    j = long.join(ours.select("id", F.lit(True).alias("have")).distinct(), "id", "left")
    return j.agg(F.count_if("have").alias("hit"), F.count("*").alias("total"))


def publish_dashboard(published: DataFrame, pending: DataFrame, now_s: int, days: int = 7) -> DataFrame:
    """One row: published in all and in the last days, pending, stuck over 6 and over 24 hours."""
    p = published.agg(F.count("*").alias("published"), F.count_if(F.lit(now_s) - F.col("ts") < days * 86400).alias("recent"), (F.lit(now_s) - F.max("ts") > 6 * 3600).alias("quiet"))
    q = pending.agg(F.count("*").alias("pending"), F.count_if(F.lit(now_s) - F.col("ts") > 6 * 3600).alias("stuck"), F.count_if(F.lit(now_s) - F.col("ts") > 86400).alias("alarm"))
    return p.join(F.broadcast(q), F.lit(True))


def deliverable_status(files: DataFrame) -> DataFrame:
    return files.groupBy("slug").agg(F.round(F.sum("bytes") / 1048576, 1).alias("mb"), F.count("*").alias("segments"))


def glossary_flatten(groups: DataFrame) -> DataFrame:
    """groups(ord, en, zh): later groups win; longest first, then by text, with pos. A glossary is a list that people keep, of some
    thousand terms, so it is numbered in one task."""
    from pyspark.sql import Window

    flat = groups.groupBy("en").agg(F.max_by("zh", "ord").alias("zh"))
    return flat.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.length("en")), "en")))


def token_except(text: Column, other: Column) -> Column:
    """Distinct words of a text that the other one lacks, in order."""
    return F.array_except(F.split(text, " "), F.split(other, " "))


def ordered_distinct(items: Column) -> Column:
    """Items of an array, each at its first place."""
    return F.array_distinct(items)


def coverage_intersect(theirs: DataFrame, ours: DataFrame, key: str = "id") -> DataFrame:
    """Distinct keys that both have."""
    return theirs.select(key).intersect(ours.select(key))
