"""Titles without near-equal ones, by an ordered walk within connected groups of candidates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, kept
from .folds import fold_sorted

#: Characters of a title that are compared.
HEAD = 20
OWN = {"__bag", "__node", "__block", "__group", "__all", "__part", "__pos", "__title"}


class KeptTitles:
    """Titles kept so far, in their places, by character: which places hold it."""

    def __init__(self) -> None:
        self.room = 16
        self.held: dict[str, np.ndarray] = {}
        self.heads: list[str] = []
        self.sizes = np.zeros(self.room, np.uint8)

    def put(self, place: int, head: str) -> None:
        """head at a place, in the stead of what is there, or after the last one."""
        if place == len(self.heads):
            self.heads.append("")
            if place >= self.room:
                self.sizes, self.held = np.append(self.sizes, np.zeros(self.room, np.uint8)), {c: np.append(x, np.zeros(self.room, np.uint8)) for c, x in self.held.items()}
                self.room *= 2
        for c in self.heads[place]:
            self.held[c][place] = 0
        for c in head:
            self.held.setdefault(c, np.zeros(self.room, np.uint8))[place] = 1
        self.heads[place], self.sizes[place] = head, len(head)

    def like(self, head: str, threshold: float) -> int:
        """The first place whose title head is as similar to as the threshold: the share of its characters that occur there,
        of the longer one's length; -1 without."""
        n = len(self.heads)
        if not n or not head:
            return -1 if threshold > 0 or not n else 0
        counts = np.zeros(n, np.uint8)
        for c in head:
            if c in self.held:
                counts += self.held[c][:n]
        # The least count that reaches the threshold, by the length of the title kept; no title is like an empty one.
        needed = [next((c for c in range(HEAD + 1) if c / max(len(head), m) >= threshold), HEAD + 1) if m else HEAD + 1 for m in range(HEAD + 1)]
        good = counts >= np.array(needed, np.uint8)[self.sizes[:n]]
        at = int(np.argmax(good))
        return at if good[at] else -1


def bag(title: Column) -> Column:
    """The compared characters of a title, sorted: all that similarity looks at."""
    return F.array_join(F.array_sort(F.split(F.substring(F.coalesce(title, F.lit("")), 1, HEAD), "")), "")


def similar_bags(bags: DataFrame, threshold: float, most_pairs: int) -> tuple[DataFrame, DataFrame]:
    """(links(a, b), whole(block)) of bags(block BIGINT, node, bag): nodes of a block one of which is similar to the other; and blocks
    whose titles have so many characters in common that they are better walked whole.

    At most `misses` characters of a title may be absent from one that it is similar to, so of its rarest ones, misses + 1
    with repeats, at least one is there: those are looked up in an index of all characters of the block's titles, and what
    is found is checked. Blocks with more than `most_pairs` such finds a title are left to the walk, which then has few
    titles to compare with."""
    misses = F.length("bag") - F.ceil(F.lit(threshold) * F.length("bag") - F.lit(1e-9))
    absent = lambda bag, other: F.length(F.call_function("translate", bag, other, F.lit("")))
    chars = bags.select("block", "node", "bag", F.explode(F.array_distinct(F.split("bag", ""))).alias("char")).where("char <> ''")
    often = chars.groupBy("block", "char").agg(F.count("*").alias("often"))
    rare = F.sort_array(F.collect_list(F.struct("often", "char", (F.length("bag") - absent(F.col("bag"), F.col("char"))).alias("n"))))
    sorted_ = chars.join(often, ["block", "char"]).groupBy("block", "node", "bag").agg(rare.alias("r"))
    seen = lambda i: F.aggregate(F.slice("r", 1, i), F.lit(0), lambda a, x: a + x["n"])
    marked = F.transform("r", lambda x, i: F.struct(x["char"].alias("char"), (seen(i) <= misses).alias("rare")))
    index = kept(sorted_.select("block", "node", "bag", F.inline(marked)))
    # What the look-ups will find, by block.
    finds = index.groupBy("block", "char").agg(F.count_if("rare").alias("asked"), F.count("*").alias("held")).groupBy("block").agg(F.sum(F.col("asked") * F.col("held")).alias("finds"))
    sizes = bags.groupBy("block").agg(F.count("*").alias("n"))
    whole = kept(finds.join(sizes, "block").where(F.col("finds") > most_pairs * F.col("n")).select("block"))
    some = index.join(whole, "block", "left_anti")
    a = some.where("rare").select(F.col("block").alias("ab"), F.col("char").alias("ac"), F.col("node").alias("a"), F.col("bag").alias("x"))
    b = some.select("block", "char", F.col("node").alias("b"), F.col("bag").alias("y"))
    near = (F.length("x") - absent(F.col("x"), F.col("y"))) / F.greatest(F.length("x"), F.length("y")) >= threshold
    on = (F.col("ab") == F.col("block")) & (F.col("ac") == F.col("char")) & (F.col("a") != F.col("b")) & (F.length("y") * threshold <= F.length("x") + 1e-9)
    return a.join(b, on).where(near).select("a", "b").distinct(), whole


def dedup_titles(cands: DataFrame, threshold: float = 0.6, most_pairs: int = 200) -> DataFrame:
    """cands(block, pos, title, has_url, duration) without titles like an earlier one of their block, with their place: in
    order, a title as similar as the threshold to one that is kept takes its place if it is better (a link counts 1, a second
    1/10000), else goes. Similarity looks at the first 20 characters; null and empty titles are like no other. Of rows with one
    pos, the title decides.

    Titles that no chain of similar ones links do not meet, so the walk is made by connected group of candidates; see
    similar_bags(). A group's rows pass in order, and only the titles kept are in memory, by character. Titles of the same
    characters are one candidate."""
    taken = {c.lower() for c in cands.columns}
    if taken & {"place", *OWN}:
        cands = cands.select(*[f"`{c}`" for c in cands.columns if c.lower() not in {"place", *OWN}])
    # Blocks and nodes go by hashes: what equal ones put into one group does no harm.
    rows = cands.withColumn("__bag", bag(F.col("title"))).withColumn("__node", F.xxhash64("block", "__bag")).withColumn("__block", F.xxhash64("block"))
    if threshold > 0:
        bags = rows.where("__bag <> ''").select(F.col("__block").alias("block"), F.col("__node").alias("node"), F.col("__bag").alias("bag")).distinct()
        links, whole = similar_bags(bags, threshold, most_pairs)
        part = components(links).withColumnsRenamed({"node": "__node", "part": "__group"})
        whole = whole.select(F.col("block").alias("__block"), F.lit(True).alias("__all"))
        rows = rows.join(part, "__node", "left").join(whole, "__block", "left")
        rows = rows.withColumn("__part", F.when(F.col("__all"), F.lit(0)).otherwise(F.coalesce("__group", "__node")))
    else:
        rows = rows.withColumn("__part", F.lit(0).cast("bigint"))
    own = [f for f in cands.schema if f.name != "block"]
    at = {f.name: i for i, f in enumerate(own)}

    def walk(found: Iterator[tuple]) -> Iterable[tuple]:
        titles, best, worth, made = KeptTitles(), [], [], []
        for row in found:
            head = (row[at["title"]] or "")[:HEAD]
            value = int(row[at["has_url"]] or 0) + (row[at["duration"]] or 0) / 10000
            place = titles.like(head, threshold)
            if place < 0:
                place = len(best)
                best.append(row)
                worth.append(value)
                made.append((row[at["pos"]], row[at["title"]]))
            elif value > worth[place]:
                best[place], worth[place] = row, value
            else:
                continue
            titles.put(place, head)
        for row, (pos, title) in zip(best, made, strict=True):
            yield *row, pos, title

    schema = T.StructType([*own, T.StructField("__pos", cands.schema["pos"].dataType), T.StructField("__title", T.StringType())])
    walked = fold_sorted(rows.select("block", "__part", *[f"`{f.name}`" for f in own]), ["block", "__part"], ["pos", "title"], walk, schema)
    place = F.row_number().over(Window.partitionBy("block").orderBy("__pos", "__title")) - 1
    return walked.withColumn("place", place.cast("bigint")).select(*[f"`{c}`" for c in cands.columns], "place")
