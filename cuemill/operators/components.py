"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.sources.files import shared_folder


def kept(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """(node, part) of links(a, b), part being the least node that can be reached; nodes without links to others are not listed.

    Each round, every node takes the least label among its own and its neighbours', and then the label of that label, until no
    label changes: about as many rounds as the logarithm of the longest chain. Rounds are checkpointed; one number a round
    reaches the driver."""
    both = kept(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("part")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("part").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", F.col("part").alias("was"), F.least("part", "near").alias("part"))
        jump = lower.select(F.col("node").alias("part"), F.col("part").alias("beyond"))
        now = kept(lower.join(jump, "part", "left").select("node", "was", F.coalesce("beyond", "part").alias("part")))
        labels = now.select("node", "part")
        if not now.where("part <> was").limit(1).count():
            return labels
