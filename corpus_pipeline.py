"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Rows without a doc_id or text, repeated rows and further columns go through all stages. Each stage says what it does with
them; columns of any name are kept but for the last stage, and an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import common, mixing_tree, packing_hist, quality_rank, simhash_dedup, toxicity_pu


def _as_documents(scored: DataFrame, docs: DataFrame) -> DataFrame:
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking keeps; columns as before. Null and empty texts are scored as texts without words, and
    rows that are alike score alike."""
    ranking = quality_rank.learn_quality(docs, common.table(spark, sf_dir, "labels"))
    score = common.hidden_name(docs, "quality")
    kept = quality_rank.score_quality(docs, ranking, out=score).where(F.col(score) >= ranking.threshold)
    return _as_documents(kept, docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not take for toxic; columns as before. Null and empty texts hold no evidence
    of toxicity and stay; rows that are alike score alike."""
    model = toxicity_pu.learn_toxicity(docs, common.table(spark, sf_dir, "labels"))
    score = common.hidden_name(docs, "toxicity")
    return _as_documents(toxicity_pu.score_toxicity(docs, model, out=score).where(F.col(score) < 0.5), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each SimHash component; columns as before. Empty texts and nulls are one group; rows
    without a doc_id stay, and so do all rows that repeat the id that stays."""
    return simhash_dedup.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, by output shard; columns as before. Null texts have size 0, null sources are
    a source; rows that are alike are drawn alike."""
    return mixing_tree.mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences of the mix, by shard and place, with their ids and the lists of their pieces. Null and empty texts
    are one id; each row of the mix is packed, repeated ones too."""
    return packing_hist.pack_sequences(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learnt models, hashes of shingles and tokenizers are beyond SQL: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents. Between stages the rows are kept in the shared checkpoint folder."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
