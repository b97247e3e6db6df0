"""Toxicity by non-negative positive-unlabelled learning over words."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Confirmed toxic documents, and unlabelled ones, that the classifier is learnt from, at most.
POSITIVES, UNLABELLED = 4000, 12000
#: Documents of the sample for each term that the classifier weighs, and those that a term must occur in.
DOCS_A_TERM, LEAST_DOCS = 40, 6
#: Standard errors by which a term's share among positives must exceed its share among unlabelled texts.
LEAST_CONTRAST = 4.5
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text, and the first four letters of longer ones (marked ^)."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {"^" + w[:4] for w in words if len(w) > 4}


@dataclass(frozen=True)
class ToxicityModel:
    weight: dict[str, float]
    bias: float

    def score(self, texts: list) -> np.ndarray:
        known = self.weight.keys()
        z = [self.bias + sum(self.weight[t] for t in known & terms_of(x)) for x in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def nn_pu_gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float, against: float = 0.2) -> np.ndarray:
    """Gradient of the non-negative PU risk with logistic loss. p, u: rows of positives and of unlabelled texts.

    Risk: prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]). Where the second part, the risk on negatives
    corrected by the class prior, is below zero, the step goes against it instead, `against` times as far, so that it
    can't be overfitted."""
    fp, fu = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    on_positives = prior * (p.T @ (sp - 1)) / len(p)
    negative_risk = np.log1p(np.exp(fu)).mean() - prior * np.log1p(np.exp(fp)).mean()
    on_negatives = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
    return on_positives + on_negatives if negative_risk >= 0 else -against * on_negatives


def fit_toxicity(
    chosen: list[str], share: list[float], positives: list[list[int]], unlabelled: list[list[int]], prior: float,
    models: int = 2, steps: int = 1200, decay: float = 1e-6, seed: int = 11,
) -> ToxicityModel:
    """Classifiers of different seeds, averaged. chosen: the terms; share: the share of the texts that have each;
    positives, unlabelled: the places of each text's terms among the chosen. Without positives or terms, or with a
    prior of 0, every text scores 0."""
    if not positives or not unlabelled or not chosen or prior <= 0:
        return ToxicityModel({}, -30.0)
    n_p, n_u = len(positives), len(unlabelled)
    rarity = np.array([*(np.log(1 + 1 / s) for s in share), 1.0], np.float32)

    def rows(texts: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(texts), len(chosen) + 1), np.float32)
        x[:, -1] = 1
        for i, places in enumerate(texts):
            x[i, places] = 1
        return x * rarity

    p, u = rows(positives), rows(unlabelled)
    total = np.zeros(len(chosen) + 1)
    for k in range(models):
        rng = np.random.default_rng(seed + k)
        w = np.zeros(len(chosen) + 1)
        w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 5.0
        m, v, mean = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            g = nn_pu_gradient(p[rng.integers(0, n_p, 1024)], u[rng.integers(0, n_u, 3072)], w, prior)
            g[:-1] += decay * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w[:-1] = np.maximum(w[:-1], 0)  # a term is evidence of toxicity or none
            if t > steps // 2:
                mean += w / (steps - steps // 2)
        total += rarity * mean / models
    return ToxicityModel({t: float(total[i]) for i, t in enumerate(chosen)}, float(total[-1]))


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    terms: int | None = None,
    contrast: float = LEAST_CONTRAST,
    least_docs: int = LEAST_DOCS,
) -> ToxicityModel:
    """Learn from at most `positives` documents labelled toxic and `unlabelled` documents of any kind, all outside
    fold 0; of the texts of one doc_id, the least counts. The model sees the `terms` terms whose share among positives is most
    above that among unlabelled texts, by `contrast` standard errors or more, and which `least_docs` of them have: of rarer or less
    telling terms it knows nothing, so that texts without any of them score by the bias alone. terms: None takes one for each
    DOCS_A_TERM documents that the sample may have, so that the list grows with the sample's bounds. prior: the share of toxic documents; None takes the share among the labels outside that fold. Labels of
    0 are used for nothing else."""
    ours = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (common.fold("doc_id") != 0))
    if prior is None:
        prior = ours.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    toxic = ours.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (common.fold("doc_id") != 0))
    some = ids.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(unlabelled).distinct()
    chosen = toxic.withColumn("p", F.lit(1)).unionByName(some.withColumn("p", F.lit(0)))
    marks = chosen.groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    known = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    known = known.groupBy("doc_id").agg(F.first("p").alias("p"), F.first("u").alias("u"), F.min("text").alias("text"))

    def start():
        return lambda texts: {"terms": ["\x00".join(sorted(terms_of(t))) for t in texts]}

    rows = common.cut(common.add_by_text(known.select("doc_id", "p", "u", "text"), start, "text", "terms string"))
    top = contrasting_terms(rows, (positives + unlabelled) // DOCS_A_TERM if terms is None else terms, contrast, least_docs)
    chosen = [r["term"] for r in top]
    listed = F.array(*[F.lit(t) for t in chosen]) if chosen else F.array().cast("array<string>")
    has = F.transform(F.array_intersect(F.split("terms", "\x00"), listed), lambda t: F.array_position(listed, t) - 1)
    got = rows.select("doc_id", "p", "u", has.alias("places")).orderBy("doc_id").collect()
    return fit_toxicity(
        chosen,
        [r["share"] for r in top],
        [r["places"] for r in got if r["p"]],
        [r["places"] for r in got if not r["u"]],
        prior,
    )


def contrasting_terms(rows: DataFrame, most: int, least: float = LEAST_CONTRAST, least_docs: int = LEAST_DOCS) -> list:
    """At most `most` rows (term, share): the terms whose share among the positives of rows(p, u, terms) is most above
    that among the unlabelled, by `least` standard errors or more, and which `least_docs` rows have at least."""
    sizes = rows.agg(F.sum("p").alias("np"), F.sum(1 - F.col("u")).alias("nu")).first()
    n_p, n_u = sizes["np"] or 0, sizes["nu"] or 0
    if not n_p or not n_u:
        return []
    one = rows.select("p", "u", F.explode(F.split("terms", "\x00")).alias("term")).where("term <> ''")
    counts = one.groupBy("term").agg(F.sum("p").alias("a"), F.sum(1 - F.col("u")).alias("b"))
    share = (F.col("a") + F.col("b")) / (n_p + n_u)
    error = F.sqrt((share * (1 - share) + 1e-6) * (1 / n_p + 1 / n_u))
    counts = counts.where(F.col("a") + F.col("b") >= least_docs).withColumn("share", F.least(share, F.lit(1.0)))
    ranked = counts.withColumn("contrast", (F.col("a") / n_p - F.col("b") / n_u) / error)
    ranked = ranked.where(F.col("contrast") >= least).orderBy(F.desc("contrast"), "term").limit(most)
    return ranked.select("term", "share").collect()


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a DOUBLE toxicity score from 0 to 1 of each whole text. Null and empty texts have no terms. Other
    columns pass through; a column of the new name is replaced."""

    def start():
        return lambda texts: {out: model.score(texts)}

    return common.add_by_text(docs, start, text, f"{out} double")


def op1_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their toxicity scores; see learn_toxicity() and score_toxicity()."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id",
        (common.fold("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
