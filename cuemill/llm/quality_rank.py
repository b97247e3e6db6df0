"""Quality by Bradley-Terry ranking: document scores from preference pairs, cut at a score quantile."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that the ranking is learnt from, at most.
SAMPLE_PER_CLASS = 4000
#: Preference pairs drawn from them.
PAIRS = 60000
FEATURES = 22
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s.,;:!?'\"()-]")


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: sizes, shares of kinds of characters, repetition of words and lines, and how well it
    can be compressed."""
    text = text or ""
    words = text.split()
    n, w = len(text), len(words)
    if not w:
        return np.zeros(FEATURES)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    marks = len(_MARKS.findall(text))
    letters = _LETTERS.findall(text)
    letter_count = sum(map(len, letters))
    stops = text.count(".") + text.count("!") + text.count("?")
    same = sum(map(str.__eq__, words, words[1:]))
    raw = text.encode("utf-8", "replace")
    packed = len(zlib.compress(raw, 1)) / len(raw)
    return np.array(
        [
            1.0,
            np.log1p(w),
            np.log1p(n) - np.log1p(w),
            len(counts) / w,
            np.log1p(len(counts)),
            marks / n,
            np.log1p(marks),
            marks / w,
            letter_count / n,
            len(_CAPITALS.findall(text)) / n,
            len(_DIGITS.findall(text)) / n,
            stops / w,
            np.log1p(stops),
            (text.count(",") + text.count(";")) / w,
            same / w,
            max(counts.values()) / w,
            len(lines) / w,
            len(set(lines)) / max(1, len(lines)),
            packed,
            min(packed, 0.2),
            len(letters) / w,
            np.log1p(max(map(len, counts))),
        ]
    )


def _features_of(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, FEATURES)


@dataclass(frozen=True)
class Ranking:
    """Weights over standardised features; a raw score at or over `cut` is kept. Probabilities are `threshold` there."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.mean) / self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _expand(z: np.ndarray) -> np.ndarray:
    """Features and their squares, both held within bounds."""
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z / 3])


def fit_ranking(x: np.ndarray, y: np.ndarray, threshold: float, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Learn from labelled rows: each pair prefers a row of label 1 to a row of label 0, with logistic loss on the
    difference of their features (Bradley-Terry). The cut is the quantile of the scores that tells the labels apart
    best by balanced accuracy. Without rows of both labels every text gets one score, at the threshold or over."""
    if not len(x) or y.min() == y.max():
        keep = 1.0 if not len(y) or y.max() else -1.0
        return Ranking(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(2 * FEATURES), -keep, 1.0, threshold)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = _expand((x - mean) / scale)
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = np.zeros(z.shape[1]), 0.0, 0.0
    for t in range(1, 1201):
        part = d[rng.integers(0, pairs, 2048)]
        g = -(part / (1 + np.exp(np.clip(part @ w, -30, 30)))[:, None]).mean(0) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (1 - t / 1300) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    raw = z @ w
    levels = np.quantile(raw, np.linspace(0, 1, 401))
    sides = np.array([(raw[good] >= c).mean() + (raw[bad] < c).mean() for c in levels])
    best = np.nonzero(sides >= sides.max() - 1e-9)[0]
    cut = levels[best].mean()
    slope = 4.0 / (np.median(raw[good]) - np.median(raw[bad]) + 1e-9)
    return Ranking(mean, scale, w, float(cut), float(max(slope, 1e-3)), threshold)


def learn_quality(
    docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = 0.3
) -> Ranking:
    """The ranking learnt from at most per_class documents of each label outside fold 0; of the texts of one doc_id, the
    least counts. Only their features come to
    the driver: 2 * per_class rows of FEATURES numbers at most."""
    chosen = common.labelled_sample(labels, "quality", per_class)
    known = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    known = known.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))

    def start():
        return lambda texts: {"x": [row.tolist() for row in _features_of(texts)]}

    rows = common.add_by_text(known.select("label", "text", "doc_id"), start, "text", "x array<double>")
    got = rows.select("doc_id", "label", "x").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist()).reshape(-1, FEATURES)
    return fit_ranking(x, got["label"].to_numpy(), threshold)


def score_quality(docs: DataFrame, ranking: Ranking, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a DOUBLE quality score from 0 to 1 of each whole text. Null and empty texts count as texts without
    words. Other columns pass through; a column of the new name is replaced."""

    def start():
        return lambda texts: {out: ranking.score(_features_of(texts))}

    return common.add_by_text(docs, start, text, f"{out} double")


def op5_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their quality scores; see learn_quality() and score_quality()."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = learn_quality(docs, common.table(spark, sf_dir, "labels"))
    scored = score_quality(docs, ranking)
    return scored.select(
        "doc_id",
        (common.fold("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= ranking.threshold).cast("int").alias("predicted"),
    )
