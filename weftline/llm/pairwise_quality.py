"""Quality scores by Bradley-Terry ranking on preference pairs.

A pair (better, worse) is a labelled good and a labelled bad text. The probability that
the first is preferred is the logistic of the difference of their scores, scores are
linear in text statistics and their squares, and the weights minimise the logistic loss
on feature differences with a ridge. The decision threshold is a quantile of the scores
of the training rows, the one of best balanced accuracy; scores are carried to 0..1 by a
logistic curve that passes the threshold at ``DECIDE``.

The model is fitted on at most ``MAX_TRAIN`` labelled rows outside the held-out fold
(those with the smallest id hash), a documented bound, and on ``MAX_PAIRS`` pairs of them
drawn with replacement, or as many as there are; every document is scored whole.

Defined results: a null text is scored as the empty one; without labels of both kinds
every document scores 1; a score at the threshold is accepted; rows that repeat an id are
scored each by its own text and of those in training one is learnt from; long texts are
read whole; an empty table gives an empty result; other columns (language, source, ids)
are never inputs, and ``keep_good`` returns them whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, held_out, labelled_sample
from weftline.llm.features import QUALITY_NAMES, quality_features

MAX_TRAIN = 8_000
MAX_PAIRS = 40_000
DECIDE = 0.3


@dataclass
class RankModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    fitted: bool = True

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z / 3])

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.ones(len(x))
        at = self.slope * (self.rank(x) - self.threshold) + np.log(DECIDE / (1 - DECIDE))
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def fit_rank(x: np.ndarray, y: np.ndarray, seed: int = 7, ridge: float = 1e-3) -> RankModel:
    """Newton's method on the pairwise logistic loss."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(1), np.ones(1))
    model = RankModel(mean, scale, np.zeros(1), 0.0, 1.0, fitted=False)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(seed)
    n = min(MAX_PAIRS, len(good) * len(bad))
    z = model.design(x)
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(diff.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (p - 1) / n + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # the quantile of best balanced accuracy; the middle of the gap it falls in
    q = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
    acc = np.array([(s[good] >= t).mean() + (s[bad] < t).mean() for t in q])
    best = np.flatnonzero(acc >= acc.max() - 1e-12)
    t = q[best[0]]
    below, above = s[s < t], s[s >= t]
    t = (below.max() + above.min()) / 2 if len(below) and len(above) else t
    spread = max(1e-6, float(np.median(s[good]) - np.median(s[bad])))
    return RankModel(mean, scale, w, float(t), 6.0 / spread)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN) -> RankModel:
    rows = labelled_sample(docs, labels, label, max_rows)

    def extract(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["label"], "x": [quality_features(t) for t in b["text"]]})

    got = rows.mapInPandas(extract, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    return fit_rank(np.array(got["x"].tolist()).reshape(len(got), len(QUALITY_NAMES)), got["y"].to_numpy())


def score_column(model: RankModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([quality_features(t) for t in texts]))) if len(texts) else pd.Series([], dtype="float64")

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document, no shuffle of texts."""
    model = train_quality(docs, labels)
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= DECIDE).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the model accepts."""
    model = train_quality(docs, labels)
    score = fresh(docs.columns, "_weft_score")
    return docs.withColumn(score, score_column(model, F.col("text"))).where(F.col(score) >= DECIDE).drop(score)
